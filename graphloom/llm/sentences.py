"""Problem 1: sentence boundaries across languages and scripts.

Document-centred disambiguation. A full stop is ambiguous where it follows a token that may be an
abbreviation or an ordinal; exclamation and question marks are ambiguous inside proper names. What a
token is comes from its unambiguous occurrences: before a lower-case word or a comma no sentence can
end, at the end of a block one must, and before an opening function word one nearly always does. The
occurrences in the same document count first, those in the whole corpus are the fallback. Tokens are
told apart by the kind of word before them ("on St. X Lane" and "on X St."). Scripts without spaces
or full stops have their own terminators; Thai ends sentences with spaces. A document that has no danda ends Devanagari sentences with
full stops; in one written in small letters throughout, a small letter tells nothing and the tokens' evidence decides.

Plan: one pass gives (page, token, counts); a partial aggregate over tokens gives the corpus
evidence; tokens whose evidence changes a decision go back to their pages by a join that splits hot
tokens; a second pass cuts the texts. No table of tokens is broadcast or collected.

Defined cases: null, empty and blank texts and rows without an id give no row; a text without terminators is one sentence a
block; rows that repeat a page_id with the same text give its sentences once; other columns are
ignored. Unmatched quote marks and brackets are ordinary characters. A heading is a line between
``=`` marks, or behind ``#`` marks, or a block of its own between empty lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.skew import hot_join
from graphloom.sources.tables import spread

#: Words that open sentences and aren't names; fixed values of the method.
OPENERS = frozenset(
    """the a an it its in on at by he she they we you this that these those there who what when where why how
    no not to from for as after before if her his some fans nobody did see version write even and but
    der die das den dem ein eine es im in am er sie wir für vgl was wer ohne niemand erst
    le la les un une il elle on ce cette dans sans pour vers voir depuis pourquoi qui quelle où
    el los las una se según desde hay qué quién véase sin nadie para
    в на и он она это кто что какой где как если
    ο η το οι τα στο στη ποιος πού γιατί""".split()
)
#: Ordinals of German dates and the like follow these words.
ORDINAL_AFTER = frozenset("am im vom zum zur der die das den dem des beim seit bis ab jeder jedem ins ans".split())
#: Titles and the like that a name or number follows; the last fallback, for a corpus too small to tell.
TITLES = frozenset("Dr Prof Mr Mrs Ms Mt Gen Lt Sgt Capt No Nr Vol Fig Abb Art Kap Hr Fa Vgl vgl Sr Sra Dra Dña Cía Av núm pág cap vol fig cf pp".split())
#: Speech verbs by which a clause after a quotation belongs to it, for scripts without letter case.
SPEECH = {"zh": "喊道|说道|问道|叫道|答道|说|问|喊", "hi": "चिल्लाया|चिल्लाई|चिल्लाए|कहा|पूछा|बोला|बोली|बोले"}
_SPEECH = {k: re.compile(v) for k, v in SPEECH.items()}
#: Particles that tie a Japanese quotation to what follows.
_TIED = re.compile("と|って|は|が|を|に|の|で|も|へ|や|から|など|だ|です")

STRONG = "。！？｡।॥؟۔։።၊။។᠃‼⁇⁈⁉།༎"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "【": "】", "‘": "’", "‹": "›", "{": "}"}
BRACKETS = "（([【{"
_CLOSERS = "”“»」』》〉）)]】’›}\"'"
_OPENERS = "“„«「『《〈（([【‘‹\"'¿¡{"
_STOPS = frozenset(_OPENERS + "…。！？।」』》）”»")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*|[ \x0c]\s*")
_HEADING = re.compile(r"^[^\S\n]*(?:=+[^\n]*[^=\s][^\n]*=+|#{1,6}[^\S\n][^\n]+)[^\S\n]*$", re.M)
_MARK = re.compile(r"[.!?…;" + STRONG + r"]+")
_SHAD = re.compile(r"[^\S\n]*[།༎]")
_LATIN_END = re.compile(r"[^\W\d_][\w]*$")
_WORD = re.compile(r"[^\W\d_]+")
_INNER = re.compile(r"(?:[^\W\d_]{1,4}\.-?)*[^\W\d_]|(?:[^\W\d_]{1,4}\.)+[^\W\d_]{1,4}")


def script(c: str) -> str:
    """The script of a character as far as the rules need it."""
    o = ord(c)
    if o < 0x370:
        return "la"
    if o < 0x400 or 0x1F00 <= o < 0x2000:
        return "el"
    if o < 0x530:
        return "cy"
    if 0x600 <= o < 0x780:
        return "ar"
    if 0x900 <= o < 0x980:
        return "hi"
    if 0xE00 <= o < 0xE80:
        return "th"
    if 0x3040 <= o < 0x3100 or o == 0x30FC:
        return "ja"
    if 0x3400 <= o < 0xA000 or 0x20000 <= o < 0x33480:
        return "zh"
    if 0x1100 <= o < 0x1200 or 0x3130 <= o < 0x3190 or 0xAC00 <= o < 0xD7B0:
        return "ko"
    return "xx"


def blocks(text: str) -> list[tuple[int, int]]:
    """The parts of a text that no sentence crosses: paragraphs between empty lines, headings."""
    out, at = [], 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        cut = at
        for h in _HEADING.finditer(part):
            out += [(cut, at + h.start()), (at + h.start(), at + h.end())]
            cut = at + h.end()
        out.append((cut, end))
        at = m.end() if m else end
    return [(a, b) for a, b in out if text[a:b].strip()]


def _pairs(s: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Outermost matched quotations and brackets (open, close); close -> open of all matched ones."""
    stack: list[tuple[str, int]] = []
    closed: dict[int, int] = {}
    n = len(s)
    for m in _QUOTES.finditer(s):
        i, c = m.start(), m.group()
        if c in "’'" and 0 < i < n - 1 and s[i - 1].isalnum() and s[i + 1].isalnum():
            continue  # an apostrophe
        if c == '"' and i and s[i - 1].isdigit() and all(o != '"' for o, _ in stack):
            continue  # inches
        for k in range(len(stack) - 1, -1, -1):
            o, j = stack[k]
            if (c == '"' and o == '"') or (c != '"' and c in PAIRS.get(o, "")):
                closed[i] = j
                del stack[k:]
                break
        else:
            if c in PAIRS or c == '"':
                stack.append((c, i))
    outer: list[tuple[int, int]] = []
    for close, o in sorted(closed.items(), key=lambda x: x[1]):
        if not outer or o > outer[-1][1]:
            outer.append((o, close))
    return outer, closed


_QUOTES = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values()) + '"') + "]")


def _token(s: str, i: int, floor: int = 0) -> tuple[str, str]:
    """The token that ends before i, and the kind of what stands before it."""
    j = i
    while j > floor and not s[j - 1].isspace() and s[j - 1] not in _STOPS:
        if s[j - 1] in ".!?" and j < i and s[j].isupper() and s[max(floor, j - 4) : j - 1].isalpha() and s[max(floor, j - 4) : j - 1].islower() and j - 4 >= floor:
            break  # a full stop without the space behind it
        j -= 1
    t = s[j:i]
    k = j
    while k > floor and s[k - 1].isspace():
        k -= 1
    if k <= floor:
        return t, "^"
    if j > 0 and k == j and s[j - 1] in _OPENERS:
        return t, "p"
    p = s[k - 1]
    if p == ".":
        w, _ = _token(s, k - 1, floor)
        if len(w) == 1 and w.isalpha():
            return t, "." + w  # t. д., z. B., p. ej.
        return t, "."
    if p.isdigit():
        return t, "9"
    if p.isalpha():
        w = k
        while w > floor and (s[w - 1].isalnum() or s[w - 1] in "-'’"):
            w -= 1
        if t.isdigit():
            return t, s[w:k].lower()
        return t, "A" if s[w].isupper() else "a"
    return t, "p"


class _Candidate:
    __slots__ = ("end", "fact", "key", "mark", "next", "quote", "start", "token")


def _key(token: str, before: str, mark: str) -> str:
    if token.isdigit():
        return f"{min(len(token), 3)}#{mark}|{before}"
    return f"{token}{mark}|{before}"


def scan(s: str) -> Iterator[tuple[int, int, str, str, int]]:
    """(mark start, end behind closing marks, token, kind before, open of a quotation that ends here or -1) of each possible end in a block."""
    outer, _ = _pairs(s)
    k = 0
    for m in _MARK.finditer(s):
        i, e = m.start(), m.end()
        while k < len(outer) and outer[k][1] < i:
            k += 1
        opened = -1
        if k < len(outer) and outer[k][0] < i:
            # inside a quotation: an end only if just the closing mark follows
            j = e
            while j < len(s) and (s[j].isspace() or s[j] in _CLOSERS) and j < outer[k][1]:
                j += 1
            if j != outer[k][1]:
                continue
            e, opened = j + 1, outer[k][0]
        while e < len(s) and s[e] in _CLOSERS and not (s[e] in "“\"'" and e + 1 < len(s) and s[e + 1].isalnum()):
            if s[e] in "“" and not (k < len(outer) and outer[k][1] == e):
                break
            e += 1
        if s[i] in "།༎":
            while (m := _SHAD.match(s, e)) is not None:
                e = m.end()
        token, before = _token(s, i)
        yield i, e, token, before, opened


def _after(s: str, e: int) -> tuple[bool, str, int]:
    """Whether white space follows e, the first character of what follows, its place."""
    j = e
    while j < len(s) and s[j].isspace():
        j += 1
    return j > e, s[j] if j < len(s) else "", j


def _first_letter(s: str, j: int) -> int:
    while j < len(s) and (s[j] in _OPENERS or s[j].isspace()):
        j += 1
    return j


def small(text: str) -> bool:
    """Whether the document is written in small letters throughout, so that their case tells nothing."""
    if text != text.lower():
        return False
    n = sum(c.islower() for c in text)
    return n >= 20 and 2 * n >= sum(c.isalpha() for c in text)


def fact(s: str, i: int, e: int, small: bool = False) -> str:
    """What follows a mark unambiguously: e(nd), l(ower case or a comma), o(pening word), d(igit), u(pper case), x (else)."""
    space, c, j = _after(s, e)
    if not c:
        return "e"
    if c in ",;:)]-–—%" or c.islower() and not small:
        return "l"
    if small and c.islower():
        m = _WORD.match(s, j)
        return "o" if m and len(m.group()) > 1 and m.group() in OPENERS and s[m.end() : m.end() + 1] != "." else "u"
    j = _first_letter(s, j)
    if j >= len(s):
        return "e"
    if s[j].isdigit():
        return "d"
    if s[j].isupper():
        m = _WORD.match(s, j)
        return "o" if m and m.group().lower() in OPENERS and (len(m.group()) > 1 or m.group() in "AВИОΟΗ") and s[m.end() : m.end() + 1] != "." else "u"
    return "x"


#: Not a token: the key under which a document says that it is written in small letters.
SMALL = "\0small"
Evidence = dict[str, tuple[int, int, int]]  # key -> all, with an end, without


def evidence(text: str) -> dict[str, list[int]]:
    """key -> [occurrences, ends seen (block ends, opening words), non-ends seen] of a document."""
    out: dict[str, list[int]] = {}
    lower = small(text)
    for a, b in blocks(text):
        s = text[a:b].rstrip()
        for i, e, token, before, _ in scan(s):
            mark = s[i]
            if mark not in ".!?" or not token or s[i : i + 2] == "..":
                continue
            f = fact(s, i, e, lower)
            for key in (_key(token, before, mark), _key(token, "*", mark)):
                x = out.setdefault(key, [0, 0, 0])
                x[0] += 1
                x[1] += f in "eo"
                x[2] += f == "l"
    return out


ABBREVIATION, CAN_END = 1, 2
#: Tokens for which evidence of an end counts too: single letters and those with inner full stops.
_INNER_KEY = r"^(?:[^\W\d_]|\S*\.\S*)\.\|"
#: Occurrences from which a token never seen at an end counts as one that doesn't end sentences.
NEVER = 10


def verdict(n: int, ends: int, non_ends: int) -> int:
    """What the evidence of a token says: bit 1, it is an abbreviation; bit 2, it can end a sentence."""
    abbreviation = non_ends >= 2 and non_ends >= 0.05 * n or ends == 0 and n >= NEVER or ends <= 0.02 * n and n >= 5 * NEVER
    return ABBREVIATION * abbreviation + CAN_END * (ends >= 1 and ends >= 0.03 * n)


def _seen(known: dict[str, int], token: str, before: str, mark: str) -> int:
    """The verdict on a token here; one that never ends sentences anywhere doesn't behind an unusual word either."""
    seen = known.get(_key(token, before, mark))
    if seen is None and known.get(_key(token, "*", mark)) == ABBREVIATION:
        return ABBREVIATION
    if seen is None and mark == "." and token in TITLES:
        return ABBREVIATION
    return seen or 0


def _is_end(s: str, start: int, i: int, e: int, token: str, before: str, opened: int, known: dict[str, int]) -> bool:
    """Whether the possible end at [i, e) of block s, in the sentence that began at start, is one."""
    mark, run = s[i], s[i:e]
    space, c, j = _after(s, e)
    if not c:
        return True
    prev = s[i - 1] if i else " "
    p = i
    while p > 0 and (s[p - 1].isspace() or s[p - 1] in _CLOSERS):
        p -= 1
    before_script = script(s[p - 1]) if p else "la"
    if c in ",;:%،；：、，)" or c in "-–—" and (not space or opened >= 0):
        return False
    k = _first_letter(s, j)
    first = s[k] if k < len(s) else c
    cased = first.isupper() or first.islower()
    if first.islower() and not known.get(SMALL):
        return False
    marks = s[i : i + len(_MARK.match(s, i).group())]
    ellipsis = marks.startswith(("…", "..."))
    if opened >= 0:
        o = s[opened]
        if o in "《〈":
            return False
        at_start = not s[start:opened].strip()
        if o in BRACKETS:
            return at_start
        if script(first) in ("ja", "zh", "ko", "hi", "th") and not first.isdigit():
            if o in "「『":
                return not _TIED.match(s, e)
            if script(first) == "ko" and not space:
                return False
            if script(first) in _SPEECH and at_start:
                m = re.search(r"[。！？।，,]", s[e:])
                clause = s[e : e + m.start()] if m else s[e:]
                if _SPEECH[script(first)].search(clause) and len(clause) <= 60:
                    return False
            return True
        return space or first.isupper() or first.isdigit()
    if any(x in STRONG for x in marks):
        return True
    if ellipsis:
        if cased or first.isdigit():
            return space or before_script in ("la", "cy", "el") and first.isupper()
        return before_script in ("la", "cy", "el") and script(first) not in ("la", "cy", "el", "xx")
    if marks[0] == ";":
        return before_script == "el" and (space or first.isupper())
    if mark in "!?":
        seen = _seen(known, token, before, mark)
        if seen & ABBREVIATION and not seen & CAN_END:
            return False
        return space or first.isupper() or not cased and not first.isdigit() and first.isalpha()
    # a full stop
    if before_script == "th" or before_script == "hi" and known.get("।"):
        return False
    if before_script == "hi":  # a document without dandas ends its sentences with full stops
        return len(token) > 2 and (space or first.isalpha()) and _seen(known, token, before, mark) & (ABBREVIATION | CAN_END) != ABBREVIATION
    if before_script == "ar":
        return len(token) > 2 and (space or first.isalpha())
    if before_script == "ko":
        return space or first.isalpha()
    if token.isdigit():
        if first.isdigit() and (space is False or before == "." or re.match(r"\d{1,2}\.(?:\s|$)", s[k:])):
            return False
        if not space and not first.isalpha():
            return False
        if script(first) == "ko" and len(token) <= 2 and before == ".":
            return False
        if len(token) <= 2:
            if before in ORDINAL_AFTER and first.isupper():
                return False
            seen = _seen(known, token, before, mark)
            if seen & ABBREVIATION and not seen & CAN_END:
                return False
        return True
    seen = _seen(known, token, before, mark)
    inner = _INNER.fullmatch(token) is not None
    if len(token) == 1 and (token.isupper() or known.get(SMALL) and token.isalpha()) and first.isalpha() and cased:
        return False  # an initial
    if not space:
        if first.isdigit():
            return len(token) >= 4 and token.isalpha() and token[1:].islower() and not seen & ABBREVIATION
        if cased:
            if not (k + 1 < len(s) and (s[k + 1].islower() or s[k + 1].isspace() or s[j] in _OPENERS)):
                return False
            if inner and not seen & CAN_END:
                return False
        if seen & ABBREVIATION and not seen & CAN_END:
            return False
        return token[-1:].isalnum() or token[-1:] in "%°"
    if seen & ABBREVIATION and not seen & CAN_END:
        return False
    if seen == 0 and inner and not first.isdigit() and before != "9":
        return False
    if seen == 0 and first.isdigit() and len(token) <= 3 and token.isalpha():
        return False
    return True


def _thai_ends(s: str) -> Iterator[int]:
    """Places in block s behind which a space ends a Thai sentence."""
    for m in re.finditer(r"(?<=[฀-๿])\s+(?=\S)", s):
        i, j = m.start(), m.end()
        if s[i - 1] == "ๆ" or s[j].isdigit() or s[j] in ",;:)-–—.":
            continue
        if script(s[j]) == "th":
            nxt = re.match(r"\S+", s[j:]).group()
            if re.match(r"(?:พ|ค|ร|ฮ)\.ศ\.|น\.", nxt) or s[max(0, i - 2) : i] == "ใน":
                continue
        yield i


def split(text: str | None, known: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points; known: verdicts of the corpus by token."""
    if not text or not text.strip():
        return []
    own = evidence(text)
    merged = dict(known)
    merged |= {SMALL: int(small(text)), "।": int("।" in text or "॥" in text)}
    for k, (n, ends, non_ends) in own.items():
        seen = merged.get(k, 0)
        if non_ends and not seen & ABBREVIATION and not ends:
            seen |= ABBREVIATION
        if ends and k not in known and non_ends:
            seen |= CAN_END
        if seen:
            merged[k] = seen
    out: list[tuple[int, int]] = []
    for a, b in blocks(text):
        s = text[a:b]
        if _HEADING.fullmatch(s.strip("\n\r")):
            out.append((a, b))
            continue
        s = s.rstrip()
        start = 0
        ends = [(e, i, token, before, o) for i, e, token, before, o in scan(s)]
        if any("฀" <= c <= "๿" for c in s):
            outer, _ = _pairs(s)
            ends += [(i, -1, "", "", -1) for i in _thai_ends(s) if not any(o < i < c for o, c in outer)]
            ends.sort()
        for e, i, token, before, o in ends:
            if e <= start:
                continue
            if i < 0 or _is_end(s, start, i, e, token, before, o, merged):
                out.append((a + start, a + e))
                start = e
        if s[start:].strip():
            out.append((a + start, a + len(s)))
    trimmed = []
    for x, y in out:
        while x < y and text[x].isspace():
            x += 1
        while y > x and text[y - 1].isspace():
            y -= 1
        if x < y:
            trimmed.append((x, y))
    return trimmed


def _evidence_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(p, k, n, e, x) for p, t in zip(pdf["page_id"], pdf["text"], strict=True) for k, (n, e, x) in evidence(t).items()]
        yield pd.DataFrame(rows, columns=["page_id", "key", "n", "ends", "non_ends"])


def _cut_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for p, t, keys, codes in zip(pdf["page_id"], pdf["text"], pdf["keys"], pdf["codes"], strict=True):
            known = dict(zip(keys, codes, strict=True)) if keys is not None else {}
            rows += [(p, a, b) for a, b in split(t, known)]
        yield pd.DataFrame(rows, columns=["page_id", "sent_start", "sent_end"])


def sentences(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(id, sent_start, sent_end) of every sentence of every text."""
    rows = spread(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(text_col).alias("text")).filter(F.col("page_id").isNotNull() & F.col("text").rlike(r"\S")), "page_id")
    seen = rows.mapInPandas(_evidence_rows, "page_id long, key string, n long, ends long, non_ends long")
    tokens = seen.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "ends", "non_ends")), F.count(F.lit(1)).alias("_rows"))
    abbreviation = ((F.col("non_ends") >= 2) & (F.col("non_ends") >= 0.05 * F.col("n"))) | ((F.col("ends") == 0) & (F.col("n") >= NEVER)) | ((F.col("ends") <= 0.02 * F.col("n")) & (F.col("n") >= 5 * NEVER))
    can_end = (F.col("ends") >= 1) & (F.col("ends") >= 0.03 * F.col("n"))
    tokens = tokens.filter(abbreviation | (can_end & F.col("key").rlike(r"^(?:\p{L}|\S*\.\S*)\.\|"))).select("key", "_rows", (abbreviation.cast("int") * ABBREVIATION + can_end.cast("int") * CAN_END).alias("code"))
    back = hot_join(seen.select("page_id", "key"), tokens, "key", "_rows", F.col("page_id"))
    own = back.distinct().groupBy("page_id").agg(F.collect_list(F.struct("key", "code")).alias("k"))
    joined = rows.join(own, "page_id", "left").select("page_id", "text", F.col("k.key").alias("keys"), F.col("k.code").alias("codes"))
    out = joined.mapInPandas(_cut_rows, "page_id long, sent_start long, sent_end long").distinct()
    return out if id_col == "page_id" else out.withColumnRenamed("page_id", id_col)
