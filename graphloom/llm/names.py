"""Problem 3: variant spellings of names typed by people.

Distinct spellings are parsed into a qualifier (a person's given name, an organisation's kind of
business) and a name proper. The words that serve as qualifiers are learned from the corpus: they stand
beside many different partners. Nicknames come from a fixed table and from spellings that show both
(Hannelore “Hanne” X). Parsed forms are blocked by the phonetic codes of their names proper, as
written and with the parts sorted, each code also with one symbol left out, so that a typo of one
consonant or another order leaves a block in common; forms of a block whose letters, sorted, are near are compared by
Jaro-Winkler and edit distance, the parts in any order. Blocks and entities of many names are split over tasks. Persons whose given name isn't a learned word, however rare, also
meet in blocks of all parts of the name, without the qualifier, where given names are compared as names
are, nicknames having been resolved; two given names a letter apart aren't told from a typo there.
Accepted pairs are clustered by connected components. Forms with an initial or a cut-off given name join
the one cluster that they fit; where they fit several, none.

All work is on distinct spellings: a name repeated a billion times is one row. The learned words are
those beside at least 1/2000 of the distinct spellings, so at most 2000 x 8 words are broadcast, whatever the
corpus. Pairs are made within clusters only. Spellings of any number of words teach.

Defined cases: null and blank texts and other labels have no pairs; a text without letters has none;
a spelling found under both labels is compared within each; repeated rows count once; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.components import connected_components
from graphloom.plans.skew import hot_join
from graphloom.sources.tables import cut, spread

LABELS = ("Person", "Organization")
#: Nicknames and the given names they stand for: fixed values.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert",
    "chris": "christopher", "kit": "christopher", "dora": "dorothy", "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "theodore", "teddy": "theodore", "theo": "theodore",
    "fran": "francesca", "frankie": "francesca", "cesca": "francesca", "fred": "frederick", "freddy": "frederick", "freddie": "frederick", "gabi": "gabriela", "gaby": "gabriela", "hanne": "hannelore", "lore": "hannelore",
    "isi": "isidora", "izzy": "isidora", "dorrie": "isidora", "josie": "josephine", "jo": "josephine", "kate": "katherine", "kath": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine",
    "larry": "lawrence", "laurie": "lawrence", "len": "leonard", "leo": "leonard", "lenny": "leonard", "leon": "leonard", "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "bess": "elizabeth", "eliza": "elizabeth",
    "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "daisy": "margaret", "mina": "wilhelmina", "minnie": "wilhelmina", "willa": "wilhelmina", "nacho": "ignacio", "iggy": "ignacio", "nat": "nathaniel", "nate": "nathaniel",
    "nell": "penelope", "penny": "penelope", "nelly": "penelope", "ollie": "oliver", "noll": "oliver", "roz": "rosalind", "rosie": "rosalind", "sam": "samuel", "sammy": "samuel", "tim": "timothy", "timmy": "timothy", "tori": "victoria", "vicky": "victoria", "vic": "victoria",
    "ulla": "ursula", "ursa": "ursula", "vova": "vladimir", "volodya": "vladimir", "vlad": "vladimir", "will": "william", "bill": "william", "billy": "william", "liam": "william", "zach": "zachary", "zack": "zachary", "zhenya": "yevgenia", "genia": "yevgenia",
    "tom": "thomas", "jim": "james", "jack": "john", "dick": "richard", "rick": "richard", "mike": "michael", "dave": "david", "dan": "daniel", "joe": "joseph", "pete": "peter", "steve": "stephen", "tony": "anthony", "sue": "susan", "jenny": "jennifer", "becky": "rebecca", "andy": "andrew", "matt": "matthew", "nick": "nicholas", "greg": "gregory",
}
#: Titles and legal forms that aren't part of a name: fixed values.
TITLES = frozenset("dr mr mrs ms prof sir dame esq jr sr phd md hon rev".split())
LEGAL = frozenset("ltd limited inc incorporated co company gmbh sa llc plc corp corporation ag kg spa nv bv oy ab the studio studios".split())
_PAIRED = re.compile(r"[“\"«„]\s*([^“”\"«»„]+?)\s*[”\"»“]")
_DOTTED = re.compile(r"\b(?:[^\W\d_]\.\s?){2,}")
PARTNERS = 15
SHARE = 2000
#: Names of a block, and spellings of an entity, from which they are dealt to several tasks.
HOT_NAMES = 5_000


def fold(s: str) -> str:
    """Letters without marks; digits typed for letters put right."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = re.sub(r"(?<=[^\W\d_])0|0(?=[^\W\d_])", "o", s)
    return re.sub(r"(?<=[^\W\d_])1|1(?=[^\W\d_])", "l", s)


def words(text: str, label: str) -> tuple[list[str], int, str, set[str]]:
    """(tokens, number of those before a comma, nickname shown, tokens written with a full stop)."""
    s = re.sub(r"\s+", " ", text).strip()
    dotted = {t.lower() for t in re.findall(r"([^\W_]+)\.", fold(s))}
    if label != "Person":
        s = _DOTTED.sub(lambda m: re.sub(r"[.\s]", "", m.group()) + " ", s)
    s = s.strip(" \t;:!?,._-*'‘’")
    for a, b in (("[[", "]]"), ("(", ")"), ("“", "”"), ('"', '"'), ("«", "»"), ("'", "'"), ("[", "]")):
        if s.startswith(a) and s.endswith(b) and len(s) > len(a) + len(b) and a not in s[len(a) :]:
            s = s[len(a) : len(s) - len(b)].strip(" ;:!?,")
        elif a == b and s.startswith(a) and s.endswith(a) and s.count(a) == 2:
            s = s[1:-1].strip()
    nick = ""
    if label == "Person":
        if m := _PAIRED.search(s):
            nick, s = fold(m.group(1)).lower(), s[: m.start()] + " " + s[m.end() :]
        if re.search(r"\([^)]*\)", s) and re.sub(r"\([^)]*\)", "", s).strip():
            s = re.sub(r"\([^)]*\)", " ", s)
    else:
        s = re.sub(r",?\s*\bthe studio\b", " ", s, flags=re.I)
    s = fold(s)
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s)
    head, comma, tail = s.partition(",")
    drop = TITLES if label == "Person" else LEGAL
    keep = lambda x: [t for t in re.findall(r"[^\W_]+", x.lower()) if t not in drop]
    a, b = keep(head), keep(tail)
    if label != "Person" and any(len(x) > 1 for x in a + b):
        a, b = [x for x in a if len(x) > 1], [x for x in b if len(x) > 1]
    return a + b, len(a) if comma and a and b else 0, nick, dotted


def edits(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours being one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [y for j, y in enumerate(b) if used[j]]
    t = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


_CODES = {c: str(k) for k, cs in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in cs}


def phonetic(word: str, doubled: bool = False) -> str:
    """Consonant classes in order, doubled letters being one unless asked for; vowels don't count. Letters of other scripts stay."""
    out, last = "", ""
    for c in word:
        if doubled or c != last:
            out += _CODES.get(c, "" if c in "aeiouyhw" else c)
        last = c
    return out or "0"


def _left_out(c: str) -> list[str]:
    """A code and each with one symbol left out."""
    return [c, *(c[:i] + c[i + 1 :] for i in range(len(c)))]


def _sorted_codes(parts: list[str]) -> set[str]:
    """The codes of parts, sorted after a symbol is left out, so that neither order nor a typo changes them all."""
    out = set()
    for doubled in (False, True):
        cs = [phonetic(p, doubled) for p in parts]
        out |= {" ".join(sorted([*cs[:i], x, *cs[i + 1 :]])) for i, c in enumerate(cs) for x in _left_out(c)}
    return out


def codes(name: str) -> list[str]:
    """The phonetic codes, doubled letters being one and two, and each with one symbol left out, however short it is; of several parts also in sorted order."""
    parts = name.split()
    whole = "".join(parts)
    return sorted({*_left_out(phonetic(whole)), *_left_out(phonetic(whole, True)), *(_sorted_codes(parts) if len(parts) > 1 else ())})


def _forms(word: str, most: int) -> set[str]:
    """A word with up to ``most`` letters left out."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Vocabulary:
    """Words that serve as qualifiers, by label, and nicknames."""

    def __init__(self, known: dict[str, list[str]], nicknames: dict[str, str]):
        self.known = {k: frozenset(v) for k, v in known.items()}
        self.nick = {k: v for k, v in (NICKNAMES | nicknames).items() if k not in self.known.get("Person", ())}
        self.nearest: dict[tuple[str, str], str] = {}
        self.forms: dict[str, dict[str, list[str]]] = {}

    def near(self, token: str, label: str, most: int) -> set[str]:
        """The known words that may be within ``most`` edits, swaps included: those that share a form with so many letters left out."""
        if label not in self.forms:
            forms = self.forms[label] = {}
            for w in self.known.get(label, ()):
                for f in _forms(w, 2):
                    forms.setdefault(f, []).append(w)
        return {w for f in _forms(token, most) for w in self.forms[label].get(f, ())}

    def resolve(self, token: str, label: str, dotted: bool = False, fuzzy: bool = True) -> str:
        """The qualifier that a token stands for, or nothing."""
        known = self.known.get(label, frozenset())
        if token in known:
            return token
        if label == "Person" and token in self.nick:
            return self.nick[token]
        if dotted and len(token) >= 3:
            fit = self.starting(token, label)
            if len(fit) == 1:
                return fit[0]
        if not fuzzy or len(token) < 4:
            return ""
        if (key := (token, label)) not in self.nearest:
            most = 1 if len(token) < 6 else 2
            best = min(((e, -jaro_winkler(token, w), w) for w in self.near(token, label, most) if (e := edits(token, w, most)) <= most), default=None)
            if len(self.nearest) > 200_000:
                self.nearest.clear()
            self.nearest[key] = best[2] if best and -best[1] >= 0.82 else ""
        return self.nearest[key]

    def starting(self, token: str, label: str) -> list[str]:
        """The qualifiers that begin with a cut-off word."""
        return [w for w in self.known.get(label, ()) if w.startswith(token) and w != token]

    def unglue(self, token: str, label: str) -> list[str]:
        """A token that is a qualifier and a name written together, taken apart."""
        known = self.known.get(label, frozenset())
        for n in range(len(token) - 4, 2, -1):
            if label == "Person" and token[:n] in known:
                return [token[:n], token[n:]]
        for n in range(3, len(token) - 2):
            if token[n:] in known and (n > 3 or token[:n] in known):
                return [*(self.unglue(token[:n], label) if label != "Person" else [token[:n]]), token[n:]]
        return [token]


def parse(text: str, label: str, v: Vocabulary) -> tuple[str, bool, str]:
    """(qualifier, whether it is cut short, name proper); ('', False, '') where there are no letters."""
    q, short, parts = parse_parts(text, label, v)
    return q, short, "".join(parts)


def parse_parts(text: str, label: str, v: Vocabulary) -> tuple[str, bool, list[str]]:
    """``parse`` with the parts of the name proper in written order."""
    tokens, before_comma, _, dotted = words(text, label)
    if not any(len(t) > 1 for t in tokens):
        return "", False, ["".join(tokens)] if tokens else []
    if label != "Person":
        flat: list[str] = []
        for t in tokens:
            flat += [t] if v.resolve(t, label, False, False) else v.unglue(t, label)
        cut_off = [t for t in flat if t in dotted and len(t) >= 3 and v.starting(t, label)]
        if cut_off and len(flat) > len(cut_off):
            return cut_off[-1], True, [t for t in flat if t not in cut_off and not v.resolve(t, label)]
        found = [(t, v.resolve(t, label)) for t in flat]
        if all(q for _, q in found):  # the name itself looks like a kind of business
            found[0] = (found[0][0], "")
        return " ".join(sorted({q for _, q in found if q})), False, [t for t, q in found if not q]
    if sum(len(t) > 1 for t in tokens) == 1 and len(tokens) == 1:
        tokens = v.unglue(tokens[0], label)
        if len(tokens) == 1:
            return "", False, tokens
    order = tokens[before_comma:] + tokens[:before_comma]
    full = [(i, v.resolve(t, label, t in dotted, False)) for i, t in enumerate(order) if len(t) > 1]
    at = next((i for i, q in full if q), None)
    if at is None:
        begun = [i for i, t in enumerate(order) if 3 <= len(t) <= 5 and (t in dotted or before_comma) and v.starting(t, label)]
        if begun and sum(len(t) > 1 for t in order) > 1:
            i = begun[0]
            fit = v.starting(order[i], label)
            name = [t for j, t in enumerate(order) if j != i and len(t) > 1]
            return (fit[0], False, name) if len(fit) == 1 else (order[i], True, name)
    if at is None and not (len(order[0]) == 1 or order[0] in dotted):
        near = [(i, q) for i, t in enumerate(order) if len(t) > 3 and (q := v.resolve(t, label))]
        at = near[0][0] if near else None
    if at is not None:
        q = v.resolve(order[at], label, order[at] in dotted)
        name = [t for i, t in enumerate(order) if i != at and len(t) > 1]
        return (q, False, name) if name else ("", False, [q])
    initials = [t for t in order if len(t) == 1]
    rest = [t for t in order if len(t) > 1]
    if len(rest) == 1:
        return (initials[0], True, rest) if initials else ("", False, rest)
    cut_short = order[0] in dotted or len(order[0]) <= 4 and before_comma > 0
    first = order[0] if len(order[0]) > 1 else initials[0]
    return first, cut_short or len(first) == 1, [t for t in rest if t != first] or [first]


def same_name(a: str, b: str) -> bool:
    """Whether two names proper are spellings of one."""
    if a == b:
        return True
    n = min(len(a), len(b))
    most = 0 if n < 4 else 1 if n < 7 else 2
    return edits(a, b, most) <= most and jaro_winkler(a, b) >= 0.88


def same_parts(a: str, b: str) -> bool:
    """Whether two names proper, with blanks between their parts, are spellings of one in some order of the parts."""
    x, y = a.split(), b.split()
    if same_name("".join(x), "".join(y)):
        return True
    if len(x) != len(y) or len(x) == 1:
        return False
    left, at = list(y), []
    for i, p in enumerate(x):
        if p in left:
            left.remove(p)
        else:
            at.append(i)
    if len(at) > 2:  # same_name allows two edits, so no more parts can differ
        return False
    for order in permutations(left):
        turned = list(x)
        for i, p in zip(at, order, strict=True):
            turned[i] = p
        if same_name("".join(x), "".join(turned)):
            return True
    return False


def _learn(spellings: DataFrame) -> Vocabulary:
    """The words beside many partners, and the nicknames shown beside given names."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for label, text in zip(pdf["label"], pdf["text"], strict=True):
                ws, k, nick, dotted = words(text, label)
                ws = ws[k:] + ws[:k]
                long = [w for w in ws if len(w) > 2]
                if len(long) >= 2:
                    for i, w in enumerate(long):
                        rows.append((label, w, long[(i + 1) % len(long)], i == 0, nick if i == 0 else ""))
                        if len(long) > 2:
                            rows.append((label, w, long[i - 1], i == 0, ""))
            yield pd.DataFrame(rows, columns=["label", "word", "partner", "first", "nick"])

    seen = cut(spellings.mapInPandas(tokens, "label string, word string, partner string, first boolean, nick string"))
    total = F.broadcast(seen.groupBy("label").agg((F.count(F.lit(1)) / SHARE).alias("least")))
    # each partner once a word: hot words are aggregated in two steps, (word, partner) first
    pairs = seen.groupBy("label", "word", "partner").agg(F.max(F.col("first").cast("int")).alias("first"), F.count(F.lit(1)).alias("n"))
    common = (
        pairs.groupBy("label", "word").agg(F.count(F.lit(1)).alias("partners"), F.avg("first").alias("first"), F.sum("n").alias("n")).join(total, "label")
        .filter((F.col("partners") >= PARTNERS) & (F.col("n") >= F.col("least")) & F.when(F.col("label") == "Person", F.col("first") >= 0.6).otherwise(F.col("first") <= 0.6))
        .select("label", "word").collect()
    )
    nicknames = {r["nick"]: r["word"] for r in seen.filter("nick <> ''").groupBy("label", "nick", "word").agg(F.count(F.lit(1)).alias("n")).join(total, "label").filter("n >= 2 and n >= least").orderBy("n", "word").select("nick", "word").collect()}
    known: dict[str, list[str]] = {}
    for r in common:
        known.setdefault(r["label"], []).append(r["word"])
    return Vocabulary(known, {k: w for k, w in nicknames.items() if w in known.get("Person", ())})


def same_person(a: str, b: str) -> bool:
    """Whether two persons' names with all their parts, the given name first, are spellings of one: given names and
    names proper alike, or the parts alike one by one in another order."""
    x, y = a.split(), b.split()
    if same_name(x[0], y[0]) and same_parts(" ".join(x[1:]), " ".join(y[1:])):
        return True

    def fit(x: list[str], y: list[str]) -> bool:
        return not x or any(same_name(x[0], p) and fit(x[1:], y[:i] + y[i + 1 :]) for i, p in enumerate(y))

    return len(x) == len(y) and fit(x, y)


_FORM = "label string, text string, qualifier string, short boolean, name string, codes array<string>, loose array<string>"


def forms(spellings: DataFrame) -> DataFrame:
    """The distinct spellings (label, text) with their parsed forms and phonetic codes.

    ``loose``: codes of all parts of a person's name, for those whose given name isn't a learned one.
    """
    shared = spellings.sparkSession.sparkContext.broadcast(_learn(spellings))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned = shared.value.known.get("Person", frozenset())
        for pdf in batches:
            rows = []
            for label, text in zip(pdf["label"], pdf["text"], strict=True):
                q, short, parts = parse_parts(text, label, shared.value)
                if parts:
                    name = " ".join(parts)
                    loose = sorted(_sorted_codes([q, *parts])) if label == "Person" and q and not short and q not in learned else []
                    rows.append((label, text, q, short, name, codes(name), loose))
            yield pd.DataFrame(rows, columns=["label", "text", "qualifier", "short", "name", "codes", "loose"])

    return spellings.mapInPandas(run, _FORM)


@F.pandas_udf(T.BooleanType())
def _same_parts(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_parts(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _same_person(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_person(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _near(blocked: DataFrame, most: int | None) -> DataFrame:
    """(node_a, node_b, name_a, name_b): pairs of a block whose letters are within ``most`` edits, or four for each part of the name. Blocks of many names are dealt to several tasks."""
    sizes = blocked.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    a, b = (blocked.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "name", "letters"))) for x in "ab")
    met = hot_join(a, b.join(sizes, "key"), "key", "_rows", F.col("node_a"), hot_rows=HOT_NAMES)
    near = f"levenshtein(letters_a, letters_b, {most}) >= 0" if most is not None else "levenshtein(letters_a, letters_b) <= 4 * size(split(name_a, ' '))"
    return met.filter(F.expr(f"node_a < node_b AND {near}")).select("node_a", "node_b", "name_a", "name_b").distinct()


def clusters(mentions: DataFrame) -> DataFrame:
    """(label, text, entity) of every spelling of a person or organisation."""
    spellings = mentions.filter(F.col("label").isin(*LABELS) & F.col("text").rlike(r"\S")).groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"))
    parsed = cut(forms(spread(cut(spellings).select("label", "text"), "text")))
    node = F.concat_ws("|", "label", "qualifier", "name")
    whole = cut(parsed.filter(~F.col("short")).groupBy("label", "qualifier", "name").agg(F.first("codes").alias("codes"), F.first("loose").alias("loose"), F.count(F.lit(1)).alias("texts")).withColumn("node", node))
    # two names within two edits, their parts in any order, have letters within four
    letters = F.array_join(F.array_sort(F.split(F.replace("name", F.lit(" ")), "")), "")
    strict = _near(whole.select("node", "name", letters.alias("letters"), F.explode("codes").alias("code"), F.xxhash64("label", "qualifier", "code").alias("key")).drop("code"), 4)
    edges = strict.filter(_same_parts("name_a", "name_b")).select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    # given names that aren't learned are no keys: their blocks are of all parts of the name, each of which may be two edits away
    whole_name = F.concat_ws(" ", "qualifier", "name")
    letters = F.array_join(F.array_sort(F.split(F.replace(whole_name, F.lit(" ")), "")), "")
    loose = _near(whole.select("node", whole_name.alias("name"), letters.alias("letters"), F.explode("loose").alias("code"), F.xxhash64("label", "code").alias("key")).drop("code"), None)
    edges = edges.unionByName(loose.filter(_same_person("name_a", "name_b")).select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))).distinct()
    entity = cut(whole.join(connected_components(edges), "node", "left").withColumn("entity", F.coalesce("component", "node")).drop("component"))
    # initials and cut-off given names: the one entity that fits
    short = parsed.filter("short").groupBy("label", "qualifier", "name").agg(F.first("codes").alias("codes"))
    words_of = entity.select("label", "codes", F.explode(F.split("qualifier", " ")).alias("word"), "name", "entity")
    fit = (
        short.select("label", F.col("qualifier").alias("cut"), F.col("name").alias("short_name"), F.explode("codes").alias("code"), F.substring("qualifier", 1, 1).alias("initial"))
        .join(words_of.select("label", F.explode("codes").alias("code"), F.substring("word", 1, 1).alias("initial"), "word", "name", "entity"), ["label", "code", "initial"])
        .filter(F.col("word").startswith(F.col("cut")) & F.expr("abs(length(replace(short_name, ' ')) - length(replace(name, ' '))) <= 2"))
        .select("label", "cut", "short_name", "name", "entity").distinct()
        .filter(_same_parts("short_name", "name"))
        .groupBy("label", "cut", "short_name").agg(F.min("entity").alias("entity"), F.max("entity").alias("other"))
    )
    fit = fit.select("label", F.col("cut").alias("qualifier"), F.col("short_name").alias("name"), "entity", "other")
    alone = F.concat_ws("|", F.col("label"), F.concat(F.col("qualifier"), F.lit(".")), F.col("name"))
    fitted = parsed.filter("short").select("label", "text", "qualifier", "name").join(fit, ["label", "qualifier", "name"], "left")
    shorts = fitted.select("label", "text", F.when(F.col("entity") == F.col("other"), F.col("entity")).otherwise(alone).alias("entity"))
    wholes = parsed.filter(~F.col("short")).join(entity.select("label", "qualifier", "name", "entity"), ["label", "qualifier", "name"]).select("label", "text", "entity")
    return wholes.unionByName(shorts)


def found(mentions: DataFrame) -> DataFrame:
    """(text_a, text_b): all pairs of spellings of one entity."""
    members = cut(clusters(mentions))
    keyed = members.select(F.xxhash64("label", "entity").alias("key"), F.struct("label", "entity").alias("of"), "text")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    a, b = (keyed.select("key", F.col("of").alias(f"of_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    pairs = hot_join(a, b.join(sizes, "key"), "key", "_rows", F.col("text_a"), hot_rows=HOT_NAMES)
    return pairs.filter("of_a = of_b AND text_a < text_b").select("text_a", "text_b").distinct()
