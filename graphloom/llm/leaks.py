"""Problem 7: evaluation texts leaking into training text.

Texts become words without case, marks, markup and look-alike letters of other scripts. Windows of items and documents
go through a CGK embedding: a random walk writes the current word and moves on, or stays, as a random bit of that word
says, so that a window with few words inserted, lost or changed writes nearly the same output, and edit distance becomes
Hamming distance. Bit sampling hashes some output places to a key; each round has its own walk and places.

Windows are sized by the item: ``BANDS`` has window lengths with their places and rounds, and an item takes the longest
window of about three fifths of the words that have to be held, so that a leak of just two fifths with a word changed in
eight still has whole windows. A document makes windows of each band that some item takes. In windows of up to three words
an edit leaves nothing to sample; they are compared as they are, which loses nothing, because every accepted stretch begins with
three words found in a row (or all of them, if fewer are needed). One equal key in one round is enough: all pairs that share one
are verified exactly. A local alignment of the item with the document around the shared windows counts the item's words
that stand there in the item's order, words with a letter lost, added or swapped included.

The windows of a document are a stream: only keys that some item may have leave the scan. That test is a bitmap
of fixed size (``FILTER_BITS`` bits, 2 MB), the only thing broadcast; it lets a few others pass, the more the fuller it is, and
loses none. Keys then meet in a join that splits hot keys. Documents are read whole at any length, in slices that overlap.
The texts are joined to the pairs by document, so a document's pairs stand together and it is cut into words once.

Defined cases: null and empty texts and items hold nothing; a document with fewer words than an item's window holds fewer
words than the item needs; equal texts are each reported; items with the same text are both reported; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrays import collected
from graphloom.llm.hashing import mixed, numbers
from graphloom.plans.skew import hot_join
from graphloom.sources.tables import cut, spread

#: Words of a window: (output places sampled for a key, rounds). Windows without places are compared as they are.
BANDS = {1: (0, 1), 2: (0, 1), 3: (0, 1), 4: (6, 4), 6: (8, 6), 8: (11, 8), 12: (16, 8)}
FILTER_BITS = 1 << 24
#: Part of an item's words that a document must hold.
SHARE = 0.4
SLICE = 20_000
#: What a foreign or missing word costs in an alignment, against 1 for a word found: a stretch with under
#: three quarters of its words in common, as questions of the same pattern have, gains nothing.
GAP = 3
#: Letters of other scripts that look like Latin ones: fixed values.
LOOK_ALIKE = str.maketrans("аеорсухкнвмтіѕјԁһӏɡοαενικρτυхΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxkhbmtisjdhlgoaevikptuxABEZHIKMNOPTYX")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&[a-z]+;|[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    s = text if text.isascii() else unicodedata.normalize("NFKD", text)
    s = _TAG.sub(lambda m: "" if len(m.group()) == 1 else " ", s) if not s.isascii() or "<" in s or "&" in s else s
    s = s.lower()
    if not s.isascii():
        for c in set(s):
            if c > "\u02ff" and (plain := _plain(c)) != c:
                s = s.replace(c, plain)
    return _WORD.findall(s)


@lru_cache(100_000)
def _plain(c: str) -> str:
    """A letter that looks like a Latin one as that; nothing for a mark that combines with the letter before it."""
    return "" if unicodedata.combining(c) else c.translate(LOOK_ALIKE)


def band(need: int) -> int:
    """The window for an item of which ``need`` words have to be held: never more than are needed."""
    return max(w for w in BANDS if w <= max(min(need, 3), 0.62 * need))


@lru_cache
def _places(w: int, r: int) -> frozenset[int]:
    """Output places that round r samples; later ones are mostly padding."""
    return frozenset(np.random.default_rng(71 + r + 1000 * w).choice(int(2.2 * w), BANDS[w][0], replace=False).tolist())


def window_keys(ns: np.ndarray, starts: np.ndarray, w: int, r: int) -> np.ndarray:
    """The key in round r of each window of w words that begins at one of ``starts``."""
    key = np.full(len(starts), 1000 * w + r + 1, dtype=np.uint64)
    times = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        if not BANDS[w][0]:
            for t in range(w):
                key = key * times + ns[starts + t]
            return mixed(key, w).view(np.int64)
        places = _places(w, r)
        bits, ends, at = mixed(ns, r + 100 * w), starts + w, starts.copy()
        # windows end where their document does or before, but the walk of the last one may stand behind the last word
        bits, padded = np.append(bits, np.uint64(0)), np.append(ns, np.uint64(0))
        for t in range(max(places) + 1):
            inside = at < ends
            if t in places:
                key = key * times + np.where(inside, padded[at], np.uint64(0))
            at += inside & ((bits[at] >> np.uint64(t)) & np.uint64(1)).view(np.int64).astype(bool)
    return mixed(key, w).view(np.int64)


def _keys_of(ids: list[int], texts: list[str | None], bands: list[list[int]], accept: np.ndarray | None) -> pd.DataFrame:
    """(id, place, key) of all windows that may match; bands: the window lengths for each text."""
    parts: list[np.ndarray] = []
    at: dict[int, list[tuple[int, int, int]]] = {}
    offset = 0
    for i, t, ws_of in zip(ids, texts, bands, strict=True):
        ws = words(t)
        n = len(ws)
        for w in ws_of:
            if n >= w:
                at.setdefault(w, []).append((i, offset, n - w + 1))
        if n:
            parts.append(numbers(ws, n))
            offset += n
    out = []
    for w, texts_of in at.items():
        words_of = np.concatenate(parts)
        owner, first, k = np.array(texts_of, dtype=np.int64).T
        place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        owner, starts = np.repeat(owner, k), np.repeat(first, k) + place
        for r in range(BANDS[w][1]):
            key = window_keys(words_of, starts, w, r)
            if accept is not None:
                slot = key & (FILTER_BITS - 1)
                ok = np.flatnonzero((accept[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                out.append(pd.DataFrame({"id": owner[ok], "place": place[ok], "key": key[ok]}))
            else:
                out.append(pd.DataFrame({"id": owner, "place": place, "key": key}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "place": [], "key": []}).astype("int64")


def needed(text: str | None) -> int:
    """The words of an item that a document has to hold."""
    return math.ceil(SHARE * len(words(text)))


def item_keys(items: DataFrame) -> DataFrame:
    """(item_id, item_place, key, w): the keys of the items' windows of w words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, rows in pdf.groupby(pdf["text"].map(lambda t: band(needed(t)) if needed(t) else 0)):
                if w:
                    yield _keys_of(rows["item_id"].tolist(), rows["text"].tolist(), [[w]] * len(rows), None).rename(columns={"id": "item_id", "place": "item_place"}).assign(w=w)

    return items.select("item_id", "text").filter("item_id is not null").mapInPandas(run, "item_id long, item_place long, key long, w int").distinct()


def _filter(keys: DataFrame) -> np.ndarray:
    """The bitmap of the items' keys, put together in numbers of 64 bits: at most FILTER_BITS / 64 rows, whatever the items."""
    slot = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    cells = collected(keys.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(key & {FILTER_BITS - 1} & 63 as int))")).alias("bits")))
    bitmap = np.zeros(FILTER_BITS // 64, dtype="<i8")
    bitmap[cells["cell"]] = cells["bits"]
    return bitmap.view(np.uint8)


@lru_cache(50_000)
def _near_forms(w: str) -> set[str]:
    """A word and what is left of it without one letter; swaps share a form."""
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} if len(w) > 3 else {w}


class _Known(dict[str, bool]):
    """Whether a word is like one of an item's; the words of many documents are asked for again and again."""

    def __init__(self, item: Item):
        super().__init__()
        self.item = item

    def __missing__(self, w: str) -> bool:
        if len(self) > 30_000:
            self.clear()
        found = self[w] = bool(self.item.like(w))
        return found


class Item:
    """An item's words, prepared for alignments."""

    def __init__(self, text: str | None):
        self.words = words(text)
        self.need = max(1, math.ceil(SHARE * len(self.words)))
        self.number = {w: k for k, w in enumerate(sorted(set(self.words)))}
        self.rows = [self.number[w] for w in self.words]
        self.masks = [0] * len(self.number)
        for i, k in enumerate(self.rows):
            self.masks[k] |= 1 << i
        self.forms: dict[str, list[int]] = {}
        for w, k in self.number.items():
            for f in _near_forms(w):
                self.forms.setdefault(f, []).append(k)
        self.lengths = {k: len(w) for w, k in self.number.items()}
        self.known = _Known(self)

    def like(self, w: str) -> tuple[int, ...]:
        """The item's words that w is, or is a letter away from."""
        if w in self.number:
            return (self.number[w],)
        if len(w) < 4 or self.forms.keys().isdisjoint(_near_forms(w)):
            return ()
        return tuple(sorted({k for f in _near_forms(w) for k in self.forms.get(f, ()) if abs(self.lengths[k] - len(w)) <= 1}))

    def in_order(self, part: list[tuple[int, ...]]) -> int:
        """The longest common subsequence, however far apart: what ``held`` can't exceed. Bit-parallel."""
        full = (1 << len(self.rows)) - 1
        v = full
        for ks in part:
            if ks:
                m = self.masks[ks[0]]
                for k in ks[1:]:
                    m |= self.masks[k]
                u = v & m
                v = ((v + u) | (v - u)) & full
        return len(self.rows) - v.bit_count()

    def hits(self, part: list[str]) -> np.ndarray:
        """Whether each word of ``part`` is, or is near, a word of the item."""
        known = self.known
        return np.fromiter(map(known.__getitem__, part), dtype=bool, count=len(part))

    def dense(self, hits: np.ndarray) -> int:
        """The item's words in the best stretch, in any order: what ``held`` can't exceed, as each start of an
        alignment scores as much here or more."""
        score = np.concatenate([[0], np.cumsum(np.where(hits, 1, -GAP))])
        count = np.concatenate([[0], np.cumsum(hits)])
        least = np.minimum.accumulate(score)
        start = np.maximum.accumulate(np.where(np.r_[True, least[1:] < least[:-1]], np.arange(len(score)), 0))
        return int((count - count[start]).max())

    def held(self, part: list[str]) -> int:
        """The item's words that the best local alignment with ``part`` finds in order; 0 if they are too few."""
        if not self.rows:
            return 0
        hits = self.hits(part)
        if hits.sum() < self.need or self.dense(hits) < self.need:
            return 0
        like = [self.like(w) if h else () for w, h in zip(part, hits.tolist(), strict=True)]
        if self.in_order(like) < self.need:
            return 0
        same = np.zeros((len(self.number), len(part)), dtype=bool)
        for j, ks in enumerate(like):
            for k in ks:
                same[k, j] = True
        big = 4096
        gain = np.where(same, big + 1, -GAP * big)
        step = GAP * big * np.arange(len(part), dtype=np.int64)
        above = np.zeros(len(part) + 1, dtype=np.int64)
        most = 0
        for k in self.rows:
            here = np.maximum(above[:-1] + gain[k], above[1:] - GAP * big)
            here = np.maximum.accumulate(here + step) - step
            np.maximum(here, 0, out=here)
            above[1:] = here
            most = max(most, int((here & (big - 1)).max()))
        return most


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    items: dict[int, Item] = {}
    last, ws = None, []
    for pdf in batches:
        rows = []
        for d, it, parts, text, item_text in zip(pdf["doc_id"], pdf["item_id"], pdf["parts"], pdf["text"], pdf["item_text"], strict=True):
            if it not in items:
                if len(items) > 2_000:
                    items.clear()
                items[it] = Item(item_text)
            if last != (d, text):
                last, ws = (d, text), words(text)
            item = items[it]
            if any(_held(item, ws, int(p["lo"]), int(p["hi"])) for p in parts):
                rows.append((d, it))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id"]).astype("int64")


def _held(item: Item, ws: list[str], lo: int, hi: int) -> bool:
    """Whether the document's words around the windows from lo to hi hold enough of the item."""
    n = len(item.words)
    reach = n + n // GAP + 1  # each foreign word costs GAP found ones, so no alignment is longer
    a, b = max(0, lo - reach), min(len(ws), hi + max(BANDS) + reach)
    return any(item.held(ws[x : min(b, x + SLICE)]) >= item.need for x in range(a, b, max(1, SLICE - 2 * reach)))


def candidates(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, parts): pairs that share a key; parts has the places (lo, hi) of shared windows near each other."""
    keys = cut(item_keys(items))
    bands = sorted(r["w"] for r in keys.select("w").distinct().collect())
    bitmap = documents.sparkSession.sparkContext.broadcast(_filter(keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 200):
                part = pdf.iloc[k : k + 200]
                yield _keys_of(part["doc_id"].tolist(), part["text"].tolist(), [bands] * len(part), bitmap.value).rename(columns={"id": "doc_id"})

    rows = spread(documents.select("doc_id", "text").filter("doc_id is not null and text is not null"), "doc_id")
    windows = cut(rows.mapInPandas(run, "doc_id long, place long, key long"))
    counts = windows.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    shared = hot_join(windows, keys.drop("w").join(counts, "key"), "key", "_rows", F.struct("doc_id", "place"))
    # windows of one alignment lie near a diagonal; each part is looked at with the item's length around it, so a cut through an alignment loses nothing
    near = shared.groupBy("doc_id", "item_id", F.floor((F.col("place") - F.col("item_place")) / 64).alias("_d")).agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    return near.groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("parts"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold at least two fifths of an item."""
    pairs = candidates(documents, items).join(items.select("item_id", F.col("text").alias("item_text")), "item_id")
    rows = pairs.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "item_id", "parts", "text", "item_text")
    return rows.mapInPandas(_verify, "doc_id long, item_id long").distinct()
