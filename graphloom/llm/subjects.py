"""Problem 8: subject areas of each document.

Subject-specific interpolated n-gram language models, each against a background model of its own language: otherwise a
subject with many German documents would win on German articles. The language of a sentence is what most of its
words are used in; the ``lang`` column, wrong in places, only teaches that by its majority over the corpus.

With h the word before w, and all counts within a language, the models are

    P0(w)   = (c(w) + 1/2) / (N + V/2)                        Ps(w)   = (1 - NU) (max(cs(w) - D, 0) / Ns + rest P0(w)) + NU P0(w)
    P0(w|h) = c(h,w) / (c(h) + MU) + rest P0(w)               Ps(w|h) = (1 - NU) (cs(h,w) / (cs(h) + MU) + rest Ps(w)) + NU P0(w|h)

where ``rest`` is what is left to one, so that each sums to one over the vocabulary. A sentence's gain for a subject is the
per-token cross-entropy of the background less that of the subject, with ``REST`` more tokens that both expect alike, so that a
few words are no proof. The sentence deals with the subject of the greatest gain, if that passes the subject's threshold. A document
has every subject that a fifth of its sentences deal with, so it may have several, or none.

Labelled documents give first unigram models; with them the sentences of the whole corpus are assigned, and counted
again by the subject assigned, which corrects wrong labels and teaches words, and languages, that few labelled documents have.
Thresholds are calibrated by subject on labelled documents that taught nothing.

The corpus is cut into numbered words once and written to the checkpoint folder; every later pass reads numbers. A word, or a pair
of words, that fewer than ``LEAST`` documents have, whatever the size of the corpus, is no evidence: such a word counts as the unknown
word of its language, which the models hold like any other, and such a pair leaves its weight to the single words. So no token is dropped.

Words, pairs and their counts are tables, which neither the driver nor a broadcast holds. Documents lie in blocks of about ``BLOCK``
words, and each word and pair has the list of the blocks it is in: a pass sends a block the rows of its own words and pairs, builds
from these the models as far as the block asks them, and sends back sums. What a task holds is thus bounded by its block (or longest
document), and what a pass sends by the different words and pairs of the blocks. The driver holds sums by language and subject
only. The labelled sample has at most ``LABELLED`` documents, chosen by hash.

Defined cases: null, empty and blank texts, stubs and redirects have no subject; labels of unknown documents or
subjects are ignored; without usable labels there are no rows; subjects without labelled documents are never
given; equal gains go to the first subject by name; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrays import collected
from graphloom.llm.hashing import mixed, numbers
from graphloom.sources.tables import cut, spread

LABELLED = 50_000
#: Documents that must have a word or pair before models tell it from others.
LEAST = 3
#: Words in a block of documents.
BLOCK = 1_000_000
#: Part of a document's sentences that must deal with a subject.
SHARE = 0.2
#: Discount, weight of the background, weight of single words in pairs.
D, NU, MU = 0.5, 0.2, 8.0
#: Tokens added to each sentence that no model tells from another.
REST = 40
#: Gains per token from which a sentence teaches, by round, and gains that are tried as thresholds, for ten subjects.
TEACH = (0.038, 0.058, 0.058)
THRESHOLDS = tuple(round(0.01 * x, 4) for x in (0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.25, 2.5, 2.75, 3.0, 3.5, 4.0, 5.0))
USUAL = 0.024
#: Labelled documents in HELD, one of which calibrates instead of teaching; documents that the mean over all subjects stands for.
HELD, PRIOR = 10, 20.0
#: Tokens scored at a time.
SLICE = 200_000
_SENTENCE = re.compile(r"[\n\r]+|(?<=[.!?…])[\"”»’)\]]*\s+|(?<=[。！？])")
_TOKEN = re.compile(r"[一-鿿々]+|[ァ-ヿ]+|[ぁ-ゖ]+|[가-힣]+|[^\W\d_一-鿿々ぁ-ヿ가-힣]+|\d+")
_REDIRECT = re.compile(r"\s*(?:#\s*(?:redirect|weiterleitung|redirection|redirecci[óo]n|転送)|this article is a stub|no text yet|edit \| view history)", re.I)


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as tokens; lines without words, such as code and rules, are none."""
    if not text or _REDIRECT.match(text):
        return []
    out = []
    for s in _SENTENCE.split(text):
        if not s:
            continue
        ts = ["#" if t[0].isdigit() else t for t in _TOKEN.findall(s.lower())]
        if len(ts) >= 3 and sum(len(t) for t in ts if t != "#") >= 0.5 * len(s.replace(" ", "")):
            out.append(ts)
    return out


class Texts:
    """Documents as numbers: words one after the other, lengths of sentences, the document of each sentence."""

    def __init__(self, tokens: list[np.ndarray], lens: list[np.ndarray]):
        self.docs = len(tokens)
        self.tokens = np.concatenate([*tokens, np.empty(0, dtype=np.int64)])
        self.lens = np.concatenate([*lens, np.empty(0, dtype=np.int64)]).astype(np.int64)
        self.sentences_of = np.array([len(x) for x in lens], dtype=np.int64)
        self.doc = np.repeat(np.arange(self.docs), self.sentences_of)
        self.starts = np.cumsum(self.lens) - self.lens
        self.sentence = np.repeat(np.arange(len(self.lens)), self.lens)

    @staticmethod
    def parts(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Texts]]:
        """A batch in parts of about SLICE words; a longer document is a part of its own."""
        size = np.cumsum(pdf["tokens"].map(len).to_numpy(dtype=np.int64)) if len(pdf) else np.empty(0)
        for _, rows in pdf.groupby(size // SLICE, sort=False):
            yield rows, Texts(list(rows["tokens"]), list(rows["lens"]))


def _find(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x among the sorted known ones, or -1."""
    if not len(known):
        return np.full(len(x), -1, dtype=np.int64)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return np.where(known[at] == x, at, -1)


def _counted(*columns: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct rows of the columns and how often each is there."""
    if not len(columns[0]):
        return (*columns, np.empty(0, dtype=np.int64))
    order = np.lexsort(columns)
    sorted_ = [c[order] for c in columns]
    new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_])]
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(new)]) if weights is None else np.add.reduceat(weights[order], at)
    return (*(c[at] for c in sorted_), n)


def _in_language(tokens: np.ndarray, lang: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(tokens.view(np.uint64) + lang.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 5).view(np.int64)


class Languages:
    """The language that each word is mostly used in."""

    def __init__(self, names: list[str], words: np.ndarray, of: np.ndarray):
        order = np.argsort(words)
        self.names, self.words, self.of = names, words[order], of[order]

    def sentences(self, t: Texts) -> np.ndarray:
        """The language of each sentence: what most of its words are used in, that of the document if it has no say."""
        k = len(self.names)
        if not k or not len(t.lens):
            return np.full(len(t.lens), k, dtype=np.int64)
        at = _find(self.words, t.tokens)
        known = at >= 0
        there, of = np.unique(self.of[at[known]], return_inverse=True)
        if not len(there):
            return np.full(len(t.lens), k, dtype=np.int64)
        absent, k = k, len(there)
        votes = np.bincount(t.sentence[known] * k + of, minlength=len(t.lens) * k).reshape(-1, k).astype(float)
        typical = np.zeros((t.docs, k))
        np.add.at(typical, t.doc, votes)
        votes += typical[t.doc] / t.sentences_of[t.doc][:, None]
        return np.where(votes.max(axis=1) > 0, there[votes.argmax(axis=1)], absent)

    def marked(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The words, each with the language of its sentence in its number, and the languages."""
        lang = self.sentences(t)[t.sentence]
        return _in_language(t.tokens, lang), lang

    def unknown(self) -> np.ndarray:
        """Numbers of the unknown words of each language, the last one's for words without one."""
        lang = np.arange(len(self.names) + 1)
        return _in_language(np.zeros_like(lang), lang)


class Vocabulary:
    """The words that models tell apart, and an unknown word for each language."""

    def __init__(self, words: np.ndarray, langs: np.ndarray, counts: np.ndarray, unknown: np.ndarray):
        """unknown: the number of unknown words of each language."""
        order = np.argsort(words)
        self.words = words[order]
        self.lang = np.r_[langs[order], np.arange(len(unknown))]
        self.counts = np.r_[counts[order], unknown].astype(float)
        self.size = len(self.lang)

    def indices(self, marked: np.ndarray, lang: np.ndarray) -> np.ndarray:
        at = _find(self.words, marked)
        return np.where(at >= 0, at, len(self.words) + lang)

    def history(self, w: np.ndarray, t: Texts) -> np.ndarray:
        """The word before each word, -1 at the beginning of a sentence."""
        h = np.r_[-1, w[:-1]]
        h[t.starts] = -1
        return h

    def pair(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.where(h >= 0, h * self.size + w, -1)


class Sums(NamedTuple):
    """By language: words that there are, different ones, and both the counts by subject and these less the discount."""

    total: np.ndarray
    words: np.ndarray
    ns: np.ndarray
    kept: np.ndarray

    @staticmethod
    def of(v: Vocabulary, one: np.ndarray) -> Sums:
        langs = int(v.lang.max()) + 1
        ns, kept = np.zeros((langs, one.shape[1])), np.zeros((langs, one.shape[1]))
        np.add.at(ns, v.lang, one)
        np.add.at(kept, v.lang, np.maximum(one - D, 0))
        return Sums(np.bincount(v.lang, v.counts, langs), np.bincount(v.lang, minlength=langs), ns, kept)


class Models:
    """Interpolated models of the subjects and the background, and the gains of their tokens."""

    def __init__(self, v: Vocabulary, one: np.ndarray, pairs: np.ndarray | None = None, background: np.ndarray | None = None, before: np.ndarray | None = None, two: np.ndarray | None = None, after: np.ndarray | None = None, sums: Sums | None = None, seen: tuple[np.ndarray, np.ndarray] | None = None):
        """one: counts of words by subject; pairs: sorted pairs, background and two: their counts; before and after: counts of words with a word after them, in all and by subject.
        sums and seen, the counts of the pairs that begin with each word, in all and by subject: those of the corpus, if the words and pairs are only a part of it."""
        self.v, self.pairs = v, np.empty(0, dtype=np.int64) if pairs is None else pairs
        lang, less = v.lang, np.maximum(one - D, 0)
        total, words, ns, kept = sums or Sums.of(v, one)
        self.p0 = (v.counts + 0.5) / (total + 0.5 * words)[lang]
        ns = np.maximum(ns, 1e-9)
        rest = 1 - kept / ns
        self.ps = (1 - NU) * (less / ns[lang] + rest[lang] * self.p0[:, None]) + NU * self.p0[:, None]
        self.gain1 = np.log(self.ps / self.p0[:, None]).astype(np.float32)
        if pairs is None:
            return
        h, w = pairs // v.size, pairs % v.size
        if seen is None:
            seen = np.bincount(h, background, v.size), np.zeros((v.size, one.shape[1]))
            np.add.at(seen[1], h, two)
        self.rest0, self.rest = 1 - seen[0] / (before + MU), 1 - seen[1] / (after + MU)
        self.q0 = background / (before[h] + MU) + self.rest0[h] * self.p0[w]
        self.qs = (1 - NU) * (two / (after[h] + MU) + self.rest[h] * self.ps[w]) + NU * self.q0[:, None]
        self.ratio1, self.ratio0 = (self.ps / self.p0[:, None]).astype(np.float32), (self.rest / self.rest0[:, None]).astype(np.float32)
        self.gain2 = np.log(self.qs / self.q0[:, None]).astype(np.float32)

    def slim(self) -> Models:
        """Only what gains need."""
        for x in ("p0", "ps", "rest0", "rest", "q0", "qs"):
            self.__dict__.pop(x, None)
        return self

    def gains(self, t: Texts, w: np.ndarray) -> np.ndarray:
        """Per-token cross-entropy of the background less that of each subject, by sentence."""
        k = self.gain1.shape[1]
        out = np.zeros((len(t.lens), k))
        h = self.v.history(w, t)
        at = 0
        ends = np.cumsum(t.lens)
        while at < len(t.lens):
            last = max(at + 1, int(np.searchsorted(ends, t.starts[at] + SLICE, side="right")))
            a, b = int(t.starts[at]), int(ends[last - 1])
            ws, hs = w[a:b], h[a:b]
            g = self.gain1[ws]
            if len(self.pairs):
                p = _find(self.pairs, self.v.pair(hs, ws))
                two = p >= 0
                one = (hs >= 0) & ~two
                g[one] = np.log((1 - NU) * self.ratio0[hs[one]] * self.ratio1[ws[one]] + NU)
                g[two] = self.gain2[p[two]]
            out[at:last] = np.add.reduceat(g, t.starts[at:last] - a, axis=0) / (t.lens[at:last, None] + REST)
            at = last
        return out


def scale(subjects: int) -> float:
    """A word can gain the logarithm of the number of subjects at most; thresholds are stated for ten."""
    return float(np.log(max(subjects, 2)) / np.log(10))


def dealt(t: Texts, gains: np.ndarray, thresholds: np.ndarray | float) -> np.ndarray:
    """The number of sentences of each document that deal with each subject."""
    best = gains.argmax(axis=1)
    sure = gains.max(axis=1) >= (thresholds[best] if isinstance(thresholds, np.ndarray) else thresholds)
    out = np.zeros((t.docs, gains.shape[1]), dtype=np.int64)
    np.add.at(out, (t.doc[sure], best[sure]), 1)
    return out


def given(t: Texts, gains: np.ndarray, thresholds: np.ndarray | float) -> np.ndarray:
    """Whether a fifth of each document's sentences deal with each subject."""
    return _fifth(t, dealt(t, gains, thresholds))


def _fifth(t: Texts, n: np.ndarray) -> np.ndarray:
    return (n >= SHARE * t.sentences_of[:, None] - 1e-9) & (n > 0)


def last_given(t: Texts, gains: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The place of the last of the rising thresholds at which each document is given each subject, or -1."""
    k = gains.shape[1]
    out = np.full((t.docs, k), -1)
    cell, reached = t.doc * k + gains.argmax(axis=1), np.searchsorted(thresholds, gains.max(axis=1), side="right")
    for i in range(len(thresholds)):
        out[_fifth(t, np.bincount(cell[reached > i], minlength=t.docs * k).reshape(-1, k))] = i
    return out


def assigned(t: Texts, gains: np.ndarray, threshold: float) -> np.ndarray:
    """A subject for each sentence, or -1. A single sentence apart from the rest teaches nothing about its own subject:
    it goes with a document that is clearly about one, as sentences that no model knows do, so stock phrases spread evenly."""
    best = gains.argmax(axis=1)
    n = dealt(t, gains, threshold)
    sure = (gains.max(axis=1) >= threshold) & (n[t.doc, best] >= 2)
    clear = (n.max(axis=1) >= 2) & (n.max(axis=1) >= 0.7 * n.sum(axis=1))
    return np.where(sure, best, np.where(clear[t.doc], n.argmax(axis=1)[t.doc], -1))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents as numbers, in blocks; a longer document is a block of its own."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for pdf in batches:
        rows = []
        for d, lang, text, labels in zip(pdf["doc_id"], pdf["lang"], pdf["text"], pdf["labels"], strict=True):
            doc = sentences(text)
            if doc:
                tokens = numbers(w for s in doc for w in s).view(np.int64)
                if size and size + len(tokens) > BLOCK:
                    block, size = block + 1, 0
                size += len(tokens)
                rows.append((block, d, lang, tokens, np.array([len(s) for s in doc], dtype=np.int32), labels))
        yield pd.DataFrame(rows, columns=["block", "doc_id", "lang", "tokens", "lens", "labels"])


#: Rows that blocks are sent: languages of words (x), words (x their language, y the counts of their pairs, n and m their counts, in all and
#: with a word after them), pairs (of the words x and y), and counts by subject of words, pairs, words with a word after them, and the pairs of words.
LANG, WORD, PAIR, ONE, TWO, AFTER, SEEN = range(7)
_SENT = ("kind", "key", "x", "y", "n", "m")


def _longs(**columns: np.ndarray) -> pa.Table:
    return pa.table({k: np.asarray(x).astype(np.int64) for k, x in columns.items()})


def _schema(*names: str) -> str:
    return ", ".join(f"{n} long" for n in names)


def _joined(rows: list[tuple[np.ndarray, ...]], width: int) -> list[np.ndarray]:
    return [np.concatenate([np.empty(0, dtype=np.int64), *(r[i] for r in rows)]).astype(np.int64) for i in range(width)]


def _by_block(docs: DataFrame, sent: DataFrame, f: Callable[[list[tuple[pd.DataFrame, Texts]], pa.Table], pa.Table], schema: str) -> DataFrame:
    """What f makes of the documents of a block and the rows sent to it, for every block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(list(Texts.parts(left.to_pandas())), right.select(["counts", "data"]))

    return docs.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, schema)


def _packed(rows: DataFrame, counts: bool) -> DataFrame:
    """The numbers of the rows one after the other, for each block that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.column_stack([b.column(c).to_numpy() for c in (_SENT[:2] if counts else _SENT)])
            if counts and len(b):
                own = np.hstack([own, b.column("c").flatten().to_numpy().reshape(len(b), -1)])
            flat = b.column("blocks").flatten().to_numpy()
            of = np.repeat(np.arange(len(b)), pc.list_value_length(b.column("blocks")).to_numpy(zero_copy_only=False))
            for a in range(0, len(flat), SLICE):
                order = np.argsort(flat[a : a + SLICE], kind="stable") + a
                blocks = flat[order]
                starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
                data = [own[of[x]].tobytes() for x in np.split(order, starts[1:])]
                yield pa.record_batch({"block": blocks[starts], "counts": np.full(len(starts), counts), "data": pa.array(data, pa.binary())})

    return rows.mapInArrow(run, "block long, counts boolean, data binary")


def _sent(*tables: DataFrame, counts: tuple[DataFrame, ...] = ()) -> DataFrame:
    """What blocks are sent of tables and of counts by subject, packed."""
    out = [t.select(*(c if c in t.columns else F.lit(0).cast("long").alias(c) for c in _SENT), "blocks") for t in tables]
    out = _packed(functools.reduce(DataFrame.union, out), False)
    if counts:
        out = out.union(_packed(functools.reduce(DataFrame.union, (t.select("kind", "key", "c", "blocks") for t in counts)), True))
    return out


class Part:
    """Languages, vocabulary, pairs and models as far as the rows sent tell them."""

    def __init__(self, sent: pa.Table, names: list[str], subjects: int, sums: Sums | None = None, paired: bool = True):
        """paired: whether the counts are those of pairs too."""
        def kinds(counts: bool, width: int, some: range) -> list[np.ndarray]:
            data = sent.filter(pc.equal(sent["counts"], counts))["data"]
            x = np.frombuffer(b"".join(data.to_pylist()), dtype=np.int64).reshape(-1, width)
            return [x[x[:, 0] == i] for i in some]

        def of(rows: np.ndarray, *columns: str) -> list[np.ndarray]:
            return [rows[:, _SENT.index(c)] for c in columns]

        lang, word, pair = kinds(False, len(_SENT), range(LANG, ONE))
        self.languages = Languages(names, *of(lang, "key", "x"))
        unknown = self.languages.unknown()
        key, x, y, n, m = of(word, "key", "x", "y", "n", "m")
        rare = np.isin(key, unknown)
        self.v = Vocabulary(key[~rare], x[~rare], n[~rare], np.bincount(x[rare], n[rare], len(unknown)))
        self.keys = np.r_[self.v.words, unknown]
        self._order = np.argsort(self.keys)
        size = self.v.size
        before, seen0 = np.zeros(size), np.zeros(size)
        before[self.at(key)], seen0[self.at(key)] = m, y
        key, h, w, n = of(pair, "key", "x", "y", "n")
        pairs = self.v.pair(self.at(h), self.at(w))
        order = np.argsort(pairs)
        self.pairs, self.pair_keys, background = pairs[order], key[order], n[order].astype(float)
        if sums is None:
            return
        by_key = np.argsort(self.pair_keys)

        one, two, after, seen = (np.zeros((n, subjects)) for n in (size, len(pairs), size, size))
        for total, rows in zip((one, two, after, seen), kinds(True, 2 + subjects, range(ONE, SEEN + 1)), strict=True):
            total[by_key[_find(self.pair_keys[by_key], rows[:, 1])] if total is two else self.at(rows[:, 1])] = rows[:, 2:]
        if paired:
            self.models = Models(self.v, one, self.pairs, background, before, two, after, sums, (seen0, seen))
        else:
            self.models = Models(self.v, one, sums=sums)
        self.models.slim()

    def at(self, keys: np.ndarray) -> np.ndarray:
        return self._order[_find(self.keys[self._order], keys)]

    def words(self, t: Texts) -> np.ndarray:
        return self.v.indices(*self.languages.marked(t))


def _languages(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """Languages that documents are marked with, and the words used in one of them mostly."""
    asked = docs.filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)
    names = sorted(r["lang"] for r in asked.collect())
    number = {k: i for i, k in enumerate(names)}

    def run(docs: pa.Table) -> pa.Table:
        out = []
        for rows, t in Texts.parts(docs.to_pandas()):
            lang = rows["lang"].map(lambda x: number.get(x, -1)).to_numpy(dtype=np.int64)
            token, of, _ = _counted(t.tokens, t.doc[t.sentence])
            out.append(_counted(token, lang[of]))
        token, lang, n = _joined(out, 3)
        token, lang, n = _counted(token, lang, weights=n)
        return _longs(block=np.full(len(token), docs["block"][0].as_py()), token=token, lang=lang, n=n)

    seen = docs.select("block", "lang", "tokens", "lens").groupBy("block").applyInArrow(run, _schema("block", "token", "lang", "n"))
    seen = seen.groupBy("token", "lang").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))
    marked = "filter (where lang >= 0)"
    best = seen.groupBy(F.col("token").alias("key")).agg(
        F.expr(f"max_by(lang, struct(n, lang)) {marked}").alias("x"), F.expr(f"max(n) {marked}").alias("most"), F.expr(f"sum(n) {marked}").alias("n"),
        F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"),
    )
    kept = best.filter((F.col("n") >= 2 * LEAST) & (F.col("most") >= 0.85 * F.col("n")))
    return names, cut(kept.select(F.lit(LANG).cast("long").alias("kind"), "key", "x", "blocks"), free=True)


def _vocabulary(docs: DataFrame, names: list[str], lang: DataFrame) -> DataFrame:
    """The words that models tell apart, and the unknown words."""

    def run(texts: list[tuple[pd.DataFrame, Texts]], sent: pa.Table) -> pa.Table:
        part, out = Part(sent, names, 0), []
        for rows, t in texts:
            marked, lang = part.languages.marked(t)
            word, of, _, n = _counted(marked, lang, t.doc[t.sentence])
            followed = np.ones(len(marked), dtype=np.int64)
            followed[t.starts + t.lens - 1] = 0
            word, of, docs = _counted(word, of)
            out.append((np.full(len(word), rows["block"].iloc[0]), word, of, docs, _counted(marked, lang)[2], _counted(marked, lang, weights=followed)[2]))
        return _longs(**dict(zip(("block", "word", "lang", "docs", "n", "m"), _joined(out, 6), strict=True)))

    sums = [F.sum(c).alias(c) for c in ("docs", "n", "m")]
    seen = _by_block(docs.select("block", "tokens", "lens"), _sent(lang), run, _schema("block", "word", "lang", "docs", "n", "m"))
    seen = cut(seen.groupBy("word", "lang").agg(*sums, F.collect_set("block").alias("blocks")), free=True)
    rare = seen.filter(F.col("docs") < LEAST)
    where = rare.select("lang", F.explode("blocks").alias("block")).distinct().groupBy("lang").agg(F.collect_list("block").alias("blocks"))
    unknown = F.array(*(F.lit(int(x)) for x in Languages(names, np.empty(0), np.empty(0)).unknown()))
    rare = rare.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).join(where, "lang").withColumn("word", F.element_at(unknown, (F.col("lang") + 1).cast("int")))
    columns = (F.lit(WORD).cast("long").alias("kind"), F.col("word").alias("key"), F.col("lang").alias("x"), F.lit(0).cast("long").alias("y"), "n", "m", "blocks")
    return cut(seen.filter(F.col("docs") >= LEAST).select(*columns).unionByName(rare.select(*columns)), free=True)


def _pairs(docs: DataFrame, names: list[str], lang: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs that models tell apart."""

    def run(texts: list[tuple[pd.DataFrame, Texts]], sent: pa.Table) -> pa.Table:
        part, out = Part(sent, names, 0), []
        for rows, t in texts:
            w = part.words(t)
            h = part.v.history(w, t)
            pair, _, n = _counted(part.v.pair(h, w)[h >= 0], t.doc[t.sentence][h >= 0])
            pair, n, docs = *_counted(pair, weights=n), _counted(pair)[1]
            x, y = part.keys[pair // part.v.size], part.keys[pair % part.v.size]
            key = mixed(mixed(x.view(np.uint64), 6) + y.view(np.uint64), 7).view(np.int64)
            out.append((np.full(len(pair), rows["block"].iloc[0]), key, x, y, docs, n))
        return _longs(**dict(zip(("block", "key", "x", "y", "docs", "n"), _joined(out, 6), strict=True)))

    seen = _by_block(docs.select("block", "tokens", "lens"), _sent(lang, words), run, _schema("block", "key", "x", "y", "docs", "n"))
    kept = seen.groupBy("key").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_set("block").alias("blocks"))
    return cut(kept.filter(F.col("docs") >= LEAST).select(F.lit(PAIR).cast("long").alias("kind"), "key", "x", "y", "n", "blocks"), free=True)


def _counts(kinds: list[tuple[int, np.ndarray, np.ndarray]], subjects: int) -> pa.Table:
    """Rows of counts by subject: for each kind, the keys and a count for each subject."""
    some = [(kind, keys[(x := counts.any(axis=1))], counts[x]) for kind, keys, counts in kinds]
    kind, key = _joined([(np.full(len(keys), kind), keys) for kind, keys, _ in some], 2)
    c = np.concatenate([np.empty((0, subjects)), *(counts for *_, counts in some)])
    return _longs(kind=kind, key=key, **{f"c{k}": c[:, k] for k in range(subjects)})


def _summed(counts: DataFrame, subjects: int) -> DataFrame:
    columns = [f"c{k}" for k in range(subjects)]
    return cut(counts.groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in columns)).select("kind", "key", F.array(*columns).alias("c")), free=True)


class Fitting:
    """The tables of a corpus, and passes over its blocks with the models they make."""

    def __init__(self, docs: DataFrame, subjects: int):
        self.docs, self.subjects = docs, subjects
        self.names, self.lang = _languages(docs)
        words = _vocabulary(docs, self.names, self.lang)
        self.pairs = _pairs(docs, self.names, self.lang, words)
        begun = self.pairs.groupBy(F.col("x").alias("key")).agg(F.sum("n").alias("y"))
        self.words = cut(words.drop("y").join(begun, "key", "left").fillna(0, ["y"]), free=True)
        langs = len(self.names) + 1
        got = collected(self.words.groupBy("x").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.max(F.col("key").isin(self._unknown())).cast("long").alias("unknown")))
        self.total = np.bincount(got["x"], got["n"], langs)
        # the unknown word of a language counts as one of its words, whether it occurs or not
        self.different = np.bincount(got["x"], got["words"] - got["unknown"], langs) + 1
        self.counts: DataFrame | None = None
        self.sums: Sums | None = None
        self.paired = False

    def _unknown(self) -> list[int]:
        return [int(x) for x in Languages(self.names, np.empty(0), np.empty(0)).unknown()]

    def learn(self, counts: DataFrame, paired: bool) -> None:
        """Further passes use the models that these counts make."""
        self.counts, self.paired = _summed(counts, self.subjects), paired
        one = self.counts.filter(F.col("kind") == ONE).join(self.words.select("key", "x"), "key")
        c = [F.col("c")[k] for k in range(self.subjects)]
        got = collected(one.groupBy("x").agg(*(F.sum(x).alias(f"n{k}") for k, x in enumerate(c)), *(F.sum(F.greatest(x - F.lit(D), F.lit(0.0))).alias(f"k{k}") for k, x in enumerate(c))))
        out = np.zeros((2, len(self.names) + 1, self.subjects))
        for i, name in enumerate("nk"):
            for k in range(self.subjects):
                out[i, got["x"], k] = got[f"{name}{k}"]
        self.sums = Sums(self.total, self.different, *out)

    def sent(self, whole: bool = False) -> DataFrame:
        """What blocks are sent, or, as that of one block, everything."""
        tables, counts = [self.lang, self.words, self.pairs], []
        if self.counts is not None:
            for own, kinds in ((self.words, (ONE, AFTER, SEEN)), (self.pairs, (TWO,))):
                counts.append(self.counts.filter(F.col("kind").isin(*kinds)).join(own.select("key", "blocks"), "key"))
        if whole:
            tables, counts = ([t.withColumn("blocks", F.array(F.lit(0).cast("long"))) for t in x] for x in (tables, counts))
        return _sent(*tables, counts=tuple(counts))

    def passed(self, docs: DataFrame, f: Callable[[Part, list[tuple[pd.DataFrame, Texts]]], pa.Table], schema: str) -> DataFrame:
        given = self.names, self.subjects, self.sums, self.paired
        return _by_block(docs, self.sent(), lambda texts, sent: f(Part(sent, *given), texts), schema)

    def labelled(self, docs: DataFrame) -> DataFrame:
        """Counts of words by the labels of the documents they are in."""
        subjects = self.subjects

        def run(part: Part, texts: list[tuple[pd.DataFrame, Texts]]) -> pa.Table:
            out = np.zeros((part.v.size, subjects), dtype=np.int64)
            for rows, t in texts:
                w, of = part.words(t), t.doc[t.sentence]
                for k in range(subjects):
                    has = rows["labels"].map(lambda x, k=k: k in x).to_numpy(dtype=bool)
                    out[:, k] += np.bincount(w[has[of]], minlength=part.v.size)
            return _counts([(ONE, part.keys, out)], subjects)

        return self.passed(docs.select("block", "tokens", "lens", "labels"), run, _schema("kind", "key", *(f"c{k}" for k in range(subjects))))

    def taught(self, teach: float) -> DataFrame:
        """Counts by the subjects that the models assign to the corpus."""
        subjects = self.subjects

        def run(part: Part, texts: list[tuple[pd.DataFrame, Texts]]) -> pa.Table:
            v = part.v
            sums = [np.zeros((n, subjects), dtype=np.int64) for n in (v.size, len(part.pairs), v.size, v.size)]
            for _, t in texts:
                w = part.words(t)
                k = assigned(t, part.models.gains(t, w), teach * scale(subjects))[t.sentence]
                h = v.history(w, t)
                p = _find(part.pairs, v.pair(h, w))
                for total, x in zip(sums, (w, p, h, np.where(p >= 0, h, -1)), strict=True):
                    ok = (k >= 0) & (x >= 0)
                    total += np.bincount(x[ok] * subjects + k[ok], minlength=total.size).reshape(total.shape)
            return _counts(list(zip((ONE, TWO, AFTER, SEEN), (part.keys, part.pair_keys, part.keys, part.keys), sums, strict=True)), subjects)

        return self.passed(self.docs.select("block", "tokens", "lens"), run, _schema("kind", "key", *(f"c{k}" for k in range(subjects))))

    def reached(self) -> DataFrame:
        """(doc_id, k, i): the last of the thresholds at which a document is given the subject, -1 if none; held-out documents have all
        subjects that they are labelled with, too."""
        subjects = self.subjects
        tried = np.array(THRESHOLDS) * scale(subjects)

        def run(part: Part, texts: list[tuple[pd.DataFrame, Texts]]) -> pa.Table:
            out = []
            for rows, t in texts:
                gains = part.models.gains(t, part.words(t))
                held = rows["held"].to_numpy(dtype=bool)
                truth = np.array([[x is not None and k in x for k in range(subjects)] for x in rows["labels"]]).reshape(-1, subjects) & held[:, None]
                last = last_given(t, gains, tried)
                d, k = np.nonzero((last >= 0) | truth)
                out.append((rows["doc_id"].to_numpy()[d], k, last[d, k], held[d], truth[d, k]))
            return _longs(**dict(zip(("doc_id", "k", "i", "held", "truth"), _joined(out, 5), strict=True)))

        return cut(self.passed(self.docs.select("block", "doc_id", "tokens", "lens", "labels", _held().alias("held")), run, _schema("doc_id", "k", "i", "held", "truth")), free=True)


def _held() -> F.Column:
    """Whether a document's labels calibrate; null labels don't."""
    return F.col("labels").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HELD)) == 0)


def _calibrated(reached: DataFrame, subjects: int) -> tuple[np.ndarray, dict[str, float]]:
    """A threshold for each subject, as its place, by its F1 on held-out labels, drawn to that of all subjects; precision and recall there."""
    tried = np.array(THRESHOLDS) * scale(subjects)
    seen = collected(reached.filter("held = 1").groupBy("k", "i").agg(F.sum("truth").alias("true"), F.count(F.lit(1)).alias("got")))
    at = np.zeros((2, len(tried) + 1, subjects))
    at[0, seen["i"] + 1, seen["k"]], at[1, seen["i"] + 1, seen["k"]] = seen["true"], seen["got"]
    # what is given at a threshold is given at those below
    hit, got = at[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    n = np.stack([hit, got, np.broadcast_to(at[0].sum(axis=0), hit.shape)])
    documents = max(float(n[2].max(axis=0).sum()), 1.0)
    hit, got, true = n + PRIOR * n.sum(axis=2, keepdims=True) / documents
    f1 = 2 * hit / np.maximum(got + true, 1e-9)
    # few labels don't tell near thresholds apart: of those within a standard error of the best, the one nearest to the usual one
    least = f1.max(axis=0) - np.sqrt(f1.max(axis=0) * (1 - f1.max(axis=0)) / np.maximum(true.max(axis=0), 1))
    usual = np.abs(tried - USUAL * scale(subjects))
    best = np.array([min(np.flatnonzero(f1[:, k] >= least[k]), key=lambda i: usual[i]) for k in range(subjects)])
    hit, got, true = (x[best, np.arange(subjects)].sum() for x in n)
    return best, {"precision": hit / max(got, 1), "recall": hit / max(true, 1), "labels": true}


def fitted(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> tuple[Fitting, list[str], DataFrame, np.ndarray, dict[str, float]] | None:
    """The final models, the subjects, which thresholds documents reach, the places of those chosen, and figures on held-out labels."""
    asked = areas.filter("subject is not null").select("subject").distinct()
    used = labels.join(F.broadcast(asked), "subject", "left_semi").select("subject").distinct()
    subjects = sorted(r["subject"] for r in used.collect())
    if not subjects:
        return None
    number = F.create_map(*(x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i))))
    per_doc = labels.filter(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.collect_set(number[F.col("subject")]).alias("labels"))
    sample = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    marked = F.when(F.trim("lang") != "", F.lower(F.trim("lang"))).alias("lang")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), marked, "text").filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    rows = spread(rows, "doc_id").join(F.broadcast(sample), "doc_id", "left").select("doc_id", "lang", "text", "labels")
    docs = cut(rows.mapInPandas(_cut, "block long, doc_id long, lang string, tokens array<long>, lens array<int>, labels array<int>"), free=True)
    teaching = docs.filter(F.col("labels").isNotNull() & ~_held())
    if teaching.isEmpty():
        return None
    fit = Fitting(docs, len(subjects))
    fit.learn(fit.labelled(teaching), paired=False)
    for teach in TEACH:
        fit.learn(fit.taught(teach), paired=True)
    reached = fit.reached()
    best, figures = _calibrated(reached, len(subjects))
    return fit, subjects, reached, best, figures


def trained(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str], Languages, Models, np.ndarray, dict[str, float]] | None:
    """The documents as numbers, the subjects, the languages, the final models, their thresholds, and figures on held-out labels. To look
    at small corpora: languages and models are brought to the driver, which ``found`` never does."""
    got = fitted(documents, areas, labels)
    if got is None:
        return None
    fit, subjects, _, best, figures = got
    part = Part(fit.sent(whole=True).toArrow(), fit.names, len(subjects), fit.sums, fit.paired)
    return fit.docs, subjects, part.languages, part.models, np.array(THRESHOLDS)[best] * scale(len(subjects)), figures


def found(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject) of every document."""
    got = fitted(documents, areas, labels)
    if got is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string")
    _, subjects, reached, best, _ = got
    asked = reached.filter(F.col("i") >= F.array(*(F.lit(int(i)) for i in best))[F.col("k").cast("int")])
    return asked.select("doc_id", F.array(*map(F.lit, subjects))[F.col("k").cast("int")].alias("subject")).distinct()
