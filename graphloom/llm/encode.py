"""Problem 6: encoding of the whole corpus with a public byte-level BPE.

Batched merge rounds in numpy. The texts of a batch are cut into words by the tokenizer's pattern;
each distinct word enters one flat array of symbols once. A round looks up the rank of every adjacent
pair of one word by binary search over the sorted pair keys, takes the lowest rank of each word, and
merges that pair wherever it stands in the word, from the left and without overlap. Rounds go on
with the words that changed until no word has a known pair. Very long words (unbroken runs of
thousands of bytes) would need a round for each different pair, so they are merged by a heap over a
linked list instead; the ids are the same.

The merge table (50,000 entries, whatever the corpus) is broadcast. Nothing is shuffled but rows of
scans that have fewer partitions than the cluster has cores.

Defined cases: a null or empty text gives an empty list; text that looks like a special token is
plain text; lone surrogates can't occur in Spark strings. Every row gives a row, repeated ones too, since telling them
apart would shuffle the corpus; rows without an id give none; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.sources.tables import spread

#: Folder of the public vocabularies.
VOCABULARIES = "/opt/tokenizers"
#: The split pattern of the byte-level vocabularies: a fixed value, published with them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Symbols from which a word is merged by the heap.
LONG_WORD = 512
#: Characters of text encoded at a time.
BATCH_CHARS = 2_000_000
_NONE = np.iinfo(np.int32).max
#: The encoder of this worker process, by vocabulary; it is built once, not once a partition.
_BUILT: dict[str, Encoder] = {}


class Encoder:
    """Encodes words given the ranks of a byte-level vocabulary (token bytes by id)."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens)}
        self.byte_id = np.zeros(256, dtype=np.int32)
        for b in range(256):
            self.byte_id[b] = ids[bytes([b])]
        left, right, rank = [], [], []
        for i, t in enumerate(tokens):
            if len(t) > 1 and (pair := self._parts(t, ids, i)):
                left.append(ids[pair[0]])
                right.append(ids[pair[1]])
                rank.append(i)
        keys = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(rank, dtype=np.int32)[order]
        self.table = dict(zip(keys.tolist(), rank, strict=True))
        self.cache: dict[str, np.ndarray] = {}

    @staticmethod
    def _parts(token: bytes, ids: dict[bytes, int], rank: int) -> tuple[bytes, bytes] | None:
        """The two parts that the token is merged from, when only lower ranks have been merged."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda k: ids.get(parts[k] + parts[k + 1], _NONE))
            if ids.get(parts[at] + parts[at + 1], _NONE) >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.ranks[at], _NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of many words in a row, and the words' lengths: the same after all merges."""
        done_sym: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        sym = symbols
        while len(sym):
            same = word[1:] == word[:-1]
            rank = np.full(len(sym), _NONE, dtype=np.int32)
            rank[:-1][same] = self._rank(sym[:-1][same], sym[1:][same])
            first = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            live = lowest != _NONE
            if not live.all():
                keep = np.repeat(live, size)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, rank = sym[keep], word[keep], rank[keep]
                lowest, size = lowest[live], size[live]
                if not len(sym):
                    break
            hit = rank == np.repeat(lowest, size)
            # runs of overlapping hits (a a a): every second one, from the left
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():
                fresh = np.r_[True, np.diff(at) > 1]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym = sym.copy()
            sym[at] = rank[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        all_sym, all_word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(all_word, kind="stable")
        return all_sym[order], np.bincount(all_word, minlength=len(lengths))

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One word of any length: a heap of (rank, place) over a linked list, in n log n."""
        sym, n = symbols.tolist(), len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        get = self.table.get
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := get(r << 32 | sym[k])) is not None:
                    heapq.heappush(heap, (x, i, r, sym[k]))
            if (h := before[i]) >= 0 and (x := get(sym[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, sym[h], r))
        return np.array([s for s in sym if s >= 0], dtype=np.int32)

    def words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        raw = [w.encode() for w in words]
        out: list[np.ndarray | None] = [None] * len(raw)
        short = [i for i, b in enumerate(raw) if len(b) < LONG_WORD]
        for i, b in enumerate(raw):
            if len(b) >= LONG_WORD:
                out[i] = self.merge_long(self.byte_id[np.frombuffer(b, dtype=np.uint8)])
        if short:
            flat = self.byte_id[np.frombuffer(b"".join(raw[i] for i in short), dtype=np.uint8)]
            sym, lengths = self.merge(flat, np.array([len(raw[i]) for i in short]))
            ends = np.cumsum(lengths)
            for i, a, b in zip(short, ends - lengths, ends, strict=True):
                out[i] = sym[a:b]
        return out  # type: ignore[return-value]

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        import regex

        pattern = regex.compile(PATTERN)
        cut = [pattern.findall(t) if t else [] for t in texts]
        new = list({w for ws in cut for w in ws if w not in self.cache})
        if len(self.cache) + len(new) > 500_000:  # the cache only saves time; it starts anew when it is large
            self.cache.clear()
            new = list({w for ws in cut for w in ws})
        self.cache.update(zip(new, self.words(new), strict=True))
        empty = np.array([], dtype=np.int32)
        return [np.concatenate([self.cache[w] for w in ws]) if ws else empty for ws in cut]


def vocabulary(path: str) -> list[bytes]:
    """Token bytes by id from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [tokens[i] for i in range(len(tokens))]


def ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = VOCABULARIES, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, ids) of each document. The vocabulary file is read on the driver and broadcast as it is (under 1 MB)."""
    spark = documents.sparkSession
    tokens = spark.sparkContext.broadcast(vocabulary(f"{folder.rstrip('/')}/{name}"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (key := f"{folder}/{name}") not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Encoder(tokens.value)
        encoder = _BUILT[key]
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            sizes = np.cumsum([len(t or "") for t in texts])
            part = sizes // BATCH_CHARS
            for p in range(int(part[-1]) + 1 if len(part) else 0):
                at = np.flatnonzero(part == p)
                if len(at):
                    yield pd.DataFrame({"id": pdf["id"].iloc[at].to_numpy(), "ids": encoder.texts([texts[i] for i in at])})

    rows = spread(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null"), "id")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInPandas(encode, schema).withColumnRenamed("id", id_col)
