"""Problem 2: matching entities across sources without keys.

Each record becomes a name (marks, case, order, articles and bracketed notes don't count; a trailing
number is kept apart), a kind, makers, years, platforms and regions; what a column lacks is read from the
description where it says it. The q-grams of a name's words, unordered pairs of letters next to each other or with one between, set one
bit each of a fixed vector of 256 bits: two letters swapped change four of them, a letter lost, added or changed seven or eight.
Close vectors are found exactly by multi-index hashing within kind and number. A vector is cut into four chunks of 64 bits; of two vectors
at a distance of at most ``RADIUS`` = 14 one chunk is at a distance of at most 3 (or 2, the last), because 4 + 4 + 4 + 3
is 15. Two chunks at a distance of d are the same when the bits that only one of them has are left out, d in all; so the keys of a
chunk are what remains of it without up to 3 or 2 of its bits, which are some 350 for a name, and two chunks meet at exactly one key,
that of all the bits they share. Names with few bits would all be near each other: from 8 to 15 bits the distance is at most
``SHORT_RADIUS`` = 5, found by halves without up to 2 bits, and below 8 only the same vector will do; so a key is always of many bits.
Keys aren't exchanged. A name goes, four times a chunk at most, to the lowest bit that stays in its keys, its route; the keys of a route are made,
sorted and compared there by numpy, some two million at a time: a route with more goes on by its next bit, one of a million rows does so before
the exchange. One chunk is searched after the other, and shuffle files are removed after each step, so the disk holds those of one step.
Pairs that met get their distance
from the vectors. Pairs then get a Dice score for each field; a logistic weighting of the fields, fitted to the pairs that are already
aligned, turns them into calibrated confidences. The best item of each entity is accepted from 0.5.

The fit takes at most ``FIT_ROWS`` labelled candidate pairs, chosen by hash; everything else covers all
rows. Distinct names are searched, not rows, so a name repeated a million times costs one search.

Defined cases: repeated rows and triples count once; a null or blank label is replaced by the entity's
own name; missing attributes neither support nor oppose; without aligned pairs fixed weights serve;
entities without triples are matched by name alone; of equal confidences the least uri wins; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.hashing import mixed
from graphloom.llm.names import LEGAL, NICKNAMES, fold
from graphloom.sources.tables import cut

BASE = "http://lanternkb.example/kb/"
KINDS = ("VideoGame", "Character", "Location", "Item", "Organization")
BITS = 256
#: Bits left out of each chunk, of names with many bits and with few; the greatest distance that is found is one less than the sum of what each chunk bridges.
LEFT_OUT, SHORT_LEFT_OUT = (3, 3, 3, 2), (2, 2)
RADIUS, SHORT_RADIUS = (sum(a + 1 for a in x) - 1 for x in (LEFT_OUT, SHORT_LEFT_OUT))
#: Bits from which a name is a long one, and below which only the same vector will do.
LONG, LEAST_BITS = 16, 8
#: Rows from which routes are searched, keys made and pairs compared at a time; rows of a route from which it is split before the exchange, into as many as DEEPEST bits tell.
ROWS, BLOCK, HOT_ROUTE, DEEPEST = 20_000, 2_000_000, 1_000_000, 5
FIT_ROWS = 40_000
ACCEPT = 0.5
#: Articles and the like, and short forms of titles: fixed values.
STOP = frozenset("the of a an s".split())
TITLES = {"prof": "professor", "capt": "captain", "dr": "doctor", "ldy": "lady", "k": "king", "q": "queen", "l": "lady", "o": "old", "sys": "systems", "c": "captain", "p": "professor", "d": "doctor"}
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}


def name_parts(s: str | None) -> tuple[str, str]:
    """(sorted words, number) of a name."""
    s = re.sub(r"\([^)]*\)|__\d+$", " ", fold(s or ""))
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])|(?<=[a-z])(?=\d)", " ", s).lower()
    s = re.sub(r"['’]s\b", " ", s)
    ts = [ROMAN.get(t, t) if i else t for i, t in enumerate(re.findall(r"[^\W_]+", s))]
    number = next((t for t in ts[1:] if t.isdigit() and len(t) <= 2), "")
    ws = [TITLES.get(t, t) if len(ts) > 1 else t for t in ts if t not in STOP and not (t.isdigit() and t == number)]
    return " ".join(sorted(ws)), number


def maker_parts(s: str | None) -> str:
    """Sorted words of a maker's name, without legal forms, nicknames in full."""
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", fold(re.sub(r"\([^)]*\)", " ", s or ""))).lower()
    s = re.sub(r"\b(?:[^\W\d_]\.){2,}", " ", s)
    ws = [NICKNAMES.get(t, t) for t in re.findall(r"[^\W_]+", s) if t not in LEGAL]
    return " ".join(sorted(ws))


def grams(words: str) -> frozenset[str]:
    return frozenset(g for w in words.split() for g in (map("".join, zip(f"^{w}", f"{w}$", strict=True))))


def dice(a: frozenset[str], b: frozenset[str]) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def skip_grams(words: str) -> frozenset[str]:
    """Unordered pairs of letters of a word, next to each other or with one between."""
    out = set()
    for w in words.split():
        p = f"^{w}$"
        for d in (1, 2):
            out |= {x + y if x < y else y + x for x, y in zip(p, p[d:], strict=False)}
    return frozenset(out)


def _bit(gram: str) -> int:
    h = zlib.crc32(gram.encode())
    for _ in range(2):
        h = ((h ^ (h >> 16)) * 0x45D9F3B) & 0xFFFFFFFF
    return (h ^ (h >> 16)) % BITS


def vector(words: str) -> list[int]:
    """The bit vector of a name, as four signed 64-bit numbers."""
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[[_bit(g) for g in skip_grams(words)]] = 1
    return np.packbits(bits).view(">i8").astype(np.int64).tolist()


_RECORD = "id string, names array<string>, number string, kinds array<string>, makers array<string>, years array<int>, platforms array<string>, regions array<string>"


def _platform(s: str) -> str:
    return re.sub(r"console|[^a-z0-9]", "", fold(s).lower())


def _record(id_: str, names: list[str | None], kinds: list[str], makers: list[str], years: list[int], platforms: list[str], regions: list[str]) -> list[tuple]:
    parts = sorted({p for n in names if n and n.strip() and (p := name_parts(n))[0]})
    rest = (
        [k for k in KINDS if k in kinds] or list(KINDS),
        sorted({m for x in makers if x and (m := maker_parts(x))}),
        sorted(set(years)),
        sorted({p for x in platforms if x and (p := _platform(x))}),
        sorted({p for x in regions if x and (p := name_parts(x)[0])}),
    )
    return [(id_, sorted(w for w, n in parts if n == number), number, *rest) for number in sorted({n for _, n in parts})]


def _listed(x: object) -> list:
    return [] if x is None else [v for v in x if v is not None]  # type: ignore[attr-defined]


def _own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    local = lambda v: v.rsplit("/", 1)[-1].replace("_", " ") if v.startswith("http") else v
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            labels = [x for x in {*_listed(r.labels), *_listed(r.kb_labels)} if x.strip()]
            years = [int(y) for v in _listed(r.years) for y in re.findall(r"\b(?:19|20)\d\d\b", v)]
            rows += _record(r.private_entity, labels or [r.private_entity.replace("_", " ")], [local(k).replace(" ", "") for k in _listed(r.kinds)], [local(m) for m in _listed(r.makers)], years, [local(p) for p in _listed(r.platforms)], [local(p) for p in _listed(r.regions)])
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RECORD.split(", ")])


#: How descriptions say what a thing is: fixed values.
_SAYS = [
    ("VideoGame", r"\b(?:video )?game (?:for|by)\b|video game$"), ("Organization", r"studio|company|developer|publisher"), ("Location", r"place|setting|location"),
    ("Character", r"character"), ("Item", r"object|item"),
]


def _other(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            text = r.description if isinstance(r.description, str) else ""
            kind = next((k for k, p in _SAYS if re.search(p, text)), "")
            said = lambda p, text=text: [m.group(1) for m in re.finditer(p, text)]
            aka = [x for x in (r.also_known_as or "").split("|") if x.strip()] if isinstance(r.also_known_as, str) else []
            years = [int(r.inception_year)] if r.inception_year == r.inception_year and r.inception_year is not None else [int(y) for y in said(r"\b((?:19|20)\d\d)\b")]
            makers = [r.creator] if isinstance(r.creator, str) else said(r"\bby (.+)$")
            platforms = [r.platform] if isinstance(r.platform, str) else said(r"game for (.+)$")
            regions = [r.region_name] if isinstance(r.region_name, str) else said(r"\bin ([A-Z].+)$")
            rows += _record(r.wikidata_uri, [r.item_label if isinstance(r.item_label, str) else None, *aka], [kind], makers, years, platforms, regions)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RECORD.split(", ")])


def own_records(mapping: DataFrame, kb: DataFrame) -> DataFrame:
    """Records of the graph's own things, from their triples."""
    prop = F.regexp_extract("p", r"([^/#]+)$", 1)
    pick = lambda name: F.collect_set(F.when(F.col("_p") == name, F.col("o")))
    facts = (
        kb.filter(F.col("s").startswith(BASE) & F.col("o").isNotNull()).select(F.expr(f"substring(s, {len(BASE) + 1})").alias("private_entity"), prop.alias("_p"), "o").distinct()
        .groupBy("private_entity").agg(pick("label").alias("kb_labels"), pick("type").alias("kinds"), pick("createdBy").alias("makers"), pick("firstYear").alias("years"), pick("onPlatform").alias("platforms"), pick("locatedIn").alias("regions"))
    )
    things = mapping.filter(F.col("private_entity").isNotNull() & F.col("status").isin("new_entity", "aligned_vip", "aligned_api")).groupBy("private_entity").agg(F.collect_set("label").alias("labels"))
    return things.join(facts, "private_entity", "left").mapInPandas(_own, _RECORD)


def other_records(items: DataFrame) -> DataFrame:
    cols = ("wikidata_uri", "item_label", "description", "also_known_as", "inception_year", "creator", "platform", "region_name")
    return items.filter("wikidata_uri is not null").select(*cols).distinct().mapInPandas(_other, _RECORD)


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        v = np.array([vector(x) for x in pdf["name"]], dtype=np.int64).reshape(len(pdf), 4)
        yield pd.DataFrame({"part": pdf["part"], "name": pdf["name"], **{f"v{i}": v[:, i] for i in range(4)}})


def _vectors(names: DataFrame) -> DataFrame:
    """Distinct (part, name) with their vectors; part: what has to be equal."""
    return names.filter("name <> ''").distinct().mapInPandas(_encode, "part string, name string, v0 long, v1 long, v2 long, v3 long")


def _routed(depth: int) -> str:
    """SQL: the ways of leaving out bits of v, besides those in gone, up to the next one that stays: (gone, place of the one that stays, or 64)."""
    rest = f"slice(filter(sequence(0, 63), b -> getbit(v & ~gone, b) = 1), {depth}, 64)"
    out = "aggregate(slice(bits, 1, n), gone, (g, b) -> g | shiftleft(1L, b))"
    ways = f"transform(sequence(0, least(most - bit_count(gone), size(bits))), n -> struct({out} AS gone, coalesce(get(bits, n), 64) AS place))"
    return f"element_at(transform(array({rest}), bits -> {ways}), 1)"


def _further(routes: DataFrame, depth: int) -> DataFrame:
    """The routes one bit further: an exchange group becomes one for each next bit that stays."""
    ways = routes.withColumn("way", F.explode(F.expr(_routed(depth))))
    return ways.selectExpr("xxhash64(route, way.place) AS route", "id", "side", "v", "way.gone AS gone", "most", f"cast({depth} AS byte) AS depth", "fold0", "fold1")


def routes(vectors: DataFrame, side: int, i: int) -> DataFrame:
    """(route, id, side, v, gone, most, depth, fold0, fold1): chunk i of each vector (id, part, v0 to v3, bits), with the bits below the lowest
    that stays left out. Two chunks that meet have a route in common, so keys are made and compared where the route is.
    most: how many bits two vectors may leave out together; folds: the vector in 128 bits, in which two are no further apart than they are."""
    long, halves = f"struct(1 AS family, v{i} AS v, {LEFT_OUT[i]} AS most)", ("v0 | v1", "v2 | v3")
    kinds = [f"if(bits >= {LONG}, array({long}), array())"]
    if i < len(halves):
        kinds.append(f"if(bits BETWEEN {LEAST_BITS} AND {LONG - 1 + SHORT_RADIUS}, array(struct(2 AS family, {halves[i]} AS v, {SHORT_LEFT_OUT[i]} AS most)), array())")
    if i == 0:
        kinds.append(f"if(bits < {LEAST_BITS}, array(struct(3 AS family, xxhash64(v0, v1, v2, v3) AS v, 0 AS most)), array())")
    chunks = vectors.selectExpr("part", "id", "v0 ^ v1 AS fold0", "v2 ^ v3 AS fold1", f"explode(concat({', '.join(kinds)})) AS c")
    return _further(chunks.selectExpr(f"xxhash64(part, c.family, {i}) AS route", "id", f"cast({side} AS byte) AS side", "c.v AS v", "0L AS gone", "cast(c.most AS byte) AS most", "fold0", "fold1"), 1)


#: Columns of routes, as numpy arrays of the same length.
Routes = dict[str, np.ndarray]


def _masks(rest: np.ndarray, most: int) -> np.ndarray:
    """For each number, all of which have equally many bits: its subsets of at most ``most`` bits."""
    bits = np.empty((int(np.bitwise_count(rest[0])), len(rest)), dtype=np.uint64)
    for i in range(len(bits)):
        bits[i] = rest & (~rest + np.uint64(1))
        rest = rest ^ bits[i]
    sets = [x for n in range(min(most, len(bits)) + 1) for x in combinations(range(len(bits)), n)]
    return np.stack([np.bitwise_or.reduce(bits[list(x)], axis=0) if x else np.zeros(len(rest), dtype=np.uint64) for x in sets], axis=1)


@cache
def _ways(n: int, most: int) -> int:
    """Subsets of at most ``most`` of ``n`` bits."""
    return sum(comb(n, i) for i in range(most + 1))


def _sizes(r: Routes) -> np.ndarray:
    """The number of keys of each route."""
    kinds, of = np.unique(r["n"].astype(np.int64) * 8 + r["left"], return_inverse=True)
    return np.array([_ways(*divmod(int(k), 8)) for k in kinds], dtype=np.int64)[of]


def _parts(weights: np.ndarray) -> Iterator[slice]:
    """Slices of at most ``BLOCK`` in weight, or of one."""
    ends, at = np.cumsum(weights), 0
    while at < len(ends):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        yield slice(at, last)
        at = last


def _keyed(r: Routes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, gone) of the routes, sorted by key."""
    out = []
    kind = r["n"].astype(np.int64) * 8 + r["left"]
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        gone = r["gone"][rows][:, None] | _masks(r["rest"][rows], int(k) % 8)
        key = mixed(r["route"][rows][:, None] ^ mixed(r["v"][rows][:, None] & ~gone, 1), 2)
        out.append((key.ravel(), np.repeat(rows, key.shape[1]), gone.ravel()))
    key, row, gone = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(key)
    return key[order], row[order], gone[order]


def _deeper(r: Routes) -> Routes:
    """The routes one bit further, sorted."""
    out = []
    gone, rest = r["gone"], r["rest"]
    for t in range(int(r["left"].max()) + 1):
        of = np.flatnonzero((r["left"] >= t) & (r["n"] >= t))
        stays = rest[of] & (~rest[of] + np.uint64(1))
        out.append({c: x[of] for c, x in r.items()} | {"gone": gone[of], "rest": rest[of] ^ stays, "route": mixed(r["route"][of] ^ mixed(stays, 3), 4)})
        low = rest & (~rest + np.uint64(1))
        gone, rest = gone | low, rest ^ low
    done = _open({c: np.concatenate([x[c] for x in out]) for c in r})
    order = np.argsort(done["route"], kind="stable")
    return {c: x[order] for c, x in done.items()}


def _open(r: Routes) -> Routes:
    """With the numbers of bits that are still open and that may still be left out."""
    return r | {"n": np.bitwise_count(r["rest"]), "left": r["most"] - np.bitwise_count(r["gone"])}


def _searched(r: Routes) -> Iterator[pd.DataFrame]:
    """The pairs that meet, of whole routes in their order. Many small routes are searched at a time; a large one goes on by its next bit."""
    new = np.r_[True, r["route"][1:] != r["route"][:-1]]
    run = np.cumsum(new) - 1
    has = [np.bincount(run[r["side"] == s], minlength=run[-1] + 1) > 0 for s in (0, 1)]
    r = {c: x[(has[0] & has[1])[run]] for c, x in r.items()}
    if not len(r["id"]):
        return
    at = np.flatnonzero(np.r_[True, r["route"][1:] != r["route"][:-1]])
    keys, ends = np.add.reduceat(_sizes(r), at), np.r_[at[1:], len(r["id"])]
    for part in _parts(keys):
        some = {c: x[at[part.start] : ends[part.stop - 1]] for c, x in r.items()}
        if keys[part.start] > BLOCK and some["n"].any():
            yield from _searched(_deeper(some))
        else:
            yield from _paired(some)


def _paired(r: Routes) -> Iterator[pd.DataFrame]:
    """The pairs that meet at the keys of all routes."""
    key, row, gone = _keyed(r)
    side = r["side"][row]
    run = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    in_b = np.bincount(run[side == 1], minlength=run[-1] + 1)
    b, first = np.flatnonzero(side == 1), np.cumsum(in_b) - in_b
    a = np.flatnonzero((side == 0) & (in_b[run] > 0))
    for part in _parts(in_b[run[a]]):
        k = in_b[run[a[part]]]
        x = np.repeat(a[part], k)
        y = b[np.arange(len(x)) + np.repeat(first[run[a[part]]] - np.cumsum(k) + k, k)]
        few = (gone[x] & gone[y] == 0) & (np.bitwise_count(gone[x]) + np.bitwise_count(gone[y]) <= r["most"][row[x]])
        x, y = row[x[few]], row[y[few]]
        near = np.bitwise_count(r["fold0"][x] ^ r["fold0"][y]) + np.bitwise_count(r["fold1"][x] ^ r["fold1"][y]) <= RADIUS
        yield pd.DataFrame({"id_a": r["id"][x[near]], "id_b": r["id"][y[near]]})


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that meet, of rows that are sorted by route."""

    def searched(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        r = {c: pdf[c].to_numpy() for c in pdf.columns}
        r |= {c: np.ascontiguousarray(r[c]).view(np.uint64) for c in ("route", "v", "gone", "fold0", "fold1")}
        rest = r["v"] & ~r["gone"]
        for d in range(int(r["depth"].max())):
            rest = np.where(r["depth"] > d, rest & (rest - np.uint64(1)), rest)
        yield from _searched(_open(r | {"rest": rest}))

    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        rows += len(pdf)
        last = pdf["route"].iloc[-1]
        if rows >= ROWS and held[0]["route"].iloc[0] != last:
            some = pd.concat(held)
            whole = int((some["route"] != last).to_numpy().sum())
            yield from searched(some[:whole])
            held, rows = [some[whole:]], len(some) - whole
    if held:
        yield from searched(pd.concat(held))


def _split(rows: DataFrame) -> DataFrame:
    """The routes, those of many rows further by the bits that tell their rows apart."""
    done, depth = [], 1
    while depth < DEEPEST:
        hot = cut(rows.groupBy("route").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_ROUTE).select("route"), free=True)
        if hot.isEmpty():
            break
        done.append(rows.join(F.broadcast(hot), "route", "left_anti"))
        depth += 1
        rows = _further(rows.join(F.broadcast(hot), "route", "left_semi"), depth)
    return reduce(DataFrame.unionByName, [*done, rows])


def met(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of vectors with a chunk that differs in few enough bits, once for each such chunk, and folds that are near too.
    One chunk is searched after the other, so only the routes of one are on disk."""
    # partitions are needed for the keys that are made there, not for the routes
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), a.sparkSession.sparkContext.defaultParallelism)
    many = a.count() + b.count() >= HOT_ROUTE  # else no route has as many rows
    found = []
    for i in range(len(LEFT_OUT)):
        rows = routes(a, 0, i).unionByName(routes(b, 1, i))
        rows = (_split(rows) if many else rows).repartition(parts, "route").sortWithinPartitions("route")
        found.append(cut(rows.mapInPandas(_met, "id_a long, id_b long"), free=True))
    return reduce(DataFrame.unionByName, found)


def near_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """(part, name_a, name_b): all pairs of names (columns part, name) whose vectors differ in at most ``RADIUS`` bits, ``SHORT_RADIUS`` if one is short."""
    # a row becomes some 15 routes, so partitions are needed for the output, not for the small input
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), a.sparkSession.sparkContext.defaultParallelism)
    bits = sum((F.bit_count(f"v{i}") for i in range(1, 4)), F.bit_count("v0"))
    va, vb = (cut(_vectors(df).withColumns({"id": F.xxhash64("part", "name"), "bits": bits}).repartition(parts, "id"), free=True) for df in (a, b))
    close = met(va, vb).distinct()
    side = lambda v, s: v.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "part", "name", "bits", "v0", "v1", "v2", "v3")))
    named = close.join(side(va, "a"), "id_a").join(side(vb, "b"), "id_b").filter("part_a = part_b")
    apart = sum((F.bit_count(F.col(f"v{i}_a").bitwiseXOR(F.col(f"v{i}_b"))) for i in range(1, 4)), F.bit_count(F.col("v0_a").bitwiseXOR(F.col("v0_b"))))
    least = F.least("bits_a", "bits_b")
    radius = F.when(least >= LONG, RADIUS).when(least >= LEAST_BITS, SHORT_RADIUS).otherwise(0)
    return cut(named.filter(apart <= radius).select(F.col("part_a").alias("part"), "name_a", "name_b"), free=True)


FEATURES = ("name", "word", "maker", "maker_differs", "year", "year_differs", "platform", "platform_differs", "region", "region_differs")
#: Weights where no aligned pairs are known: intercept, then the features.
DEFAULT_WEIGHTS = (-10.0, 7.0, 4.0, 4.0, -4.0, 2.5, -3.0, 1.5, -1.5, 1.0, -1.0)


def _least_word(xs: list[str], ys: list[str]) -> float:
    """Of the best pair of names: the similarity of the word that has the least like it on the other side."""
    best = 0.0
    for x in xs:
        for y in ys:
            a, b = sorted((x.split(), y.split()), key=len)
            best = max(best, min((max(dice(grams(v), grams(w)) for w in b) for v in a), default=0.0))
    return best


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    best = lambda xs, ys: max((dice(grams(x), grams(y)) for x in xs for y in ys), default=None)
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            name = best(r.names, r.names_b) or 0.0
            maker = best(r.makers, r.makers_b)
            gap = min((abs(int(x) - int(y)) for x in r.years for y in r.years_b), default=None)
            plat = None if not len(r.platforms) or not len(r.platforms_b) else bool(set(r.platforms) & set(r.platforms_b))
            reg = None if not len(r.regions) or not len(r.regions_b) else bool(set(r.regions) & set(r.regions_b))
            rows.append((r.id, r.id_b, name, _least_word(r.names, r.names_b), maker or 0.0, 0.0 if maker is None else float(maker < 0.55), 0.0 if gap is None else float(gap <= 1), 0.0 if gap is None else float(min(max(gap - 1, 0), 3)), float(plat is True), float(plat is False), float(reg is True), float(reg is False)))
        yield pd.DataFrame(rows, columns=["id", "id_b", *FEATURES])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic model by Newton steps with a small ridge."""
    if len(y) < 20 or y.min() == y.max():
        return DEFAULT_WEIGHTS
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 0.1 * np.r_[0, w[1:]]
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def _confidence(weights: tuple[float, ...]) -> Column:
    z = F.lit(weights[0])
    for w, c in zip(weights[1:], FEATURES, strict=True):
        z = z + F.lit(w) * F.col(c)
    return 1 / (1 + F.exp(-z))


def scored(mapping: DataFrame, kb: DataFrame, items: DataFrame) -> DataFrame:
    """(private_entity, wikidata_uri, confidence) of every candidate pair of entities that aren't aligned yet."""
    own, other = cut(own_records(mapping, kb), free=True), cut(other_records(items), free=True)
    named = lambda df: df.withColumn("kind", F.explode("kinds")).select("id", F.concat_ws("|", "kind", "number").alias("part"), F.explode("names").alias("name"))
    a, b = named(own), named(other).withColumnRenamed("id", "id_b")
    near = near_names(*(df.select("part", "name") for df in (a, b)))
    pairs = cut(near.join(a.withColumnRenamed("name", "name_a"), ["part", "name_a"]).join(b.withColumnRenamed("name", "name_b"), ["part", "name_b"]).select("id", "id_b").distinct(), free=True)
    merged = lambda df: df.groupBy("id").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("names", "makers", "years", "platforms", "regions")))
    right = merged(other)
    right = right.select(*(F.col(c).alias(f"{c}_b") for c in right.columns))
    rows = cut(pairs.join(merged(own), "id").join(right, "id_b").mapInPandas(_features, "id string, id_b string, " + ", ".join(f"{f} double" for f in FEATURES)), free=True)
    aligned = mapping.filter(F.col("status").isin("aligned_vip", "aligned_api") & F.col("wikidata_uri").startswith("http")).select(F.col("private_entity").alias("id"), F.col("wikidata_uri").alias("_uri")).distinct()
    known = rows.join(aligned, "id").groupBy("id", "id_b", *FEATURES).agg(F.max((F.col("id_b") == F.col("_uri")).cast("double")).alias("_same"))
    sample = known.orderBy(F.xxhash64("id", "id_b"), "id", "id_b").limit(FIT_ROWS).toPandas()
    weights = fit(sample[list(FEATURES)].to_numpy(dtype=float), sample["_same"].to_numpy(dtype=float))
    new = mapping.filter("status = 'new_entity'").select(F.col("private_entity").alias("id")).distinct()
    return rows.join(new, "id", "left_semi").select(F.col("id").alias("private_entity"), F.col("id_b").alias("wikidata_uri"), _confidence(weights).alias("confidence"))


def found(mapping: DataFrame, kb: DataFrame, items: DataFrame) -> DataFrame:
    """(private_entity, wikidata_uri) of the accepted pairs."""
    best = scored(mapping, kb, items).groupBy("private_entity").agg(F.max("confidence").alias("confidence"), F.max_by("wikidata_uri", F.struct("confidence", F.reverse("wikidata_uri"))).alias("wikidata_uri"))
    return best.filter(F.col("confidence") >= ACCEPT).select("private_entity", "wikidata_uri")
