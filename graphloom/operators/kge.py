"""Embeddings of graphs: preparation, training, ranking, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import fixed, vectors
from graphloom.sources.tables import cut


def cleaned(triples: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """The distinct links between IRIs, without properties that embeddings don't take."""
    return triples.filter("o_kind = 'uri'").filter(~F.col("p").isin(*(fixed.EMBEDDING_SKIP if skip is None else skip))).select("s", "p", "o").distinct()


def cleaning_counters(triples: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """One row: links read, skipped by property, repeated, kept; entities and relations kept. Skipping comes before the test for repeats."""
    skip = fixed.EMBEDDING_SKIP if skip is None else skip
    grouped = triples.filter("o_kind = 'uri'").groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n")).withColumn("_skip", F.col("p").isin(*skip))
    kept = grouped.filter(~F.col("_skip"))
    counts = grouped.agg(F.sum("n").alias("parsed"), F.coalesce(F.sum(F.when(F.col("_skip"), F.col("n"))), F.lit(0)).alias("skipped"), F.coalesce(F.sum(F.when(~F.col("_skip"), F.col("n") - 1)), F.lit(0)).alias("duplicates"), F.count_if(~F.col("_skip")).alias("kept"))
    entities = kept.select(F.explode(F.array("s", "o")).alias("e")).distinct().agg(F.count(F.lit(1)).alias("entities"))
    return counts.crossJoin(entities).crossJoin(kept.select("p").distinct().agg(F.count(F.lit(1)).alias("relations")))


def split_key(seed: int = 42) -> Column:
    """A reproducible random order of triples."""
    return F.md5(F.concat_ws("\u0001", "s", "p", "o", F.lit(str(seed))))


def split(links: DataFrame, train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """Links with their part. The global rank comes from a range partitioning: counts of partitions, then ranks within them. The ranked rows are
    written once, so that no recomputation can rank them anew."""
    keyed = links.withColumn("_key", split_key(seed))
    spark = links.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(keyed.repartitionByRange(parts, "_key").sortWithinPartitions("_key").withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, before, offsets = sum(sizes.values()), 0, {}
    for p in sorted(sizes):
        offsets[p] = before
        before += sizes[p]
    offset = F.create_map(*(F.lit(x) for p, o in offsets.items() for x in (p, o))) if offsets else F.create_map(F.lit(0), F.lit(0))
    rank = F.col("_i") + offset[F.col("_part")]
    a, b = int(total * train), int(total * train) + int(total * valid)
    return ordered.withColumn("part", F.when(rank < a, "train").when(rank < b, "valid").otherwise("test")).drop("_key", "_part", "_i")


def repair_leakage(parts: DataFrame) -> DataFrame:
    """Links of the other parts with an end that training doesn't have go to training; one round is enough, as training only grows."""
    known = parts.filter("part = 'train'").select(F.explode(F.array("s", "o")).alias("e")).distinct()
    s, o = (known.select(F.col("e").alias(c), F.lit(True).alias(f"_{c}")) for c in "so")
    rel = parts.filter("part = 'train'").select("p").distinct().withColumn("_p", F.lit(True))
    seen = parts.join(s, "s", "left").join(o, "o", "left").join(rel, "p", "left")
    return seen.withColumn("part", F.when(F.col("_s").isNull() | F.col("_o").isNull() | F.col("_p").isNull(), "train").otherwise(F.col("part"))).select("s", "p", "o", "part")


def dictionary(values: DataFrame, name: str) -> DataFrame:
    """(name, id): distinct values numbered from 0 in their order; ranks within ranges of a range partitioning, as in ``split``."""
    distinct = values.select(name).filter(F.col(name).isNotNull()).distinct()
    ordered = cut(distinct.repartitionByRange(name).sortWithinPartitions(name).withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    before, offsets = 0, {}
    for r in ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        offsets[r["_part"]] = before
        before += r["n"]
    offset = F.create_map(*(F.lit(x) for p, o in (offsets or {0: 0}).items() for x in (p, o)))
    return ordered.select(name, (F.col("_i") + offset[F.col("_part")]).cast("long").alias("id"))


def encode(links: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(h, r, t) ids; links with an unknown end are dropped. entities: (uri, id), relations: (uri, id)."""
    e = lambda a, b: entities.select(F.col("uri").alias(a), F.col("id").alias(b))
    return links.join(e("s", "h"), "s").join(e("o", "t"), "o").join(relations.select(F.col("uri").alias("p"), F.col("id").alias("r")), "p").select("h", "r", "t")


def last_types(triples: DataFrame, order: Column) -> DataFrame:
    """(s, type): of several types of a subject the last in the given order."""
    return triples.groupBy("s").agg(F.max_by("o", order).alias("type"))


#: Triples that a block of the training has at least, if there are as many, and at most, about.
LEAST_BLOCK, LARGEST_BLOCK = 5_000, 50_000


def _transe_step(e: np.ndarray, r: np.ndarray, h: np.ndarray, k: np.ndarray, t: np.ndarray, nh: np.ndarray, nt: np.ndarray, rate: float) -> None:
    """A margin step: the true translation has to be shorter than the corrupted one by one."""
    d, nd = e[h] + r[k] - e[t], e[nh] + r[k] - e[nt]
    a, b = np.linalg.norm(d, axis=1), np.linalg.norm(nd, axis=1)
    on = (1.0 + a - b > 0)[:, None]
    g, ng = on * d / np.maximum(a, 1e-9)[:, None], on * nd / np.maximum(b, 1e-9)[:, None]
    for ids, step in ((h, g), (t, -g), (nh, -ng), (nt, ng)):
        np.add.at(e, ids, -rate * step)
    np.add.at(r, k, -rate * (g - ng))


def complex_score(h: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Real part of the product of h, r and the conjugate of t; vectors hold their real parts, then their imaginary ones."""
    (a, b), (c, d), (x, y) = (np.split(v, 2, axis=-1) for v in (h, r, t))
    return (a * c * x + b * c * y + a * d * y - b * d * x).sum(axis=-1)


def _complex_step(e: np.ndarray, r: np.ndarray, h: np.ndarray, k: np.ndarray, t: np.ndarray, nh: np.ndarray, nt: np.ndarray, rate: float) -> None:
    """A logistic step on true and corrupted triples, with a small decay."""
    for hs, ts, y in ((h, t, 1.0), (nh, nt, -1.0)):
        eh, rk, et = e[hs], r[k], e[ts]
        (a, b), (c, d), (x, z) = (np.split(v, 2, axis=1) for v in (eh, rk, et))
        g = (-y / (1 + np.exp(np.clip(y * complex_score(eh, rk, et), -30, 30))))[:, None]
        np.add.at(e, hs, -rate * (g * np.hstack([c * x + d * z, c * z - d * x]) + 1e-4 * eh))
        np.add.at(e, ts, -rate * (g * np.hstack([a * c - b * d, b * c + a * d]) + 1e-4 * et))
        np.add.at(r, k, -rate * (g * np.hstack([a * x + b * z, a * z - b * x]) + 1e-4 * rk))


def _discard(df: DataFrame) -> None:
    """Removes the files of a checkpoint that nothing reads any more."""
    at = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()  # noqa: SLF001
    if at.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(at.get())  # noqa: SLF001
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def train(encoded: DataFrame, n_entities: int, n_relations: int, model: str = "transe", dim: int = 100, epochs: int = 50, rate: float | None = None, batch: int = 512, seed: int = 42) -> DataFrame:
    """(kind, id, vec): a model (``transe`` or ``complex``) trained in parallel blocks whose parameters are averaged after each epoch.

    Triples and parameters are tables; the driver holds neither. In each epoch a triple gets its corrupted end by a hash, from all entities;
    a block gets its triples and the parameters that they name, takes its batches one by one and hands the parameters back, whose
    mean over the blocks becomes the new row. Between epochs they are kept in single precision; old ones are removed.
    """
    width = dim if model == "transe" else 2 * dim
    step = {"transe": _transe_step, "complex": _complex_step}[model]
    rate = rate if rate is not None else {"transe": 0.01, "complex": 0.1}[model]
    spark = encoded.sparkSession
    triples = cut(encoded.select("h", "r", "t"))
    n = triples.count()
    # the mean of many blocks with few triples each would hardly move
    blocks = max(1, min(n // LEAST_BLOCK, max(spark.sparkContext.defaultParallelism, -(-n // LARGEST_BLOCK))))
    triples = triples.withColumn("block", F.pmod(F.xxhash64("h", "r", "t", F.lit(seed)), F.lit(blocks)))
    single = pa.list_(pa.float32())

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            k = rows.column("k").to_numpy()
            if not len(k):
                continue
            rng = np.random.default_rng([seed, abs(int(k[0])), int(k[0] < 0)])
            x = rng.uniform(-6 / np.sqrt(dim), 6 / np.sqrt(dim), (len(k), dim)) if model == "transe" else rng.normal(0, 0.3, (len(k), width))
            if model == "transe":
                x[k < 0] /= np.linalg.norm(x[k < 0], axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([rows.column("k"), pa.array(list(x.astype(np.float32)), single)], ["k", "vec"])

    def trained(epoch: int):  # noqa: ANN202
        def run(rows: pa.Table, params: pa.Table) -> pa.Table:
            k = params.column("k").to_numpy()
            order = np.argsort(k)
            k, x = k[order], _matrix(params, width)[order]
            first = int(np.searchsorted(k, 0))  # relations have the keys below 0
            r, e = x[:first], x[first:]
            if model == "transe":
                e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
            h, t, other, p, head, b = (rows.column(c).to_numpy() for c in ("h", "t", "other", "p", "head", "block"))
            mixed = np.random.default_rng([seed, epoch, int(b[0])]).permutation(len(h)) if len(h) else np.zeros(0, dtype=int)
            mixed = np.lexsort((t, p, h))[mixed]
            h, t, other, p, head = (c[mixed] for c in (h, t, other, p, head))
            h, t, other, p = (np.searchsorted(k, c) for c in (h, t, other, p))
            h, t, other = h - first, t - first, other - first
            for at in range(0, len(h), batch):
                i = slice(at, at + batch)
                step(e, r, h[i], p[i], t[i], np.where(head[i], other[i], h[i]), np.where(head[i], t[i], other[i]), rate)
            return pa.table({"k": k, "vec": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(x.astype(np.float32).ravel()))})

        return run

    keys = spark.range(0, n_entities).select(F.col("id").alias("k")).unionByName(spark.range(0, n_relations).select((-1 - F.col("id")).alias("k")))
    params = cut(keys.mapInArrow(started, "k long, vec array<float>"))
    mean = F.array(*(F.avg(F.col("vec")[i]).cast("float") for i in range(width))).alias("new")
    length = F.greatest(vectors.norm(F.col("vec")), F.lit(1e-12))
    old = F.when(F.col("k") >= 0, F.transform("vec", lambda x: (x / length).cast("float"))).otherwise(F.col("vec")) if model == "transe" else F.col("vec")
    for epoch in range(epochs):
        dice = lambda what, epoch=epoch: F.xxhash64("h", "r", "t", F.lit(f"{seed} {epoch} {what}"))
        drawn = triples.select("block", "h", "t", (-1 - F.col("r")).alias("p"), F.pmod(dice("other"), F.lit(n_entities)).alias("other"), (F.pmod(dice("side"), F.lit(2)) == 0).alias("head"))
        named = drawn.select((F.col("block") + 0).alias("to"), F.explode(F.array("h", "t", "other", "p")).alias("k")).distinct()
        sent = params.hint("merge").join(named, "k").select("to", "k", "vec")
        new = drawn.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(trained(epoch), "k long, vec array<float>").groupBy("k").agg(mean)
        last, params = params, cut(params.hint("merge").join(new, "k", "left").select("k", F.coalesce("new", old).alias("vec")), free=True)
        _discard(last)
    return params.select(F.when(F.col("k") >= 0, "e").otherwise("r").alias("kind"), F.when(F.col("k") >= 0, F.col("k")).otherwise(-1 - F.col("k")).alias("id"), F.col("vec").cast("array<double>").alias("vec"))


def train_transe(encoded: DataFrame, n_entities: int, n_relations: int, **options: float) -> DataFrame:
    return train(encoded, n_entities, n_relations, "transe", **options)


def model_ranks(model: DataFrame, tests: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """(q, rank): filtered ranks of the tails of test triples (h, r, t) among all entities, for a trained model.

    Blocks of entity vectors score the broadcast tests, which are bounded by the caller, and hand on counts only.
    """
    queries = tests.dropDuplicates(["h", "r", "t"]).withColumn("q", F.xxhash64("h", "r", "t"))
    e = model.filter("kind = 'e'").select("id", "vec")
    at = lambda c, x: e.select(F.col("id").alias(c), F.col("vec").alias(x))
    rel = model.filter("kind = 'r'").select(F.col("id").alias("r"), F.col("vec").alias("vr"))
    full = at("h", "vh").join(F.broadcast(queries), "h")  # the tests are what is broadcast, never the model
    full = rel.join(F.broadcast(full), "r")
    full = at("t", "vt").join(F.broadcast(full), "t")
    others = known.join(queries.select("h", "r", F.col("t").alias("_own"), "q"), ["h", "r"]).filter("t <> _own").select("q", F.col("t").alias("id"))
    skip = others.groupBy("id").agg(F.collect_set("q").alias("skip"))
    rows = full.select("q", "vh", "vr", "vt").toArrow()
    q = rows.column("q").to_numpy()
    vh, vr, vt = (np.stack(rows.column(c).to_numpy(zero_copy_only=False)) if rows.num_rows else np.zeros((0, 1)) for c in ("vh", "vr", "vt"))
    score = (lambda h, r, t: -np.linalg.norm(h + r - t, axis=-1)) if kind == "transe" else complex_score
    shared = model.sparkSession.sparkContext.broadcast((q, vh, vr, score(vh, vr, vt), kind))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, vh, vr, true, kind = shared.value
        score = (lambda h, r, t: -np.linalg.norm(h + r - t, axis=-1)) if kind == "transe" else complex_score
        place = {x: i for i, x in enumerate(q.tolist())}
        above, not_below = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
        for pdf in batches:
            for vec, skip in zip(pdf["vec"], pdf["skip"], strict=True):
                s = score(vh, vr, np.asarray(vec)[None, :])
                on = np.ones(len(q), dtype=bool)
                if skip is not None:
                    on[[place[x] for x in skip]] = False
                above += on & (s > true + 1e-12)
                not_below += on & (s >= true - 1e-12)
        yield pd.DataFrame({"q": q, "above": above, "not_below": not_below})

    counts = e.join(skip, "id", "left").mapInPandas(run, "q long, above long, not_below long").groupBy("q").agg(F.sum("above").alias("above"), F.sum("not_below").alias("not_below"))
    return counts.select("q", ((F.col("above") + 1 + F.col("not_below")) / 2).alias("rank"))


def neighbour_stats(neighbours: DataFrame) -> DataFrame:
    """One row: seeds with neighbours, and neighbours in all."""
    return neighbours.agg(F.countDistinct("seed").alias("entities"), F.count(F.lit(1)).alias("neighbours"))


def filtered_ranks(scored: DataFrame, known: DataFrame) -> DataFrame:
    """(q, rank): the realistic rank of the true answer, the mean of the best and worst place among equals.

    scored: (q, candidate, score, truth); known: (q, candidate) true answers, other than the one asked for, that don't count.
    """
    rest = scored.join(known, ["q", "candidate"], "left_anti").unionByName(scored.join(known, ["q", "candidate"], "left_semi").filter(F.col("candidate") == F.col("truth"))).distinct()
    best = scored.filter(F.col("candidate") == F.col("truth")).select("q", F.col("score").alias("_true")).distinct()
    both = rest.join(best, "q")
    counts = both.groupBy("q").agg(F.count_if(F.col("score") > F.col("_true")).alias("above"), F.count_if(F.col("score") >= F.col("_true")).alias("not_below"))
    return counts.select("q", ((F.col("above") + 1 + F.col("not_below")) / 2).alias("rank"))


def ranking_metrics(ranks: DataFrame) -> DataFrame:
    hits = lambda k: F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"hits_at_{k}")
    return ranks.agg(F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), hits(1), hits(3), hits(10))


def nearest(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = True, round_to: int | None = None) -> DataFrame:
    """(qid, id, score, place) by cosine similarity; ties by id. queries: (qid, qvec), items: (id, vec).

    Queries are a stated set. They are collected in blocks of at most ``BLOCK`` and each block meets all items in numpy, where
    every partition keeps its own best k; the partial results are then ranked per query. Nothing but (query, k) rows is shuffled.
    """
    spark = items.sparkSession
    blocks = []
    rows = queries.select("qid", "qvec").filter("qvec is not null").toLocalIterator()
    block: list = []
    for r in rows:
        block.append(r)
        if len(block) == BLOCK:
            blocks.append(block)
            block = []
    if block:
        blocks.append(block)
    schema = f"qid {dict(queries.dtypes)['qid']}, id {dict(items.dtypes)['id']}, score double"
    out = None
    for b in blocks:
        q = np.array([r["qvec"] for r in b], dtype=np.float64)
        shared = spark.sparkContext.broadcast(([r["qid"] for r in b], q, np.linalg.norm(q, axis=1)))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            qids, q, qn = shared.value
            for pdf in batches:
                pdf = pdf[pdf["vec"].notna()]
                if not len(pdf):
                    continue
                ids, v = pdf["id"].to_numpy(), np.array(pdf["vec"].tolist(), dtype=np.float64)
                s = (q @ v.T) / (np.outer(qn, np.linalg.norm(v, axis=1)) + 1e-10)
                if round_to is not None:
                    s = np.round(s, round_to)
                if exclude_self:
                    s[np.array(qids, dtype=object)[:, None] == ids[None, :]] = -np.inf
                for i, qid in enumerate(qids):
                    order = np.lexsort((ids, -s[i]))[:k]
                    order = order[s[i][order] > -np.inf]
                    yield pd.DataFrame({"qid": [qid] * len(order), "id": ids[order], "score": s[i][order]})

        part = items.select("id", "vec").mapInPandas(best, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema + ", place int")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


#: Queries that meet all items at once.
BLOCK = 2048


def similar_pairs(vecs: DataFrame, k: int = 5) -> DataFrame:
    """(a, b, cos): the k most similar pairs of (id, vec). A pair among the k best is among the k best of both its ends."""
    near = nearest(vecs.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), vecs, k, round_to=6)
    return near.filter("qid < id").select(F.col("qid").alias("a"), F.col("id").alias("b"), F.col("score").alias("cos")).orderBy(F.desc("cos"), "a", "b").limit(k)


def ranks_by_distance(queries: DataFrame, entities: DataFrame, known: DataFrame, round_to: int = 6) -> DataFrame:
    """(q, rank): realistic filtered ranks of the true entity by translation score, minus the distance to h + r.

    queries: (q, qvec, truth), where qvec is h + r; entities: (id, vec); known: (q, candidate), true answers that don't count. Blocks of
    queries meet all entities in numpy; each partition returns two counts a query, so the shuffle doesn't see scores.
    Known answers are scored by equality joins and taken off the counts.
    """
    spark = entities.sparkSession
    near = lambda a, b: F.round(-vectors.distance(a, b), round_to)
    true = queries.join(entities.select(F.col("id").alias("truth"), F.col("vec").alias("_t")), "truth").select("q", "qvec", "truth", near(F.col("qvec"), F.col("_t")).alias("true"))
    off = known.distinct().join(true, "q").filter(F.col("candidate") != F.col("truth")).join(entities.select(F.col("id").alias("candidate"), F.col("vec").alias("_c")), "candidate").withColumn("s", near(F.col("qvec"), F.col("_c")))
    counts = off.select("q", (-(F.col("s") > F.col("true")).cast("long")).alias("above"), (-(F.col("s") >= F.col("true")).cast("long")).alias("not_below"))
    block: list = []

    def scored(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r["q"] for r in rows], np.array([r["qvec"] for r in rows], dtype=np.float64), np.array([r["true"] for r in rows])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, t = shared.value
            above, not_below = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
            for pdf in batches:
                for k in range(0, len(pdf), 256):
                    v = np.array(pdf["vec"].iloc[k : k + 256].tolist(), dtype=np.float64)
                    if len(v):
                        s = np.round(-np.sqrt(np.maximum(((q[:, None, :] - v[None, :, :]) ** 2).sum(axis=2), 0)), round_to)
                        above += (s > t[:, None]).sum(axis=1)
                        not_below += (s >= t[:, None]).sum(axis=1)
            yield pd.DataFrame({"q": ids, "above": above, "not_below": not_below})

        return entities.select("vec").filter("vec is not null").mapInPandas(run, f"q {dict(queries.dtypes)['q']}, above long, not_below long")

    for r in true.select("q", "qvec", "true").toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            counts = counts.unionByName(scored(block))
            block = []
    if block:
        counts = counts.unionByName(scored(block))
    sums = counts.groupBy("q").agg(F.sum("above").alias("above"), F.sum("not_below").alias("not_below"))
    return sums.select("q", ((F.col("above") + 1 + F.col("not_below")) / 2).alias("rank"))


def useful_neighbour(uri: Column, label: Column, base: str = "http://dbpedia.org/resource/") -> Column:
    """Whether a neighbour can be shown: of the base, no file, no opaque id, no category, at least three letters."""
    from graphloom.functions.terms import ascii_letters, is_file, is_opaque, is_qid

    local = F.substring_index(uri, "/", -1)
    return uri.startswith(base) & ~is_file(label) & ~is_qid(local) & ~is_opaque(local) & (ascii_letters(label) >= 3) & ~local.startswith("Category:")
