"""Retrieval for question answering: texts by similarity, facts by the names that a question holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import fixed
from graphloom.functions.terms import FOAF, OWL, RDF, RDFS, format_value, ngrams, question_words, short_name, strip, words


def label_index(triples: DataFrame, base: str) -> DataFrame:
    """(label, uri): lower-case names. Later sources win: labels, then foaf names, then the local names of things of ``base``."""
    english = F.col("lang").isNull() | (F.lower("lang") == "en")
    labels = triples.filter((F.col("p") == RDFS + "label") & (F.col("o_kind") == "literal") & english).select(F.lower("o").alias("label"), F.col("s").alias("uri"), F.lit(1).alias("pass"))
    names = triples.filter((F.col("p") == FOAF + "name") & (F.col("o_kind") == "literal")).select(F.lower("o").alias("label"), F.col("s").alias("uri"), F.lit(2).alias("pass"))
    local = triples.filter((F.col("p") == RDF + "type") & F.col("s").startswith(base)).select(F.lower(F.replace(F.substring_index("s", "#", -1), F.lit("_"), F.lit(" "))).alias("label"), F.col("s").alias("uri"), F.lit(3).alias("pass"))
    every = labels.unionByName(names).unionByName(local)
    return every.groupBy("label").agg(F.max_by("uri", F.struct("pass", "uri")).alias("uri"))


#: Letters of the keys by which names and labels that hold one another meet.
KEY = 5


def _grams(c: Column) -> Column:
    """All distinct substrings of up to KEY letters: KEY for each letter of a text, however long it is."""
    n = F.length(c)
    size = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: c.substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(size(k) for k in range(1, KEY + 1))))


#: Bytes that names take with a copy for each of their substrings, up to which they are broadcast.
SENT = 8_000_000


def _how(names: DataFrame, key: str) -> str:
    """The hint for joins of ``names`` with a graph. The planner can't size either side (a local list counts as endless, substrings
    of labels as no larger than their file) and would broadcast the labels; so names are measured, and sorting is asked for where they are many."""
    n = F.length(key).cast("double")
    return "broadcast" if (names.agg(F.sum(KEY * (n + 1) * (4 * n + 64)).alias("n")).first()["n"] or 0) <= SENT else "merge"


def _holding(long: DataFrame, text: str, short: DataFrame, part: str) -> DataFrame:
    """Rows of ``long`` and ``short`` where ``text`` holds ``part``: the first letters of the part meet the substrings of the
    text. A hint of either side stays with it; where both are sorted adaptive execution splits hot letters ("the ")."""
    keyed = long.withColumn("_g", F.explode(_grams(F.col(text))))
    return keyed.join(short.withColumn("_g", F.substring(part, 1, KEY)), "_g").filter(F.contains(text, F.col(part))).drop("_g")


def search(names: DataFrame, index: DataFrame, triples: DataFrame, bases: list[str]) -> DataFrame:
    """(name, uri, rank): what each name stands for. Ranks: the same label; a subject of that name under one of ``bases``; a label that
    holds the name or is held by it. Of several the longest label wins.

    Names within labels, of any length, are found by equality of their first letters with substrings, not by trying all pairs.
    Only names are broadcast, up to ``SENT``; never the graph or its labels.
    """
    names = names.select("name").filter("name is not null").distinct().withColumn("_k", F.lower(strip("name")))
    how = _how(names, "_k")
    found = [names.hint(how).join(index, F.col("_k") == F.col("label")).select("name", "uri", "label", F.lit(1).alias("rank"))]
    for i, base in enumerate(bases):
        at = names.withColumn("uri", F.concat(F.lit(base), F.replace("name", F.lit(" "), F.lit("_")))).hint(how)
        found.append(triples.select("s").join(at, F.col("uri") == F.col("s")).select("name", "uri", F.col("_k").alias("label"), F.lit(2 + i).alias("rank")).distinct())
    last = 2 + len(bases)
    parts = names.filter(F.length("_k") >= 2).hint(how)
    inside = _holding(parts, "_k", index.filter(F.length("label") >= 1), "label")
    around = _holding(index.filter(F.length("label") >= 2), "label", parts, "_k")
    found += [x.select("name", "uri", "label", F.lit(last).alias("rank")) for x in (inside, around)]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    best = F.struct("rank", (-F.length("label")).alias("n"), "label", "uri")
    return every.groupBy("name").agg(F.min(best).alias("b")).select("name", "b.uri", "b.rank")


def facts(triples: DataFrame, limit: int) -> DataFrame:
    """(s, place, fact): readable facts of every subject, the first ``limit`` in the order of property and object."""
    name = short_name("p")
    rows = triples.filter(~name.isin(*fixed.NOISY_NAMES) & ~((F.col("o_kind") == "literal") & F.col("lang").isNotNull() & (F.lower("lang") != "en")))
    value = format_value("o", "o_kind")
    w = Window.partitionBy("s").orderBy("p", "o")
    return rows.select("s", "p", "o", F.concat(name, F.lit(": "), value).alias("fact")).filter(value.isNotNull() & (value != "")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("s", "place", "fact")


def related(triples: DataFrame, limit: int) -> DataFrame:
    """(s, name): names of the things a subject points to."""
    rows = triples.filter((F.col("o_kind") == "uri") & (F.col("p") != OWL + "sameAs")).select("s", short_name("o").alias("name")).filter(F.length("name") > 1).distinct()
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("s").orderBy("name"))).filter(F.col("_n") <= limit).drop("_n")


def question_entities(questions: DataFrame, index: DataFrame, triples: DataFrame, bases: list[str], most: int = 3) -> DataFrame:
    """(qid, place, uri): the first things that a question names, longest phrases first."""
    phrases = questions.select("qid", F.posexplode(ngrams(question_words("question"))).alias("k", "name"))
    hits = phrases.join(search(phrases.select("name"), index, triples, bases), "name")
    first = hits.groupBy("qid", "uri").agg(F.min("k").alias("k"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("k"))).filter(F.col("place") <= most).select("qid", "place", "uri")


def blocks(entities: DataFrame, triples: DataFrame, limit: int = 15) -> DataFrame:
    """(qid, place, block): the facts of each entity as text."""
    lines = facts(triples.join(entities.select(F.col("uri").alias("s")).distinct(), "s", "left_semi"), limit)
    texts = lines.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "fact"))), lambda x: F.concat(F.lit("  - "), x["fact"])), "\n").alias("t"))
    texts = texts.hint("merge")  # the planner takes them for no larger than the graph's file and would broadcast them
    return entities.join(texts, entities["uri"] == texts["s"]).select("qid", "place", F.concat(F.lit("["), short_name("uri"), F.lit("]\n"), "t").alias("block"))


def neighbour_seeds(questions: DataFrame, keywords: DataFrame, most: int = 2) -> DataFrame:
    """(qid, place, seed): the seeds whose keyword a question holds. keywords: (ord, keyword, seed), a table of at most ``MAX_KEYWORDS``."""
    rows = keywords.select("ord", "keyword", "seed").limit(MAX_KEYWORDS + 1).collect()
    if len(rows) > MAX_KEYWORDS:
        raise ValueError(f"over {MAX_KEYWORDS} keywords")
    if not rows:
        return questions.select("qid", F.lit(1).alias("place"), F.lit("").alias("seed")).limit(0)
    table = F.array(*(F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["keyword"]).alias("keyword"), F.lit(r["seed"]).alias("seed")) for r in rows))
    hit = questions.select("qid", F.explode(F.filter(table, lambda k: F.contains(F.lower(F.col("question")), k["keyword"]))).alias("k")).select("qid", "k.*")
    first = hit.groupBy("qid", "seed").agg(F.min("ord").alias("ord"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("ord", "seed"))).filter(F.col("place") <= most).select("qid", "place", "seed")


#: Keywords that questions are searched for.
MAX_KEYWORDS = 1_000


def neighbour_facts(seeds: DataFrame, neighbours: DataFrame, triples: DataFrame, each: int = 3, limit: int = 5) -> DataFrame:
    """(qid, place, block): facts of the nearest neighbours of a question's seeds, each neighbour once. neighbours: (seed, rank, entity, label, sim)."""
    w = Window.partitionBy("seed").orderBy("rank")
    near = neighbours.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= each)
    hits = seeds.join(near, "seed").groupBy("qid", "entity").agg(F.min_by(F.struct("label", "sim"), F.struct("place", "_n")).alias("b"), F.min(F.struct("place", "_n")).alias("k"))
    lines = facts(triples.join(hits.select(F.col("entity").alias("s")).distinct(), "s", "left_semi"), limit)
    texts = lines.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "fact"))), lambda x: F.concat(F.lit("  - "), x["fact"])), "\n").alias("t"))
    head = F.concat(F.lit("[KGE-related: "), F.replace("b.label", F.lit("_"), F.lit(" ")), F.lit(" (sim="), F.format_number("b.sim", 2), F.lit(")]\n"))
    placed = hits.join(texts, hits["entity"] == texts["s"]).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("k")))
    return placed.select("qid", "place", F.concat(head, "t").alias("block"))


def lexical_weights(chunks: DataFrame) -> DataFrame:
    """(id, term, w): tf-idf weights of texts, of unit length. Terms are sorted to their idf: by the size of the texts' file the planner would broadcast all terms of all texts."""
    terms = chunks.select("id", F.explode(words(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = chunks.agg(F.countDistinct("id").alias("n_docs"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)).alias("idf"))
    weighted = terms.hint("merge").join(df, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return weighted.join(norms, "id").select("id", "term", F.try_divide("x", "norm").alias("w"))


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, place) by the cosine of tf-idf weights. Rare terms join first by themselves: the join is on terms."""
    weights = lexical_weights(chunks)
    terms = queries.select("qid", F.explode(F.array_distinct(words(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "))))).alias("term"))
    scores = terms.join(weights, "term").groupBy("qid", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k)


def coverage(facts_per_term: DataFrame) -> DataFrame:
    """One row: the per cent of terms with a fact, and whether it is half or more. Column: n_facts."""
    share = F.round(F.avg((F.col("n_facts") > 0).cast("int")) * 100, 2)
    return facts_per_term.agg(share.alias("coverage"), (F.avg((F.col("n_facts") > 0).cast("int")) >= 0.5).alias("passed"))
