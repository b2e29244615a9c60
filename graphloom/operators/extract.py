"""Extraction of mentions and relations from documents.

Patterns, verbs and stop words are parameters; ``functions.fixed`` has the usual ones. A document's mentions stay in its
row as arrays through the whole pipeline, so neither sentences nor pairs cross documents and nothing is joined on text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import fixed
from graphloom.functions.terms import is_valid_mention, norm_surface, strip

#: Words that start with a capital in a row: what a tagger would take for a name.
CAPITAL_RUN = r"\b[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*\b"
SENTENCES, TAGGED_SENTENCES, SENTENCE_WORDS, PAIRS = 60, 15, 50, 6


def sentences(text: Column) -> Column:
    """A text cut behind ``.``, ``!`` or ``?`` and white space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda x: strip(x) != "")


def pattern_mentions(docs: DataFrame, id_col: str, text_col: str, patterns: list[tuple[str, str]], case: bool = False) -> DataFrame:
    """(id, ord, text, type, label, confidence, method): every match of every pattern, in the order of patterns, then of the text."""
    table = F.array(*(F.struct(F.lit(i).alias("k"), F.lit(t).alias("type"), F.regexp_extract_all(F.col(text_col), F.lit(p if case else f"(?i){p}"), F.lit(0)).alias("found")) for i, (p, t) in enumerate(patterns)))
    hits = docs.select(id_col, F.explode(table).alias("_p")).filter(F.size("_p.found") > 0).select(id_col, "_p.k", "_p.type", F.posexplode("_p.found").alias("i", "raw"))
    labels = F.create_map(*(F.lit(x) for kv in fixed.TYPE_LABELS.items() for x in kv))
    out = hits.select(id_col, (F.col("k") * 1_000_000 + F.col("i")).alias("ord"), norm_surface("raw").alias("text"), "type")
    return out.filter(is_valid_mention("text")).select(id_col, "ord", "text", "type", F.coalesce(labels[F.col("type")], F.col("type")).alias("label"), F.lit(0.97).alias("confidence"), F.lit("pattern").alias("method"))


def tagged_mentions(docs: DataFrame, id_col: str, text_col: str, tagger: Column | None = None) -> DataFrame:
    """Names by runs of capitals in the first sentences; ``tagger`` may be any column of array<string> made of ``_s``, such as a pandas UDF."""
    sents = docs.select(id_col, F.posexplode(F.slice(sentences(F.col(text_col)), 1, TAGGED_SENTENCES)).alias("k", "_s")).filter(F.size(F.split("_s", r"\s+")) <= SENTENCE_WORDS)
    names = tagger if tagger is not None else F.regexp_extract_all(F.col("_s"), F.lit(CAPITAL_RUN), F.lit(0))
    hits = sents.select(id_col, "k", F.posexplode(names).alias("i", "raw"))
    out = hits.select(id_col, (F.lit(1_000_000_000) + F.col("k") * 1000 + F.col("i")).alias("ord"), norm_surface("raw").alias("text"), F.lit("PERSON").alias("type"))
    return out.filter(is_valid_mention("text")).select(id_col, "ord", "text", "type", F.lit(fixed.TYPE_LABELS["PERSON"]).alias("label"), F.lit(0.80).alias("confidence"), F.lit("nltk").alias("method"))


def merged(patterns: DataFrame, tagged: DataFrame, id_col: str) -> DataFrame:
    """Both kinds; what a pattern found in a document, the tagger adds no more."""
    seen = patterns.select(id_col, F.lower("text").alias("_l")).distinct()
    rest = tagged.withColumn("_l", F.lower("text")).join(seen, [id_col, "_l"], "left_anti").drop("_l")
    return patterns.unionByName(rest)


def first_mentions(mentions: DataFrame, id_col: str) -> DataFrame:
    """The first mention of each (lower-case text, type) in the order of documents."""
    row = F.struct(id_col, "ord", *(c for c in mentions.columns if c not in (id_col, "ord")))
    return mentions.groupBy(F.lower("text").alias("_l"), F.col("type").alias("_t")).agg(F.min_by(row, F.struct(id_col, "ord")).alias("r")).select("r.*")


def sentence_mentions(docs: DataFrame, mentions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sent, sentence, ents): the sentences that name at least two entities, with them in the order of extraction.

    The mentions of a document are gathered once; a document's length bounds them.
    """
    first = mentions.groupBy(id_col, "text", "type").agg(F.min("ord").alias("ord"))
    per_doc = first.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ord", "text", "type"))).alias("_all"))
    sents = docs.select(id_col, F.posexplode(F.slice(sentences(F.col(text_col)), 1, SENTENCES)).alias("sent", "sentence"))
    return (
        sents.join(per_doc, id_col)
        .withColumn("ents", F.filter("_all", lambda e: F.contains(F.lower(F.col("sentence")), F.lower(e["text"]))))
        .filter(F.size("ents") >= 2).select(id_col, "sent", "sentence", "ents")
    )


def svo(found: DataFrame, id_col: str, verbs: list[tuple[str, str]] | None = None) -> DataFrame:
    """A relation for each verb of a sentence: the last entity named before it and the first behind it, in the order of extraction."""
    verbs = fixed.RELATION_VERBS if verbs is None else verbs
    table = F.array(*(F.struct(F.lit(i).alias("v"), F.lit(p).alias("predicate"), F.regexp_instr(F.col("sentence"), F.lit(rf"(?i)\b{w}\b")).alias("at"), F.lit(len(w)).alias("n")) for i, (w, p) in enumerate(verbs)))
    hits = found.select(id_col, "sent", "sentence", "ents", F.explode(F.filter(table, lambda x: x["at"] > 0)).alias("_v"))
    left, right = F.lower(F.expr("substring(sentence, 1, _v.at - 1)")), F.lower(F.expr("substring(sentence, _v.at + _v.n)"))
    ends = hits.withColumn("_l", left).withColumn("_r", right)
    subj = F.element_at(F.filter("ents", lambda e: F.contains(F.col("_l"), F.lower(e["text"]))), -1)
    obj = F.get(F.filter("ents", lambda e: F.contains(F.col("_r"), F.lower(e["text"]))), 0)
    some = ends.filter(F.exists("ents", lambda e: F.contains(F.col("_l"), F.lower(e["text"])))).withColumn("_s", subj).withColumn("_o", obj).filter(F.col("_o").isNotNull())
    return some.filter("_s.text <> _o.text").select(id_col, "sent", F.col("_v.v").alias("ord"), F.col("_s.text").alias("subject"), F.col("_s.type").alias("subject_type"), F.col("_v.predicate").alias("predicate"), F.col("_o.text").alias("object"), F.col("_o.type").alias("object_type"), F.lit("svo").alias("method"), F.substring("sentence", 1, 120).alias("sentence"))


def cooccurrence(found: DataFrame, relations: DataFrame, id_col: str, most: int = PAIRS) -> DataFrame:
    """Pairs of entities of the sentences without a verb relation, the first ``most`` in order. The pairs are made within the row from
    as many entities as can take part, so a crowded sentence costs no more than another."""
    rest = found.join(relations.select(id_col, "sent").distinct(), [id_col, "sent"], "left_anti")
    # the first pairs come from the first entity, then the second and so on: each has at least one partner behind it
    head = F.slice("ents", 1, most + 1)
    pairs = F.flatten(F.transform(head, lambda a, i: F.transform(F.filter(F.col("ents"), lambda b, j: (j > i) & (a["text"] != b["text"])), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = rest.select(id_col, "sent", "sentence", F.posexplode(F.slice(pairs, 1, most)).alias("ord", "p"))
    return rows.select(id_col, "sent", "ord", F.col("p.a.text").alias("subject"), F.col("p.a.type").alias("subject_type"), F.lit("co_occurs_with").alias("predicate"), F.col("p.b.text").alias("object"), F.col("p.b.type").alias("object_type"), F.lit("cooccurrence").alias("method"), F.substring("sentence", 1, 120).alias("sentence"))


def first_relations(relations: DataFrame, id_col: str) -> DataFrame:
    """The first relation of each (subject, predicate, object) without case."""
    first = F.struct(id_col, "sent", "ord")
    keys = [F.lower("subject").alias("_s"), F.col("predicate").alias("_p"), F.lower("object").alias("_o")]
    return relations.groupBy(*keys).agg(F.min_by(F.struct(*relations.columns), first).alias("r")).select("r.*")


def process(docs: DataFrame, id_col: str, text_col: str, patterns: list[tuple[str, str]], case: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mentions, relations) of documents."""
    mentions = merged(pattern_mentions(docs, id_col, text_col, patterns, case), tagged_mentions(docs, id_col, text_col), id_col)
    found = sentence_mentions(docs, mentions, id_col, text_col)
    relations = svo(found, id_col)
    return mentions, relations.unionByName(cooccurrence(found, relations, id_col))


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 50, least: int = 50) -> DataFrame:
    """(id, chunk, text): windows of ``size`` characters that overlap; short ones are dropped."""
    step = size - overlap
    at = F.when(F.length(text_col) > 0, F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = docs.select(id_col, F.col(text_col).alias("_t"), F.posexplode(at).alias("chunk", "_at")).select(id_col, "chunk", F.expr(f"substring(_t, _at + 1, {size})").alias("text"))
    return rows.filter(F.length(strip("text")) > least)
