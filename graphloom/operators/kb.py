"""From mentions and relations to a graph; alignment with an outside source; expansion from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import fixed
from graphloom.functions.terms import OWL, RDF, RDFS, XSD, slugify, strip
from graphloom.operators.triples import novel
from graphloom.sources.rdf import COLUMNS, TRIPLE
from graphloom.sources.tables import cut

KB = "http://graphloom.example/kb#"
PROP = "http://graphloom.example/kb/prop#"

#: Classes with their parent, object properties with domain, range and kind, data properties with range: fixed values.
CLASSES = [("Entity", None), ("Character", "Entity"), ("Enemy", "Character"), ("VideoGame", "Entity"), ("Location", "Entity"), ("Item", "Entity"), ("Organization", "Entity"), ("RealPerson", "Entity"), ("GeoPoliticalEntity", "Location")]
DISJOINT = [("Character", "VideoGame"), ("Character", "Location"), ("Character", "Item")]
OBJECT_PROPERTIES = [
    ("coOccursWith", "Entity", "Entity", "SymmetricProperty"), ("saves", "Character", "Character", None), ("kidnaps", "Character", "Character", None), ("defeats", "Character", "Character", None),
    ("appearsIn", "Character", "VideoGame", None), ("rules", "Character", "Location", None), ("locatedIn", "Entity", "Location", None), ("contains", "Location", "Entity", None), ("isPartOf", "Entity", "Entity", None),
    ("createdBy", "Entity", "RealPerson", None), ("developedBy", "VideoGame", "Organization", None), ("publishedBy", "VideoGame", "Organization", None), ("features", "VideoGame", "Character", None),
    ("fights", "Character", "Character", "SymmetricProperty"), ("helps", "Character", "Character", None), ("opposes", "Character", "Character", None), ("follows", "VideoGame", "VideoGame", None), ("isRelatedTo", "Entity", "Entity", "SymmetricProperty"),
]
DATA_PROPERTIES = [("confidence", "decimal"), ("sourceURL", "anyURI"), ("extractMethod", "string")]


def ontology(spark: SparkSession) -> DataFrame:
    uri = lambda s, p, o: (s, p, o, "uri", None, None)
    label = lambda s, x: (s, RDFS + "label", x, "literal", None, None)
    rows = [uri(KB + "Ontology", RDF + "type", OWL + "Ontology")]
    for c, parent in CLASSES:
        rows += [uri(KB + c, RDF + "type", OWL + "Class"), label(KB + c, c)] + ([uri(KB + c, RDFS + "subClassOf", KB + parent)] if parent else [])
    rows += [uri(KB + a, OWL + "disjointWith", KB + b) for a, b in DISJOINT]
    for p, d, r, kind in OBJECT_PROPERTIES:
        rows += [uri(PROP + p, RDF + "type", OWL + "ObjectProperty"), label(PROP + p, p), uri(PROP + p, RDFS + "domain", KB + d), uri(PROP + p, RDFS + "range", KB + r)] + ([uri(PROP + p, RDF + "type", OWL + kind)] if kind else [])
    for p, r in DATA_PROPERTIES:
        rows += [uri(PROP + p, RDF + "type", OWL + "DatatypeProperty"), label(PROP + p, p), uri(PROP + p, RDFS + "range", XSD + r)]
    return spark.createDataFrame(rows, TRIPLE)


def _map(values: dict[str, str], c: Column, default: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c], default)


def _po(p: str, o: Column, kind: str = "uri", dt: str | None = None) -> Column:
    return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))


def entity_triples(mentions: DataFrame) -> DataFrame:
    """Four to six triples for each mention, in one pass."""
    text, none = strip("text"), F.lit(None).cast("string")
    cls = F.concat(F.lit(KB), _map(fixed.TYPE_CLASSES, F.upper(strip("type")), F.lit("Entity")))
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(none)
    po = F.array(
        _po(RDF + "type", F.lit(OWL + "NamedIndividual")), _po(RDF + "type", cls), _po(RDFS + "label", text, "literal"),
        _po(PROP + "confidence", F.coalesce(F.col("confidence"), F.lit(0.5)).cast("decimal(5,2)").cast("string"), "literal", XSD + "decimal"),
        _po(PROP + "sourceURL", blank("source_url"), "literal", XSD + "anyURI"), _po(PROP + "extractMethod", blank("method"), "literal"),
    )
    return mentions.filter(F.coalesce(text, F.lit("")) != "").select(F.concat(F.lit(KB), slugify("text")).alias("s"), F.explode(po).alias("t")).select("s", "t.*").filter("o is not null").select(*COLUMNS).distinct()


def relation_triples(relations: DataFrame) -> DataFrame:
    p = _map(fixed.RELATION_PROPERTIES, strip("predicate"), slugify("predicate"))
    none = F.lit(None).cast("string")
    return relations.select(F.concat(F.lit(KB), slugify("subject")).alias("s"), F.concat(F.lit(PROP), p).alias("p"), F.concat(F.lit(KB), slugify("object")).alias("o"), F.lit("uri").alias("o_kind"), none.alias("dt"), none.alias("lang")).distinct()


def endpoint_triples(mentions: DataFrame, relations: DataFrame, case: bool = True) -> DataFrame:
    """Triples of the relations' ends that no mention has; ends are told apart by case unless told otherwise."""
    key = (lambda c: c) if case else F.lower
    ends = relations.select(strip("subject").alias("text")).unionByName(relations.select(strip("object").alias("text"))).distinct()
    missing = ends.withColumn("_k", key(F.col("text"))).join(mentions.select(key(strip("text")).alias("_k")).distinct(), "_k", "left_anti")
    po = F.array(_po(RDF + "type", F.lit(OWL + "NamedIndividual")), _po(RDF + "type", F.lit(KB + "Entity")), _po(RDFS + "label", F.col("text"), "literal"))
    return missing.select(F.concat(F.lit(KB), slugify("text")).alias("s"), F.explode(po).alias("t")).select("s", "t.*").select(*COLUMNS).distinct()


def build(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    return entity_triples(mentions).unionByName(endpoint_triples(mentions, relations)).unionByName(relation_triples(relations)).distinct()


# alignment


def fuzzy_score(query: Column, label: Column, description: Column) -> Column:
    """0.95 for the same label, 0.80 where one holds the other, else 0.55; 0.10 more, 0.99 at most, where the description tells."""
    q, t, d = F.lower(query), F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    base = F.when(q == t, F.lit(0.95)).when(t.contains(q) | q.contains(t), F.lit(0.80)).otherwise(F.lit(0.55))
    told = F.lit(False)
    for w in fixed.DESCRIPTION_WORDS:
        told = told | d.contains(w)
    return F.round(F.when(told, F.least(F.lit(0.99), base + F.lit(0.10))).otherwise(base), 3)


def label_search(labels: DataFrame, external: DataFrame, least_links: int = 2) -> DataFrame:
    """(label, qid, conf): the item of the same label with the most links, if it has more than ``least_links``."""
    hits = labels.select("label").distinct().join(external.filter(F.col("links") > least_links), "label")
    return hits.groupBy("label").agg(F.max_by("qid", F.struct("links", "qid")).alias("qid")).withColumn("conf", F.lit(0.80))


def align(entities: DataFrame, known: DataFrame, searched: DataFrame, fuzzy: DataFrame, least: float = 0.55, base: str = "http://www.wikidata.org/entity/") -> DataFrame:
    """Entities (entity, label) with what the first source that knows their label says.

    known: (label, qid, conf) given by hand; searched and fuzzy: the same from outside, in this order. Each has a label once.
    """
    named = lambda df, x: df.select("label", F.col("qid").alias(f"q_{x}"), F.col("conf").alias(f"c_{x}"))
    out = entities.join(named(known, "k"), "label", "left").join(named(searched, "s"), "label", "left").join(named(fuzzy, "f"), "label", "left")
    qid, conf = F.coalesce("q_k", "q_s", "q_f"), F.coalesce("c_k", "c_s", "c_f")
    fits = qid.isNotNull() & (conf >= least)
    return out.select(
        "entity", "label", F.when(fits, qid).alias("qid"), F.when(fits, F.concat(F.lit(base), qid)).alias("uri"), F.when(fits, conf).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("q_k").isNotNull() & fits, F.lit("aligned_vip")).when(fits, F.lit("aligned_api")).otherwise(F.lit("new_entity")).alias("status"),
    )


def predicate_alignment(spark: SparkSession, base: str = "http://www.wikidata.org/prop/direct/") -> DataFrame:
    """(slug, pid, uri, status) of the graph's properties."""
    return spark.createDataFrame([(s, p, base + p if p else None, k) for s, p, k in fixed.PROPERTY_HINTS], "slug string, pid string, uri string, status string")


def predicate_triples(table: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    p = F.when(F.col("status") == "equivalent", F.lit(OWL + "equivalentProperty")).when(F.col("status") == "sub_property", F.lit(RDFS + "subPropertyOf"))
    return table.select(F.concat(F.lit(PROP), "slug").alias("s"), p.alias("p"), F.col("uri").alias("o"), F.lit("uri").alias("o_kind"), none.alias("dt"), none.alias("lang")).filter("p is not null")


def alignment_stats(mapping: DataFrame) -> DataFrame:
    """One row: aligned, new and all entities, and the mean confidence of the aligned."""
    aligned = F.col("status").startswith("aligned")
    return mapping.agg(F.count_if(aligned).alias("aligned"), F.count_if(F.col("status") == "new_entity").alias("new_entities"), F.count(F.lit(1)).alias("total"), F.round(F.avg(F.when(aligned, F.col("confidence"))), 3).alias("avg_confidence"))


# expansion


def expand(frontier: DataFrame, external: DataFrame, per_subject: int = 500, blacklist: list[str] | None = None) -> DataFrame:
    """One hop: the first ``per_subject`` triples of each subject of the frontier (column s), then without unwanted properties."""
    w = Window.partitionBy("s").orderBy("p", "o")
    hop = external.filter("o_kind <> 'bnode'").join(frontier.select("s").distinct(), "s", "left_semi").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_subject).drop("_n")
    return hop.filter(~F.col("p").isin(*(fixed.NOISY_PROPERTIES if blacklist is None else blacklist)))


def discovered(*sources: DataFrame) -> DataFrame:
    """The things (column s) that any of several searches found."""
    return reduce(DataFrame.unionByName, (d.select("s") for d in sources)).distinct()


def frontier(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """What was found and isn't expanded yet."""
    return found.select("s").distinct().join(anchors.select("s").distinct(), "s", "left_anti")


def resources(triples: DataFrame, base: str = "http://dbpedia.org/resource/") -> DataFrame:
    """Triples to things of a resource space, without its categories."""
    return triples.filter((F.col("o_kind") == "uri") & F.col("o").startswith(base) & ~F.col("o").contains("Category:"))


def expand_properties(external: DataFrame, members: DataFrame, properties: list[str]) -> DataFrame:
    return external.filter(F.col("p").isin(*properties)).join(members.select("s").distinct(), "s", "left_semi")


def within_budget(steps: DataFrame, order: str, added: str, budget: int) -> DataFrame:
    """The steps of an expansion that begin while the total is below the budget. The steps are a log with a row each, not data."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("running", F.sum(added).over(w)).filter(F.col("running") - F.col(added) < budget)


def expansion_log(graph: DataFrame, batches: list[tuple[str, str, DataFrame]]) -> tuple[DataFrame, list[dict]]:
    """The graph with each batch inserted, and how many triples each one brought that were new."""
    log = []
    for phase, description, facts in batches:
        fresh = cut(novel(graph, facts))
        log.append({"phase": phase, "description": description, "items": facts.select("s").distinct().count(), "triples_added": fresh.count()})
        graph = graph.unionByName(fresh)
    return graph, log
