"""Every query on the test tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import fixed, terms, vectors
from graphloom.functions.terms import OWL, RDF, RDFS
from graphloom.operators import extract, kb, kge, rag, reason, retrieve, sparql
from graphloom.operators import triples as tr
from graphloom.plans import views
from graphloom.plans.views import DATA, PREFIXES, T
from graphloom.sources import files, rdf
from graphloom.sources.tables import cut, ensure_checkpoint_dir, load

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _n(kind: str, key: str) -> str:
    return f"'{DATA}{kind}/' || CAST({key} AS VARCHAR)"


def _m(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0b\x85\p{{Z}}]+|[\s\x0b\x85\p{{Z}}]+$', '', 'g')"


def _short(x: str) -> str:
    return f"replace(split_part(split_part({x}, '#', -1), '/', -1), '_', ' ')"


# ---------------------------------------------------------------- patterns and the query language


@query(f"""SELECT {_n("customer", "c_custkey")} AS c, c_name AS label, {_m("c_acctbal")} AS bal, {_n("nation", "n_nationkey")} AS n, {_n("region", "n_regionkey")} AS r
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE CAST(c_acctbal AS DECIMAL(18,2)) > 5000""")
def bgp_star_customer(spark: SparkSession, d: str) -> DataFrame:
    return sparql.run(views.customers(spark, d).unionByName(views.places(spark, d)), "SELECT ?c ?label ?bal ?n ?r WHERE { ?c a t:Customer ; rdfs:label ?label ; t:acctbal ?bal . OPTIONAL { ?c t:locatedIn ?n . ?n t:locatedIn ?r } FILTER(?bal > 5000) } ORDER BY ?label", PREFIXES)


@query(f"""SELECT {_n("order", "o_orderkey")} AS o, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def bgp_chain_order_nation(spark: SparkSession, d: str) -> DataFrame:
    g = views.orders(spark, d).unionByName(views.customers(spark, d)).unionByName(views.places(spark, d))
    return sparql.run(g, "SELECT ?o ?name WHERE { ?o t:placedBy ?c . ?c t:locatedIn ?n . ?n rdfs:label ?name }", PREFIXES)


@query(f"SELECT s, p, o FROM ({views.CUSTOMERS_SQL}) WHERE o IS NOT NULL")
def bgp_variable_predicate(spark: SparkSession, d: str) -> DataFrame:
    return sparql.run(views.parties(spark, d), "SELECT ?s ?p ?o WHERE { ?s a t:Customer . ?s ?p ?o }", PREFIXES)


@query(f"""SELECT {_n("customer", "c_custkey")} AS c, CASE WHEN o_orderkey IS NOT NULL THEN {_n("order", "o_orderkey")} END AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'""")
def optional_multi_pattern(spark: SparkSession, d: str) -> DataFrame:
    return sparql.run(views.customers(spark, d).unionByName(views.orders(spark, d)), 'SELECT ?c ?o WHERE { ?c a t:Customer . OPTIONAL { ?o t:placedBy ?c . ?o t:status "F" } }', PREFIXES)


@query(f"""SELECT {_n("customer", "c_custkey")} AS c, {_m("o_totalprice")} AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND CAST(o_totalprice AS DECIMAL(18,2)) > 200000""")
def optional_inner_filter(spark: SparkSession, d: str) -> DataFrame:
    return sparql.run(views.customers(spark, d).unionByName(views.orders(spark, d)), "SELECT ?c ?total WHERE { ?c a t:Customer . OPTIONAL { ?o t:placedBy ?c . ?o t:totalprice ?total . FILTER(?total > 200000) } }", PREFIXES)


@query(f"""SELECT {_n("customer", "c_custkey")} AS x, {_n("nation", "c_nationkey")} AS n FROM customer WHERE c_nationkey IN (3, 7) UNION ALL SELECT {_n("supplier", "s_suppkey")}, {_n("nation", "s_nationkey")} FROM supplier WHERE s_nationkey IN (3, 7)""")
def filter_in_union(spark: SparkSession, d: str) -> DataFrame:
    return sparql.run(views.parties(spark, d), f"SELECT ?x ?n WHERE {{ {{ ?x a t:Supplier }} UNION {{ ?x a t:Customer }} ?x t:locatedIn ?n . FILTER(?n IN (<{DATA}nation/3>, <{DATA}nation/7>)) }}", PREFIXES)


@query("SELECT DISTINCT o_orderstatus AS st FROM orders ORDER BY 1 LIMIT 2")
def select_distinct_limit(spark: SparkSession, d: str) -> DataFrame:
    return sparql.run(views.orders(spark, d), "SELECT DISTINCT ?st WHERE { ?o t:status ?st } ORDER BY ?st LIMIT 2", PREFIXES)


@query("SELECT count(*) > 0 AS ask FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) < 0")
def ask_negative_balance(spark: SparkSession, d: str) -> DataFrame:
    return sparql.run(views.customers(spark, d), "ASK { ?c t:acctbal ?b . FILTER(?b < 0) }", PREFIXES)


@query(f"SELECT {_n('nation', 'n_nationkey')} AS n FROM nation")
def filter_not_blank(spark: SparkSession, d: str) -> DataFrame:
    g = views.places(spark, d).unionByName(views.schema(spark).select(*rdf.COLUMNS))
    return sparql.run(g, "SELECT ?n WHERE { ?n a t:Nation . FILTER(!isBlank(?n) && !isLiteral(?n)) }", PREFIXES)


@query(f"""SELECT {_n("region", "n_regionkey")} AS s, '{T}contains' AS p, {_n("nation", "n_nationkey")} AS o, 'uri' AS o_kind FROM nation""")
def construct_inverse(spark: SparkSession, d: str) -> DataFrame:
    return sparql.run(views.places(spark, d), "CONSTRUCT { ?r t:contains ?n } WHERE { ?n a t:Nation ; t:locatedIn ?r }", PREFIXES).select("s", "p", "o", "o_kind")


@query(f"SELECT {_n('customer', 'c_custkey')} AS c, c_name AS label FROM customer WHERE lower(c_name) LIKE '%7' AND c_mktsegment <> 'BUILDING' ORDER BY c_name DESC, 1 LIMIT 25 OFFSET 5")
def filter_functions_page(spark: SparkSession, d: str) -> DataFrame:
    return sparql.run(views.customers(spark, d), 'SELECT ?c ?label WHERE { ?c rdfs:label ?label ; t:segment ?s . FILTER(REGEX(LCASE(STR(?label)), "7$")) FILTER(?s != "BUILDING") } ORDER BY DESC(?label) LIMIT 25 OFFSET 5', PREFIXES)


# ---------------------------------------------------------------- graphs


@query(f"""WITH g AS (SELECT DISTINCT * FROM ({views.GRAPH_SQL})), s AS (SELECT DISTINCT s AS x FROM g), o AS (SELECT DISTINCT o AS x FROM g WHERE o_kind = 'uri')
SELECT (SELECT count(*) FROM g) AS triples, (SELECT count(*) FROM s) AS subjects, (SELECT count(*) FROM o) AS objects, (SELECT count(*) FROM (SELECT x FROM s UNION SELECT x FROM o)) AS entities, (SELECT count(DISTINCT p) FROM g) AS predicates""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return tr.stats(views.graph(spark, d))


@query(f"SELECT split_part(split_part(o, '/', -1), '#', -1) AS type, count(*) AS n FROM (SELECT DISTINCT s, o FROM ({views.GRAPH_SQL}) WHERE p = '{RDF}type') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def graph_stats_types(spark: SparkSession, d: str) -> DataFrame:
    g = views.graph(spark, d).filter(F.col("p") == RDF + "type").select("s", "o").distinct()
    return tr.top_counts(g, terms.local_name("o"), "type", 20)


@query(f"SELECT split_part(split_part(p, '/', -1), '#', -1) AS predicate, count(*) AS n FROM (SELECT DISTINCT * FROM ({views.GRAPH_SQL})) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def graph_stats_predicates(spark: SparkSession, d: str) -> DataFrame:
    return tr.top_counts(views.graph(spark, d).distinct(), terms.local_name("p"), "predicate", 10)


@query("""WITH g AS (SELECT DISTINCT * FROM private_kb WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL), s AS (SELECT DISTINCT s AS x FROM g), o AS (SELECT DISTINCT o AS x FROM g WHERE o_kind = 'uri')
SELECT (SELECT count(*) FROM g) AS triples, (SELECT count(*) FROM s) AS subjects, (SELECT count(*) FROM o) AS objects, (SELECT count(*) FROM (SELECT x FROM s UNION SELECT x FROM o)) AS entities, (SELECT count(DISTINCT p) FROM g) AS predicates""")
def private_kb_stats(spark: SparkSession, d: str) -> DataFrame:
    return tr.stats(load(spark, d, "private_kb").filter("s is not null and p is not null and o is not null"))


@query(f"""WITH l AS (SELECT s, p, o, count(*) AS n, p = '{T}suppliedBy' AS skip FROM ({views.GRAPH_SQL}) WHERE o_kind = 'uri' GROUP BY s, p, o)
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM l) AS parsed, (SELECT CAST(sum(n) AS BIGINT) FROM l WHERE skip) AS skipped, (SELECT CAST(sum(n - 1) AS BIGINT) FROM l WHERE NOT skip) AS duplicates, (SELECT count(*) FROM l WHERE NOT skip) AS kept,
(SELECT count(*) FROM (SELECT s FROM l WHERE NOT skip UNION SELECT o FROM l WHERE NOT skip)) AS entities, (SELECT count(DISTINCT p) FROM l WHERE NOT skip) AS relations""")
def cleaning_counters(spark: SparkSession, d: str) -> DataFrame:
    return kge.cleaning_counters(views.graph(spark, d), [T + "suppliedBy"])


@query(f"""WITH a AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM ({views.PARTIES_SQL}))), b AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM ({views.GRAPH_SQL})))
SELECT round(CAST(b.n AS DOUBLE) / greatest(a.n, 1), 1) AS factor, b.n BETWEEN 5000 AND 5000000 AS triples_ok FROM a, b""")
def requirement_checks(spark: SparkSession, d: str) -> DataFrame:
    n = lambda g, c: g.distinct().agg(F.count(F.lit(1)).alias(c))
    both = n(views.parties(spark, d), "a").crossJoin(n(views.graph(spark, d), "b"))
    return both.select(F.round(F.col("b") / F.greatest("a", F.lit(1)), 1).alias("factor"), F.col("b").between(5_000, 5_000_000).alias("triples_ok"))


@query(f"SELECT DISTINCT s, p, o, o_kind, dt FROM ({views.SUPPLIERS_SQL} UNION ALL {views.PLACES_SQL})")
def insert_novel_triples(spark: SparkSession, d: str) -> DataFrame:
    return tr.novel(views.customers(spark, d), views.parties(spark, d)).select("s", "p", "o", "o_kind", "dt")


@query(f"SELECT s, p, o FROM ({views.CUSTOMERS_SQL}) WHERE p <> '{T}segment'")
def remove_triples(spark: SparkSession, d: str) -> DataFrame:
    return tr.remove(views.customers(spark, d), F.col("p") == T + "segment").select("s", "p", "o")


# ---------------------------------------------------------------- expansion and alignment


@query(f"SELECT DISTINCT {_n('order', 'l_orderkey')} AS s, '{T}contains' AS p, {_n('part', 'l_partkey')} AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def expand_one_hop(spark: SparkSession, d: str) -> DataFrame:
    frontier = sparql.run(views.orders(spark, d), 'SELECT ?s WHERE { ?s t:status "F" }', PREFIXES)
    return kb.expand(frontier, views.lines(spark, d), blacklist=[T + "suppliedBy"]).select("s", "p", "o")


@query(f"""WITH found AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'), front AS (SELECT k FROM found WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))
SELECT {_n('customer', 'c_custkey')} AS s, '{T}locatedIn' AS p, {_n('nation', 'c_nationkey')} AS o FROM customer JOIN front ON c_custkey = k UNION ALL SELECT {_n('customer', 'c_custkey')}, '{RDFS}label', c_name FROM customer JOIN front ON c_custkey = k""")
def expansion_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Things that two searches discover, less those already expanded, and two properties of what is left."""
    g = views.customers(spark, d)
    by_status = lambda x: load(spark, d, "orders").filter(F.col("o_orderstatus") == x).select(views.node("customer", "o_custkey").alias("s"))
    found = kb.discovered(g.filter((F.col("p") == T + "segment") & (F.col("o") == "BUILDING")), by_status("P"))
    return kb.expand_properties(g, kb.frontier(found, by_status("F")), [T + "locatedIn", RDFS + "label"]).select("s", "p", "o")


@query(f"""SELECT s, p, o FROM (SELECT s, p, o, row_number() OVER (PARTITION BY s ORDER BY p, o) AS n FROM ({views.CUSTOMERS_SQL})) WHERE n <= 2 AND p <> '{T}locatedIn'""")
def expand_limited(spark: SparkSession, d: str) -> DataFrame:
    g = views.customers(spark, d)
    return kb.expand(g.select("s"), g, per_subject=2, blacklist=[T + "locatedIn"]).select("s", "p", "o")


@query("""WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS added FROM orders GROUP BY 1)
SELECT day, added, CAST(running AS BIGINT) AS running FROM (SELECT day, added, sum(added) OVER (ORDER BY day) AS running FROM s) WHERE running - added < 5000""")
def expand_budget(spark: SparkSession, d: str) -> DataFrame:
    days = load(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("added"))
    return kb.within_budget(days, "day", "added", 5000)


_KNOWN_SQL = "known AS (SELECT label, max(wikidata_qid) AS qid, max(confidence) AS conf FROM entity_mapping WHERE status = 'aligned_vip' AND label IS NOT NULL AND regexp_matches(wikidata_qid, '^Q[0-9]+$') AND confidence IS NOT NULL GROUP BY label HAVING count(DISTINCT wikidata_qid) = 1)"
_EXT_SQL = "ext AS (SELECT item_label AS label, split_part(wikidata_uri, '/', -1) AS qid, CAST(coalesce(inception_year, 0) - 1970 AS INTEGER) AS links, description FROM external_items WHERE item_label IS NOT NULL)"
_ENT_SQL = "ent AS (SELECT DISTINCT private_entity AS entity, label FROM entity_mapping WHERE status <> 'typed_value' AND label IS NOT NULL)"
_SEARCH_SQL = "searched AS (SELECT label, qid, 0.80 AS conf FROM (SELECT label, qid, row_number() OVER (PARTITION BY label ORDER BY links DESC, qid DESC) AS n FROM ext WHERE links > 2 AND label IN (SELECT label FROM ent)) WHERE n = 1)"
_SCORE_SQL = (
    "CASE WHEN lower(e.label) = lower(x.label) THEN 0.95 WHEN contains(lower(x.label), lower(e.label)) OR contains(lower(e.label), lower(x.label)) THEN 0.80 ELSE 0.55 END"
)
_TOLD_SQL = " OR ".join(f"contains(lower(coalesce(x.description, '')), '{w}')" for w in fixed.DESCRIPTION_WORDS)
_FUZZY_SQL = f"""cand AS (SELECT e.label, x.qid, round(CASE WHEN {_TOLD_SQL} THEN least(0.99, CAST({_SCORE_SQL} AS DOUBLE) + 0.10) ELSE CAST({_SCORE_SQL} AS DOUBLE) END, 3) AS conf
  FROM (SELECT DISTINCT label FROM ent) e JOIN ext x ON split_part(lower(e.label), ' ', 1) = split_part(lower(x.label), ' ', 1)),
fuzzy AS (SELECT label, qid, conf FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY conf DESC, qid DESC) AS n FROM cand) WHERE n = 1)"""


def _alignment(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    em = load(spark, d, "entity_mapping")
    ent = em.filter("status <> 'typed_value' and label is not null").select(F.col("private_entity").alias("entity"), "label").distinct()
    known = em.filter((F.col("status") == "aligned_vip") & F.col("label").isNotNull() & terms.is_qid("wikidata_qid") & F.col("confidence").isNotNull())
    known = known.groupBy("label").agg(F.max("wikidata_qid").alias("qid"), F.max("confidence").alias("conf"), F.countDistinct("wikidata_qid").alias("_q")).filter("_q = 1").drop("_q")
    ext = load(spark, d, "external_items").filter("item_label is not null").select(F.col("item_label").alias("label"), F.substring_index("wikidata_uri", "/", -1).alias("qid"), (F.coalesce("inception_year", F.lit(0)) - 1970).alias("links"), "description")
    word = lambda c: F.substring_index(F.lower(c), " ", 1)
    pairs = ent.select("label").distinct().withColumn("_w", word("label")).join(ext.select(F.col("label").alias("x"), "qid", "description", word("label").alias("_w")), "_w")
    scored = pairs.select("label", "qid", kb.fuzzy_score(F.col("label"), F.col("x"), F.col("description")).alias("conf"))
    fuzzy = scored.groupBy("label").agg(F.max(F.struct("conf", "qid")).alias("b")).select("label", "b.qid", "b.conf")
    return ent, known, kb.label_search(ent, ext), fuzzy


@query(f"WITH {_ENT_SQL}, {_KNOWN_SQL} SELECT entity, ent.label, qid, conf FROM ent LEFT JOIN known ON ent.label = known.label")
def align_vip(spark: SparkSession, d: str) -> DataFrame:
    ent, known, _, _ = _alignment(spark, d)
    return ent.join(known, "label", "left").select("entity", "label", "qid", "conf")


@query(f"WITH {_ENT_SQL}, {_EXT_SQL}, {_SEARCH_SQL} SELECT label, qid FROM searched")
def align_label_search(spark: SparkSession, d: str) -> DataFrame:
    return _alignment(spark, d)[2].select("label", "qid")


@query(f"WITH {_ENT_SQL}, {_EXT_SQL}, {_FUZZY_SQL} SELECT label, qid, conf FROM fuzzy")
def align_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _alignment(spark, d)[3]


_ALIGN_SQL = f"""WITH {_ENT_SQL}, {_KNOWN_SQL}, {_EXT_SQL}, {_SEARCH_SQL}, {_FUZZY_SQL}, al AS (
SELECT entity, ent.label, coalesce(k.qid, s.qid, f.qid) AS qid, CAST(coalesce(k.conf, s.conf, f.conf) AS DOUBLE) AS conf, k.qid AS kq
FROM ent LEFT JOIN known k ON ent.label = k.label LEFT JOIN searched s ON ent.label = s.label LEFT JOIN fuzzy f ON ent.label = f.label)"""


@query(f"""{_ALIGN_SQL} SELECT entity, label, CASE WHEN conf >= 0.55 THEN qid END AS qid, CASE WHEN conf >= 0.55 THEN conf ELSE 0 END AS confidence,
CASE WHEN conf >= 0.55 AND kq IS NOT NULL THEN 'aligned_vip' WHEN conf >= 0.55 THEN 'aligned_api' ELSE 'new_entity' END AS status FROM al""")
def align_tiered(spark: SparkSession, d: str) -> DataFrame:
    return kb.align(*_alignment(spark, d)).drop("uri")


@query("SELECT count(*) FILTER (WHERE status LIKE 'aligned%') AS aligned, count(*) FILTER (WHERE status = 'new_entity') AS new_entities, count(*) AS total, round(avg(confidence) FILTER (WHERE status LIKE 'aligned%'), 3) AS avg_confidence FROM entity_mapping")
def alignment_stats(spark: SparkSession, d: str) -> DataFrame:
    return kb.alignment_stats(load(spark, d, "entity_mapping"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', {repr(p) if p else 'CAST(NULL AS VARCHAR)'}, '{k}')" for s, p, k in fixed.PROPERTY_HINTS) + ") AS t(slug, pid, status)")
def predicate_alignment(spark: SparkSession, d: str) -> DataFrame:
    return kb.predicate_alignment(spark).drop("uri")


# ---------------------------------------------------------------- building the graph

_SLUG = lambda x: rf"CASE WHEN regexp_replace(regexp_replace({_strip(x)}, '[^\p{{L}}\p{{M}}\p{{N}}_\-\s\x0b\x85\p{{Z}}]', '', 'g'), '[\s\x0b\x85\p{{Z}}]+', '_', 'g') = '' THEN 'Unknown' ELSE regexp_replace(regexp_replace({_strip(x)}, '[^\p{{L}}\p{{M}}\p{{N}}_\-\s\x0b\x85\p{{Z}}]', '', 'g'), '[\s\x0b\x85\p{{Z}}]+', '_', 'g') END"
_CLS = "CASE upper(type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.TYPE_CLASSES.items()) + " ELSE 'Entity' END"
_MENTION_SQL = f"m AS (SELECT '{kb.KB}' || {_SLUG('text')} AS s, {_strip('text')} AS text, {_CLS} AS cls, source_url, method, confidence FROM extracted_knowledge WHERE text IS NOT NULL AND {_strip('text')} <> '')"


@query(f"""WITH {_MENTION_SQL}, g AS (SELECT s, '{RDF}type' AS p, '{OWL}NamedIndividual' AS o FROM m UNION SELECT s, '{RDF}type', '{kb.KB}' || cls FROM m UNION SELECT s, '{RDFS}label', text FROM m
UNION SELECT s, '{kb.PROP}confidence', CAST(CAST(coalesce(confidence, 0.5) AS DECIMAL(5,2)) AS VARCHAR) FROM m UNION SELECT s, '{kb.PROP}sourceURL', source_url FROM m WHERE coalesce(source_url, '') <> '' UNION SELECT s, '{kb.PROP}extractMethod', method FROM m WHERE coalesce(method, '') <> '')
SELECT s, p, o FROM g""")
def kb_build(spark: SparkSession, d: str) -> DataFrame:
    return kb.entity_triples(load(spark, d, "extracted_knowledge")).select("s", "p", "o")


_RELATION_SQL = "rel AS (SELECT c_name AS subject, n_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_ENTITY_SQL = f"""SELECT s, '{RDF}type' AS p, '{OWL}NamedIndividual' AS o FROM m UNION SELECT s, '{RDF}type', '{kb.KB}' || cls FROM m UNION SELECT s, '{RDFS}label', text FROM m
UNION SELECT s, '{kb.PROP}confidence', CAST(CAST(coalesce(confidence, 0.5) AS DECIMAL(5,2)) AS VARCHAR) FROM m UNION SELECT s, '{kb.PROP}sourceURL', source_url FROM m WHERE coalesce(source_url, '') <> '' UNION SELECT s, '{kb.PROP}extractMethod', method FROM m WHERE coalesce(method, '') <> ''"""


@query(f"""WITH {_MENTION_SQL}, {_RELATION_SQL}, ends AS (SELECT DISTINCT e FROM (SELECT {_strip('subject')} AS e FROM rel UNION SELECT {_strip('object')} FROM rel) WHERE e NOT IN (SELECT text FROM m))
{_ENTITY_SQL} UNION SELECT '{kb.KB}' || {_SLUG('e')}, '{RDF}type', '{OWL}NamedIndividual' FROM ends UNION SELECT '{kb.KB}' || {_SLUG('e')}, '{RDF}type', '{kb.KB}Entity' FROM ends UNION SELECT '{kb.KB}' || {_SLUG('e')}, '{RDFS}label', e FROM ends
UNION SELECT '{kb.KB}' || {_SLUG('subject')}, '{kb.PROP}locatedIn', '{kb.KB}' || {_SLUG('object')} FROM rel""")
def kb_build_whole(spark: SparkSession, d: str) -> DataFrame:
    """Entities, the ends of relations that no mention has, and the relations."""
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    relations = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("subject"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"))
    mentions = load(spark, d, "extracted_knowledge").filter(terms.strip("text") != "")
    return kb.build(mentions, relations).select("s", "p", "o").distinct()


@query(f"""WITH {_MENTION_SQL}, seen AS (SELECT DISTINCT text FROM m), ends AS (SELECT DISTINCT {_strip("label")} AS text FROM entity_mapping WHERE label IS NOT NULL AND {_strip("label")} <> '')
SELECT '{kb.KB}' || {_SLUG('text')} AS s, text AS label FROM ends WHERE text NOT IN (SELECT text FROM seen)""")
def kb_missing_endpoints(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "entity_mapping").filter(terms.strip("label") != "").select(F.col("label").alias("subject"), F.col("label").alias("object"))
    g = kb.endpoint_triples(load(spark, d, "extracted_knowledge").filter("text is not null"), names)
    return g.filter(F.col("p") == RDFS + "label").select("s", F.col("o").alias("label"))


@query(f"SELECT upper(type) AS type, count(*) AS n FROM extracted_knowledge WHERE text IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def kb_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return tr.top_counts(load(spark, d, "extracted_knowledge").filter("text is not null"), F.upper("type"), "type", 10)


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{kb.KB}{a}', '{kb.KB}{b}')" for a, b in (("Character", "Entity"), ("Enemy", "Character"), ("Enemy", "Entity"), ("VideoGame", "Entity"), ("Location", "Entity"), ("Item", "Entity"), ("Organization", "Entity"), ("RealPerson", "Entity"), ("GeoPoliticalEntity", "Location"), ("GeoPoliticalEntity", "Entity"))) + ") AS t(sub, sup)"
)
def ontology_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return reason.subclass_closure(kb.ontology(spark))


# ---------------------------------------------------------------- reasoning


def _closed(spark: SparkSession, d: str) -> DataFrame:
    g = views.parties(spark, d).unionByName(views.orders(spark, d)).unionByName(views.schema(spark).select(*rdf.COLUMNS))
    return reason.materialise(g)


_SUB_SQL = "edges(a, b) AS (VALUES ('Customer', 'Party'), ('Supplier', 'Party'), ('Party', 'Agent'), ('Order', 'Thing'), ('Part', 'Thing'), ('Nation', 'Place'), ('Region', 'Place')), sco(a, b) AS (SELECT a, b FROM edges UNION SELECT s.a, e.b FROM sco s JOIN edges e ON s.b = e.a)"


@query(f"WITH RECURSIVE {_SUB_SQL} SELECT '{T}' || a AS sub, '{T}' || b AS sup FROM sco")
def sco_closure(spark: SparkSession, d: str) -> DataFrame:
    pairs = reason.subclass_closure(views.schema(spark))
    return pairs.filter(~F.col("sub").startswith("_:") & ~F.col("sup").startswith("_:") & (F.col("sub") != F.col("sup")))


@query(f"WITH RECURSIVE {_SUB_SQL}, t AS (SELECT {_n('customer', 'c_custkey')} AS s, 'Customer' AS c FROM customer UNION ALL SELECT {_n('supplier', 's_suppkey')}, 'Supplier' FROM supplier) SELECT DISTINCT s, '{T}' || b AS cls FROM t JOIN sco ON c = a")
def type_propagation(spark: SparkSession, d: str) -> DataFrame:
    g = views.customers(spark, d).unionByName(views.suppliers(spark, d)).filter(F.col("p") == RDF + "type").unionByName(views.schema(spark).filter(F.col("p") == RDFS + "subClassOf").select(*rdf.COLUMNS))
    return reason.derive(g.filter(F.col("p") == RDF + "type"), g, reason.Schema(g)).select("s", F.col("o").alias("cls")).distinct()


@query(f"SELECT {_n('order', 'o_orderkey')} AS s, '{T}relatedTo' AS p, {_n('customer', 'o_custkey')} AS o FROM orders UNION SELECT {_n('order', 'o_orderkey')}, '{RDF}type', '{T}Order' FROM orders UNION SELECT {_n('customer', 'o_custkey')}, '{RDF}type', '{T}Customer' FROM orders")
def subproperty_domain_range(spark: SparkSession, d: str) -> DataFrame:
    axioms = views.schema(spark).filter(F.col("p").isin(RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range")).select(*rdf.COLUMNS)
    g = views.orders(spark, d).filter(F.col("p") == T + "placedBy")
    return reason.derive(g, g, reason.Schema(axioms)).select("s", "p", "o").distinct()


@query(f"SELECT {_n('customer', 'o_custkey')} AS s, '{T}placed' AS p, {_n('order', 'o_orderkey')} AS o FROM orders UNION SELECT {_n('nation', 'b.n_nationkey')}, '{T}trades', {_n('nation', 'a.n_nationkey')} FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def symmetric_inverse(spark: SparkSession, d: str) -> DataFrame:
    axioms = views.schema(spark).filter((F.col("p") == OWL + "inverseOf") | (F.col("o") == OWL + "SymmetricProperty")).select(*rdf.COLUMNS)
    n = load(spark, d, "nation")
    pairs = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    none = F.lit(None).cast("string")
    trades = pairs.select(views.node("nation", "a.n_nationkey").alias("s"), F.lit(T + "trades").alias("p"), views.node("nation", "b.n_nationkey").alias("o"), F.lit("uri").alias("o_kind"), none.alias("dt"), none.alias("lang"))
    g = views.orders(spark, d).filter(F.col("p") == T + "placedBy").unionByName(trades)
    return reason.derive(g, g, reason.Schema(axioms)).select("s", "p", "o").distinct()


@query(f"""WITH l AS (SELECT {_n('customer', 'c_custkey')} AS s, {_n('nation', 'c_nationkey')} AS o FROM customer UNION SELECT {_n('supplier', 's_suppkey')}, {_n('nation', 's_nationkey')} FROM supplier), n AS (SELECT {_n('nation', 'n_nationkey')} AS s, {_n('region', 'n_regionkey')} AS o FROM nation)
SELECT s, o FROM l UNION SELECT s, o FROM n UNION SELECT l.s, n.o FROM l JOIN n ON l.o = n.s""")
def transitive_located_in(spark: SparkSession, d: str) -> DataFrame:
    axioms = views.schema(spark).filter(F.col("o") == OWL + "TransitiveProperty").select(*rdf.COLUMNS)
    g = views.parties(spark, d).filter(F.col("p") == T + "locatedIn").unionByName(axioms)
    return reason.materialise(g).filter(F.col("p") == T + "locatedIn").select("s", "o")


@query(f"SELECT DISTINCT {_n('customer', 'o_custkey')} AS s FROM orders")
def some_values_from(spark: SparkSession, d: str) -> DataFrame:
    return _closed(spark, d).filter((F.col("p") == RDF + "type") & (F.col("o") == T + "Buyer")).select("s")


@query(f"SELECT {_n('customer', 'c_custkey')} AS s, '{T}RichCustomer' AS o FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) > 5000")
def swrl_rich_customer(spark: SparkSession, d: str) -> DataFrame:
    return reason.apply_rule(views.customers(spark, d), "?c a t:Customer . ?c t:acctbal ?a . FILTER(?a > 5000)", "?c a t:RichCustomer", PREFIXES).select("s", "o")


@query(f"SELECT {_n('customer', 'o_custkey')} AS s, count(DISTINCT o_orderkey) AS n_values FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) > 1")
def functional_violations(spark: SparkSession, d: str) -> DataFrame:
    """Customers who placed several orders, as if that were functional; some placed one."""
    axioms = views.schema(spark).filter(F.col("p") == OWL + "inverseOf").select(*rdf.COLUMNS)
    g = views.orders(spark, d).filter(F.col("p") == T + "placedBy")
    return reason.functional_violations(reason.derive(g, g, reason.Schema(axioms)), [T + "placed"]).select("s", "n_values")


@query(f"WITH l AS (SELECT DISTINCT {_n('part', 'l_partkey')} AS s, {_n('supplier', 'l_suppkey')} AS o FROM lineitem), m AS (SELECT s, min(o) AS least FROM l GROUP BY s) SELECT DISTINCT least AS s, '{OWL}sameAs' AS p, o FROM l JOIN m USING (s) WHERE o <> least")
def functional_same_as(spark: SparkSession, d: str) -> DataFrame:
    return reason.functional_same(views.lines(spark, d), [T + "suppliedBy"]).select("s", "p", "o")


@query(f"SELECT {_n('customer', 'c_custkey')} AS s, '{T}Customer' AS a, '{T}RichCustomer' AS b FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) > 5000")
def disjoint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Members of two classes declared disjoint, one of which a rule fills; a third pair has no members in common."""
    g = views.customers(spark, d)
    rich = reason.apply_rule(g, "?c a t:Customer . ?c t:acctbal ?a . FILTER(?a > 5000)", "?c a t:RichCustomer", PREFIXES)
    return reason.disjoint_violations(tr.union(g, rich, views.suppliers(spark, d)), [(T + "Customer", T + "RichCustomer"), (T + "Customer", T + "Supplier")])


@query(f"SELECT {_n('customer', 'o_custkey')} AS s, '{T}fulfilledBy' AS p, {_n('order', 'o_orderkey')} AS o FROM orders WHERE o_orderstatus = 'F'")
def rule_of_three_patterns(spark: SparkSession, d: str) -> DataFrame:
    g = tr.union(views.orders(spark, d), views.customers(spark, d))
    return reason.apply_rule(g, '?c a t:Customer . ?o t:placedBy ?c . ?o t:status "F"', "?c t:fulfilledBy ?o", PREFIXES).select("s", "p", "o")


@query(f"SELECT {_n('supplier', 'a.s_suppkey')} AS s, '{T}neighbourOf' AS p, {_n('supplier', 'b.s_suppkey')} AS o FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def rule_with_inequality(spark: SparkSession, d: str) -> DataFrame:
    return reason.apply_rule(views.suppliers(spark, d), "?a t:locatedIn ?n . ?b t:locatedIn ?n . ?a a t:Supplier . ?b a t:Supplier . FILTER(?a != ?b)", "?a t:neighbourOf ?b", PREFIXES).select("s", "p", "o")


@query(f"""WITH g AS (SELECT s, o, o_kind, p FROM ({views.CUSTOMERS_SQL})) SELECT DISTINCT x AS s, '{OWL}sameAs' AS p, x AS o FROM (SELECT s AS x FROM g UNION SELECT o FROM g WHERE o_kind = 'uri')""")
def reflexive_same_as(spark: SparkSession, d: str) -> DataFrame:
    return reason.reflexive(views.customers(spark, d)).select("s", "p", "o")


@query(f"""SELECT 'Agent' AS cls, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'Party', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'Customer', (SELECT count(*) FROM customer)
UNION ALL SELECT 'Supplier', (SELECT count(*) FROM supplier) UNION ALL SELECT 'Order', (SELECT count(*) FROM orders) UNION ALL SELECT 'Thing', (SELECT count(*) FROM orders) UNION ALL SELECT 'Buyer', (SELECT count(DISTINCT o_custkey) FROM orders)
UNION ALL SELECT 'Nation', (SELECT count(*) FROM nation) UNION ALL SELECT 'Region', (SELECT count(*) FROM region) UNION ALL SELECT 'Place', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)""")
def owlrl_closure_counts(spark: SparkSession, d: str) -> DataFrame:
    members = _closed(spark, d).filter((F.col("p") == RDF + "type") & F.col("o").startswith(T))
    return members.groupBy(terms.local_name("o").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- documents

_WORDS = lambda x: rf"len(list_filter(string_split_regex({x}, '[\s\x0b\x85\p{{Z}}]+'), lambda w: w <> ''))"
_CLEAN = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: length(x) >= 15 AND NOT (starts_with(x, '==') AND ends_with(x, '=='))), ' ')"


@query(f"SELECT doc_id, md5(clean) AS clean, {_WORDS('clean')} AS n_words FROM (SELECT doc_id, {_CLEAN} AS clean FROM documents WHERE text IS NOT NULL) WHERE {_WORDS('clean')} >= 100")
def doc_clean_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").filter("text is not null").select("doc_id", terms.clean_text("text").alias("clean"))
    return docs.withColumn("n_words", terms.word_count("clean")).filter("n_words >= 100").select("doc_id", F.md5("clean").alias("clean"), F.col("n_words").cast("long").alias("n_words"))


def _html() -> Column:
    return F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title><style>p { }</style></head><body><nav>menu</nav><script>x</script><p>"), F.col("text"), F.lit("</p></body></html>"))


_HTML_SQL = "'<html><head><title>' || coalesce(title, '') || '</title><style>p { }</style></head><body><nav>menu</nav><script>x</script><p>' || text || '</p></body></html>'"


@query(
    "SELECT page_id, title, md5(" + _strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x0b\x85\p{Z}]+', ' ', 'g')")
    + f") AS body FROM (SELECT page_id, regexp_extract({_HTML_SQL}, '(?is)<title>(.*?)</title>', 1) AS title, {_HTML_SQL} AS html FROM crawler_output WHERE text IS NOT NULL)"
)
def page_main_text(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "crawler_output").filter("text is not null").select("page_id", _html().alias("html"))
    return pages.select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.md5(terms.main_text("html")).alias("body"))


@query(f"SELECT coalesce(c.page_id, d.doc_id) AS page_id, md5(CASE WHEN c.text IS NOT NULL AND {_strip('c.text')} <> '' THEN c.text ELSE d.text END) AS text FROM crawler_output c FULL JOIN documents d ON c.page_id = d.doc_id")
def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return files.first_text(load(spark, d, "crawler_output").select("page_id", "text"), docs, "page_id").select("page_id", F.md5("text").alias("text"))


@query(f"SELECT count(*) AS docs, CAST(sum(w) AS BIGINT) AS words, CAST(sum(w) // count(*) AS BIGINT) AS avg_words FROM (SELECT {_WORDS('text')} AS w FROM documents WHERE text IS NOT NULL)")
def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "documents").filter("text is not null").select(terms.word_count("text").cast("long").alias("w"))
    return w.agg(F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words")).select("docs", "words", F.expr("words div docs").alias("avg_words"))


#: Patterns of the test wiki's names.
WORLD = [
    ("[A-Z][a-z]+ (?:Harbour|Docks|Keep|Canyon|Falls|Marsh|Ridge|Caverns|Orchard|Observatory|Village|Isle|Land|Drift)", "LOCATION"),
    ("[A-Z][a-z]+ (?:Racers|Quest|Odyssey|Party|Golf|Rally|Story|Chronicle|Tactics|Puzzle League)", "GAME"),
    ("(?:Lady|Captain|Professor|Doctor|King|Queen) [A-Z][a-z]+", "CHARACTER"),
    ("[A-Z][a-z]{8,}", "CHARACTER"),
]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("text is not null").select("doc_id", "text")


_MENTIONS_SQL = "raw AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} * 1000000 + generate_subscripts(f, 1) - 1 AS ord, unnest(f) AS t, '{t}' AS type FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS f FROM documents WHERE text IS NOT NULL)" for i, (p, t) in enumerate(WORLD)) + f"), ments AS (SELECT doc_id, ord, text, type FROM (SELECT doc_id, ord, regexp_replace({_strip('t')}, '[.,;:!?]+$', '') AS text, type FROM raw) WHERE length(text) >= 2 AND lower(text) NOT IN ({_list(fixed.ENTITY_STOP)}))"


@query(f"WITH {_MENTIONS_SQL} SELECT doc_id, CAST(ord AS INTEGER) AS ord, text, type FROM ments")
def pattern_mentions(spark: SparkSession, d: str) -> DataFrame:
    return extract.pattern_mentions(_docs(spark, d), "doc_id", "text", WORLD, case=True).select("doc_id", F.col("ord").cast("int").alias("ord"), "text", "type")


@query(f"WITH {_MENTIONS_SQL} SELECT text, type, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(text), type ORDER BY doc_id, ord) AS n FROM ments) WHERE n = 1")
def mention_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return extract.first_mentions(extract.pattern_mentions(_docs(spark, d), "doc_id", "text", WORLD, case=True), "doc_id").select("text", "type", "doc_id")


_SENTS_SQL = rf"sents AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[\t\n\x0b\f\r ]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')} <> '')[1:60] AS s FROM documents WHERE text IS NOT NULL))"


@query(f"WITH {_SENTS_SQL} SELECT doc_id, CAST(sent AS INTEGER) AS sent, md5(sentence) AS sentence FROM sents")
def sentence_split_cap(spark: SparkSession, d: str) -> DataFrame:
    s = _docs(spark, d).select("doc_id", F.posexplode(F.slice(extract.sentences(F.col("text")), 1, extract.SENTENCES)).alias("sent", "s"))
    return s.select("doc_id", "sent", F.md5("s").alias("sentence"))


_SE_SQL = f"{_MENTIONS_SQL}, {_SENTS_SQL}, firsts AS (SELECT doc_id, text, type, min(ord) AS ord FROM ments GROUP BY ALL), se AS (SELECT s.doc_id, s.sent, s.sentence, f.text, f.type, f.ord, count(*) OVER (PARTITION BY s.doc_id, s.sent) AS k FROM sents s JOIN firsts f ON s.doc_id = f.doc_id AND contains(lower(s.sentence), lower(f.text))), good AS (SELECT * FROM se WHERE k >= 2)"


def _found(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return extract.sentence_mentions(docs, extract.pattern_mentions(docs, "doc_id", "text", WORLD, case=True), "doc_id", "text")


@query(f"WITH {_SE_SQL} SELECT doc_id, CAST(sent AS INTEGER) AS sent, text, type FROM good")
def sentence_entities(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("doc_id", "sent", F.explode("ents").alias("e")).select("doc_id", "sent", "e.text", "e.type")


_VERBS_SQL = "verbs(v, w, predicate) AS (VALUES " + ", ".join(f"({i}, '{w}', '{p}')" for i, (w, p) in enumerate(fixed.RELATION_VERBS)) + ")"
_SVO_SQL = rf"""{_SE_SQL}, {_VERBS_SQL}, hit AS (SELECT DISTINCT g.doc_id, g.sent, g.sentence, v, w, predicate, regexp_extract(g.sentence, '(?is)^(.*?)\b(?:' || w || ')\b', 1) AS l FROM (SELECT DISTINCT doc_id, sent, sentence FROM good) g JOIN verbs ON contains(lower(g.sentence), w) AND regexp_matches(g.sentence, '(?i)\b' || w || '\b')),
sides AS (SELECT *, substr(sentence, length(l) + length(w) + 1) AS r FROM hit),
sub AS (SELECT x.doc_id, x.sent, x.v, arg_max(g.text, g.ord) AS subject, arg_max(g.type, g.ord) AS st FROM sides x JOIN good g ON x.doc_id = g.doc_id AND x.sent = g.sent AND contains(lower(x.l), lower(g.text)) GROUP BY ALL),
obj AS (SELECT x.doc_id, x.sent, x.v, arg_min(g.text, g.ord) AS object, arg_min(g.type, g.ord) AS ot FROM sides x JOIN good g ON x.doc_id = g.doc_id AND x.sent = g.sent AND contains(lower(x.r), lower(g.text)) GROUP BY ALL),
svo AS (SELECT doc_id, sent, v, subject, predicate, object FROM sub JOIN obj USING (doc_id, sent, v) JOIN verbs USING (v) WHERE subject <> object)"""


@query(f"WITH {_SVO_SQL} SELECT doc_id, CAST(sent AS INTEGER) AS sent, subject, predicate, object FROM svo")
def svo_relations(spark: SparkSession, d: str) -> DataFrame:
    return extract.svo(_found(spark, d), "doc_id").select("doc_id", "sent", "subject", "predicate", "object")


_CO_SQL = f"""{_SVO_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY ord, text) AS pos FROM good WHERE (doc_id, sent) NOT IN (SELECT (doc_id, sent) FROM svo)),
co AS (SELECT doc_id, sent, subject, object, n FROM (SELECT a.doc_id, a.sent, a.text AS subject, b.text AS object, row_number() OVER (PARTITION BY a.doc_id, a.sent ORDER BY a.pos, b.pos) AS n FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND a.sent = b.sent AND a.pos < b.pos AND a.text <> b.text) WHERE n <= 6)"""


@query(f"WITH {_CO_SQL} SELECT doc_id, CAST(sent AS INTEGER) AS sent, subject, object FROM co")
def cooccurrence_capped(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    return extract.cooccurrence(found, extract.svo(found, "doc_id"), "doc_id").select("doc_id", "sent", "subject", "object")


@query(f"""WITH {_CO_SQL}, al AS (SELECT doc_id, sent, v AS ord, subject, predicate, object FROM svo UNION ALL SELECT doc_id, sent, n - 1, subject, 'co_occurs_with', object FROM co)
SELECT subject, predicate, object FROM (SELECT *, row_number() OVER (PARTITION BY lower(subject), predicate, lower(object) ORDER BY doc_id, sent, ord) AS k FROM al) WHERE k = 1""")
def relation_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    svo = extract.svo(found, "doc_id")
    return extract.first_relations(svo.unionByName(extract.cooccurrence(found, svo, "doc_id")), "doc_id").select("subject", "predicate", "object")


@query(f"WITH {_MENTIONS_SQL} SELECT type, count(*) AS n, count(DISTINCT lower(text)) AS names FROM ments GROUP BY type")
def extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    m = extract.pattern_mentions(_docs(spark, d), "doc_id", "text", WORLD, case=True)
    return m.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("text")).alias("names"))


@query()
def tagged_mentions_merged(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    m = extract.merged(extract.pattern_mentions(docs, "doc_id", "text", WORLD, case=True), extract.tagged_mentions(docs, "doc_id", "text"), "doc_id")
    return m.groupBy("method", "type").agg(F.count(F.lit(1)).alias("n"))


_CHUNK_SQL = f"chunks AS (SELECT doc_id, chunk, text FROM (SELECT doc_id, CAST(k AS INTEGER) AS chunk, substr(text, CAST(k * 450 + 1 AS BIGINT), 500) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 450.0) AS BIGINT))) AS k FROM documents WHERE text IS NOT NULL AND length(text) > 0)) WHERE length({_strip('text')}) > 50)"


@query(f"WITH {_CHUNK_SQL} SELECT doc_id, chunk, text FROM chunks")
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extract.chunks(_docs(spark, d), "doc_id", "text")


@query(f"WITH {_CHUNK_SQL} SELECT (SELECT count(DISTINCT title) FROM documents) AS titles, (SELECT count(*) FROM chunks) AS n_chunks, 500 AS dim")
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    n = extract.chunks(_docs(spark, d), "doc_id", "text").agg(F.count(F.lit(1)).alias("n_chunks"))
    return load(spark, d, "documents").agg(F.countDistinct("title").alias("titles")).crossJoin(n).select("titles", "n_chunks", F.lit(500).alias("dim"))


# ---------------------------------------------------------------- names and questions

_INDEX_SQL = f"lab AS (SELECT lower(o) AS label, s AS uri, 1 AS pass FROM g WHERE p = '{RDFS}label' UNION ALL SELECT lower(replace(split_part(s, '#', -1), '_', ' ')), s, 3 FROM g WHERE p = '{RDF}type'), idx AS (SELECT label, uri FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pass DESC, uri DESC) AS n FROM lab) WHERE n = 1)"
NAMES = ["FRANCE", "customer/1", "china and japan", "asia", "ameri", "UNITED", "no such thing at all", "Supplier#000000003"]


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


@query(f"WITH g AS ({views.PARTIES_SQL}), {_INDEX_SQL} SELECT label, uri FROM idx")
def label_index_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.label_index(views.parties(spark, d), DATA)


@query(f"""WITH g AS ({views.PARTIES_SQL}), {_INDEX_SQL}, names(name) AS (VALUES {', '.join(f"('{n}')" for n in NAMES)}), cand AS (
SELECT name, uri, label, 1 AS rank FROM names JOIN idx ON lower(trim(name)) = label
UNION ALL SELECT DISTINCT name, s, lower(name), 2 FROM names JOIN g ON s = '{DATA}' || replace(name, ' ', '_')
UNION ALL SELECT name, uri, label, 3 FROM names JOIN idx ON contains(label, lower(name)) OR contains(lower(name), label))
SELECT name, uri, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, length(label) DESC, label, uri) AS n FROM cand) WHERE n = 1""")
def entity_cascade_lookup(spark: SparkSession, d: str) -> DataFrame:
    g = views.parties(spark, d)
    return retrieve.search(_names(spark), retrieve.label_index(g, DATA), g, [DATA])


@query(f"SELECT s, CAST(place AS INTEGER) AS place, fact FROM (SELECT s, {_short('p')} || ': ' || CASE WHEN o_kind = 'uri' THEN {_short('o')} ELSE o END AS fact, row_number() OVER (PARTITION BY s ORDER BY p, o) AS place FROM ({views.PARTIES_SQL})) WHERE place <= 3")
def entity_facts_topn(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.facts(views.parties(spark, d), 3)


@query(f"SELECT s, name FROM (SELECT s, name, row_number() OVER (PARTITION BY s ORDER BY name) AS n FROM (SELECT DISTINCT s, {_short('o')} AS name FROM ({views.PARTIES_SQL}) WHERE o_kind = 'uri') WHERE length(name) > 1) WHERE n <= 10")
def entity_related(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.related(views.parties(spark, d), 10)


QUESTIONS = ["Which suppliers are in France?", "Tell me about the orders of Germany and China.", "Who is Customer#000000007?", "what is it", "How far is Saudi Arabia from Asia?"]


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "qid long, question string")


_QS_SQL = "qs(qid, question) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ")"


@query(f"""WITH {_QS_SQL}, w AS (SELECT qid, list_filter(string_split(lower(question), ' '), lambda x: regexp_replace(x, '^[?,!.]+|[?,!.]+$', '', 'g') NOT IN ({_list(fixed.QUESTION_STOP)})) AS ws FROM qs),
n AS (SELECT qid, ws, unnest(range(1, 5)) AS k FROM w), i AS (SELECT qid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM n WHERE k <= len(ws))
SELECT CAST(qid AS BIGINT) AS qid, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM i WHERE length(array_to_string(ws[i:i + k - 1], ' ')) >= 2""")
def question_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark).select("qid", F.explode(terms.ngrams(terms.question_words("question"))).alias("phrase"))


@query()
def question_entity_facts(spark: SparkSession, d: str) -> DataFrame:
    g = views.parties(spark, d)
    ents = retrieve.question_entities(_questions(spark), retrieve.label_index(g, DATA), g, [DATA])
    return retrieve.blocks(ents, g)


TERMS = ["france", "germany", "china", "asia", "europe", "atlantis", "africa", "mars", "japan", "kenya"]


@query(f"""WITH g AS ({views.PARTIES_SQL}), {_INDEX_SQL}, t(name) AS (VALUES {', '.join(f"('{n}')" for n in TERMS)}) SELECT round(avg(CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END) * 100, 2) AS coverage, avg(CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END) >= 0.5 AS passed FROM t LEFT JOIN idx ON name = label""")
def coverage_metric(spark: SparkSession, d: str) -> DataFrame:
    g = views.parties(spark, d)
    names = spark.createDataFrame([(t,) for t in TERMS], "name string")
    hits = names.join(retrieve.label_index(g, DATA), F.col("name") == F.col("label"), "left")
    counts = retrieve.facts(g, 15).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return retrieve.coverage(hits.join(counts, hits["uri"] == counts["s"], "left").select(F.coalesce("n", F.lit(0)).alias("n_facts")))


@query()
def neighbour_facts(spark: SparkSession, d: str) -> DataFrame:
    vec = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    near = kge.nearest(vec.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), vec, 5)
    neighbours = near.select(F.concat(F.lit(f"{DATA}customer/"), F.col("qid")).alias("seed"), (F.col("place") - 1).alias("rank"), F.concat(F.lit(f"{DATA}customer/"), F.col("id")).alias("entity"), F.concat(F.lit("Customer_"), F.col("id")).alias("label"), F.col("score").alias("sim"))
    keywords = spark.createDataFrame([(0, "france", f"{DATA}customer/20"), (1, "germany", f"{DATA}customer/40")], "ord int, keyword string, seed string")
    return retrieve.neighbour_facts(retrieve.neighbour_seeds(_questions(spark), keywords), neighbours, views.customers(spark, d))


# ---------------------------------------------------------------- vectors and embeddings


_COS_SQL = "q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id AS id, round(list_sum(list_transform(list_zip(q, embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) + 1e-10), 6) AS score FROM q, embeddings)"


@query(f"WITH {_COS_SQL} SELECT qid, id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM s) WHERE place <= 5")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vec = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return kge.nearest(vec.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), vec, 5, exclude_self=False, round_to=6)


@query(f"WITH {_COS_SQL} SELECT qid, id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM s WHERE qid <> id) WHERE place <= 5")
def vector_knn_excl_self(spark: SparkSession, d: str) -> DataFrame:
    vec = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return kge.nearest(vec.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), vec, 5, round_to=6)


_TFIDF_SQL = r"""t AS (SELECT doc_id AS id, unnest(list_filter(string_split(lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, ln(((SELECT count(DISTINCT id) FROM docs) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY term),
w AS (SELECT id, term, tf * idf AS x FROM tf JOIN df USING (term)), nm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM w GROUP BY id), ww AS (SELECT id, term, x / nullif(norm, 0) AS w FROM w JOIN nm USING (id))"""


@query(r"WITH docs AS (SELECT doc_id AS id FROM documents WHERE text IS NOT NULL), " + _TFIDF_SQL + r""", qt AS (SELECT DISTINCT item_id AS qid, unnest(string_split(lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS term FROM eval_items), sc AS (SELECT qid, id, round(sum(w), 6) AS score FROM qt JOIN ww USING (term) WHERE term <> '' GROUP BY ALL)
SELECT qid, round(score, 4) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM sc) WHERE place <= 3""")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    top = retrieve.lexical_topk(load(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "text"), _docs(spark, d).withColumnRenamed("doc_id", "id"), 3)
    return top.select("qid", F.round("score", 4).alias("score"), F.col("place").cast("int").alias("place"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return kge.cleaned(views.orders(spark, d).unionByName(views.parties(spark, d)), [RDF + "type"])


_LINKS_SQL = f"links AS (SELECT DISTINCT s, p, o FROM ({views.ORDERS_SQL} UNION ALL {views.PARTIES_SQL}) WHERE o_kind = 'uri' AND p <> '{RDF}type')"
_PARTS_SQL = f"{_LINKS_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY md5(s || chr(1) || p || chr(1) || o || chr(1) || '42')) - 1 AS r, count(*) OVER () AS n FROM links), parts AS (SELECT s, p, o, CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS part FROM ranked)"


@query(f"WITH {_PARTS_SQL} SELECT s, p, o, part FROM parts")
def split_80_10_10(spark: SparkSession, d: str) -> DataFrame:
    return kge.split(_links(spark, d))


@query(f"""WITH {_PARTS_SQL}, e AS (SELECT s AS x FROM parts WHERE part = 'train' UNION SELECT o FROM parts WHERE part = 'train'), r AS (SELECT DISTINCT p FROM parts WHERE part = 'train')
SELECT s, p, o, CASE WHEN s IN (SELECT x FROM e) AND o IN (SELECT x FROM e) AND p IN (SELECT p FROM r) THEN part ELSE 'train' END AS part FROM parts""")
def split_leakage_repair(spark: SparkSession, d: str) -> DataFrame:
    return kge.repair_leakage(kge.split(_links(spark, d)))


@query(f"""WITH {_LINKS_SQL}, e AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS id FROM (SELECT s AS x FROM links UNION SELECT o FROM links)), r AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS id FROM (SELECT DISTINCT p FROM links))
SELECT a.id AS h, r.id AS r, b.id AS t FROM links l JOIN e a ON l.s = a.x JOIN e b ON l.o = b.x JOIN r ON l.p = r.p""")
def id_encoding(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    ents = kge.dictionary(links.select(F.col("s").alias("uri")).unionByName(links.select(F.col("o").alias("uri"))), "uri")
    return kge.encode(links, ents, kge.dictionary(links.select(F.col("p").alias("uri")), "uri"))


@query("SELECT s, max(o) AS type FROM private_kb WHERE p LIKE '%#type' AND o IS NOT NULL GROUP BY s")
def entity_type_last(spark: SparkSession, d: str) -> DataFrame:
    return kge.last_types(load(spark, d, "private_kb").filter((F.col("p") == RDF + "type") & F.col("o").isNotNull()), F.col("o"))


@query("SELECT DISTINCT e.private_entity AS entity, coalesce(t.type, 'Other') AS type FROM entity_mapping e LEFT JOIN (SELECT s, split_part(max(o), '/', -1) AS type FROM private_kb WHERE p LIKE '%#type' AND o IS NOT NULL GROUP BY s) t ON 'http://lanternkb.example/kb/' || e.private_entity = t.s")
def entity_type_or_other(spark: SparkSession, d: str) -> DataFrame:
    types = entity_type_last(spark, d).select("s", F.substring_index("type", "/", -1).alias("type"))
    e = load(spark, d, "entity_mapping").select(F.col("private_entity").alias("entity"), F.concat(F.lit("http://lanternkb.example/kb/"), "private_entity").alias("s")).distinct()
    return e.join(types, "s", "left").select("entity", F.coalesce("type", F.lit("Other")).alias("type"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").groupBy(F.col("label").alias("id")).agg(vectors.mean_vector(F.col("embedding"), 64).alias("vec"))


_CENT_SQL = "c AS (SELECT label AS id, [" + ", ".join(f"avg(CAST(embedding[{i}] AS DOUBLE))" for i in range(1, 65)) + "] AS vec FROM embeddings GROUP BY label)"
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_COS = lambda a, b: f"({_DOT(a, b)} / (sqrt({_DOT(a, a)}) * sqrt({_DOT(b, b)}) + 1e-10))"


@query(f"WITH {_CENT_SQL} SELECT id, round(sqrt({_DOT('vec', 'vec')}), 6) AS norm FROM c")
def relation_norms(spark: SparkSession, d: str) -> DataFrame:
    return _centroids(spark, d).select("id", F.round(vectors.norm(F.col("vec")), 6).alias("norm"))


@query(f"WITH {_CENT_SQL} SELECT a.id AS a, b.id AS b, round({_COS('a.vec', 'b.vec')}, 6) AS cos FROM c a JOIN c b ON a.id < b.id ORDER BY 3 DESC, 1, 2 LIMIT 5")
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return kge.similar_pairs(_centroids(spark, d), 5)


_SUM_SQL = "p AS (SELECT a.id * 100 + b.id AS qid, list_transform(list_zip(a.vec, b.vec), lambda z: z[1] + z[2]) AS q FROM c a JOIN c b ON b.id = a.id + 1)"


@query(f"WITH {_CENT_SQL}, {_SUM_SQL} SELECT qid, id, score FROM (SELECT qid, id, round({_COS('q', 'vec')}, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round({_COS('q', 'vec')}, 6) DESC, id) AS n FROM p, c) WHERE n <= 3")
def composition_top3(spark: SparkSession, d: str) -> DataFrame:
    c = cut(_centroids(spark, d))
    pairs = c.alias("a").join(c.alias("b"), F.col("b.id") == F.col("a.id") + 1).select((F.col("a.id") * 100 + F.col("b.id")).alias("qid"), vectors.add(F.col("a.vec"), F.col("b.vec")).alias("qvec"))
    return kge.nearest(pairs, c, 3, exclude_self=False, round_to=6).select("qid", "id", "score")


@query(f"WITH {_CENT_SQL}, {_SUM_SQL}, s AS (SELECT qid, id, round({_COS('q', 'vec')}, 6) AS score FROM p, c), t AS (SELECT qid, score FROM s WHERE id = qid % 100) SELECT t.qid, CAST(1 + count(*) FILTER (WHERE s.score > t.score) AS BIGINT) AS target_rank FROM t JOIN s USING (qid) GROUP BY t.qid")
def rule_vs_vector(spark: SparkSession, d: str) -> DataFrame:
    c = cut(_centroids(spark, d))
    pairs = c.alias("a").join(c.alias("b"), F.col("b.id") == F.col("a.id") + 1).select((F.col("a.id") * 100 + F.col("b.id")).alias("qid"), vectors.add(F.col("a.vec"), F.col("b.vec")).alias("qvec"))
    s = kge.nearest(pairs, c, 1000, exclude_self=False, round_to=6)
    t = s.filter(F.col("id") == F.pmod("qid", F.lit(100))).select("qid", F.col("score").alias("_t"))
    return s.join(t, "qid").groupBy("qid").agg((F.lit(1) + F.count_if(F.col("score") > F.col("_t"))).cast("long").alias("target_rank"))


# embeddings as things of several spaces, some of which can't be shown
_THING_SQL = "CASE id % 5 WHEN 0 THEN 'http://dbpedia.org/resource/Lamp_' || id WHEN 1 THEN 'http://dbpedia.org/resource/Category:' || id WHEN 2 THEN 'http://fr.dbpedia.org/resource/Lampe_' || id WHEN 3 THEN 'http://dbpedia.org/resource/Lamp_' || id || '.PNG' ELSE 'http://dbpedia.org/resource/Q' || id END"


def _near_things(spark: SparkSession, d: str) -> DataFrame:
    thing = F.expr(_THING_SQL)
    return vector_knn_excl_self(spark, d).withColumn("entity", thing).withColumn("label", F.substring_index("entity", "/", -1))


@query(f"WITH {_COS_SQL}, n AS (SELECT qid, id, score, {_THING_SQL} AS entity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM s WHERE qid <> id) WHERE place <= 5) SELECT qid, entity, score FROM n WHERE id % 5 = 0 AND score >= 0.3")
def neighbour_filter_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _near_things(spark, d).filter(kge.useful_neighbour(F.col("entity"), F.col("label")) & (F.col("score") >= 0.30)).select("qid", "entity", "score")


@query(f"WITH {_COS_SQL} SELECT count(DISTINCT qid) AS entities, count(*) AS neighbours FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM s WHERE qid <> id) WHERE place <= 5")
def neighbour_stats(spark: SparkSession, d: str) -> DataFrame:
    return kge.neighbour_stats(vector_knn_excl_self(spark, d).withColumnRenamed("qid", "seed"))


# test triples: each vector belongs to its label's centroid; the candidates are the centroids
_RANK_SQL = f"{_CENT_SQL}, sc AS (SELECT vec_id AS q, c.id AS candidate, e.label AS truth, round(-sqrt(list_sum(list_transform(list_zip(e.embedding, c.vec), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))), 6) AS score FROM embeddings e, c), rk AS (SELECT a.q, (count(*) FILTER (WHERE b.score > a.score) + 1 + count(*) FILTER (WHERE b.score >= a.score)) / 2 AS rank FROM sc a JOIN sc b ON a.q = b.q WHERE a.candidate = a.truth AND NOT (b.candidate = (b.truth + 1) % 10) GROUP BY a.q)"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec"), F.col("label").alias("truth"))
    return kge.ranks_by_distance(e, _centroids(spark, d), e.select("q", ((F.col("truth") + 1) % 10).alias("candidate")))


@query(f"WITH {_RANK_SQL} SELECT q, rank FROM rk")
def transe_filtered_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d)


@query(f"WITH {_RANK_SQL} SELECT round(avg(1 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS hits_at_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS hits_at_3, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS hits_at_10 FROM rk")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return kge.ranking_metrics(_ranks(spark, d))


_HALF = lambda v, lo: f"{v}[{lo + 1}:{lo + 32}]"
_THREE = lambda a, b, c: f"list_sum(list_transform(list_zip({a}, {b}, {c}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE) * CAST(z[3] AS DOUBLE)))"


@query(
    "WITH x AS (SELECT a.vec_id AS id, a.embedding AS h, b.embedding AS r, t.embedding AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings t ON t.vec_id = a.vec_id + 2) SELECT id, round("
    + " ".join(f"{sign} {_THREE(_HALF('h', h), _HALF('r', r), _HALF('t', t))}" for sign, h, r, t in (("", 0, 0, 0), ("+", 32, 0, 32), ("+", 0, 32, 32), ("-", 32, 32, 0)))
    + ", 6) AS score FROM x"
)
def complex_scores(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    at = lambda n, k: e.select((F.col("vec_id") - k).alias("id"), F.slice("embedding", 1, 32).alias(f"{n}_re"), F.slice("embedding", 33, 32).alias(f"{n}_im"))
    x = at("h", 0).join(at("r", 1), "id").join(at("t", 2), "id")
    return x.select("id", F.round(vectors.complex_score(*(F.col(f"{n}_{k}") for n in "hrt" for k in ("re", "im"))), 6).alias("score"))


@query(f"WITH {_LINKS_SQL} SELECT s, p, o FROM links ORDER BY md5(s || chr(1) || p || chr(1) || o || chr(1) || '42') LIMIT 2000")
def kb_size_sample(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).orderBy(kge.split_key()).limit(2000)


@query()
def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = load(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    p = PCA(k=2, inputCol="v", outputCol="xy").fit(v).transform(v).select("vec_id", "label", vector_to_array("xy").alias("xy"))
    return p.select("vec_id", "label", F.round(F.col("xy")[0], 4).alias("x"), F.round(F.col("xy")[1], 4).alias("y"))


def _encoded(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    parts = kge.repair_leakage(kge.split(kge.cleaned(views.parties(spark, d), [RDF + "type"])))
    ents = kge.dictionary(parts.select(F.col("s").alias("uri")).unionByName(parts.select(F.col("o").alias("uri"))), "uri")
    rels = kge.dictionary(parts.select(F.col("p").alias("uri")), "uri")
    e = lambda a, b: ents.select(F.col("uri").alias(a), F.col("id").alias(b)).hint("merge")
    enc = parts.join(e("s", "h"), "s").join(e("o", "t"), "o").join(rels.select(F.col("uri").alias("p"), F.col("id").alias("r")), "p").select("h", "r", "t", "part")
    return enc, ents.count(), rels.count()


@query()
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Both models trained on the same part and ranked on the same test triples, with the better one marked."""
    enc, n_e, n_r = _encoded(spark, d)
    enc = cut(enc)
    rows = []
    for name, rate in (("TransE", 0.1), ("ComplEx", 0.3)):
        model = cut(kge.train(enc.filter("part = 'train'").drop("part"), n_e, n_r, name.lower(), dim=32, epochs=10, batch=16, rate=rate))
        rows.append(kge.ranking_metrics(kge.model_ranks(model, enc.filter("part = 'test'").drop("part"), enc.select("h", "r", "t"), name.lower())).withColumn("model", F.lit(name)))
    both = rows[0].unionByName(rows[1])
    best = both.agg(F.max("mrr").alias("_best"))
    return both.crossJoin(F.broadcast(best)).select("model", "mrr", "hits_at_1", "hits_at_3", "hits_at_10", (F.col("mrr") == F.col("_best")).alias("best"))


@query()
def transe_training(spark: SparkSession, d: str) -> DataFrame:
    enc, n_e, n_r = _encoded(spark, d)
    return kge.train_transe(enc.drop("part"), n_e, n_r, dim=32, epochs=10, batch=16, rate=0.1).select("kind", "id", F.round(vectors.norm(F.col("vec")), 3).alias("norm"))


# ---------------------------------------------------------------- answers

ANSWERS = ["text ```sparql\nSELECT ?s WHERE { ?s ?p ?o }\n``` tail", "Here:\nPREFIX t: <x>\nSELECT ?a\n```", "  nothing of the kind "]


@query("SELECT * FROM (VALUES (0::BIGINT, 'SELECT ?s WHERE { ?s ?p ?o }'), (1::BIGINT, 'PREFIX t: <x>' || chr(10) || 'SELECT ?a'), (2::BIGINT, 'nothing of the kind')) AS t(k, q)")
def sparql_text_extraction(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ANSWERS)), "k long, answer string").select("k", terms.sparql_block("answer").alias("q"))


@query(f"""WITH g AS (SELECT DISTINCT s, p, o FROM ({views.PARTIES_SQL})) SELECT * FROM (SELECT 'predicate' AS part, p AS term FROM (SELECT DISTINCT p FROM g ORDER BY 1 LIMIT 80)) UNION ALL SELECT 'class', o FROM (SELECT DISTINCT o FROM g WHERE p = '{RDF}type' ORDER BY 1 LIMIT 40)
UNION ALL SELECT 'triple', s || ' ' || p || ' ' || o FROM (SELECT * FROM g ORDER BY s, p, o LIMIT 20) UNION ALL SELECT * FROM (VALUES {', '.join(f"('prefix', 'PREFIX {k}: <{v}>')" for k, v in sorted(({'rdf': RDF, 'rdfs': RDFS, 'xsd': terms.XSD, 'owl': OWL} | PREFIXES).items()))}) AS t(part, term)""")
def schema_summary(spark: SparkSession, d: str) -> DataFrame:
    return sparql.schema_summary(views.parties(spark, d), PREFIXES)


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    g = views.parties(spark, d)
    qs = _questions(spark)
    docs = load(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "title", "text")
    facts, texts = rag.retrieved(qs, g, docs, DATA)
    none = qs.select("qid").limit(0).withColumn("related", F.lit(""))
    return rag.context(qs, facts, none, texts)


@query()
def rag_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d).select("qid", F.length(rag.prompt()).alias("n"), F.col("facts").contains("[").alias("has_facts"), (F.col("related") == rag.NO_RELATED).alias("no_related"))


@query()
def rag_batch_answer(spark: SparkSession, d: str) -> DataFrame:
    return rag.answered(_contexts(spark, d), lambda p: p.rpartition("Question: ")[2].partition("\n")[0].upper()).select("qid", "question", "answer")


@query("SELECT * FROM (VALUES (0::BIGINT, true, 5::BIGINT), (1::BIGINT, true, 25::BIGINT)) AS t(k, repaired, n_rows)")
def nl2sparql_repair_eval(spark: SparkSession, d: str) -> DataFrame:
    def model(p: str) -> str:
        kind = "t:Region" if "regions" in p else "t:Nation"
        return f"```sparql\nSELECT ?x WHERE {{ ?x a {kind} {'}' if 'ERROR' in p else ''}\n```"

    g = views.places(spark, d)
    rows = [rag.answer_by_query(g, q, "", model, PREFIXES) for q in ("Name the regions.", "Name the nations.")]
    return spark.createDataFrame([(k, r["repaired"], len(r["rows"])) for k, r in enumerate(rows)], "k long, repaired boolean, n_rows long")


# ---------------------------------------------------------------- files


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@query(f"SELECT s, p, o, o_kind, dt FROM ({views.PARTIES_SQL})")
def nt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    rdf.write_ntriples(views.parties(spark, d), path)
    return rdf.read_ntriples(spark, path).drop("lang")


@query(f"SELECT s, p, o FROM ({views.PARTIES_SQL}) WHERE o_kind = 'uri'")
def nt_links_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    rdf.write_ntriples(views.parties(spark, d), path)
    return rdf.read_links(spark, path)


@query(f"SELECT s, p, o, o_kind FROM ({views.PLACES_SQL})")
def turtle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    rdf.write_turtle(views.places(spark, d).coalesce(2), path, PREFIXES)
    return rdf.read_turtle(spark, f"{path}/part-*").select("s", "p", "o", "o_kind")


@query(f"WITH {_LINKS_SQL} SELECT s, p, o FROM links")
def tsv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    rdf.write_tsv(_links(spark, d), path)
    return rdf.read_tsv(spark, path)


@query("SELECT url, md5(text) AS text, word_count FROM crawler_output")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    files.write_jsonl(load(spark, d, "crawler_output").drop("page_id"), path)
    return files.read_jsonl(spark, path).select("url", F.md5("text").alias("text"), "word_count")


@query(f"SELECT {_strip('private_entity')} AS private_entity, nullif({_strip('label')}, '') AS label, status FROM entity_mapping")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    files.write_csv(load(spark, d, "entity_mapping"), path, files.ENTITY_MAPPING)
    return files.read_csv(spark, path, files.ENTITY_MAPPING).select("private_entity", F.when(F.col("label") != "", F.col("label")).alias("label"), "status")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


