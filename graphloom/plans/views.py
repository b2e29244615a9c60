"""A graph over the test tables: customers, suppliers, parts, orders and where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import OWL, RDF, RDFS, XSD
from graphloom.sources.rdf import COLUMNS, TRIPLE
from graphloom.sources.tables import load

DATA = "http://graphloom.example/"
T = "http://graphloom.example/ont#"
PREFIXES = {"t": T, "d": DATA}

#: The schema of the view, as (s, p, o).
SCHEMA = [
    *((T + c, RDF + "type", OWL + "Class") for c in ("Agent", "Party", "Customer", "Supplier", "Thing", "Order", "Part", "Place", "Nation", "Region", "Buyer", "RichCustomer")),
    *((T + a, RDFS + "subClassOf", T + b) for a, b in (("Customer", "Party"), ("Supplier", "Party"), ("Party", "Agent"), ("Order", "Thing"), ("Part", "Thing"), ("Nation", "Place"), ("Region", "Place"))),
    (T + "locatedIn", RDF + "type", OWL + "TransitiveProperty"), (T + "trades", RDF + "type", OWL + "SymmetricProperty"), (T + "acctbal", RDF + "type", OWL + "FunctionalProperty"),
    (T + "placed", OWL + "inverseOf", T + "placedBy"), (T + "placedBy", RDFS + "subPropertyOf", T + "relatedTo"), (T + "placedBy", RDFS + "domain", T + "Order"), (T + "placedBy", RDFS + "range", T + "Customer"),
    (T + "Customer", OWL + "disjointWith", T + "Supplier"),
    ("_:buyer", RDF + "type", OWL + "Restriction"), ("_:buyer", OWL + "onProperty", T + "placed"), ("_:buyer", OWL + "someValuesFrom", T + "Order"), (T + "Buyer", OWL + "equivalentClass", "_:buyer"),
]


def node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{DATA}{kind}/"), F.col(key).cast("string"))


def _po(p: str, o: Column, kind: str = "literal", dt: str | None = None) -> Column:
    return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def _triples(df: DataFrame, s: Column, *po: Column) -> DataFrame:
    """One pass over a table: all triples of a row at once."""
    return df.select(s.alias("s"), F.explode(F.array(*po)).alias("_t")).select("s", "_t.*").filter("o is not null").select(*COLUMNS)


def customers(spark: SparkSession, d: str) -> DataFrame:
    return _triples(load(spark, d, "customer"), node("customer", "c_custkey"), _po(RDF + "type", F.lit(T + "Customer"), "uri"), _po(RDFS + "label", F.col("c_name")), _po(T + "locatedIn", node("nation", "c_nationkey"), "uri"), _po(T + "acctbal", money("c_acctbal"), dt=XSD + "decimal"), _po(T + "segment", F.col("c_mktsegment")))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return _triples(load(spark, d, "supplier"), node("supplier", "s_suppkey"), _po(RDF + "type", F.lit(T + "Supplier"), "uri"), _po(RDFS + "label", F.col("s_name")), _po(T + "locatedIn", node("nation", "s_nationkey"), "uri"), _po(T + "acctbal", money("s_acctbal"), dt=XSD + "decimal"))


def places(spark: SparkSession, d: str) -> DataFrame:
    r = _triples(load(spark, d, "region"), node("region", "r_regionkey"), _po(RDF + "type", F.lit(T + "Region"), "uri"), _po(RDFS + "label", F.col("r_name")))
    n = _triples(load(spark, d, "nation"), node("nation", "n_nationkey"), _po(RDF + "type", F.lit(T + "Nation"), "uri"), _po(RDFS + "label", F.col("n_name")), _po(T + "locatedIn", node("region", "n_regionkey"), "uri"))
    return r.unionByName(n)


def parts(spark: SparkSession, d: str) -> DataFrame:
    return _triples(load(spark, d, "part"), node("part", "p_partkey"), _po(RDF + "type", F.lit(T + "Part"), "uri"), _po(RDFS + "label", F.col("p_name")), _po(T + "brand", F.col("p_brand")), _po(T + "ptype", F.col("p_type")), _po(T + "size", F.col("p_size").cast("string"), dt=XSD + "int"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return _triples(load(spark, d, "orders"), node("order", "o_orderkey"), _po(RDF + "type", F.lit(T + "Order"), "uri"), _po(T + "placedBy", node("customer", "o_custkey"), "uri"), _po(T + "totalprice", money("o_totalprice"), dt=XSD + "decimal"), _po(T + "status", F.col("o_orderstatus")), _po(T + "priority", F.col("o_orderpriority")))


def lines(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    link = lambda s, p, o: li.select(s.alias("s"), F.lit(T + p).alias("p"), o.alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")).distinct()
    return link(node("order", "l_orderkey"), "contains", node("part", "l_partkey")).unionByName(link(node("part", "l_partkey"), "suppliedBy", node("supplier", "l_suppkey")))


def parties(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).unionByName(suppliers(spark, d)).unionByName(places(spark, d))


def graph(spark: SparkSession, d: str) -> DataFrame:
    return parties(spark, d).unionByName(parts(spark, d)).unionByName(orders(spark, d)).unionByName(lines(spark, d))


def schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, p, o, "bnode" if o.startswith("_:") else "uri", None, None) for s, p, o in SCHEMA], TRIPLE)


def _sql(table: str, s: str, *po: tuple[str, str, str, str | None]) -> str:
    sel = [f"SELECT {s} AS s, '{p}' AS p, {o} AS o, '{k}' AS o_kind, {f"'{dt}'" if dt else 'CAST(NULL AS VARCHAR)'} AS dt, CAST(NULL AS VARCHAR) AS lang FROM {table}" for p, o, k, dt in po]
    return "\nUNION ALL\n".join(sel)


def _n(kind: str, key: str) -> str:
    return f"'{DATA}{kind}/' || CAST({key} AS VARCHAR)"


def _m(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


_A, _L = RDF + "type", RDFS + "label"
CUSTOMERS_SQL = _sql("customer", _n("customer", "c_custkey"), (_A, f"'{T}Customer'", "uri", None), (_L, "c_name", "literal", None), (T + "locatedIn", _n("nation", "c_nationkey"), "uri", None), (T + "acctbal", _m("c_acctbal"), "literal", XSD + "decimal"), (T + "segment", "c_mktsegment", "literal", None))
SUPPLIERS_SQL = _sql("supplier", _n("supplier", "s_suppkey"), (_A, f"'{T}Supplier'", "uri", None), (_L, "s_name", "literal", None), (T + "locatedIn", _n("nation", "s_nationkey"), "uri", None), (T + "acctbal", _m("s_acctbal"), "literal", XSD + "decimal"))
PLACES_SQL = _sql("region", _n("region", "r_regionkey"), (_A, f"'{T}Region'", "uri", None), (_L, "r_name", "literal", None)) + "\nUNION ALL\n" + _sql("nation", _n("nation", "n_nationkey"), (_A, f"'{T}Nation'", "uri", None), (_L, "n_name", "literal", None), (T + "locatedIn", _n("region", "n_regionkey"), "uri", None))
PARTS_SQL = _sql("part", _n("part", "p_partkey"), (_A, f"'{T}Part'", "uri", None), (_L, "p_name", "literal", None), (T + "brand", "p_brand", "literal", None), (T + "ptype", "p_type", "literal", None), (T + "size", "CAST(p_size AS VARCHAR)", "literal", XSD + "int"))
ORDERS_SQL = _sql("orders", _n("order", "o_orderkey"), (_A, f"'{T}Order'", "uri", None), (T + "placedBy", _n("customer", "o_custkey"), "uri", None), (T + "totalprice", _m("o_totalprice"), "literal", XSD + "decimal"), (T + "status", "o_orderstatus", "literal", None), (T + "priority", "o_orderpriority", "literal", None))
LINES_SQL = _sql(f"(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)", _n("order", "l_orderkey"), (T + "contains", _n("part", "l_partkey"), "uri", None)) + "\nUNION ALL\n" + _sql("(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)", _n("part", "l_partkey"), (T + "suppliedBy", _n("supplier", "l_suppkey"), "uri", None))
PARTIES_SQL = "\nUNION ALL\n".join((CUSTOMERS_SQL, SUPPLIERS_SQL, PLACES_SQL))
GRAPH_SQL = "\nUNION ALL\n".join((PARTIES_SQL, PARTS_SQL, ORDERS_SQL, LINES_SQL))
