"""Inference: the RDFS and OWL RL rules of the ontologies at hand, and rules given as patterns.

The schema is small and collected (its triples are checked to be at most ``MAX_SCHEMA``); its transitive closures are made
on the driver and broadcast as literal tables. The data stay distributed: a semi-naive loop applies every rule to the
triples that the last round added, keeps what is new by an anti-join on a hash, and ends when nothing is. Each round writes only
what it added to the checkpoint folder; the graph is the union of these parts and is never written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import OWL, RDF, RDFS
from graphloom.operators import sparql
from graphloom.operators.triples import novel
from graphloom.sources.rdf import COLUMNS
from graphloom.sources.tables import cut

MAX_SCHEMA = 50_000
TYPE = RDF + "type"


def closure(pairs: set[tuple[str, str]]) -> set[tuple[str, str]]:
    """The transitive closure; cycles are fine."""
    out = set(pairs)
    new = set(pairs)
    after: dict[str, set[str]] = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    while new:
        new = {(a, c) for a, b in new for c in after.get(b, ())} - out
        out |= new
    return out


class Schema:
    """The axioms of a graph that rules need."""

    def __init__(self, triples: DataFrame):
        wanted = [RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range", OWL + "inverseOf", OWL + "equivalentClass", OWL + "equivalentProperty", OWL + "disjointWith", OWL + "onProperty", OWL + "someValuesFrom"]
        kinds = [OWL + k for k in ("TransitiveProperty", "SymmetricProperty", "FunctionalProperty", "Restriction")]
        rows = triples.filter(F.col("p").isin(*wanted) | ((F.col("p") == TYPE) & F.col("o").isin(*kinds))).select("s", "p", "o").distinct().limit(MAX_SCHEMA + 1).collect()
        if len(rows) > MAX_SCHEMA:
            raise ValueError(f"the schema has over {MAX_SCHEMA} axioms")
        of = lambda p: {(r["s"], r["o"]) for r in rows if r["p"] == p}
        kind = lambda k: {r["s"] for r in rows if r["p"] == TYPE and r["o"] == OWL + k}
        same = of(OWL + "equivalentClass")
        self.sub_class = closure(of(RDFS + "subClassOf") | same | {(b, a) for a, b in same})
        same = of(OWL + "equivalentProperty")
        self.sub_property = closure(of(RDFS + "subPropertyOf") | same | {(b, a) for a, b in same})
        self.domain, self.range = of(RDFS + "domain"), of(RDFS + "range")
        inverse = of(OWL + "inverseOf")
        self.inverse = inverse | {(b, a) for a, b in inverse}
        self.transitive, self.symmetric, self.functional = kind("TransitiveProperty"), kind("SymmetricProperty"), kind("FunctionalProperty")
        self.disjoint = of(OWL + "disjointWith") | {(b, a) for a, b in of(OWL + "disjointWith")}
        on, some = dict(of(OWL + "onProperty")), dict(of(OWL + "someValuesFrom"))
        self.some = {(c, on[c], some[c]) for c in on if c in some}


def _table(df: DataFrame, rows: set[tuple], names: str) -> DataFrame:
    """A broadcast table of axioms; its size is bounded by MAX_SCHEMA."""
    return F.broadcast(df.sparkSession.createDataFrame(sorted(rows), ", ".join(f"{n} string" for n in names.split())))


def _triple(df: DataFrame, s: str, p: str, o: str, kind: str = "'uri'", dt: str = "cast(null as string)", lang: str = "cast(null as string)") -> DataFrame:
    return df.selectExpr(f"{s} as s", f"{p} as p", f"{o} as o", f"{kind} as o_kind", f"{dt} as dt", f"{lang} as lang")


def derive(new: DataFrame, everything: DataFrame, schema: Schema) -> DataFrame:
    """What one application of the rules to ``new``, with ``everything`` as the other side, gives; with repeats."""
    types = new.filter((F.col("p") == TYPE) & (F.col("o_kind") != "literal"))
    links = new.filter((F.col("p") != TYPE) & (F.col("o_kind") != "literal"))
    out = []
    if schema.sub_class:
        out.append(_triple(types.join(_table(new, schema.sub_class, "o sup"), "o"), "s", f"'{TYPE}'", "sup"))
    if schema.sub_property:
        out.append(_triple(new.join(_table(new, schema.sub_property, "p sup"), "p"), "s", "sup", "o", "o_kind", "dt", "lang"))
    if schema.domain:
        out.append(_triple(new.join(_table(new, schema.domain, "p cls"), "p"), "s", f"'{TYPE}'", "cls"))
    if schema.range:
        out.append(_triple(links.join(_table(new, schema.range, "p cls"), "p"), "o", f"'{TYPE}'", "cls"))
    turned = schema.inverse | {(p, p) for p in schema.symmetric}
    if turned:
        out.append(_triple(links.join(_table(new, turned, "p inv"), "p"), "o", "inv", "s", "case when s like '\\_:%' then 'bnode' else 'uri' end"))
    if schema.transitive:
        of = lambda df, a, b: df.filter(F.col("p").isin(*sorted(schema.transitive)) & (F.col("o_kind") != "literal")).select(F.col("s").alias(a), "p", F.col("o").alias(b))
        for left, right in ((new, everything), (everything, new)):
            out.append(_triple(of(left, "s", "m").join(of(right, "m", "o"), ["p", "m"]), "s", "p", "o", "case when o like '\\_:%' then 'bnode' else 'uri' end"))
    if schema.some:
        some = _table(new, schema.some, "cls p target")
        thing = OWL + "Thing"
        for left, right in ((new, everything), (everything, new)):
            member = right.filter(F.col("p") == TYPE).select(F.col("s").alias("o"), F.col("o").alias("target"))
            out.append(_triple(left.filter(F.col("o_kind") != "literal").select("s", "p", "o").join(some, "p").join(member, ["o", "target"]), "s", f"'{TYPE}'", "cls"))
        out.append(_triple(new.select("s", "p").join(some.filter(F.col("target") == thing), "p"), "s", f"'{TYPE}'", "cls"))
    return reduce(DataFrame.unionByName, out) if out else new.limit(0)


def materialise(triples: DataFrame, max_rounds: int = 100) -> DataFrame:
    """The graph with all that its axioms imply, without reflexive and axiomatic triples."""
    everything = cut(triples.select(*COLUMNS).distinct())
    schema = Schema(everything)
    new = everything
    for _ in range(max_rounds):
        new = cut(novel(everything, derive(new, everything, schema)))
        if new.isEmpty():
            return everything
        everything = everything.unionByName(new)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def reflexive(triples: DataFrame) -> DataFrame:
    """``owl:sameAs`` of every resource with itself, and the mutual sub-class triples of equivalent classes."""
    nodes = triples.select("s").unionByName(triples.filter("o_kind = 'uri'").select(F.col("o").alias("s"))).distinct()
    same = triples.filter(F.col("p") == OWL + "equivalentClass")
    sub = f"'{RDFS}subClassOf'"
    return _triple(nodes, "s", f"'{OWL}sameAs'", "s").unionByName(_triple(same, "s", sub, "o", "o_kind")).unionByName(_triple(same, "o", sub, "s"))


def functional_violations(triples: DataFrame, properties: list[str]) -> DataFrame:
    """(s, p, values): subjects with several values of a functional property."""
    term = F.concat_ws("\u0001", "o", "o_kind", F.coalesce("dt", F.lit("")), F.coalesce("lang", F.lit("")))
    return triples.filter(F.col("p").isin(*properties)).groupBy("s", "p").agg(F.countDistinct(term).alias("n_values")).filter("n_values > 1")


def functional_same(triples: DataFrame, properties: list[str]) -> DataFrame:
    """``owl:sameAs`` between the values of a functional property that are things: each with the least of its subject's values,
    which says as much as all pairs do."""
    values = triples.filter(F.col("p").isin(*properties) & (F.col("o_kind") != "literal")).select("s", "p", "o").distinct()
    least = values.groupBy("s", "p").agg(F.min("o").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return _triple(values.join(least, ["s", "p"]).filter("o <> least").select("least", "o").distinct(), "least", f"'{OWL}sameAs'", "o")


def disjoint_violations(triples: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(s, a, b): members of two disjoint classes, from one aggregate over the types of each subject."""
    classes = sorted({c for p in pairs for c in p})
    sets = triples.filter((F.col("p") == TYPE) & F.col("o").isin(*classes)).groupBy("s").agg(F.collect_set("o").alias("cs"))
    hits = F.filter(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs)), lambda x: F.array_contains(F.col("cs"), x["a"]) & F.array_contains(F.col("cs"), x["b"]))
    return sets.select("s", F.explode(hits).alias("h")).select("s", "h.a", "h.b")


def apply_rule(triples: DataFrame, body: str, head: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The new triples of a rule: ``body`` is a group of patterns and filters, ``head`` a template, both in SPARQL."""
    return novel(triples, sparql.run(triples, f"CONSTRUCT {{ {head} }} WHERE {{ {body} }}", prefixes))


def subclass_closure(triples: DataFrame) -> DataFrame:
    """(sub, sup) pairs of the class hierarchy."""
    return triples.sparkSession.createDataFrame(sorted(Schema(triples).sub_class), "sub string, sup string")
