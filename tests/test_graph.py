import random

import pytest

from graphloom.functions.terms import OWL, RDF, RDFS, XSD
from graphloom.operators import kb, reason, sparql
from graphloom.operators import triples as tr
from graphloom.operators.components import connected_components
from graphloom.sources import rdf

NS = "http://family.example/"
TTL = """
@prefix ns: <http://family.example/> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ns:Female rdfs:subClassOf ns:Person . ns:Male rdfs:subClassOf ns:Person . ns:Father rdfs:subClassOf ns:Parent , ns:Male .
ns:isFatherOf rdfs:subPropertyOf ns:isParentOf ; rdfs:domain ns:Male . ns:isChildOf owl:inverseOf ns:isParentOf .
ns:isMarriedWith a owl:SymmetricProperty . ns:isSiblingOf a owl:SymmetricProperty , owl:TransitiveProperty .
ns:Parent owl:equivalentClass [ a owl:Restriction ; owl:onProperty ns:isParentOf ; owl:someValuesFrom ns:Person ] .
ns:Grandfather owl:equivalentClass [ a owl:Restriction ; owl:onProperty ns:isFatherOf ; owl:someValuesFrom ns:Parent ] .
# people
ns:Peter a ns:Male ; ns:name "Peter" ; ns:age "70"^^xsd:int ; ns:isFatherOf ns:Thomas , ns:Sylvie ; ns:isMarriedWith ns:Marie .
ns:Marie a ns:Female ; ns:name "Marie" ; ns:age 69 .
ns:Thomas a ns:Male ; ns:name "Thomas"@en ; ns:age 40 ; ns:isFatherOf ns:Alex ; ns:isSiblingOf ns:Sylvie .
ns:Sylvie a ns:Female ; ns:age 30.5 ; ns:nick \"\"\"a "quoted"
line\"\"\" . ns:Alex a ns:Male .
"""


@pytest.fixture(scope="module")
def family(spark):
    return spark.createDataFrame(rdf.parse_turtle(TTL), rdf.TRIPLE).distinct()


def ask(g, q):
    return sorted(tuple(r) for r in sparql.run(g, q, {"ns": NS}).collect())


def members(g, c):
    return {r[0].removeprefix(NS) for r in ask(g, f"SELECT ?x WHERE {{ ?x a ns:{c} }}")}


def test_turtle():
    ts = rdf.parse_turtle(TTL)
    assert (NS + "Peter", NS + "age", "70", "literal", XSD + "int", None) in ts
    assert (NS + "Marie", NS + "age", "69", "literal", XSD + "integer", None) in ts
    assert (NS + "Thomas", NS + "name", "Thomas", "literal", None, "en") in ts
    assert (NS + "Sylvie", NS + "nick", 'a "quoted"\nline', "literal", None, None) in ts
    assert sum(t[2] == OWL + "Restriction" for t in ts) == 2
    with pytest.raises(ValueError):
        rdf.parse_turtle("x:y a z .")
    lists = rdf.parse_turtle("@prefix : <http://e/> . :a :b (:c 1) .")
    assert sum(t[1] == RDF + "first" for t in lists) == 2


def test_closure(family):
    g = reason.materialise(family)
    assert members(g, "Person") == {"Peter", "Marie", "Thomas", "Sylvie", "Alex"}
    assert members(g, "Parent") >= {"Peter", "Thomas"} and members(g, "Grandfather") == {"Peter"}
    assert {(a.removeprefix(NS), b.removeprefix(NS)) for a, b in ask(g, "SELECT ?a ?b WHERE { ?a ns:isSiblingOf ?b }")} == {(a, b) for a in ("Thomas", "Sylvie") for b in ("Thomas", "Sylvie")}
    assert len(ask(g, "SELECT ?c ?p WHERE { ?c ns:isChildOf ?p }")) == 3
    assert reason.materialise(g).count() == g.count()


def test_rules(family):
    new = reason.apply_rule(family, "?p a ns:Male . ?p ns:age ?a . FILTER(?a > 60)", "?p a ns:OldPerson", {"ns": NS})
    assert [r["s"] for r in new.collect()] == [NS + "Peter"]
    assert reason.disjoint_violations(family, [(NS + "Male", NS + "Female")]).count() == 0
    extra = family.sparkSession.createDataFrame([(NS + "Peter", NS + "age", "71", "literal", XSD + "int", None)], rdf.TRIPLE)
    assert [r["s"] for r in reason.functional_violations(family.unionByName(extra), [NS + "age"]).collect()] == [NS + "Peter"]


@pytest.mark.parametrize(
    "q,want",
    [
        ("SELECT ?a WHERE { ns:Peter ns:age ?a }", [("70",)]),
        ("SELECT ?x ?n WHERE { ns:Peter ns:isFatherOf ?x . OPTIONAL { ?x ns:name ?n } } ORDER BY ?n", [(NS + "Sylvie", None), (NS + "Thomas", "Thomas")]),
        ("SELECT ?x WHERE { ?x a ns:Female ; ns:age ?a . FILTER(?a > 30 && ?a < 60) }", [(NS + "Sylvie",)]),
        ('SELECT ?x WHERE { ?x ns:name "Thomas" }', []),
        ('SELECT ?x WHERE { ?x ns:name "Thomas"@en }', [(NS + "Thomas",)]),
        ('SELECT ?x WHERE { ?x ns:name ?n FILTER(LANG(?n) = "en") }', [(NS + "Thomas",)]),
        ("SELECT DISTINCT ?t WHERE { { ?x a ns:Male } UNION { ?x a ns:Female } ?x a ?t }", [(NS + "Female",), (NS + "Male",)]),
        ("SELECT ?x WHERE { ?x ns:age ?a . FILTER(?x IN (ns:Marie, ns:Peter)) } ORDER BY DESC(?x) LIMIT 1", [(NS + "Peter",)]),
        ("ASK { ns:Peter ns:age 70 }", [(False,)]),
        ("ASK { ?x ns:age ?a . FILTER(?a = 70) }", [(True,)]),
        ("SELECT ?x WHERE { ?x ns:isMarriedWith ?y . OPTIONAL { ?y ns:name ?n . FILTER(?n = \"nobody\") } FILTER(!BOUND(?n)) }", [(NS + "Peter",)]),
        ("SELECT ?r WHERE { ?c <http://www.w3.org/2002/07/owl#equivalentClass> ?r . FILTER(!isBlank(?r)) }", []),
    ],
)
def test_sparql(family, q, want):
    assert sorted(ask(family, q), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(
    "q",
    ["SELECT", "SELECT ?x WHERE { ?x", "SELECT ?x WHERE { ?x ns:age }", "SELECT ?x WHERE { ?x zz:a ?y }", "DESCRIBE ns:x", "SELECT ?x WHERE { SERVICE <http://x> { ?x ?p ?o } }", "SELECT ?x WHERE { ?x ns:a ?y . ?z ns:b ?w }", "SELECT ?x WHERE { ?x a/ns:b ?y }", "SELECT ?x WHERE { ?x ?p ?o } FILTER(?x)", "SELECT ?x WHERE { ?x ?p ?o FILTER(FOO(?x)) }"],
)
def test_errors_come_before_jobs(family, q):
    with pytest.raises(sparql.SparqlError):
        sparql.run(family, q, {"ns": NS})
    assert sparql.run_or_empty(family, q, {"ns": NS}) == []


def test_bgp_against_brute_force(spark):
    rng = random.Random(9)
    for _ in range(6):
        ts = sorted({(f"u:{rng.randint(0, 4)}", f"p:{rng.randint(0, 2)}", f"u:{rng.randint(0, 4)}") for _ in range(14)})
        g = spark.createDataFrame([(*t, "uri", None, None) for t in ts], rdf.TRIPLE)
        pats = [("?a", "<p:0>", "?b"), ("?b", rng.choice(["<p:1>", "?p"]), "?c"), (rng.choice(["?a", "?c"]), "<p:2>", rng.choice(["?d", "<u:1>", "?b"]))]
        names = sorted({x[1:] for t in pats for x in t if x[0] == "?"})
        rows = [{}]
        for t in pats:
            nxt = []
            for r in rows:
                for x in ts:
                    m, ok = dict(r), True
                    for a, v in zip(t, x, strict=True):
                        if a[0] == "?":
                            ok &= m.setdefault(a[1:], v) == v
                        else:
                            ok &= a[1:-1] == v
                    if ok:
                        nxt.append(m)
            rows = nxt
        want = sorted(tuple(r[n] for n in names) for r in rows)
        q = f"SELECT {' '.join('?' + n for n in names)} WHERE {{ {' . '.join(' '.join(t) for t in pats)} }}"
        assert sorted(tuple(r) for r in sparql.run(g, q).collect()) == want


def test_set_semantics(spark, family):
    n = family.count()
    assert tr.insert(family, family).count() == n
    assert tr.novel(family, family).count() == 0
    other = spark.createDataFrame([(NS + "Peter", NS + "age", "70", "literal", None, None)], rdf.TRIPLE)
    assert tr.novel(family, other).count() == 1
    s = tr.stats(family).first()
    assert s["triples"] == n and s["predicates"] == family.select("p").distinct().count()


def test_files(spark, family, tmp_path):
    same = lambda df: sorted(map(str, df.select(*rdf.COLUMNS).collect()))
    plain = family.filter("o_kind <> 'bnode' and s not like '\\_:%'")
    rdf.write_ntriples(plain, str(tmp_path / "nt"))
    assert same(rdf.read_ntriples(spark, str(tmp_path / "nt"))) == same(plain)
    rdf.write_turtle(plain, str(tmp_path / "ttl"), {"ns": NS, "rdfs": RDFS})
    assert same(rdf.read_turtle(spark, str(tmp_path / "ttl" / "part-*"))) == same(plain)
    (tmp_path / "g.owl").write_text(rdf.rdfxml_text(family), encoding="utf-8")
    assert same(rdf.read_rdfxml(spark, str(tmp_path / "g.owl")).filter("o_kind <> 'bnode' and s not like '\\_:%'")) == same(plain)
    (tmp_path / "t.tsv").write_text("a\tb\tc\nbad line\nd\te\tf\tg\n")
    assert [tuple(r) for r in rdf.read_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("a", "b", "c")]


def test_kb(spark):
    mentions = spark.createDataFrame([("Bosu Kurīpā", "PERSON", "Person", "http://u", 0.8, "nltk"), ("Peach's Castle", "odd", "x", None, None, None), (" ", "x", "x", None, None, None)], "text string, type string, label string, source_url string, confidence double, method string")
    relations = spark.createDataFrame([("Bosu Kurīpā", "Person", "rival of", "MARIO", "Person", "u", "svo")], "subject string, subject_type string, predicate string, object string, object_type string, source_url string, method string")
    g = {(r["s"].removeprefix(kb.KB), r["p"].rpartition("#")[2], r["o"].rpartition("#")[2]) for r in kb.build(mentions, relations).collect()}
    assert ("Bosu_Kurīpā", "type", "RealPerson") in g and ("Peachs_Castle", "type", "Entity") in g and ("Peachs_Castle", "confidence", "0.50") in g
    assert ("Bosu_Kurīpā", "rival_of", "MARIO") in g and ("MARIO", "label", "MARIO") in g
    assert len(kb.ontology(spark).filter(f"o = '{OWL}Class'").collect()) == 9


def test_components(spark):
    edges = [(f"a{i}", f"a{i + 1}") for i in range(30)] + [("hub", f"h{i:03}") for i in range(200)] + [("x", "x"), ("y", "z"), ("z", "y")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {got[f"a{i}"] for i in range(31)} == {"a0"} and {got[k] for k in got if k[0] == "h"} == {"h000"} and got["z"] == "y" and "x" not in got
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_functional_same(spark):
    g = spark.createDataFrame([("a", "http://x/p/" + "f", x, "uri", None, None) for x in "zyx"] + [("b", "http://x/p/" + "f", "x", "uri", None, None), ("a", "http://x/p/" + "g", "w", "uri", None, None), ("a", "http://x/p/" + "f", "5", "literal", None, None)], rdf.TRIPLE)
    assert {(r["s"], r["o"]) for r in reason.functional_same(g, ["http://x/p/" + "f"]).collect()} == {("x", "y"), ("x", "z")}


def test_discovery_frontier_and_resources(spark):
    s = lambda *xs: spark.createDataFrame([(x,) for x in xs], "s string")
    assert {r["s"] for r in kb.frontier(kb.discovered(s("a", "b", "b"), s("b", "c")), s("c")).collect()} == {"a", "b"}
    base = "http://dbpedia.org/resource/"
    g = spark.createDataFrame([("a", "http://x/p/" + "l", base + "X", "uri", None, None), ("a", "http://x/p/" + "l", base + "Category:Y", "uri", None, None), ("a", "http://x/p/" + "l", "http://else/Z", "uri", None, None)], rdf.TRIPLE)
    assert [r["o"] for r in kb.resources(g).collect()] == [base + "X"]
