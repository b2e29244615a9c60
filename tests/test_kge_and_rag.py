import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import kge, rag, retrieve
from graphloom.sources import rdf
from graphloom.sources.files import read_neighbours

P = "http://p/"


@pytest.fixture(scope="module")
def links(spark):
    return spark.range(1124).select(F.concat(F.lit("e"), F.col("id") % 97).alias("s"), F.concat(F.lit("p"), F.col("id") % 5).alias("p"), F.concat(F.lit("e"), F.col("id") % 89).alias("o")).distinct()


def test_split(links):
    parts = kge.split(links)
    n = links.count()
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sizes == {"train": int(n * 0.8), "valid": int(n * 0.1), "test": n - int(n * 0.8) - int(n * 0.1)}
    fixed = kge.repair_leakage(parts).persist()
    ends = lambda cond: {r[0] for r in fixed.filter(cond).select(F.explode(F.array("s", "o"))).collect()}
    assert ends("part <> 'train'") <= ends("part = 'train'") and fixed.count() == n


def test_dictionary(links):
    d = kge.dictionary(links.select(F.col("s").alias("uri")), "uri").collect()
    assert sorted(r["id"] for r in d) == list(range(len(d))) and [r["uri"] for r in sorted(d, key=lambda r: r["id"])] == sorted(r["uri"] for r in d)


def test_ranks(spark):
    scored = spark.createDataFrame([(1, c, s, 2) for c, s in ((0, 0.9), (1, 0.5), (2, 0.5), (3, 0.1))], "q int, candidate int, score double, truth int")
    known = spark.createDataFrame([(1, 0), (1, 2)], "q int, candidate int")
    assert kge.filtered_ranks(scored, known).first()["rank"] == 1.5
    m = kge.ranking_metrics(spark.createDataFrame([(1.0,), (4.0,)], "rank double")).first()
    assert (m["mrr"], m["hits_at_1"], m["hits_at_3"], m["hits_at_10"]) == (0.625, 0.5, 0.5, 1.0)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, vec array<double>")
    got = kge.nearest(df.filter("id < 5").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), df, 3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for r in got.collect():
        order = [k for k in np.argsort(-(u @ u[r["qid"]])) if k != r["qid"]]
        assert order[r["place"] - 1] == r["id"]


def test_training_learns(spark):
    enc = spark.createDataFrame([(i, 0, (i + 1) % 12) for i in range(12)], "h long, r long, t long").coalesce(1)
    model = {(r["kind"], r["id"]): np.array(r["vec"]) for r in kge.train_transe(enc, 12, 1, dim=8, epochs=40, rate=0.05).collect()}
    good = np.mean([np.linalg.norm(model["e", i] + model["r", 0] - model["e", (i + 1) % 12]) for i in range(12)])
    bad = np.mean([np.linalg.norm(model["e", i] + model["r", 0] - model["e", (i + 6) % 12]) for i in range(12)])
    assert good < bad


def test_complex_training_learns_and_ranks(spark):
    triples = [(i, 0, (i + 1) % 12) for i in range(12)]
    enc = spark.createDataFrame(triples, "h long, r long, t long").coalesce(1)
    df = kge.train(enc, 12, 1, "complex", dim=8, epochs=60, rate=0.2, batch=4)
    model = {(r["kind"], r["id"]): np.array(r["vec"]) for r in df.collect()}
    score = lambda i, j: float(kge.complex_score(model["e", i], model["r", 0], model["e", j]))
    assert np.mean([score(i, (i + 1) % 12) for i in range(12)]) > np.mean([score(i, (i + 6) % 12) for i in range(12)])
    ranks = {r["q"]: r["rank"] for r in kge.model_ranks(df, enc, enc, "complex").collect()}
    want = sorted(1 + sum(score(h, x) > score(h, t) for x in range(12)) for h, _, t in triples)
    assert sorted(ranks.values()) == want
    assert kge.train(enc.limit(0), 3, 1, "complex", dim=4, epochs=1).count() == 4


def test_training_holds_no_parameters_in_the_driver(spark, monkeypatch):
    enc = spark.createDataFrame([(i, 0, (i + 1) % 12) for i in range(12)], "h long, r long, t long")

    def refused(*_, **__):
        raise AssertionError("the driver holds parameters")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    monkeypatch.setattr(type(enc), "toArrow", refused)
    for model in ("transe", "complex"):
        got = kge.train(enc, 12, 1, model, dim=4, epochs=2, batch=4).collect()
        assert sorted((r["kind"], r["id"], len(r["vec"])) for r in got) == sorted([("e", i, 4 if model == "transe" else 8) for i in range(12)] + [("r", 0, 4 if model == "transe" else 8)])


def test_filtered_ranks_of_a_model_skip_other_true_answers(spark):
    model = spark.createDataFrame([("e", i, [float(x)]) for i, x in enumerate((0, 1, 2, 3))] + [("r", 0, [1.0])], "kind string, id long, vec array<double>")
    test = spark.createDataFrame([(0, 0, 2)], "h long, r long, t long")
    assert [r["rank"] for r in kge.model_ranks(model, test, test, "transe").collect()] == [2.5]
    known = test.union(spark.createDataFrame([(0, 0, 1)], "h long, r long, t long"))
    assert [r["rank"] for r in kge.model_ranks(model, test, known, "transe").collect()] == [1.5]


def test_long_names_are_searched(spark):
    tr = spark.createDataFrame([("http://x#w", "http://www.w3.org/2000/01/rdf-schema#label", "old well", "literal", None, None)], rdf.TRIPLE)
    index = retrieve.label_index(tr, "http://x#")
    long = "tell me please " * 20 + "about the old well of the town"
    got = retrieve.search(spark.createDataFrame([(long,), ("well",), ("nothing",)], "name string"), index, tr, []).collect()
    assert {r["name"]: r["uri"] for r in got} == {long: "http://x#w", "well": "http://x#w"}


def broadcast_scans(df):
    """Files that a plan reads below a broadcast of rows."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda x: next((i for i, c in enumerate(x) if c.isalpha() or c == "*"), 0)
    for i, x in enumerate(lines):
        if "BroadcastExchange Hashed" in x:
            for y in lines[i + 1 :]:
                if depth(y) <= depth(x):
                    break
                found += [y.strip()] * ("Scan parquet" in y)
    return found


@pytest.fixture
def filed(spark, tmp_path):
    """The graph in a file, by whose size the planner goes."""
    graph(spark).write.parquet(str(tmp_path / "g"))
    return spark.read.parquet(str(tmp_path / "g"))


@pytest.mark.parametrize("sent", (retrieve.SENT, 0))
def test_labels_and_subjects_are_never_broadcast(spark, filed, sent, monkeypatch):
    monkeypatch.setattr(retrieve, "SENT", sent)
    names = spark.createDataFrame([(n,) for n in ("LAMP", "Old_Well", "the old well here", "wel", "zzz", None)], "name string")
    got = retrieve.search(names, retrieve.label_index(filed, "http://x#"), filed, ["http://x#"])
    assert not broadcast_scans(got)
    assert {(r["name"], r["uri"].rpartition("#")[2], r["rank"]) for r in got.collect()} == {("LAMP", "Lamp", 1), ("Old_Well", "Old_Well", 2), ("the old well here", "Old_Well", 3), ("wel", "Old_Well", 3)}


def test_facts_are_never_broadcast(spark, filed):
    ents = spark.createDataFrame([(1, 1, "http://x#Old_Well")], "qid long, place int, uri string")
    got = retrieve.blocks(ents, filed)
    assert not broadcast_scans(got) and [r["block"] for r in got.collect()] == ["[Old Well]\n  - label: Old Well"]


def test_documents_and_their_terms_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(k, f"T{k}", f"old well number{k} by the lamp") for k in range(30)], "id long, title string, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    qs = spark.createDataFrame([(0, "Where is number7"), (1, "nothing")], "qid long, question string")
    assert not broadcast_scans(retrieve.lexical_weights(docs.select("id", "text")))
    texts = rag.retrieved(qs, graph(spark), docs, "http://x#")[1]
    assert not [x for x in broadcast_scans(texts) if "title" in x.partition("]")[0]]
    assert [(r["qid"], r["texts"].partition("]")[0]) for r in texts.collect()] == [(0, "[T7")]


def graph(spark):
    label = "http://www.w3.org/2000/01/rdf-schema#label"
    rows = [("http://x#Lamp", label, "Lamp", "literal", None, "en"), ("http://x#Lamp", label, "Lampe", "literal", None, "fr"), ("http://x#Lamp", P + "near", "http://x#Old_Well", "uri", None, None), ("http://x#Old_Well", label, "Old Well", "literal", None, None), ("http://x#Lamp", P + "q", "http://w/Q42", "uri", None, None), ("http://x#Lamp", P + "sameAs", "http://w/Z", "uri", None, None)]
    return spark.createDataFrame(rows, rdf.TRIPLE)


def test_retrieval(spark):
    g = graph(spark)
    index = retrieve.label_index(g, "http://x#")
    names = spark.createDataFrame([(n,) for n in ("LAMP", "Old_Well", "the old well here", "wel", "zzz")], "name string")
    got = {r["name"]: (r["uri"].rpartition("#")[2], r["rank"]) for r in retrieve.search(names, index, g, ["http://x#"]).collect()}
    assert got == {"LAMP": ("Lamp", 1), "Old_Well": ("Old_Well", 2), "the old well here": ("Old_Well", 3), "wel": ("Old_Well", 3)}
    facts = [(r["s"].rpartition("#")[2], r["fact"]) for r in retrieve.facts(g, 5).orderBy("s", "place").collect()]
    assert facts == [("Lamp", "near: Old Well"), ("Lamp", "label: Lamp"), ("Old_Well", "label: Old Well")]
    qs = spark.createDataFrame([(0, "Where is the Lamp?"), (1, "Where is the old well")], "qid long, question string")
    ents = retrieve.question_entities(qs, index, g, ["http://x#"])
    assert {(r["qid"], r["uri"].rpartition("#")[2]) for r in ents.collect()} >= {(1, "Old_Well")}
    ctx = rag.context(qs, rag.joined_blocks(retrieve.blocks(ents, g), "facts"), qs.limit(0).select("qid", F.lit("").alias("related")), qs.limit(0).select("qid", F.lit("").alias("texts")))

    def failing(p):
        raise RuntimeError("down")

    assert all(r["answer"].startswith("[LLM error: down]") for r in rag.answered(ctx, failing).collect())
    assert all(rag.NO_TEXTS in r["answer"] for r in rag.answered(ctx).collect())


def test_repair(spark):
    g = graph(spark)
    calls = []

    def model(p):
        calls.append(p)
        return "```sparql\nSELECT ?x WHERE { ?x ?p ?o " + ("}" if "ERROR" in p else "") + "\n```"

    r = rag.answer_by_query(g, "q", "s", model)
    assert r["repaired"] and r["error"] is None and len(r["rows"]) == 6 and len(calls) == 2
    r = rag.answer_by_query(g, "q", "s", lambda p: "nonsense")
    assert r["repaired"] and r["error"] and r["rows"] == []
    r = rag.answer_by_query(g, "q", "s", lambda p: "nonsense", repair=False)
    assert not r["repaired"] and r["error"]


def test_neighbours_file(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"http://a": [{"entity": "http://b", "label": "B_b", "sim": 0.4}, {"entity": "http://c", "label": "C", "sim": 0.3}]}')
    rows = [tuple(r) for r in read_neighbours(spark, str(tmp_path / "n.json")).orderBy("rank").collect()]
    assert rows == [("http://a", 0, "http://b", "B_b", 0.4), ("http://a", 1, "http://c", "C", 0.3)]


def test_stream(spark, tmp_path):
    from graphloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"url": "u1", "text": "The Lamp Harbour is far away from here"}\n')
    q = ingest.mentions_to(ingest.useful(ingest.documents(spark, str(tmp_path / "in")), 3), str(tmp_path / "out"), str(tmp_path / "cp"), [("[A-Z][a-z]+ Harbour", "LOCATION")])
    q.awaitTermination(60)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Lamp Harbour"]
