from graphloom.operators import extract as X

SVO = [("text", "x")]
NAMES = [(r"\bMarlo\b", "CHARACTER"), (r"\bBramble Jr\.?\b", "CHARACTER"), (r"\bBramble\b", "CHARACTER"), (r"\bLuce\b", "CHARACTER"), (r"\bYarrow\b", "CHARACTER"), (r"\bMoo\b", "ENEMY"), (r"\bTodd\b", "CHARACTER"), (r"\bTodd Town\b", "LOCATION")]


def found(spark, sentence, ents):
    return spark.createDataFrame([(1, 0, sentence, [{"ord": i, "text": t, "type": "CHARACTER"} for i, t in enumerate(ents)])], "doc_id int, sent int, sentence string, ents array<struct<ord: int, text: string, type: string>>")


def test_patterns_in_order_and_overlapping(spark):
    docs = spark.createDataFrame([(1, "Bramble Jr. wins against MARLO and the Moo."), (2, None)], "doc_id int, text string")
    got = [(r["text"], r["type"]) for r in X.pattern_mentions(docs, "doc_id", "text", NAMES).orderBy("ord").collect()]
    assert got == [("MARLO", "CHARACTER"), ("Bramble Jr", "CHARACTER"), ("Bramble", "CHARACTER"), ("Moo", "ENEMY")]


def test_svo(spark):
    f = found(spark, "Marlo saved Lady Pear from Bramble.", ["Marlo", "Lady Pear", "Pear", "Bramble"])
    assert [tuple(r) for r in X.svo(f, "doc_id").select("subject", "predicate", "object").collect()] == [("Marlo", "saves", "Lady Pear")]
    f = found(spark, "Bramble and Marlo fought Luce.", ["Marlo", "Luce", "Bramble"])
    assert [tuple(r) for r in X.svo(f, "doc_id").select("subject", "predicate", "object").collect()] == [("Bramble", "fights", "Luce")]


def test_cooccurrence_cap(spark):
    f = found(spark, "A1 B2 C3 D4 E5", ["A1", "B2", "C3", "D4", "E5"])
    none = X.svo(f, "doc_id")
    assert none.count() == 0
    got = [(r["subject"][1], r["object"][1]) for r in X.cooccurrence(f, none, "doc_id").orderBy("ord").collect()]
    assert got == [("1", "2"), ("1", "3"), ("1", "4"), ("1", "5"), ("2", "3"), ("2", "4")]


def test_containment_has_no_word_boundary(spark):
    docs = spark.createDataFrame([(1, "Moo and Todd. The Moor of rules and todds.")], "doc_id int, text string")
    m = X.pattern_mentions(docs, "doc_id", "text", NAMES)
    assert [(r["sent"], len(r["ents"])) for r in X.sentence_mentions(docs, m, "doc_id", "text").orderBy("sent").collect()] == [(0, 2), (1, 2)]


def test_first_mentions_and_pipeline(spark):
    docs = spark.createDataFrame([(2, "marlo lives in Todd Town."), (1, "Marlo saved Luce. Marlo and Luce and Yarrow ran.")], "doc_id int, text string")
    mentions, relations = X.process(docs, "doc_id", "text", NAMES)
    first = {(r["text"], r["doc_id"]) for r in X.first_mentions(mentions.filter("method = 'pattern'"), "doc_id").collect()}
    assert ("Marlo", 1) in first and ("marlo", 2) not in first
    got = {(r["subject"], r["predicate"], r["object"]) for r in relations.collect()}
    assert ("Marlo", "saves", "Luce") in got
    assert X.first_relations(relations, "doc_id").count() <= relations.count()
