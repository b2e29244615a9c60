import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import extract, kb, kge


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("Peach's Castle", "Peachs_Castle"), ("!!!", "Unknown"), ("Bosu Kurīpā", "Bosu_Kurīpā"), ("  a  b ", "a_b"), ("x-y_z", "x-y_z")])
def test_slugify(spark, text, want):
    assert one(spark, T.slugify("t"), t=text) == want


def test_names_and_values(spark):
    assert one(spark, T.short_name("u"), u="http://x/y#a_b") == "a b"
    assert one(spark, T.local_name("u"), u="http://x/y#a_b") == "a_b"
    assert one(spark, T.format_value("o", "k"), o="http://www.wikidata.org/entity/Q42", k="uri") is None
    assert one(spark, T.format_value("o", "k"), o="http://x/Category:Foo_Bar", k="uri") == "Foo Bar"
    assert one(spark, T.format_value("o", "k"), o="http://x/Q42", k="literal") == "http://x/Q42"


def test_texts(spark):
    assert one(spark, T.clean_text("t"), t="== Title ==\nshort\nThis line is long enough.") == "This line is long enough."
    assert one(spark, T.word_count("t"), t="  a b\n c ") == 3
    assert one(spark, T.question_words("t"), t="Who is Mario?") == ["mario?"]
    assert one(spark, T.ngrams(F.split("t", " ")), t="a b c") == ["a b c", "a b", "b c"]
    assert one(spark, T.sparql_block("t"), t="text ```sparql\nSELECT 1\n``` tail") == "SELECT 1"
    assert one(spark, T.sparql_block("t"), t="well\nASK { }\n```") == "ASK { }"
    assert one(spark, T.norm_surface("t"), t=" Bowser!?. ") == "Bowser"


def test_fuzzy_score(spark):
    score = lambda q, label, d: one(spark, kb.fuzzy_score(F.col("q"), F.col("l"), F.col("d")), q=q, l=label, d=d)
    assert score("Mario", "Super Mario", "video game") == 0.90
    assert score("Mario", "mario", "a video game") == 0.99
    assert score("Mario", "Zelda", "") == 0.55


def test_chunks(spark):
    at = lambda n: [(r["chunk"], len(r["text"])) for r in extract.chunks(spark.createDataFrame([(1, "x" * n)], "id int, text string"), "id", "text", least=0).orderBy("chunk").collect()]
    assert at(1000) == [(0, 500), (1, 500), (2, 100)]
    assert at(450) == [(0, 450)]
    assert at(0) == []


def test_useful_neighbours(spark):
    ok = lambda u, x: one(spark, kge.useful_neighbour(F.col("u"), F.col("l")), u=u, l=x)
    base = "http://dbpedia.org/resource/"
    assert ok(base + "Ever_Oasis", "Ever_Oasis")
    assert not any([ok("http://fr.dbpedia.org/resource/Console", "Console"), ok(base + "Q42", "Q42"), ok(base + "m.0x", "m.0x"), ok(base + "Logo.PNG", "Logo.PNG"), ok(base + "1080", "1080"), ok(base + "Category:Games", "Games")])
