from graphloom.llm import copies

SCHEMA = "mention_id long, text string, type string, label string, source_url string, confidence double, method string"


def rows(spark, *data):
    return spark.createDataFrame([(i, t, k, lab, u, None, None) for i, t, k, lab, u in data], SCHEMA)


def pairs(df):
    return sorted(tuple(r) for r in copies.found(df).collect())


def test_layout_does_not_matter_and_order_of_parameters_neither(spark):
    df = rows(
        spark,
        (5, "The  Lamp!", "A", None, "https://x.example/i?b=2&a=1"), (3, "the lamp", "A", None, "HTTPS://x.example/i?a=1&b=2"), (9, "THE-LAMP", "A", None, "<https://x.example/i?&a=1&b=2>"),
        (1, "the lamp", "B", None, "https://x.example/i?a=1&b=2"), (2, "the lamp", "A", "L", "https://x.example/i?a=1&b=2"), (4, "the lamp", "A", None, "https://x.example/i?a=1&b=2#f"),
    )
    assert pairs(df) == [(3, 5), (3, 9)]


def test_same_letters_in_another_order_are_no_copies(spark):
    assert pairs(rows(spark, (1, "abc", "A", "L", "u"), (2, "acb", "A", "L", "u"), (3, "abc", "A", "L", "v"))) == []


def test_nulls_blanks_and_empty_tables(spark):
    df = rows(spark, (1, None, "A", "L", "u"), (2, None, "A", "L", "u"), (3, "a", "A", "L", None), (4, "a", "A", "L", None), (5, "!?", "A", "L", "u"), (6, "..", "A", "L", "u"), (7, "b", None, None, ""), (8, "B", None, None, " "))
    assert pairs(df) == [(7, 8)]
    assert pairs(df.limit(0)) == []


def test_hot_groups_are_split_and_whole(spark):
    df = spark.range(3000).selectExpr("id as mention_id", "case when id % 3 = 0 then 'Hot Name' else concat('n', id) end as text", "'A' as type", "'L' as label", "'u' as source_url")
    got = copies.copy_classes(df, hot_rows=100)
    assert got.count() == 1000
    assert {tuple(r) for r in got.select("first_id", "copies").distinct().collect()} == {(0, 1000)}


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    df = rows(spark, (1, "a", "A", "L", "u"), (2, "A", "A", "L", "u")).withColumn("_k1", F.lit(1)).withColumn("copies", F.lit("x"))
    assert pairs(df) == [(1, 2)]


def test_very_long_texts_and_repeated_rows(spark):
    long = "Long Word " * 20_000
    df = rows(spark, (1, long, "A", "L", "u"), (2, long.upper(), "A", "L", "u"), (2, long.upper(), "A", "L", "u"))
    assert pairs(df) == [(1, 2)]


def test_rows_without_an_id(spark):
    assert pairs(rows(spark, (None, "a", "A", "L", "u"), (1, "A", "A", "L", "u"), (2, "a", "A", "L", "u"))) == [(1, 2)]


def test_letters_with_marks_and_ligatures(spark):
    """Every step is an invariant of the last key, which folds letter by letter."""
    df = rows(spark, (1, "Straße 5", "A", "L", "u/ﬁn"), (2, "STRASSE-5", "A", "L", "U/FIN"), (3, "strasse5", "A", "L", "u fin"), (4, "strase5", "A", "L", "ufin"), (5, "ÉCLAIR ΣΑΣ", "A", "L", "É"), (6, "éclair-σας", "A", "L", "é"))
    assert (2, 3) in pairs(df) and (5, 6) in pairs(df) and len(pairs(df)) == 2


def test_every_step_keeps_what_the_last_key_joins(spark):
    from pyspark.sql import functions as F

    texts = ["Ab c", "aB-C", "abc", "É1", "é 1", "ΣΑΣ", "σας", "Ω2", "ω2", "Ǆx", "ǆX", "İz", "i̇z", "Kelvin", "kelvin"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(copies.text_key(F.col("t")).alias("k"), F.xxhash64(*copies._counts(F.col("t"))).alias("one"), copies._histogram(copies.folded(F.col("t"))).alias("two"))
    assert df.groupBy("k").agg(F.countDistinct("one").alias("n"), F.countDistinct("two").alias("m")).filter("n > 1 or m > 1").count() == 0
