import random
import time

import numpy as np

from pyspark.sql import functions as F

from graphloom.llm import entities as M


def test_names():
    assert M.name_parts("The Somdihil's Boots") == M.name_parts("Boots of Somdihil")
    assert M.name_parts("Lirwuhet Tactics II") == ("lirwuhet tactics", "2")
    assert M.name_parts("Prof. Zuttekél") == M.name_parts("professor_zuttekel")
    assert M.maker_parts("Kosmogrim Records Ltd.") == M.maker_parts("Records, KOSMOGRIM")


def apart(a, b):
    x, y = (np.array(M.vector(s), dtype=np.int64).view(np.uint64) for s in (a, b))
    return sum(int(v).bit_count() for v in x ^ y)


def limit(a, b):
    least = min(sum(int(v).bit_count() for v in np.array(M.vector(s), dtype=np.int64).view(np.uint64)) for s in (a, b))
    return M.RADIUS if least >= M.LONG else M.SHORT_RADIUS if least >= M.LEAST_BITS else 0


def _names(rng, n):
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.choice([1, 2, 2, 3, 5, 5, 6])))
    a = sorted({" ".join(word() for _ in range(rng.choice([1, 1, 2]))) for _ in range(n)})
    b = []
    for w in a:
        c = list(w)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(c) - 1)
            c[i : i + 2] = rng.choice([[c[i + 1], c[i]], [rng.choice("aeioubdf"), c[i + 1]], [c[i]], [c[i], "o", c[i + 1]]])
            c = c if len(c) > 1 else [*c, "b"]
        b.append("".join(c))
    return a, sorted(set(b))


def test_search_is_exact(spark):
    """Against brute force, with short names, many typos and swaps."""
    a, b = _names(random.Random(4), 300)
    table = lambda ws: spark.createDataFrame([("k", w) for w in [*ws, *ws[:5]]], "part string, name string")
    got = [(r["name_a"], r["name_b"]) for r in M.near_names(table(a), table(b)).collect()]
    want = {(x, y) for x in a for y in b if apart(x, y) <= limit(x, y)}
    assert set(got) == want and len(got) == len(want) > 200


def test_parts_are_apart(spark):
    a, b = _names(random.Random(5), 40)
    table = lambda p, ws: spark.createDataFrame([(p, w) for w in ws], "part string, name string")
    got = {(r["part"], r["name_a"], r["name_b"]) for r in M.near_names(table("k", a).union(table("l", b)), table("k", b).union(table("m", a))).collect()}
    assert got == {("k", x, y) for x in a for y in b if apart(x, y) <= limit(x, y)}


def test_index_prunes(spark):
    """Rows that meet at a key, against the pairs that are near, at two scales."""
    ratios = []
    for n in (500, 2_000):
        rng = random.Random(6)
        word = lambda rng=rng: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(4))
        a = sorted({f"{word()} {rng.choice(['quest', 'tactics', 'racers', 'story'])}" for _ in range(n)})
        b = [w[:3] + w[4] + w[3] + w[5:] for w in a]
        table = lambda ws: spark.createDataFrame([("k", w) for w in ws], "part string, name string")
        bits = sum((F.bit_count(f"v{i}") for i in range(1, 4)), F.bit_count("v0"))
        va, vb = (M._vectors(table(x)).withColumns({"id": F.xxhash64("name"), "bits": bits}) for x in (a, b))
        ratios.append(M.met(va, vb).count() / M.near_names(table(a), table(b)).count())
    assert max(ratios) < 20


def test_fit_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(M.FEATURES)))
    p = 1 / (1 + np.exp(-(x[:, 0] * 2 - 1)))
    y = (rng.random(4000) < p).astype(float)
    w = M.fit(x, y)
    assert abs(w[0] + 1) < 0.2 and abs(w[1] - 2) < 0.25
    assert M.fit(x[:5], y[:5]) == M.DEFAULT_WEIGHTS


def test_found(spark):
    em = [(i, f"Lampquest_{w}", f"Lampquest {w}", None, None, None, "new_entity") for i, w in enumerate(["Orrimdal", "Fendolak", "Saltigren"])] + [(7, "Lampquest_Orrimdal", None, None, None, None, "new_entity"), (8, None, "x", None, None, None, "new_entity")]
    mapping = spark.createDataFrame(em, "mapping_id long, private_entity string, label string, wikidata_qid string, wikidata_uri string, confidence double, status string")
    kb = spark.createDataFrame([(M.BASE + "Lampquest_Orrimdal", "http://x/prop/firstYear", "1999", "literal", None, None), (M.BASE + "Lampquest_Orrimdal", "http://x/prop/createdBy", "Moth Works", "literal", None, None)], "s string, p string, o string, o_kind string, dt string, lang string")
    items = spark.createDataFrame(
        [("http://w/Q1", "lampquest: Orrimdal", "video game", None, 1999, "Moth Works Ltd.", None, None), ("http://w/Q2", "Lampquest Orrimdal", "video game", None, 1980, "Otter Toys", None, None), ("http://w/Q3", "Something Else", None, None, None, None, None, None)],
        "wikidata_uri string, item_label string, description string, also_known_as string, inception_year int, creator string, platform string, region_name string",
    )
    got = {tuple(r) for r in M.found(mapping, kb, items).collect()}
    assert ("Lampquest_Orrimdal", "http://w/Q1") in got and all(u != "http://w/Q3" for _, u in got)
    assert M.found(mapping.limit(0), kb, items).count() == 0
    assert M.found(mapping, kb.limit(0), items.limit(0)).count() == 0


def test_large_routes_give_the_same(spark, monkeypatch):
    """Routes that are split before the exchange, and ones that are searched by their next bits, against brute force."""
    a, b = _names(random.Random(7), 150)
    want = {(x, y) for x in a for y in b if apart(x, y) <= limit(x, y)}
    table = lambda ws: spark.createDataFrame([("k", w) for w in ws], "part string, name string")
    monkeypatch.setattr(M, "HOT_ROUTE", 60)
    assert {(r["name_a"], r["name_b"]) for r in M.near_names(table(a), table(b)).collect()} == want
    bits = sum((F.bit_count(f"v{i}") for i in range(1, 4)), F.bit_count("v0"))
    va, vb = (M._vectors(table(x)).withColumns({"id": F.xxhash64("name"), "bits": bits}) for x in (a, b))
    for i in range(4):
        rows = M.routes(va, 0, i).union(M.routes(vb, 1, i)).orderBy("route").toPandas()
        met = []
        for block, batch in ((2_000_000, 10**6), (20_000, 500)):
            monkeypatch.setattr(M, "BLOCK", block)
            monkeypatch.setattr(M, "ROWS", batch)
            found = [tuple(x) for pdf in M._met(rows[k : k + batch] for k in range(0, len(rows), batch)) for x in pdf.itertuples(index=False)]
            met.append(sorted(found))
        assert met[0] == met[1] and len(met[0]) > 20


def test_rows_exchanged_for_a_name(spark):
    """A name is exchanged some fifteen times, not once for each of its hundreds of keys, and its shuffle files don't outlast the search."""
    a, b = _names(random.Random(8), 200)
    table = lambda ws: spark.createDataFrame([("k", w) for w in ws], "part string, name string")
    bits = sum((F.bit_count(f"v{i}") for i in range(1, 4)), F.bit_count("v0"))
    va, vb = (M._vectors(table(x)).withColumns({"id": F.xxhash64("name"), "bits": bits}) for x in (a, b))
    assert sum(M.routes(va, 0, i).count() for i in range(4)) <= 21 * len(a)  # 15, and 6 where both searches apply
    before = _shuffles(spark)
    M.met(va, vb)
    deadline = time.time() + 20
    while _shuffles(spark) > before and time.time() < deadline:  # executors are told, not waited for
        time.sleep(0.2)
    assert _shuffles(spark) <= before


def _shuffles(spark):
    """Shuffles whose files are kept."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.getName().startswith("shuffle_") for f in (blocks.apply(i) for i in range(blocks.size())))
