import random

from graphloom.llm import leaks as L

ITEM = "When Fendolin crossed the amber causeway at dusk the lamplighters of Orrim counted ninety moths before the tide took the western stair and nobody could say which bell had rung first that night or why the otter refused the silver oar again"
OTHER = "The quick shopkeeper sold apples and pears to travellers on the road while the rain fell over green hills and a dog slept near the warm stove until someone knocked twice and asked for bread"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def items(spark, *texts):
    return spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "item_id long, suite string, text string")


def found(d, i):
    return sorted(tuple(r) for r in L.found(d, i).collect())


def test_whole_partly_and_changed(spark):
    ws = ITEM.split()
    changed = " ".join(w if k % 11 else "quite " + w for k, w in enumerate(ws)).upper()
    markup = " ".join(f"<b>{w}</b>" if k % 7 == 0 else f"[[{w}]]" if k % 7 == 3 else w for k, w in enumerate(ws))
    d = docs(spark, OTHER + " " + ITEM, OTHER + ". " + " ".join(ws[: len(ws) // 2]) + ". " + OTHER, changed, markup, ITEM.replace("o", "о"), "\n".join(ws))
    assert found(d, items(spark, ITEM, OTHER[:150])) >= [(k, 0) for k in range(6)] or {(k, 0) for k in range(6)} <= set(found(d, items(spark, ITEM, OTHER[:150])))


def test_short_quotations_and_patterns_do_not_count(spark):
    ws = ITEM.split()
    like = " ".join("xyzzy" if k % 3 == 2 else w for k, w in enumerate(ws))
    d = docs(spark, OTHER + " " + " ".join(ws[: len(ws) // 4]), like, " ".join(reversed(ws)), None, "")
    assert found(d, items(spark, ITEM)) == []


def test_short_items_nulls_and_empty_tables(spark):
    d = docs(spark, "before " + "seven small words are a whole item" + " after all of this text ends", ITEM)
    assert (1, 2) in found(d, items(spark, None, "", ITEM))
    assert found(d.limit(0), items(spark, ITEM)) == []
    assert found(d, items(spark, ITEM).limit(0)) == []


def test_equal_items_and_documents(spark):
    assert found(docs(spark, ITEM, ITEM), items(spark, ITEM, ITEM)) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_very_long_document(spark):
    rng = random.Random(1)
    noise = [rng.choice(OTHER.split()) for _ in range(60_000)]
    text = " ".join(noise[:50_000]) + " " + ITEM + " " + " ".join(noise[50_000:])
    assert found(docs(spark, text), items(spark, ITEM)) == [(0, 0)]


def test_bound_holds():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))) for _ in range(2))
        item = L.Item(a)
        item.need = 0
        assert item.held(b.split()) <= item.in_order([item.like(w) for w in b.split()])


def test_dense_bound_holds():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (" ".join(rng.choice("abcdefghijkl"[: rng.randint(3, 12)]) for _ in range(rng.randint(1, 30))) for _ in range(2))
        item = L.Item(a)
        item.need = 0
        assert item.held(b.split()) <= item.dense(item.hits(b.split()))


def _reworded(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    ws = [word() for _ in range(60)]
    return " ".join(ws), " ".join([word() for _ in range(30)] + [word() if k % 5 == 4 else w for k, w in enumerate(ws[:40])] + [word() for _ in range(30)])


def test_pairs_with_few_shared_keys_are_verified(spark):
    shared = lambda item, doc: len(L._keys_of([0], [item], [[12]], None).merge(L._keys_of([0], [doc], [[12]], None), on="key"))
    pairs = [p for p in map(_reworded, range(200)) if 1 <= shared(*p) < 4][:10]
    assert len(pairs) >= 3
    got = found(docs(spark, *(d for _, d in pairs)), items(spark, *(i for i, _ in pairs)))
    assert got == [(k, k) for k in range(len(pairs))]


def test_window_never_exceeds_what_is_needed():
    for n in range(1, 200):
        need = L.needed(" ".join(f"w{k}" for k in range(n)))
        assert 1 <= L.band(need) <= need and (need > 3 or L.band(need) == need)


def _piece(rng, word, n, share, change):
    """An item of n words and a run of its words, in which a word in eight is another; it still holds as many as are needed."""
    item = [word() for _ in range(n)]
    need = -(-2 * n // 5)
    first = rng.randrange(8)
    run = [word() if change and (k + first) % 8 == 7 else w for k, w in enumerate(item)]
    length = max(need, -(-int(share * 10) * n // 10))
    start = rng.randrange(n - length + 1)
    while sum(a == b for a, b in zip(item[start : start + length], run[start : start + length], strict=True)) < need:
        length += 1
        start = min(start, n - length)
    return " ".join(item), run[start : start + length]


def test_recall_by_length_and_share(spark):
    """Leaks of 5 to 100 words, of two fifths, three fifths and all, as they are and with a word changed in eight."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    its, ds, cells = [], [], []
    for n in (5, 8, 12, 18, 25, 50, 100):
        for share in (0.4, 0.6, 1.0):
            for change in (False, True):
                for _ in range(20):
                    item, run = _piece(rng, word, n, share, change)
                    its.append(item)
                    around = [[word() for _ in range(30)] for _ in range(2)] if rng.random() < 0.7 else [[], []]
                    ds.append(" ".join(around[0] + run + around[1]))
                    cells.append((n, share, change))
    # what the verification itself accepts is what has to be found
    real = [k for k in range(len(ds)) if L.Item(its[k]).held(L.words(ds[k])) >= L.needed(its[k])]
    got = {d for d, i in found(docs(spark, *ds), items(spark, *its)) if d == i}
    for cell in set(cells):
        want = [k for k in real if cells[k] == cell]
        assert len(want) >= 10
        assert sum(k in got for k in want) >= 0.9 * len(want), cell


def test_a_short_item_is_found_as_the_whole_document(spark):
    texts = ["amber", "amber otter", "seven small words are a whole item", "five words that nobody wrote"]
    got = found(docs(spark, *texts), items(spark, *texts))
    assert {(k, k) for k in range(4)} <= set(got)


def test_boilerplate_key_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr("graphloom.plans.skew.HOT_ROWS", 5)
    got = found(docs(spark, *[f"{OTHER} {ITEM} {k}" for k in range(30)]), items(spark, ITEM))
    assert got == [(k, 0) for k in range(30)]
