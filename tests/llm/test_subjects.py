import numpy as np

from graphloom.llm import subjects as P

WORDS = {"sport": ["goal", "referee", "striker", "league"], "cooking": ["oven", "dough", "garlic", "skillet"]}


def corpus(spark):
    docs, labels = [], []
    for i in range(120):
        k = ("sport", "cooking")[i % 2]
        ws = WORDS[k]
        text = " ".join(f"The {ws[(i + j) % 4]} was near the {ws[(i + j + 1) % 4]} of number {j}." for j in range(6))
        docs.append((i, text, "en"))
        if i < 40:
            labels.append((i, k if i != 7 else "cooking", "editor"))
    docs += [(200, "The goal was near the referee. The oven was near the dough.", "en"), (201, None, "en"), (202, " ", None), (203, "This article is a stub. You can help by expanding it.", "en"), (204, "#REDIRECT [[Goal referee]]", "en")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string"),
        spark.createDataFrame([("sport", "games"), ("cooking", "food"), ("law", "courts")], "subject string, description string"),
        spark.createDataFrame([*labels, (999, "sport", "crowd"), (3, "nothing", "crowd")], "doc_id long, subject string, labelled_by string"),
    )


def test_found(spark):
    docs, areas, labels = corpus(spark)
    got = {tuple(r) for r in P.found(docs, areas, labels).collect()}
    want = {(i, ("sport", "cooking")[i % 2]) for i in range(120)} | {(200, "sport"), (200, "cooking")}
    assert len(got & want) / len(want) > 0.98 and len(got - want) <= 2
    assert not {i for i, _ in got} & {201, 202, 203, 204}


def test_nothing_to_learn_from(spark):
    docs, areas, labels = corpus(spark)
    assert P.found(docs, areas, labels.limit(0)).count() == 0
    assert P.found(docs.limit(0), areas, labels).count() == 0


def texts(*lens):
    """Documents with so many sentences of three words each."""
    return P.Texts([np.arange(3 * n) for n in lens], [np.full(n, 3) for n in lens])


def test_a_fifth_is_enough():
    g = np.full((10, 3), -1.0)
    g[0, 1] = g[1, 1] = g[2, 2] = 9
    assert P.given(texts(10), g, 1.0).tolist() == [[False, True, False]]
    assert P.given(texts(), np.zeros((0, 3)), 1.0).shape == (0, 3)


def test_thresholds_by_subject():
    g = np.array([[3.0, 0.0], [0.0, 3.0]])
    assert P.given(texts(1, 1), g, np.array([2.0, 4.0])).tolist() == [[True, False], [False, False]]


def _models(rng, size=30, subjects=3):
    v = P.Vocabulary(np.arange(size), rng.integers(0, 2, size), rng.integers(1, 50, size), np.array([7.0, 0.0]))
    one = np.floor(v.counts[:, None] * rng.dirichlet(np.ones(subjects + 1), v.size)[:, :subjects])
    pairs = np.array(sorted({int(h * v.size + w) for h, w in rng.integers(0, v.size, (80, 2)) if v.lang[h] == v.lang[w]}))
    background = rng.integers(2, 9, len(pairs)).astype(float)
    two = np.floor(background[:, None] * rng.dirichlet(np.ones(subjects + 1), len(pairs))[:, :subjects])
    h = pairs // v.size
    before, after = np.bincount(h, background, v.size) + rng.integers(0, 20, v.size), np.zeros((v.size, subjects))
    np.add.at(after, h, two)
    return P.Models(v, one, pairs, background, before, two, after + rng.integers(0, 5, (v.size, subjects)))


def test_models_sum_to_one():
    m = _models(np.random.default_rng(1))
    v = m.v
    for lang in (0, 1):
        of = v.lang == lang
        assert np.isclose(m.p0[of].sum(), 1) and np.allclose(m.ps[of].sum(axis=0), 1)
        for h in np.flatnonzero(of):
            mine = m.pairs // v.size == h
            held = np.zeros(v.size, dtype=bool)
            held[m.pairs[mine] % v.size] = True
            assert np.isclose(m.q0[mine].sum() + m.rest0[h] * m.p0[of & ~held].sum(), 1)
            other = (1 - P.NU) * m.rest[h] * m.ps[of & ~held] + P.NU * m.rest0[h] * m.p0[of & ~held][:, None]
            assert np.allclose(m.qs[mine].sum(axis=0) + other.sum(axis=0), 1)


def test_gains_are_differences_of_cross_entropies():
    rng = np.random.default_rng(2)
    m = _models(rng)
    v = m.v
    w = rng.choice(np.flatnonzero(v.lang == 0), 12)
    t = P.Texts([w[:5], w[5:]], [np.array([5]), np.array([3, 4])])
    got = m.gains(t, w)
    for s, (a, b) in enumerate([(0, 5), (5, 8), (8, 12)]):
        want = np.zeros(3)
        for i in range(a, b):
            p = P._find(m.pairs, np.array([w[i - 1] * v.size + w[i]]))[0] if i > a else -1
            if p >= 0:
                want += np.log(m.qs[p] / m.q0[p])
            elif i > a:
                want += np.log((1 - P.NU) * m.rest[w[i - 1]] * m.ps[w[i]] / (m.rest0[w[i - 1]] * m.p0[w[i]]) + P.NU)
            else:
                want += np.log(m.ps[w[i]] / m.p0[w[i]])
        assert np.allclose(got[s], want / (b - a + P.REST), atol=1e-5)


def test_slices_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    m = _models(rng)
    w = rng.integers(0, m.v.size, 300)
    t = P.Texts([w], [np.full(60, 5)])
    whole = m.gains(t, w)
    monkeypatch.setattr(P, "SLICE", 17)
    assert np.allclose(m.gains(t, w), whole)


def test_a_models_own_text_is_less_surprising(spark):
    """Perplexity: held-out documents of a subject are likelier in its model than in the background's and the others'."""
    docs, areas, labels = corpus(spark)
    numbered, subjects, languages, models, thresholds, figures = P.trained(docs, areas, labels)
    assert subjects == ["cooking", "sport"] and len(thresholds) == 2 and figures["precision"] > 0.9 and figures["recall"] > 0.9
    for r in numbered.filter("doc_id between 60 and 119").collect():
        t = P.Texts([np.array(r.tokens)], [np.array(r.lens)])
        g = models.gains(t, models.v.indices(*languages.marked(t))).mean(axis=0)
        own = 1 - r.doc_id % 2
        assert g[own] > 0 > g[1 - own]


def test_rare_words_are_the_unknown_word():
    v = P.Vocabulary(np.array([5, 9]), np.array([0, 1]), np.array([4, 4]), np.array([3.0, 2.0]))
    assert v.indices(np.array([9, 5, 7, 7]), np.array([1, 0, 0, 1])).tolist() == [1, 0, 2, 3]


def test_extra_columns_and_repeated_rows(spark):
    docs, areas, labels = corpus(spark)
    more = docs.union(docs.filter("doc_id < 30")).selectExpr("doc_id", "text", "lang", "'x' as tokens", "1 as labels", "'y' as subject")
    got = [tuple(r) for r in P.found(more, areas, labels).collect()]
    assert len(got) == len(set(got)) >= 120


def test_size_of_the_corpus_switches_nothing(spark):
    """Words and pairs of three documents are told apart among 80,000 documents as they are among 120."""
    docs, areas, labels = corpus(spark)
    docs = docs.union(spark.createDataFrame([(i, "The quokka wombat was near.", "en") for i in (300, 301, 302)], docs.schema))
    more = spark.range(1000, 81_000).selectExpr("id", "'It is so of old.'", "'en'")
    for all_ in (docs, docs.union(more)):
        _, _, languages, models, _, _ = P.trained(all_, areas, labels)
        w = P.numbers(["the", "quokka", "wombat"]).view(np.int64)
        t = P.Texts([w], [np.array([3])])
        at = models.v.indices(*languages.marked(t))
        assert (at < len(models.v.words)).all()
        assert (P._find(models.pairs, models.v.pair(at[:-1], at[1:])) >= 0).all()


def test_blocks_get_all_they_need(spark):
    """Each block's part of the models gives what the whole models give."""
    docs, areas, labels = corpus(spark)
    numbered, subjects, languages, models, thresholds, _ = P.trained(docs, areas, labels)
    assert numbered.select("block").distinct().count() > 1
    want = set()
    for r in numbered.collect():
        t = P.Texts([np.array(r.tokens)], [np.array(r.lens)])
        got = P.given(t, models.gains(t, models.v.indices(*languages.marked(t))), thresholds)
        want |= {(r.doc_id, subjects[k]) for k in np.flatnonzero(got[0])}
    assert {tuple(r) for r in P.found(docs, areas, labels).collect()} == want


def test_last_given_is_what_each_threshold_gives():
    rng = np.random.default_rng(4)
    t, tried = texts(7, 1, 12), np.array([0.5, 1.0, 1.5])
    g = rng.integers(0, 5, (20, 3)) / 2
    last = P.last_given(t, g, tried)
    for i, th in enumerate(tried):
        assert ((last >= i) == P.given(t, g, float(th))).all()
