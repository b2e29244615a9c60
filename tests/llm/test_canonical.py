from graphloom.llm import canonical as C

NAMES = [("Q1", "Level Designer", "role", None), ("Q2", "Orbel 8", "platform_or_brand", None), ("Q3", "Orbel 16", "platform_or_brand", None), ("Q4", "Quality Assurance Tester", "role", "QA Tester|Playtester"), ("Q5", "Saltford", "place", None), ("Q6", "Port Saltford", "place", "PS"), ("Q7", None, "place", None)]


def mapped(spark, *labels, names=NAMES):
    m = spark.createDataFrame([(i, f"e{i}", x, "typed_value") for i, x in enumerate(labels)] + [(999, "e", "Level Designer", "new_entity")], "mapping_id long, private_entity string, label string, status string")
    c = spark.createDataFrame(names, "wikidata_qid string, wikidata_label string, kind string, also_known_as string")
    got = dict(C.mapped(m, c).collect())
    return [got[i] for i in range(len(labels))]


def test_values(spark):
    labels = ["level  designer", "Lvl Dsgnr", "Designer, Level", "freelance Level Designer", "Level Designer at Orbel 8", "Leval Dseigner (contract)", "ORBEL 8®", "Orebl 16", "QA tester.", "Sa1tf0rd, Salt Coast", "near the docks, Port Saltford", "ps", "pq"]
    assert mapped(spark, *labels) == ["Q1", "Q1", "Q1", "Q1", "Q1", "Q1", "Q2", "Q3", "Q4", "Q5", "Q6", "Q6", "NONE"]


def test_no_match(spark):
    assert mapped(spark, None, "", "  ", "n/a", "x", "hat designer", "Orbel 32", "y" * 50_000) == ["NONE"] * 8


def test_ties_and_empty_list(spark):
    assert mapped(spark, "Twin", names=[("Q1", "Twin", "role", None), ("Q2", "twin", "role", None)]) == ["NONE"]
    assert mapped(spark, "Twin", names=[("Q1", "x", "role", None)]) == ["NONE"]


def test_join_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    base = ["quillhaven", "thornferry", "umberwick", "slategate", "velvetcross", "marrowdale"]
    labels = []
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            rng.choice([lambda k=k: w.pop(k), lambda k=k: w.insert(k, rng.choice("abcxyz")), lambda k=k: w.__setitem__(k, rng.choice("abcxyz"))])()
        labels.append("".join(w))
    from graphloom.llm.names import edits

    def lev(a, b):
        import numpy as np

        p = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return int(p[-1])

    assert edits("a", "b", 1) == 1
    got = mapped(spark, *labels, names=[(f"Q{i}", n, "place", None) for i, n in enumerate(base)])
    for label, q in zip(labels, got, strict=True):
        near = []
        for i, n in enumerate(base):
            k = 2 if len(n) <= 9 else 3
            dist = lev(label, n)
            if dist <= k or dist <= k + 1 and lev("".join(sorted(label)), "".join(sorted(n))) <= 1:
                near.append((dist, -len(n), f"Q{i}"))
        near.sort()
        want = "NONE" if not near or len(near) > 1 and near[0][:2] == near[1][:2] else near[0][2]
        assert q == want, label
