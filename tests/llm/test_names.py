import random

import pytest

from graphloom.llm import names as N

V = N.Vocabulary({"Person": ["timothy", "theodore", "gabriela", "victoria", "vladimir"], "Organization": ["software", "sound", "house", "records", "works", "game"]}, {})


@pytest.mark.parametrize(
    "text,label,want",
    [
        ("Timothy Dumlihonfit", "Person", ("timothy", False, "dumlihonfit")), ("DUMLIHONFIT, TIMOTHY T.", "Person", ("timothy", False, "dumlihonfit")), ("Dr._Timothy_Dumlihonfít", "Person", ("timothy", False, "dumlihonfit")),
        ("TheodoreDidpake1lir", "Person", ("theodore", False, "didpakellir")), ("gabrielabugdurektet", "Person", ("gabriela", False, "bugdurektet")), ("Timohty Dumlihonfit", "Person", ("timothy", False, "dumlihonfit")),
        ("Timothy “Tim” Lagvigasfol (designer)", "Person", ("timothy", False, "lagvigasfol")), ("Tim Lagvigasfol", "Person", ("timothy", False, "lagvigasfol")), ("V. Rolrasurdes", "Person", ("v", True, "rolrasurdes")), ("Gabr., Bugdurektet", "Person", ("gabriela", False, "bugdurektet")),
        ("Dumpovornul Timothy", "Person", ("timothy", False, "dumpovornul")), ("The Bug Software Ltd.", "Organization", ("software", False, "bug")), ("Zirfugigföl (sound house)", "Organization", ("house sound", False, "zirfugigfol")),
        ("Records, Husvivimkos", "Organization", ("records", False, "husvivimkos")), ("Tusfo Rec.", "Organization", ("rec", True, "tusfo")), ("Wudsi Software S. A.", "Organization", ("software", False, "wudsi")), ("!!", "Person", ("", False, "")),
    ],
)
def test_parse(text, label, want):
    assert N.parse(text, label, V) == want


def test_similarity():
    assert N.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert N.edits("abcd", "abdc", 2) == 1
    assert N.edits("abcd", "wxyz", 2) == 3
    assert N.same_name("didpakellir", "didpakelir") and not N.same_name("didpakellir", "didpasomlir")


def _edited(rng, w):
    """The word with a letter lost, added, changed or swapped with the next."""
    i, c = rng.randrange(len(w) - 1), rng.choice("abcdefghijklmnopqrstuvwxyz")
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])


def _word(rng, syllables):
    return "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "", "l", "n", "r", "s"]) for _ in range(syllables))


def test_a_typo_leaves_a_block_in_common():
    rng = random.Random(1)
    for _ in range(2_000):
        a = _word(rng, rng.randint(2, 4))
        b = _edited(rng, a)
        assert set(N.codes(a)) & set(N.codes(b)), (a, b)


def test_known_words_near_a_token():
    rng = random.Random(2)
    known = sorted({_word(rng, 3) for _ in range(300)})
    v = N.Vocabulary({"Person": known}, {})
    for w in known[:60]:
        for most, token in ((1, _edited(rng, w)), (2, _edited(rng, _edited(rng, w)))):
            assert {x for x in known if N.edits(token, x, most) <= most} <= v.near(token, "Person", most)


def test_rare_given_names(spark):
    """People with mostly unlike given names: typos of the given name, and turned names without a comma."""
    rng = random.Random(3)
    people = sorted({(_word(rng, 3).capitalize(), _word(rng, 4).capitalize()) for _ in range(3_000)})
    rng.shuffle(people)
    swapped = lambda w: w[:2] + w[3] + w[2] + w[4:]
    typos = [(f"{g} {n}", f"{swapped(g)} {n}") for g, n in people[:300] if g[2] != g[3]]
    turned = [(f"{g} {n}", f"{n} {g}") for g, n in people[300:600]]
    rows = [(f"{g} {n}",) for g, n in people] + [(b,) for _, b in typos + turned]
    got = {tuple(r) for r in N.found(spark.createDataFrame(rows, "text string").selectExpr("text", "'Person' as label")).collect()}
    for want in ({tuple(sorted(p)) for p in typos}, {tuple(sorted(p)) for p in turned}):
        assert len(got & want) >= 0.9 * len(want)
    assert len(got) <= 1.02 * (len(typos) + len(turned))


def test_hot_blocks_and_entities_give_the_same(spark, monkeypatch):
    rows = [(f"{t}Timothy {n}{e}", "Person") for t in ("", "Dr. ", "(", "[[") for n in ("Bugdurek", "Bugdureek", "Budgurek", "Lirwejad", "Lirwejjad") for e in ("", " ", ";", " esq.")]
    df = spark.createDataFrame(rows, "text string, label string")
    want = {tuple(r) for r in N.found(df).collect()}
    monkeypatch.setattr(N, "HOT_NAMES", 2)
    assert {tuple(r) for r in N.found(df).collect()} == want and len(want) > 500


def test_found(spark):
    given = ["Timothy", "Gabriela", "Robert", "Victoria", "Vladimir"]
    names = ["Bugdurek", "Zokwawat", "Lirwejad", "Dumlihon", "Kathacot", "Namrutil", "Pelsovic", "Hontagrem", "Fisbolat", "Wigpurnes", "Jalketom", "Rudvosin", "Cemfigal", "Tosbunir", "Mavdelok", "Sorpikut"]
    rows = [(f"{g} {n}", "Person") for g in given for n in names]
    rows += [("Bugdurek, Timothy", "Person"), ("TIMOTHY  BUGDUREK", "Person"), ("V. Zokwawat", "Person"), (None, "Person"), (" ", "Person"), ("Timothy Bugdurek", "Item"), ("timothy bugdurek", "Item")]
    rows = rows + rows[:5]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "mention_id long, text string, label string")
    got = {tuple(r) for r in N.found(df).collect()}
    assert got == {("Bugdurek, Timothy", "TIMOTHY  BUGDUREK"), ("Bugdurek, Timothy", "Timothy Bugdurek"), ("TIMOTHY  BUGDUREK", "Timothy Bugdurek")}
    assert N.found(df.limit(0)).count() == 0


def test_a_consonant_typo_in_a_short_name_leaves_a_block_in_common():
    for a, b in (("novak", "noak"), ("marlow", "malrow"), ("weber", "weser"), ("novak", "novlak"), ("aiel", "aier"), ("aiea", "aied")):
        assert N.same_name(a, b) and set(N.codes(a)) & set(N.codes(b)), (a, b)


def test_short_names_with_a_consonant_typo_are_found(spark):
    rows = [("Tim Novak",), ("Timothy Noak",), ("Tim Marlow",), ("Timothy Malrow",), ("Tim Gruen",)]
    got = {tuple(r) for r in N.found(spark.createDataFrame(rows, "text string").selectExpr("text", "'Person' as label")).collect()}
    assert got == {("Tim Novak", "Timothy Noak"), ("Tim Marlow", "Timothy Malrow")}


def test_parts_of_a_name_in_any_order():
    for a, b in (("lopez garcia", "garcia lopez"), ("lopez garcia", "farcia lopez"), ("van der berg", "berg van der"), ("lopez garcia", "garzia lopes"), ("van der berg", "vander berg")):
        assert N.same_parts(a, b) and set(N.codes(a)) & set(N.codes(b)), (a, b)
    assert not N.same_parts("lopez garcia", "lopez moreno") and not N.same_parts("lopez garcia", "garcia lorca")


def test_names_of_two_parts_in_turned_order_are_found(spark):
    rows = [("Tim Lopez Garcia", "Person"), ("Garcia Lopez Tim", "Person"), ("Garzia Lopez, Tim", "Person"), ("Tim Lopez Moreno", "Person"), ("Amber Causeway Ltd.", "Organization"), ("Causeway Amber", "Organization")]
    got = {tuple(r) for r in N.found(spark.createDataFrame(rows, "text string, label string")).collect()}
    assert got == {("Garcia Lopez Tim", "Tim Lopez Garcia"), ("Garcia Lopez Tim", "Garzia Lopez, Tim"), ("Garzia Lopez, Tim", "Tim Lopez Garcia"), ("Amber Causeway Ltd.", "Causeway Amber")}


def test_given_names_that_are_not_learned_are_compared(spark):
    rows = [("Zbigniew Novak",), ("Zbignew Novak",), ("Novak Zbigniew",), ("Novakk Zbiggniew",), ("William Marlow",), ("Marlow Bill",), ("Zdenek Novak",), ("Zbigniew Marlow",)]
    members = N.clusters(spark.createDataFrame(rows, "text string").selectExpr("text", "'Person' as label")).collect()
    got = {}
    for r in members:
        got.setdefault(r["entity"], set()).add(r["text"])
    assert sorted(map(sorted, got.values())) == [["Marlow Bill", "William Marlow"], ["Novak Zbigniew", "Novakk Zbiggniew", "Zbignew Novak", "Zbigniew Novak"], ["Zbigniew Marlow"], ["Zdenek Novak"]]
