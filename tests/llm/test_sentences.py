import re

import pytest

from graphloom.llm import sentences as S


def cut(text, known=None):
    return [text[a:b] for a, b in S.split(text, known or {})]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Hello there. It is late.", ["Hello there.", "It is late."]),
        ("Dr. Moth left. The end.", ["Dr. Moth left.", "The end."]),
        ("It weighs 3.5 kg. The rest is lost.", ["It weighs 3.5 kg.", "The rest is lost."]),
        ("“Who goes there?” asked Ann. Nobody came.", ["“Who goes there?” asked Ann.", "Nobody came."]),
        ("Her motto was: “Light first. Ask later.” They agreed.", ["Her motto was: “Light first. Ask later.”", "They agreed."]),
        ("(The cut is lost.) Nobody knows.", ["(The cut is lost.)", "Nobody knows."]),
        ("塔很高。真的吗？是的！", ["塔很高。", "真的吗？", "是的！"]),
        ("「門は閉まったか。」ソルデナは言った。", ["「門は閉まったか。」", "ソルデナは言った。"]),
        ("「早く逃げて！橋が落ちる！」と彼は叫んだ。", ["「早く逃げて！橋が落ちる！」と彼は叫んだ。"]),
        ("क्या यह सच है? मीनार खड़ी है।", ["क्या यह सच है?", "मीनार खड़ी है।"]),
        ("هل رأيت المفتاح؟ رسم د. بلتورا خريطة.", ["هل رأيت المفتاح؟", "رسم د. بلتورا خريطة."]),
        ("Πού είναι το κλειδί; Εδώ είναι.", ["Πού είναι το κλειδί;", "Εδώ είναι."]),
        ("== Notes ==\nFirst one. Second one.", ["== Notes ==", "First one.", "Second one."]),
        ("A title\n\nA line that\ngoes on.", ["A title", "A line that\ngoes on."]),
        ("No end here", ["No end here"]),
        ("He left; she stayed: all, all.", ["He left; she stayed: all, all."]),
        ("Wait... the bridge fell. Nobody saw…", ["Wait... the bridge fell.", "Nobody saw…"]),
        ("สะพานถูกทำลาย ราคาอยู่ที่ 19.90 เหรียญ", ["สะพานถูกทำลาย", "ราคาอยู่ที่ 19.90 เหรียญ"]),
    ],
)
def test_cases(text, want):
    assert cut(text) == want


@pytest.mark.parametrize("text", ["", None, "  \n\t "])
def test_blank(text):
    assert S.split(text, {}) == []


def test_evidence_of_the_corpus_decides():
    text = "He met Xq. Bolt at noon."
    assert cut(text) == ["He met Xq.", "Bolt at noon."]
    assert cut(text, {"Xq.|a": S.ABBREVIATION}) == [text]


def test_every_character_is_covered():
    text = "A “b. c” d! (e.) f… «g»\n\nh. 3. i ? j 。k『l！』m"
    spans = S.split(text, {})
    assert re.sub(r"\s", "", "".join(text[a:b] for a, b in spans)) == re.sub(r"\s", "", text)
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_table(spark):
    df = spark.createDataFrame([(1, "One. Two.", "x"), (2, None, "x"), (3, " ", "x"), (1, "One. Two.", "y")], "page_id long, text string, n string")
    assert sorted(tuple(r) for r in S.sentences(df).collect()) == [(1, 0, 4), (1, 5, 9)]
    assert S.sentences(df.limit(0)).count() == 0


def test_very_long_text():
    assert len(S.split("The lamp burns. " * 5000, {})) == 5000


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "One. Two."), (2, "Three.")], "page_id long, text string")
    assert [tuple(r) for r in S.sentences(df).collect()] == [(2, 0, 6)]


def _cut(text, known=None):
    return [text[a:b] for a, b in S.split(text, known or {})]


def test_devanagari_with_full_stops_where_there_is_no_danda():
    assert _cut("हा एक खेळ आहे. तो लोकप्रिय आहे. त्याला अनेक पात्रे आहेत.") == ["हा एक खेळ आहे.", "तो लोकप्रिय आहे.", "त्याला अनेक पात्रे आहेत."]
    assert _cut("डॉ. शर्मा आए। वे खेले।") == ["डॉ. शर्मा आए।", "वे खेले।"]


def test_tibetan():
    assert _cut("བོད་ཡིག་ནི་སྐད་ཡིག་ཅིག་ཡིན། །དེ་ནི་རྙིང་པ་ཡིན།") == ["བོད་ཡིག་ནི་སྐད་ཡིག་ཅིག་ཡིན། །", "དེ་ནི་རྙིང་པ་ཡིན།"]


def test_posts_in_small_letters():
    assert _cut("i played it last night. the boss was hard, e.g. the second form. did you win? not yet") == ["i played it last night.", "the boss was hard, e.g. the second form.", "did you win?", "not yet"]
    assert _cut("The keep is old. it was rebuilt.") == ["The keep is old. it was rebuilt."]


def test_inches_are_no_quotation():
    assert _cut('The first screen has 5" of glass. It broke. The second has 7" of glass. It held.') == ['The first screen has 5" of glass.', "It broke.", 'The second has 7" of glass.', "It held."]
    assert _cut('She said "We left in 1990" and sat. Then she rose.') == ['She said "We left in 1990" and sat.', "Then she rose."]


def test_long_tokens_give_evidence():
    long = "Gesellschaftsvertr"
    text = f"Siehe {long}. nach dem Krieg. Auch {long}. vor dem Krieg. Der {long}. Müller kam."
    assert S.evidence(text)[S._key(long, "*", ".")][2] == 2
