"""Search by trigrams against looking at every label."""

import random

from latticework.operators import label_index as LI
from latticework.operators import tables as TB

NODE = "id string, label string, type string"


def test_equal_to_looking_at_every_label(spark, tmp_path):
    rng = random.Random(2)
    labels = ["".join(rng.choice("abAB é") for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    rows = [(f"n{i}", x, rng.choice(["note", "tag"])) for i, x in enumerate(labels)] + [("twice", "Abba", "note"), ("twice", "Abba", "note"), ("null", None, "note"), ("empty", "", "tag")]
    texts = ["a", "ab", "aba", "ABBA", " bab ", "é", "éa", "zzz", "z", "", "a b", "abbaabba", "b"]
    nodes = spark.createDataFrame(rows, NODE)
    index = LI.built(nodes.filter("id < 'n5'"), str(tmp_path / "labels"), 8).insert(nodes.filter("id >= 'n5'"))
    asked = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], "qid string, text string")
    for hidden in ((), ("tag",)):
        got = {}
        for r in LI.search(index, asked, hidden, None).collect():
            got.setdefault(r.qid, []).append((r.id, r.label, r.type))
        for i, t in enumerate(texts):
            want = [r for r in rows if r[1] is not None and t.strip().lower() in r[1].lower() and r[2] not in hidden]
            assert sorted(got.get(str(i), [])) == sorted(want), t
        assert "null" not in got
    first = [tuple(r)[1:4] for r in LI.search(index, asked.filter("qid = '1'"), limit=5).orderBy("place").collect()]
    assert first == [tuple(r) for r in TB.label_search(nodes, "ab", limit=5).select("id", "label", "type").collect()]


def test_few_rows_are_read(spark, tmp_path):
    nodes = spark.range(3000).selectExpr("concat('n', id) as id", "concat('label number ', id, case when id = 77 then ' quux' else '' end) as label", "'note' as type")
    index = LI.built(nodes, str(tmp_path / "labels"))
    asked = spark.createDataFrame([("q", "number 77 quux")], "qid string, text string")
    assert [r.id for r in LI.search(index, asked).collect()] == ["n77"]
    read, of = LI.rows_read(index, asked)
    assert read == 1 and of > 30_000


def test_empty(spark, tmp_path):
    index = LI.built(spark.createDataFrame([], NODE), str(tmp_path / "labels"))
    assert LI.search(index, spark.createDataFrame([("q", "abc"), ("r", "")], "qid string, text string")).count() == 0


def test_a_text_that_many_ask_for_is_looked_up_once(spark, tmp_path, monkeypatch):
    nodes = spark.range(50).selectExpr("concat('n', id) as id", "concat('label ', id) as label", "'note' as type")
    index, asked, grams = LI.built(nodes, str(tmp_path / "labels"), 4), [], LI.grams
    monkeypatch.setattr(LI, "grams", lambda index, texts: (asked.append(texts.count()), grams(index, texts))[1])
    texts = spark.range(200).selectExpr("concat('q', id) as qid", "if(id % 2 = 0, ' Label 7', 'bel 4') as text")
    found = LI.search(index, texts, limit=3).collect()
    assert asked == [2] and len(found) == 100 * 1 + 100 * 3
    assert {(r.id, r.place) for r in found if r.qid == "q1"} == {("n4", 1), ("n40", 2), ("n41", 3)}
