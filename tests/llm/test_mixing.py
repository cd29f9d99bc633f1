import pytest

from textquarry.llm import mixing
from textquarry.llm.mixing import build_mix, short_sources

DOCS = "doc_id long, text string, source string, tokens string, key string, range string"
TARGETS = "source string, target_share double, max_repeats int"


def frames(spark, docs, targets):
    return spark.createDataFrame([(i, t, s, None, None, None) for i, t, s in docs], DOCS), spark.createDataFrame(targets, TARGETS)


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)  # several ranges per source
    docs = [(i, "one two three four five", "big") for i in range(300)] + [(1000 + i, "one two three four five", " Small ") for i in range(10)] + [(2000 + i, "one two three four five", "mid") for i in range(90)] + [(5000, None, "mid"), (5001, "x", None), (5002, "", "big")]
    frame = frames(spark, docs, [("big", 0.5, 2), ("small", 0.3, 3), ("mid", 0.2, 1), ("absent", 0.0, 1)])
    mix, report = build_mix(*frame)
    rows = {r["source"]: r for r in report.collect()}
    total = 400 * 5 + 1
    assert rows["big"]["tokens"] in range(int(0.5 * total), int(0.5 * total) + 6) and rows["small"]["tokens"] == 10 * 3 * 5 and rows["mid"]["tokens"] in range(int(0.2 * total), int(0.2 * total) + 6)
    assert [r["source"] for r in short_sources(*frame).collect()] == ["small"] and sum(r["actual_share"] for r in rows.values()) == pytest.approx(1)
    copies = {r["doc_id"]: r["n"] for r in mix.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert all(n <= 3 for n in copies.values()) and 5000 not in copies and len([d for d in copies if d < 1000]) < 300
    again = {(r["doc_id"], r["epoch"]) for r in build_mix(*frame)[0].collect()}
    assert again == {(r["doc_id"], r["epoch"]) for r in mix.collect()}


def test_whole_epochs_and_rest(spark):
    docs = [(i, "one two three four five", "a") for i in range(10)] + [(100 + i, "one two three four five", "b") for i in range(30)]
    mix, report = build_mix(*frames(spark, docs, [("a", 0.6, 9), ("b", 0.4, 1)]))
    per = mix.groupBy("doc_id").count().where("doc_id < 100").collect()
    assert {r["count"] for r in per} == {2, 3} and sum(r["count"] for r in per) == 24


def test_edge_cases(spark):
    mix, report = build_mix(*frames(spark, [], [("a", 1.0, 2)]))
    assert mix.count() == 0 and report.first()["tokens"] == 0
    mix, report = build_mix(*frames(spark, [(1, "word " * 400_000, "a"), (1, "x", "a")], [("a", 1.0, None), (None, 0.5, 1)]))
    assert report.count() == 1 and mix.count() == 2
    assert build_mix(*frames(spark, [(1, "x", "a")], []))[1].count() == 0
