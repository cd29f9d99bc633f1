import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textquarry.functions.vectors import unit
from textquarry.operators import keyword, ranking, search_log, vector
from textquarry.operators.embedding import HashingEmbedder, available_providers, create_embedder, model_info, quarantine_blank, register_provider


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, "Python programming language python"), (1, "JavaScript web development"), (2, "the web of python and the web"), (3, ""), (4, None), (5, "other words entirely here")]
    return spark.createDataFrame(rows, "vec_id long, chunk_text string")


def model_bm25(rows, query):
    docs = {i: t.lower().split() for i, t in rows if t is not None}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for ws in docs.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return {i: s for i, ws in docs.items() if (s := sum(idf.get(q, 0) * ws.count(q) * 2.5 / (ws.count(q) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for q in query.lower().split())) > 0}


@pytest.mark.parametrize("query", ["python", "Web web python", "nothing"])
def test_bm25(docs, query):
    index = keyword.KeywordIndex.of(docs, "chunk_text", "vec_id")
    got = {r["vec_id"]: r["score"] for r in keyword.bm25(index, query, normalize=False).collect()}
    assert got == pytest.approx(model_bm25([tuple(r) for r in docs.collect()], query), abs=1e-6)
    best = [r["score"] for r in keyword.bm25(index, query).collect()]
    assert not best or max(best) == 1.0


def test_tfidf_and_mean(spark, docs):
    index, empty = (keyword.KeywordIndex.of(d, "chunk_text", "vec_id") for d in (docs, docs.limit(0)))
    got = {r["vec_id"]: r["score"] for r in keyword.tfidf(index, "python programming").collect()}
    assert set(got) == {0, 2} and 0 < got[2] < got[0] <= 1
    assert keyword.tfidf(index, "the of").count() == 0 and keyword.tfidf(empty, "python").count() == 0
    assert keyword.bm25(empty, "python").count() == 0 and keyword.keyword_scores(index, "").count() == 0 and keyword.keyword_scores(empty, "python").columns == ["vec_id", "score"]
    stats = keyword.index_stats(index).first()
    assert stats["documents"] == 5 and stats["vocabulary"] == 13 and keyword.index_stats(empty).first()["documents"] == 0


def test_a_kept_index_is_read_by_the_terms_of_the_query(spark, folder, monkeypatch):
    monkeypatch.setattr(keyword, "BUCKET_POSTINGS", 50)
    monkeypatch.setattr(keyword, "FILE_TEXTS", 40)
    rows = [(f"k{i}", f"common w{i % 37} v{i % 11} Python") for i in range(200)] + [("k0", "common again"), (None, "w1"), ("e", None)]
    frame = spark.createDataFrame(rows, "name string, text string")
    index = keyword.KeywordIndex.of(frame, "text", "name", f"{folder}/kw")
    assert index.buckets > 1 and index.key == "name"
    scores = {r["name"]: r["score"] for r in keyword.bm25(index, "w3 nothing", normalize=False).collect()}
    assert set(scores) == {f"k{i}" for i in range(200) if i % 37 == 3}
    again = keyword.KeywordIndex.of(frame.limit(0), "text", "name", f"{folder}/kw")  # kept: nothing is read again
    plan = keyword.keyword_scores(again, "w3 python")._jdf.queryExecution().executedPlan().toString()
    assert "chunk_text" not in plan and "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    assert len(index.rows_of("words", ["common"]).inputFiles()) > 1  # a term of most texts is spread over files


def test_hybrid(spark):
    hits = spark.createDataFrame([(1, 0.1), (0, 0.9)], "vec_id long, score double")
    kw = spark.createDataFrame([(1, 0.5), (0, 0.5), (7, 1.0)], "vec_id long, score double")
    rows = keyword.hybrid_topk(hits, kw, 5).collect()
    assert [r["vec_id"] for r in rows] == [0, 1] and rows[0]["score"] == pytest.approx(0.78)
    assert [r["score"] for r in keyword.hybrid_topk(hits, kw, 5, 0.0).collect()] == [0.9, 0.1]


def test_vectors(spark):
    v = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [list(r["u"]) for r in v.where("vec_id < 2").orderBy("vec_id").select(unit(F.col("embedding")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [(r["vec_id"], r["score"]) for r in vector.vector_topk(v, [1.0, 0.0], 3).collect()] == [(0, 3.0), (2, 1.0), (5, 1.0)]
    assert "TakeOrderedAndProject" in vector.vector_topk(v, [1.0, 0.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert [r["vec_id"] for r in vector.vector_topk(v.union(v), [1.0, 0.0], 3, repeated=True).collect()] == [0, 2, 5]
    out = vector.vector_topk_batch(v, v.where("vec_id = 2"), 2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(0, 3.0), (5, 1.0)]
    assert [r["score"] for r in vector.compat_scores(vector.vector_topk(v, [1.0, 0.0], 1)).collect()] == [0.0]
    assert vector.index_info(v, 2).first()["memory_bytes"] == 5 * 2 * 4 + (1 << 20) and vector.index_info(v.limit(0), 2).first()["memory_bytes"] == 0
    assert vector.vector_topk_batch(v.limit(0), v.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        vector.query_vector(v, 99)


def test_ranking(spark):
    hits = spark.createDataFrame([(i, 1.0 - i / 10) for i in range(4)], "vec_id long, score double")
    rows = ranking.ranking_info(ranking.rank_results(hits)).orderBy("rank").collect()
    assert [r["top_percentile"] for r in rows] == [100.0, 75.0, 50.0, 25.0] and rows[0]["relative_score"] == 1.0
    one = spark.createDataFrame([(0.8, None, 0.8, "Winter")], "v double, k double, s double, t string")
    c = one.select(*[x.alias(n) for n, x in ranking.confidence(F.col("v"), F.col("k"), F.col("s")).items()]).first()
    assert tuple(c) == (0.8, 0.4, 0.0, 0.8)
    assert one.select(ranking.matched_terms(F.col("t"), "in in").alias("m")).first()["m"] == ["in", "in"]
    kind = ranking.match_type(F.col("v"), F.col("k"), F.col("s"))
    assert one.select(kind.alias("m"), ranking.relevance_reason(kind, ranking.matched_terms(F.col("t"), "in")).alias("r")).first() == ("semantic", "Semantically similar to query")


def test_positions_and_routing(spark):
    one = spark.createDataFrame([(2, 9, 4, 3), (None, 5, None, 7)], "a int, b int, f int, l int")
    rows = one.select(*[c.alias(n) for n, c in ranking.position(*map(F.col, "abfl")).items()]).collect()
    assert [(r["char_length"], r["line_count"]) for r in rows] == [(7, 1), (None, None)]
    routed = one.select(ranking.routed_metadata({"word_count": F.col("a"), "file_size": F.col("b"), "model_name": F.lit("m"), "other": F.lit(1)}).alias("m")).first()["m"]
    assert routed["content"]["word_count"] == 2 and routed["source"]["file_size"] == 9 and routed["processing"]["model_name"] == "m" and routed["other"] == 1


def test_embedding(spark):
    d = spark.createDataFrame([(1, "one two"), (2, ""), (3, None), (4, " \t")], "id long, text string")
    good, blank = quarantine_blank(d, "text")
    assert good.count() == 1 and blank.count() == 3
    e = HashingEmbedder(8).embed(d.where("id < 3"), "text").orderBy("id").collect()
    assert sum(x * x for x in e[0]["embedding"]) == pytest.approx(1) and set(e[1]["embedding"]) == {0.0}
    vectors = spark.createDataFrame([(1, [1.0]), (1, [1.0])], "id long, embedding array<float>")
    assert create_embedder("precomputed", vectors=vectors, key="id", model="m", dimension=1).embed(d, "text").where("embedding is not null").count() == 1
    assert model_info(HashingEmbedder(8)) == {"provider": "hashing", "model": "hashing-8", "dimension": 8, "available": True}
    assert not create_embedder("precomputed", vectors=vectors.limit(0), key="id", model="m", dimension=1).is_available()
    register_provider("own", lambda: HashingEmbedder(4))
    assert create_embedder("own").dimension == 4 and "own" in available_providers()
    with pytest.raises(ValueError):
        create_embedder("missing")


def test_search_log(spark):
    rows = [(1, "q", None, 5, 10.0, None, "2024-01-02 00:00:00"), (1, "q", None, 5, 99.0, None, "2024-01-03 00:00:00"), (2, " Two Words ", "hybrid", 0, 2000.0, None, "2024-01-01 00:00:00"), (3, None, "hybrid", 900, None, "E", None)]
    log = spark.createDataFrame(rows, "query_id long, query_text string, search_mode string, top_k int, elapsed_ms double, error_code string, logged_at string")
    stats = {r["search_mode"]: r for r in search_log.search_log_stats(log).collect()}
    assert stats["unknown"]["mean_ms"] == 10.0 and stats["hybrid"]["errors"] == 1 and stats["hybrid"]["error_rate"] == 0.5
    assert [r["query_id"] for r in search_log.slow_searches(log).collect()] == [2]
    a = {r["query_id"]: r for r in search_log.query_analysis(log).collect()}
    assert a[2]["normalized_query"] == "two words" and a[2]["used_k"] == 5 and a[3]["blank"] and a[3]["used_k"] == 50
    assert search_log.search_log_stats(log.limit(0)).count() == 0
