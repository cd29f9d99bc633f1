"""Queries of the search: vectors, keywords, fusion, ranking, and the search log."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from textquarry.functions.arrays import as_text
from textquarry.functions.text import STOP_WORDS, preview
from textquarry.functions.vectors import unit
from textquarry.operators import keyword, ranking, search_log, vector
from textquarry.operators.embedding import HashingEmbedder, quarantine_blank
from textquarry.plans import pipeline
from textquarry.plans import sql as q
from textquarry.runtime import Folder, cut, ensure_checkpoint_dir, table
from textquarry.streaming.ingest import windowed_searches

QUERY, K, WEIGHT = "token scheduler cache token release", 10, 0.3
#: The model whose vectors answer the searches of chunks, and its length.
MODEL, DIMENSION = "all-MiniLM-L6-v2", 64


def _c(s, d):
    return table(s, d, "chunks")


def _e(s, d):
    return table(s, d, "embeddings")


def _hits(s, d, k=K):
    e = _e(s, d)
    return vector.vector_topk(e, vector.query_vector(e, 0), k)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _keywords(s, d):
    """The keyword index of the chunks below a folder, kept for the session as long as the files are the same."""
    stamp = hashlib.sha256(Folder(s, d).stamps("chunks.parquet").encode()).hexdigest()[:16]
    return keyword.KeywordIndex.of(_c(s, d), "chunk_text", "vec_id", f"{ensure_checkpoint_dir(s)}/keywords-{s.sparkContext.applicationId}-{stamp}")


def _own(s, d):
    """Vectors of the chunks of one model; some are there twice."""
    return table(s, d, "chunk_vectors").where((F.col("embedding_model") == MODEL) & (F.size("embedding") == DIMENSION))


def _own_query(s, d):
    return [float(x) for x in _own(s, d).agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"]]


def _own_hits(s, d, k=K):
    return vector.vector_topk(_own(s, d), _own_query(s, d), k, repeated=True)


def _hybrid(s, d):
    return keyword.hybrid_topk(cut(_own_hits(s, d, 2 * K)), keyword.keyword_scores(_keywords(s, d), QUERY), K, WEIGHT)


def _explained(s, d):
    """The flagship: a hybrid search of the chunks by one of their own vectors, explained."""
    return pipeline.search(_c(s, d), _own(s, d), _keywords(s, d), QUERY, _own_query(s, d), K, WEIGHT, repeated=True)


def _ranked(s, d):
    return _explained(s, d).select("rank", "vec_id", F.round("score", 6).alias("score"), "match_type", as_text(F.col("terms")).alias("matched_terms"), "reason", "preview")


def _match_types(s, d):
    """How many chunks the keywords, the vectors or both find, by the scores of a search for all chunks with either."""
    near = _own_hits(s, d, 1000).select("vec_id", F.col("score").alias("v"))
    scored = near.join(keyword.keyword_scores(_keywords(s, d), QUERY).select("vec_id", F.col("score").alias("k")), "vec_id", "full")
    return scored.groupBy(ranking.match_type(F.col("v"), F.col("k"), F.greatest("v", "k")).alias("match_type")).agg(F.count(F.lit(1)).alias("chunks"))


def _batch(s, d):
    v = table(s, d, "chunk_vectors").where("embedding is not null").dropDuplicates(["vec_id"]).withColumn("embedding", unit(F.col("embedding"))).withColumn("space", F.concat_ws("/", "embedding_model", F.size("embedding").cast("string")))
    v = cut(v)
    out = vector.vector_topk_batch(v, v.where("vec_id % 100 = 0"), 5, group="space")
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"))


def _confidence(s, d):
    e = _explained(s, d)
    return e.select("vec_id", *[F.col(c) for c in ("semantic_confidence", "keyword_confidence", "exact_match_confidence", "overall_confidence")])


def _bm25_raw(s, d):
    return keyword.bm25(_keywords(s, d), QUERY, normalize=False)


QUERIES = {
    "search_ranked": _ranked,
    "vector_topk": lambda s, d: _rounded(_hits(s, d), "score"),
    "vector_topk_batch": _batch,
    "vector_by_id": lambda s, d: _e(s, d).where("vec_id = 7").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("v").cast("double"), 6).alias("value")),
    "vector_lookup": lambda s, d: vector.lookup(_rounded(_own_hits(s, d), "score"), _c(s, d).select("vec_id", "chunk_id", "source_path")).select("vec_id", "score", "chunk_id", "source_path"),
    "vector_score_compat": lambda s, d: _rounded(vector.compat_scores(_hits(s, d, 2 * K)).orderBy(F.desc("score"), "vec_id").limit(K), "score"),
    "l2_normalize": lambda s, d: table(s, d, "chunk_vectors").where("embedding is not null").select("vec_id", unit(F.col("embedding")).alias("u")).groupBy("vec_id").agg(F.round(F.max(F.array_max("u")), 6).alias("largest"), F.count(F.lit(1)).alias("rows")),
    "hashing_embed": lambda s, d: _c(s, d).where("chunk_text is not null").select("vec_id", F.posexplode(HashingEmbedder(16, normalize=False).vector(F.col("chunk_text"))).alias("p", "v")).select("vec_id", F.col("p").cast("long").alias("slot"), "v").where("v != 0").withColumnRenamed("v", "value"),
    "blank_texts": lambda s, d: quarantine_blank(table(s, d, "documents"), "text")[1].select("doc_id"),
    "bm25_scores": _bm25_raw,
    "bm25_normalized": lambda s, d: keyword.bm25(_keywords(s, d), QUERY),
    "tfidf_scores": lambda s, d: keyword.tfidf(_keywords(s, d), QUERY),
    "keyword_scores": lambda s, d: keyword.keyword_scores(_keywords(s, d), QUERY),
    "keyword_index_stats": lambda s, d: keyword.index_stats(_keywords(s, d)),
    "hybrid_topk": lambda s, d: _rounded(_hybrid(s, d), "vector_score", "keyword_score", "score"),
    "rank_results": lambda s, d: _rounded(ranking.rank_results(_hits(s, d)), "score"),
    "ranking_info": lambda s, d: ranking.ranking_info(ranking.rank_results(_own_hits(s, d))).select("vec_id", "rank", "total_results", "top_percentile", "relative_score"),
    "match_type": _match_types,
    "matched_terms": lambda s, d: _c(s, d).select("vec_id", as_text(ranking.matched_terms(F.col("chunk_text"), QUERY)).alias("terms")).where("terms != ''"),
    "confidence": _confidence,
    "relevance_reason": lambda s, d: _explained(s, d).select("vec_id", "match_type", "reason"),
    "content_preview": lambda s, d: _c(s, d).where("chunk_text is not null").select("vec_id", preview(F.col("chunk_text")).alias("preview")),
    "structured_position": lambda s, d: _c(s, d).select("vec_id", *[c.cast("long").alias(n) for n, c in ranking.position(F.col("start_char"), F.col("end_char")).items()]),
    "query_analysis": lambda s, d: search_log.query_analysis(table(s, d, "search_log")),
    "search_log_stats": lambda s, d: search_log.search_log_stats(table(s, d, "search_log")),
    "slow_searches": lambda s, d: search_log.slow_searches(table(s, d, "search_log"), 100),
    "searches_by_hour": lambda s, d: windowed_searches(table(s, d, "search_log").dropDuplicates()),
}

_DOT = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * q.v[i]::DOUBLE))"
_HITS = f"hits AS (SELECT e.vec_id, {_DOT} AS score FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q WHERE len(e.embedding) = len(q.v) ORDER BY score DESC, e.vec_id LIMIT {{k}})"
_OWN = f"ov AS (SELECT vec_id, any_value(embedding) AS embedding FROM chunk_vectors WHERE embedding_model = '{MODEL}' AND len(embedding) = {DIMENSION} GROUP BY vec_id)"
_OWN_HITS = f"{_OWN}, hits AS (SELECT e.vec_id, {_DOT} AS score FROM ov e, (SELECT embedding AS v FROM ov ORDER BY vec_id LIMIT 1) q ORDER BY score DESC, e.vec_id LIMIT {{k}})"
_ASKED = "asked AS (SELECT term, count(*) AS times FROM (SELECT unnest(string_split('" + QUERY + "', ' ')) AS term) GROUP BY term)"
_BM25 = f"""w AS (SELECT vec_id, {q.words("lower(chunk_text)")} AS w FROM chunks WHERE chunk_text IS NOT NULL),
    st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
    tf AS (SELECT vec_id, dl, term, count(*) AS tf FROM (SELECT vec_id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    idfs AS (SELECT term, ln(n + 0.5 - df) - ln(df + 0.5) AS idf FROM dfs, st),
    wanted AS (SELECT term, times, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idfs) ELSE idf END AS idf FROM idfs JOIN asked USING (term)),
    bm AS (SELECT vec_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN wanted USING (term), st GROUP BY vec_id)"""
_STOP = q.listed(STOP_WORDS)
_GRAMS = f"list_filter(regexp_extract_all(lower({{c}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}'), lambda x: x NOT IN ({_STOP}))"


def _pairs(w: str) -> str:
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


def _grams(c: str) -> str:
    return _GRAMS.format(c=c)


_TFIDF = f"""g AS (SELECT vec_id, {_grams("chunk_text")} AS w FROM chunks WHERE chunk_text IS NOT NULL),
    gt AS (SELECT vec_id, term, count(*) AS tf FROM (SELECT vec_id, unnest({_pairs("w")}) AS term FROM g) GROUP BY ALL),
    voc AS (SELECT term, count(*) AS df, sum(tf) AS total FROM gt GROUP BY term HAVING count(*) <= 0.95 * (SELECT count(*) FROM g) ORDER BY total DESC, term LIMIT 10000),
    iv AS (SELECT term, ln((1.0 + (SELECT count(*) FROM g)) / (1 + df)) + 1 AS idf FROM voc),
    qg AS (SELECT {_grams("'" + QUERY + "'")} AS w),
    qt AS (SELECT term, count(*) * any_value(idf) AS v FROM (SELECT unnest({_pairs("w")}) AS term FROM qg) JOIN iv USING (term) GROUP BY term),
    tfs AS (SELECT vec_id, sum(tf * idf * coalesce(v, 0)) / sqrt(sum(tf * idf * tf * idf)) / (SELECT sqrt(sum(v * v)) FROM qt) AS score FROM gt JOIN iv USING (term) LEFT JOIN qt USING (term) GROUP BY vec_id)"""
_KEYWORD = f"""{_ASKED}, {_BM25}, {_TFIDF},
    bn AS (SELECT vec_id, round(score / (SELECT max(score) FROM bm), 12) AS score FROM bm WHERE score > 0),
    tn AS (SELECT vec_id, round(score, 12) AS score FROM tfs WHERE score > 0),
    kw AS (SELECT vec_id, round((coalesce(bn.score, 0) + coalesce(tn.score, 0)) / 2, 6) AS score FROM bn FULL JOIN tn USING (vec_id))"""
_HYBRID = f"""{_OWN_HITS.format(k=2 * K)}, {_KEYWORD},
    hy AS (SELECT h.vec_id, h.score AS vector_score, coalesce(k.score, 0) AS keyword_score, {1 - WEIGHT} * h.score + {WEIGHT} * coalesce(k.score, 0) AS score FROM hits h LEFT JOIN kw k USING (vec_id) ORDER BY score DESC, h.vec_id LIMIT {K})"""
_CLAMPED = "least(1.0, greatest(0.0, h.score))"
_EXPLAINED = _HYBRID.replace("h.score AS vector_score", f"{_CLAMPED} AS vector_score").replace("* h.score", f"* {_CLAMPED}")
_TERMS = f"list_filter(string_split('{QUERY}', ' '), lambda t: contains(lower(chunk_text), t))"
_CLAMP = "round(greatest(0.0, least(1.0, {x})), 3)"
_FIRST = "first AS (SELECT * FROM search_log WHERE query_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY logged_at NULLS LAST) = 1)"
_CLEAN = q.strip("coalesce(query_text, '')")
_REASON = "CASE WHEN n > 0 THEN 'Combined keyword and semantic matching. Matches ' || n || ' terms' ELSE 'Combined keyword and semantic matching' END AS reason"
_P = f"replace(replace({q.strip('chunk_text')}, repeat(chr(10), 3), repeat(chr(10), 2)), chr(9), ' ')"


def _preview(source: str) -> str:
    return f"""p AS (SELECT vec_id, chunk_text AS whole, {_P} AS c FROM {source}), h AS (SELECT *, substr(c, 1, 400) AS h, reverse(substr(c, 1, 400)) AS r FROM p),
        b AS (SELECT *, greatest(CASE WHEN contains(h, '.') THEN 400 - strpos(r, '.') ELSE -1 END, CASE WHEN contains(h, '!') THEN 400 - strpos(r, '!') ELSE -1 END, CASE WHEN contains(h, '?') THEN 400 - strpos(r, '?') ELSE -1 END) AS s, CASE WHEN contains(h, ' ') THEN 400 - strpos(r, ' ') ELSE -1 END AS b FROM h)"""


_SHOWN = "CASE WHEN whole = '' THEN '[No content available]' WHEN length(c) <= 400 THEN c WHEN s > 280 THEN substr(h, 1, s + 1) || '...' WHEN b > 320 THEN substr(h, 1, b) || '...' ELSE h || '...' END AS preview"

SQL = {
    "vector_topk": f"WITH {_HITS.format(k=K)} SELECT vec_id, round(score, 6) AS score FROM hits",
    "vector_topk_batch": """WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, embedding_model AS m, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM chunk_vectors WHERE embedding IS NOT NULL),
        p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i]::DOUBLE * b.e[i]::DOUBLE)) / (CASE WHEN a.n = 0 THEN 1 ELSE a.n END) / (CASE WHEN b.n = 0 THEN 1 ELSE b.n END) AS s FROM v a JOIN v b ON a.m = b.m AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        SELECT query_id, vec_id, round(s, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) <= 5""",
    "vector_by_id": "SELECT vec_id, unnest(range(0, len(embedding))) AS pos, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings WHERE vec_id = 7",
    "vector_lookup": f"WITH {_OWN_HITS.format(k=K)} SELECT c.vec_id, round(score, 6) AS score, chunk_id, source_path FROM hits JOIN chunks c USING (vec_id)",
    "vector_score_compat": f"WITH {_HITS.format(k=2 * K)} SELECT vec_id, round(greatest(0.0, 1.0 - score), 6) AS score FROM hits ORDER BY greatest(0.0, 1.0 - hits.score) DESC, vec_id LIMIT {K}",
    "l2_normalize": """WITH n AS (SELECT vec_id, list_max(embedding)::DOUBLE AS m, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM chunk_vectors WHERE embedding IS NOT NULL)
        SELECT vec_id, round(max(m / CASE WHEN n = 0 THEN 1 ELSE n END), 6) AS largest, count(*) AS rows FROM n GROUP BY vec_id""",
    "hashing_embed": f"""WITH w AS (SELECT vec_id, unnest({q.words("lower(chunk_text)")}) AS word FROM chunks WHERE chunk_text IS NOT NULL), h AS (SELECT vec_id, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM w)
        SELECT vec_id, h % 16 AS slot, sum(CASE WHEN (h // 16) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS value FROM h GROUP BY 1, 2 HAVING value <> 0""",
    "blank_texts": f"SELECT doc_id FROM documents WHERE text IS NULL OR {q.strip('text')} = ''",
    "bm25_scores": f"WITH {_ASKED}, {_BM25} SELECT vec_id, round(score, 6) AS score FROM bm WHERE score > 0",
    "bm25_normalized": f"WITH {_ASKED}, {_BM25} SELECT vec_id, round(score / (SELECT max(score) FROM bm), 6) AS score FROM bm WHERE bm.score > 0",
    "tfidf_scores": f"WITH {_TFIDF} SELECT vec_id, round(score, 6) AS score FROM tfs WHERE tfs.score > 0",
    "keyword_scores": f"WITH {_KEYWORD} SELECT vec_id, score FROM kw",
    "keyword_index_stats": f"WITH {_ASKED}, {_BM25} SELECT (SELECT n FROM st) AS documents, count(*) AS vocabulary, sum(df)::BIGINT AS postings, (SELECT round(avgdl, 6) FROM st) AS average_length FROM dfs",
    "hybrid_topk": f"WITH {_HYBRID} SELECT vec_id, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score, round(score, 6) AS score FROM hy",
    "rank_results": f"WITH {_HITS.format(k=K)} SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY hits.score DESC, vec_id) AS rank FROM hits",
    "ranking_info": f"""WITH {_OWN_HITS.format(k=K)}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank, count(*) OVER () AS n, max(score) OVER () AS best FROM hits)
        SELECT vec_id, rank, n AS total_results, round((n - rank + 1) / n * 100, 1) AS top_percentile, CASE WHEN best > 0 THEN round(score / best, 3) END AS relative_score FROM r""",
    "match_type": f"""WITH {_OWN_HITS.format(k=1000)}, {_KEYWORD} SELECT CASE WHEN h.score IS NOT NULL AND k.score IS NOT NULL THEN 'hybrid' WHEN h.score IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS match_type, count(*) AS chunks FROM hits h FULL JOIN kw k USING (vec_id) GROUP BY 1""",
    "matched_terms": f"SELECT vec_id, {q.as_text(_TERMS)} AS terms FROM chunks WHERE chunk_text IS NOT NULL AND len({_TERMS}) > 0",
    "confidence": f"""WITH {_EXPLAINED} SELECT vec_id, {_CLAMP.format(x="vector_score")} AS semantic_confidence, {_CLAMP.format(x="keyword_score")} AS keyword_confidence, CASE WHEN score >= 0.95 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match_confidence, {_CLAMP.format(x="hy.score")} AS overall_confidence FROM hy JOIN (SELECT vec_id FROM chunks) USING (vec_id)""",
    "relevance_reason": f"""WITH {_EXPLAINED}, t AS (SELECT vec_id, len({_TERMS}) AS n FROM hy JOIN chunks USING (vec_id)) SELECT vec_id, 'hybrid' AS match_type, {_REASON} FROM t""",
    "content_preview": f"WITH {_preview('chunks WHERE chunk_text IS NOT NULL')} SELECT vec_id, {_SHOWN} FROM b",
    "search_ranked": f"""WITH {_EXPLAINED}, {_preview('hy JOIN chunks USING (vec_id)')}, t AS (SELECT vec_id, hy.score, chunk_text, {_TERMS} AS terms, len({_TERMS}) AS n FROM hy JOIN chunks USING (vec_id))
        SELECT row_number() OVER (ORDER BY t.score DESC, vec_id) AS rank, vec_id, round(t.score, 6) AS score, 'hybrid' AS match_type, {q.as_text("terms")} AS matched_terms, {_REASON}, {_SHOWN} FROM t JOIN b USING (vec_id)""",
    "structured_position": "SELECT vec_id, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char, (end_char - start_char)::BIGINT AS char_length FROM chunks",
    "query_analysis": f"WITH {_FIRST} SELECT query_id, lower({_CLEAN}) AS normalized_query, length(coalesce(query_text, '')) AS char_count, len({q.words(_CLEAN)}) AS word_count, {_CLEAN} = '' AS blank, (CASE WHEN top_k IS NULL OR top_k < 1 THEN 5 ELSE least(top_k, 50) END)::BIGINT AS used_k FROM first",
    "search_log_stats": f"""WITH {_FIRST}, g AS (SELECT coalesce(search_mode, 'unknown') AS search_mode, count(*) AS searches, count(*) FILTER (error_code IS NOT NULL) AS errors, round(avg(elapsed_ms) FILTER (error_code IS NULL), 4) AS mean_ms, max(elapsed_ms) FILTER (error_code IS NULL) AS longest_ms FROM first GROUP BY 1)
        SELECT *, round(errors / searches, 6) AS error_rate, round(1 - errors / searches, 3) AS success_rate FROM g""",
    "slow_searches": f"WITH {_FIRST} SELECT query_id, coalesce(search_mode, 'unknown') AS search_mode, elapsed_ms, CASE WHEN length(query_text) > 50 THEN substr(query_text, 1, 50) || '...' ELSE query_text END AS shown_query FROM first WHERE error_code IS NULL AND elapsed_ms > 100",
    "searches_by_hour": "WITH o AS (SELECT DISTINCT ON (query_id) * FROM search_log WHERE ts_query IS NOT NULL) SELECT date_trunc('hour', ts_query) AS window_start, coalesce(search_mode, 'unknown') AS search_mode, count(*) AS searches, count(*) FILTER (error_code IS NOT NULL) AS errors FROM o GROUP BY 1, 2",
}
