"""Keyword search over a kept index: BM25 and TF-IDF scores of a query, and their mean.

The index is built once per collection. Each text is read into its words and features in one pass without a shuffle; what
is shuffled are the postings, into buckets by a hash of the term and, since a term may be in most texts, by a hash of the
key too. A query reads the postings of its own terms only; the statistics (lengths, document frequencies) cover all
documents. Null texts aren't documents; blank ones count as documents without terms; rows of a repeated key are documents
whose scores add up. Scores are rounded to 6 decimals at the end.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import BLANKS, STOP_WORDS
from textquarry.runtime import Folder, dealt, ensure_checkpoint_dir

K1, B, EPSILON = 1.5, 0.75, 0.25
MAX_FEATURES, MAX_DF = 10_000, 0.95
#: Postings of a bucket, most buckets, and texts whose postings of one term share a file.
BUCKET_POSTINGS, BUCKETS, FILE_TEXTS = 250_000, 4096, 2_000_000

_BLANK = re.compile(f"[{BLANKS}]+")
_CONTENT = re.compile(r"\w{2,}")


def words_of(text: str) -> list[str]:
    """Words of a lower-case text between white space."""
    return [w for w in _BLANK.split(text) if w]


def features_of(text: str, stop_words: frozenset[str]) -> list[str]:
    """Words of two or more letters or digits of a lower-case text without stop words, and their pairs."""
    content = [w for w in _CONTENT.findall(text) if w not in stop_words]
    return content + [f"{a} {b}" for a, b in zip(content, content[1:])]


def _forward(docs: DataFrame, text: str, key: str, stop_words: frozenset[str]) -> DataFrame:
    """``key, dl, words, word_tf, grams, gram_tf``: what each text has, one row per text."""
    kind = docs.schema[key].dataType.simpleString()
    columns = ["key", "dl", "words", "word_tf", "grams", "gram_tf"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"]):
                words, grams = words_of(t), Counter(features_of(t, stop_words))
                counted = Counter(words)
                rows.append((k, len(words), list(counted), list(counted.values()), list(grams), list(grams.values())))
            yield pd.DataFrame(rows, columns=columns)

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("text"))
    return dealt(rows).mapInPandas(read, f"key {kind}, dl long, words array<string>, word_tf array<long>, grams array<string>, gram_tf array<long>")


def _term_counts(rows: DataFrame, terms: str, times: str) -> DataFrame:
    """``term, df, total``."""
    each = rows.select(F.explode(F.arrays_zip(F.col(terms).alias("term"), F.col(times).alias("tf"))).alias("p"))
    return each.groupBy("p.term").agg(F.count(F.lit(1)).alias("df"), F.sum("p.tf").alias("total"))


class KeywordIndex:
    """Stored tables below a folder: ``texts`` (what each has), ``words`` and ``grams`` (postings by bucket), ``terms`` (document frequencies), ``stats``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        row = spark.read.parquet(f"{path}/stats").first()
        self.key, self.documents, self.average, self.mean_idf, self.buckets, self.postings, self.vocabulary = (row[c] for c in ("key_name", "documents", "average_length", "mean_idf", "buckets", "postings", "vocabulary"))
        self.stop_words = frozenset(row["stop_words"])

    @staticmethod
    def is_built(spark: SparkSession, path: str) -> bool:
        return Folder(spark, path).exists("stats/_SUCCESS")

    @classmethod
    def of(cls, docs: DataFrame, text: str, key: str, path: str | None = None, max_features: int = MAX_FEATURES, max_df: float = MAX_DF, stop_words: list[str] | None = None) -> KeywordIndex:
        """The index kept below ``path``, built there if it isn't yet; without a path, a new one in the shared folder of the session."""
        spark = docs.sparkSession
        if path is None:
            path = f"{ensure_checkpoint_dir(spark)}/keywords-{spark._jvm.java.util.UUID.randomUUID()}"
        if cls.is_built(spark, path):
            return cls(spark, path)
        stops = frozenset(STOP_WORDS if stop_words is None else stop_words)
        _forward(docs, text, key, stops).write.mode("overwrite").parquet(f"{path}/texts")
        rows = spark.read.parquet(f"{path}/texts")
        sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), F.sum(F.size("words")).alias("postings")).first()
        n, postings = sizes["n"], sizes["postings"] or 0
        buckets = min(BUCKETS, max(1, -(-postings // BUCKET_POSTINGS)))
        spread = max(1, -(-n // FILE_TEXTS), postings // (8 * BUCKET_POSTINGS * buckets))
        bucket = F.pmod(F.crc32("term"), F.lit(buckets)).cast("int")

        def store(posted: DataFrame, name: str) -> None:
            salted = posted.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(spread)))
            salted.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")

        store(rows.select("key", "dl", F.explode(F.arrays_zip(F.col("words").alias("term"), F.col("word_tf").alias("tf"))).alias("p")).select("key", "dl", "p.term", "p.tf"), "words")
        terms = _term_counts(rows, "words", "word_tf").select("term", "df", (F.log(F.lit(n + 0.5) - F.col("df")) - F.log(F.col("df") + 0.5)).alias("idf"))
        terms.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        summed = spark.read.schema("term string, df long, idf double, bucket int").parquet(f"{path}/terms").agg(F.count(F.lit(1)).alias("vocabulary"), F.avg("idf").alias("mean")).first()
        # The vocabulary of the features is bounded by max_features, ties in order of the feature.
        chosen = _term_counts(rows, "grams", "gram_tf").where(F.col("df") <= max_df * n).orderBy(F.desc("total"), "term").limit(max_features)
        idf = {r["term"]: math.log((1.0 + n) / (1 + r["df"])) + 1 for r in chosen.collect()}
        shared = spark.sparkContext.broadcast((pa.array(list(idf), pa.string()), np.array(list(idf.values()))))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, values = shared.value
            for batch in batches:
                grams, times = batch["grams"], batch["gram_tf"]
                at = pc.index_in(grams.flatten(), terms)
                known = pc.is_valid(at)
                row = pc.list_parent_indices(grams).filter(known).to_numpy()
                at = at.filter(known)
                weight = times.flatten().filter(known).to_numpy() * values[at.to_numpy()]
                length = np.sqrt(np.bincount(row, weight * weight, minlength=batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(row)), terms.take(at), pa.array(weight / length[row]), pa.array(values[at.to_numpy()])], ["key", "term", "weight", "idf"])

        kind = rows.schema["key"].dataType.simpleString()
        store(rows.select("key", "grams", "gram_tf").mapInArrow(weigh, f"key {kind}, term string, weight double, idf double"), "grams")
        stats = (key, n, float(sizes["avg"] or 0.0), summed["mean"], buckets, postings, summed["vocabulary"], sorted(stops))
        spark.createDataFrame([stats], "key_name string, documents long, average_length double, mean_idf double, buckets long, postings long, vocabulary long, stop_words array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return cls(spark, path)

    def rows_of(self, name: str, terms: list[str]) -> DataFrame:
        """The rows of some terms of a table; other buckets aren't read."""
        kind = "key " + self._key_kind() + ", " if name != "terms" else ""
        schema = {"words": f"{kind}dl long, term string, tf long, bucket int", "grams": f"{kind}term string, weight double, idf double, bucket int", "terms": "term string, df long, idf double, bucket int"}[name]
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def _key_kind(self) -> str:
        if not hasattr(self, "_kind"):
            self._kind = self.spark.read.parquet(f"{self.path}/words").schema["key"].dataType.simpleString() if self.postings else "long"
        return self._kind

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], f"`{self.key}` {self._key_kind()}, score double")


def query_terms(query: str) -> Counter[str]:
    """Lower-case words of the query with their number."""
    return Counter(query.lower().split())


def bm25(index: KeywordIndex, query: str, normalize: bool = True, digits: int = 6) -> DataFrame:
    """``key, score``: Okapi BM25 with repeated query terms counted each time; divided by the best if normalised.

    Negative inverse document frequencies are replaced by a quarter of the mean over the whole vocabulary.
    """
    asked = query_terms(query)
    known = {r["term"]: r["idf"] for r in index.rows_of("terms", list(asked)).collect()} if asked and index.postings else {}  # one row per term of the query
    if not known:
        return index._nothing()
    per_term = {t: asked[t] * (idf if idf >= 0 else EPSILON * index.mean_idf) * (K1 + 1) for t, idf in known.items()}
    weight = F.create_map(*[F.lit(x) for pair in sorted(per_term.items()) for x in pair])[F.col("term")]
    value = weight * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / index.average))
    scored = index.rows_of("words", sorted(per_term)).groupBy(F.col("key").alias(index.key)).agg(F.sum(value).alias("score"))
    if normalize:
        best = scored.agg(F.max("score")).first()[0]
        if best and best > 0:
            scored = scored.withColumn("score", F.col("score") / best)
    return scored.where(F.col("score") > 0).select(index.key, F.round("score", digits).alias("score"))


def tfidf(index: KeywordIndex, query: str, digits: int = 6) -> DataFrame:
    """``key, score``: cosine of the documents' and the query's TF-IDF vectors over the most frequent features."""
    asked = Counter(features_of(query.lower(), index.stop_words))
    posted = index.rows_of("grams", sorted(asked)) if asked and index.postings else None
    known = {r["term"]: asked[r["term"]] * r["idf"] for r in posted.groupBy("term").agg(F.first("idf").alias("idf")).collect()} if posted is not None else {}  # one row per term of the query
    if not known:
        return index._nothing()
    length = math.sqrt(sum(v * v for v in known.values()))
    weight = F.create_map(*[F.lit(x) for t, v in sorted(known.items()) for x in (t, v / length)])[F.col("term")]
    scored = posted.groupBy(F.col("key").alias(index.key)).agg(F.sum(weight * F.col("weight")).alias("score"))
    return scored.where(F.col("score") > 0).select(index.key, F.round("score", digits).alias("score"))


def keyword_scores(index: KeywordIndex, query: str) -> DataFrame:
    """``key, score``: the mean of both scores, a missing one counting as 0."""
    half = [scores(index, query, digits=12).select(index.key, (F.col("score") / 2).alias("score")) for scores in (tfidf, bm25)]
    return half[0].unionByName(half[1]).groupBy(index.key).agg(F.round(F.sum("score"), 6).alias("score"))


def index_stats(index: KeywordIndex) -> DataFrame:
    """``documents, vocabulary, postings, average_length`` in one row."""
    return index.spark.read.parquet(f"{index.path}/stats").select("documents", "vocabulary", "postings", F.round("average_length", 6).alias("average_length"))


def hybrid_topk(hits: DataFrame, keyword: DataFrame, k: int, weight: float = 0.3, key: str = "vec_id") -> DataFrame:
    """``key, vector_score, keyword_score, score``: the k best of the vector hits by the weighted sum of both scores.

    A chunk that only the keywords find can't come in: that is the documented behaviour.
    """
    # The hits are few (twice k), so they are what is broadcast.
    found = keyword.select(key, F.col("score").alias("keyword_score")).join(F.broadcast(hits.select(key)), key, "left_semi")
    both = hits.withColumnRenamed("score", "vector_score").join(found, key, "left")
    scored = both.withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0))).withColumn("score", F.lit(1 - weight) * F.col("vector_score") + F.lit(weight) * F.col("keyword_score"))
    return scored.orderBy(F.desc("score"), key).limit(k).select(key, "vector_score", "keyword_score", "score")
