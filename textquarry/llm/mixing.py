"""A mix of several sources with target shares of its tokens, small sources repeated a capped number of times.

Every document gets a random key from a hash of its id. Within a source the keys are cut into ranges (as many as the
source needs), tokens are summed per range, the sums are accumulated over the ranges and then, within each range, over
the sorted documents. That prefix sum decides where the source's budget ends, exactly to the document. A source of any
size is split over many ranges, so none is one task; all steps but the token count are built-in functions.

Sources are compared trimmed and in lower case; null sources and those without a target are left out of the mix but
count in the total. Null texts have no tokens and aren't drawn. A source without documents stays empty; repeated rows
of a document are separate rows. Ties of the key go to the smaller id. Null or non-positive caps count as one.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.runtime import cut, small_or_plain

#: A vocabulary of ranks of a public tokenizer; it must be at the same place on every machine.
TOKENIZER = os.environ.get("TEXTQUARRY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how that vocabulary splits text before merging bytes.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a range of keys.
RANGE_ROWS = 20_000

_encodings: dict[str, object] = {}


def _encoding(path: str):
    """The tokenizer, loaded once per worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(column: str, path: str = TOKENIZER) -> F.Column:
    """Tokens of a text column; null for null. Very long texts are encoded in parts cut at blanks."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)

        def size(text: str | None) -> int | None:
            if text is None:
                return None
            total, start = 0, 0
            while len(text) - start > 1_000_000:
                stop = text.rfind(" ", start + 500_000, start + 1_000_000)
                stop = stop if stop > 0 else start + 1_000_000
                total += len(encoding.encode_ordinary(text[start:stop]))
                start = stop
            return total + len(encoding.encode_ordinary(text[start:]))

        for texts in batches:
            yield pd.Series([size(t) for t in texts], dtype="Int64")

    return tokens(column)


def clean_source(column: str) -> F.Column:
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def token_sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens`` of every document."""
    return documents.select("doc_id", clean_source("source").alias("source"), F.coalesce(count_tokens("text", path), F.lit(0)).alias("tokens"))


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: ``source, target_share, max_repeats, budget, available, rows, epochs, rest``."""
    by_source = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("rows"))
    total = by_source.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total")).first()["total"]
    wanted = targets.where(F.col("source").isNotNull()).select(clean_source("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"))
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = wanted.join(by_source.where(F.col("source").isNotNull()), "source", "left").withColumns({"available": F.coalesce("available", F.lit(0)), "rows": F.coalesce("rows", F.lit(0)), "budget": F.col("target_share") * F.lit(int(total))})
    epochs = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats").cast("long"))).otherwise(0)
    out = out.withColumn("epochs", epochs)
    return out.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0.0))


def draw_mix(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``doc_id, source, tokens, epoch``: one row per copy of a document in the mix; ``epoch`` counts from 1."""
    # 31 random bits, so that ranges of keys are exact integers.
    key = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id"), 33)
    ranges = F.greatest(F.ceil(F.col("rows") / RANGE_ROWS), F.lit(1))
    keyed = sizes.where(F.col("tokens") > 0).join(small_or_plain(plan.select("source", "rows", "epochs", "rest")), "source").withColumn("key", key)
    keyed = keyed.withColumn("range", F.floor(F.col("key") * ranges / F.lit(2**31)))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("sum")).select("source", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(small_or_plain(sums), ["source", "range"]).withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    copies = (F.col("epochs") + F.when(F.col("at") < F.col("rest"), 1).otherwise(0)).cast("int")
    return placed.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"))


def build_mix(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(mix, report); the report has the share each target source has reached in the mix, and by how much its last document exceeds its budget."""
    sizes = cut(token_sizes(documents, path))
    plan = cut(budgets(sizes, targets))
    mix = draw_mix(sizes, plan)
    reached = mix.groupBy("source").agg(F.sum("tokens").alias("mixed"), F.count(F.lit(1)).alias("copies"))
    whole = F.sum(F.coalesce("mixed", F.lit(0))).over(Window.partitionBy())
    # A source that can fill its budget is drawn up to the document that reaches it, so only a capped one stays below.
    short = F.coalesce("mixed", F.lit(0)) < F.col("budget") - 0.5
    # One row per target: a small table, so the window over all of it is no hot task.
    report = plan.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("mixed", F.lit(0)).alias("tokens"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce(F.col("mixed") / whole, F.lit(0.0)).alias("actual_share"), F.round("budget").cast("long").alias("budget_tokens"), F.round(F.greatest(F.coalesce("mixed", F.lit(0)) - F.col("budget"), F.lit(0.0))).cast("long").alias("overshoot_tokens"), short.alias("short"),
    )
    return mix, report


def short_sources(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``source`` of every target whose share can't be reached."""
    return build_mix(documents, targets, path)[1].where("short").select("source")
