"""Queries of this subpackage, by name; each takes (spark, folder of the tables). SQL can express none of them exactly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import credentials, leakage, mixing, neighbours, scan_repair, source_origin, splitting, subjects
from textquarry.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _subject_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples"), table(spark, sf_dir, "subjects")


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: source_origin.not_hand_written(table(s, d, "chunks")),
        "p1_origins": lambda s, d: source_origin.file_origins(table(s, d, "chunks")),
        "p2_found": lambda s, d: splitting.oversized(table(s, d, "chunks"), table(s, d, "split_limits")),
        "p2_pieces": lambda s, d: splitting.split_oversized(table(s, d, "chunks"), table(s, d, "split_limits")),
        "p3_found": lambda s, d: scan_repair.defects(table(s, d, "chunks")),
        "p3_paragraphs": lambda s, d: scan_repair.repair_pages(table(s, d, "chunks")),
        "p4_found": lambda s, d: credentials.find_secrets(table(s, d, "chunks")).select("vec_id", "start_pos", "end_pos"),
        "p4_redacted": lambda s, d: credentials.redact(table(s, d, "chunks")),
        "p5_found": lambda s, d: neighbours.neighbour_pairs(table(s, d, "chunk_vectors")),
        "p5_neighbours": lambda s, d: neighbours.neighbour_chunks(table(s, d, "chunk_vectors"), table(s, d, "chunks")),
        "p6_found": lambda s, d: leakage.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")),
        "p6_spans": lambda s, d: leakage.removal_spans(table(s, d, "documents"), table(s, d, "eval_items")),
        "p7_found": lambda s, d: mixing.short_sources(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_mix": lambda s, d: mixing.build_mix(table(s, d, "documents"), table(s, d, "mix_targets"))[0],
        "p7_report": lambda s, d: mixing.build_mix(table(s, d, "documents"), table(s, d, "mix_targets"))[1],
        "p8_found": lambda s, d: subjects.document_subjects(*_subject_tables(s, d)),
        "p8_composition": lambda s, d: subjects.composition(*_subject_tables(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {}
