"""Cutting oversized texts into overlapping pieces at natural boundaries, by agglomerative merging.

A text starts as atomic segments (sections, paragraphs, lines, sentences; clauses, words or plain cuts only inside a
segment that is too long by itself). Adjacent pairs lie in a heap ordered by the strength of the boundary between them;
the weakest boundary is merged away first, as long as the combined size plus the overlap fits the limit. What remains
are the strongest boundaries of the text. Every piece but the first starts with about ``overlap_chars`` of the piece
before, from a white space on where there is one.

Each row is cut by itself, so the operator needs no shuffle. Null texts and texts within the limit give no row; null or
unknown kinds take the limits of ``document``. Extra columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.runtime import small_or_plain

# Boundary strengths, strongest first; a boundary lies behind the match.
_BOUNDARIES = [
    (6, re.compile(r"\n(?=#{1,6}\s|(?:export |public |private |static |async )*(?:def|class|function|func|fn|interface|struct)\b)")),
    (5, re.compile(r"\n[ \t\r]*\n+")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[.!?…][\"')\]]*\s+")),
    (2, re.compile(r"[,;:]\s+")),
    (1, re.compile(r"\s+")),
]
_SPACE = re.compile(r"\s")


def _segments(text: str, start: int, end: int, core: int, whole: int, level: int, out: list[tuple[int, int]]) -> None:
    """Append (end, strength of the boundary behind it) of the segments of text[start:end] to out."""
    for at in range(level, len(_BOUNDARIES)):
        strength, pattern = _BOUNDARIES[at]
        # Clauses and words only matter inside a segment that doesn't fit.
        if strength <= 2 and end - start <= (core if strength == 2 or _SPACE.search(text, start, end - 1) else whole):
            break
        cuts = [m.end() for m in pattern.finditer(text, start, end) if m.end() < end]
        if cuts:
            begin = start
            for c in cuts:
                _segments(text, begin, c, core, whole, at + 1, out)
                out[-1] = (c, strength)
                begin = c
            _segments(text, begin, end, core, whole, at + 1, out)
            return
    if end - start <= whole and (end - start <= core or not _SPACE.search(text, start, end - 1)):
        out.append((end, 0))
        return
    for c in range(start + core, end, core):
        if text[c - 1 : c + 1] == "\r\n":
            c -= 1
        out.append((c, 0))
    out.append((end, 0))


def cut_points(text: str, max_chars: int, overlap_chars: int) -> list[int]:
    """The ends of the pieces' own parts (without overlap), in order."""
    overlap = max(0, min(overlap_chars, max_chars // 2))
    core = max(1, max_chars - overlap)
    ends: list[tuple[int, int]] = []
    _segments(text, 0, len(text), core, max_chars, 0, ends)
    n = len(ends)
    begin = [0] + [e for e, _ in ends[:-1]]
    end = [e for e, _ in ends]
    right, left, alive, version = list(range(1, n)) + [-1], [-1] + list(range(n - 1)), [True] * n, [0] * n
    heap = [(ends[i][1], end[i + 1] - begin[i], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    strength = [s for _, s in ends]
    while heap:
        _, size, i, vi, vj = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j < 0 or version[i] != vi or version[j] != vj:
            continue
        if size > (core if begin[i] else max_chars):
            continue
        end[i], strength[i], alive[j], right[i] = end[j], strength[j], False, right[j]
        version[i] += 1
        if right[i] >= 0:
            left[right[i]] = i
            heapq.heappush(heap, (strength[i], end[right[i]] - begin[i], i, version[i], version[right[i]]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (strength[k], end[i] - begin[k], k, version[k], version[i]))
    return [end[i] for i in range(n) if alive[i]]


def pieces(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int]]:
    """(start, end) of each piece in the text, overlap included; together they cover the whole text."""
    out: list[tuple[int, int]] = []
    begin = 0
    for end in cut_points(text, max_chars, overlap_chars):
        start = begin
        if out:
            earliest = max(begin - min(overlap_chars, max(0, max_chars - (end - begin))), out[-1][0])
            m = _SPACE.search(text, earliest, begin - 1) if earliest < begin else None
            start = earliest if earliest == begin or (earliest and text[earliest - 1].isspace()) or not m else m.end()
        out.append((start, end))
        begin = end
    return out


_PIECES = "vec_id long, piece_no int, n_pieces int, piece_text string, start_char int, end_char int, parent_section string, cut string"


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["vec_id", "piece_no", "n_pieces", "piece_text", "start_char", "end_char", "parent_section", "cut"]
    for pdf in batches:
        rows = []
        for vec_id, text, section, limit, overlap in zip(pdf["vec_id"], pdf["chunk_text"], pdf["parent_section"], pdf["max_chars"], pdf["overlap_chars"]):
            limit = int(limit)
            spans = pieces(text, limit, int(overlap))
            cut = "hard" if max(map(len, text.split()), default=0) > limit else "soft"
            rows += [(vec_id, k + 1, len(spans), text[a:b], a, b, section, cut) for k, (a, b) in enumerate(spans)]
            if len(rows) >= 2000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The numbered pieces of every chunk longer than its limit, with exact offsets in the chunk's own text."""
    limits = limits.select(F.col("source_type").alias("_kind"), "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    kind = F.when(F.col("source_type") == "code", "code").otherwise("document")
    long_rows = (
        chunks.select("vec_id", "chunk_text", "parent_section", kind.alias("_kind"))
        .join(small_or_plain(limits), "_kind")
        .where(F.length("chunk_text") > F.col("max_chars"))
        .select("vec_id", "chunk_text", "parent_section", "max_chars", "overlap_chars")
    )
    return long_rows.mapInPandas(_split, _PIECES)


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``vec_id, cut`` of every chunk that had to be split."""
    return split_oversized(chunks, limits).where("piece_no = 1").select("vec_id", "cut")
