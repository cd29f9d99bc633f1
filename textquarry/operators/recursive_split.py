"""Recursive character splitting with overlap, per row in vectorised batches.

Separators are tried from the coarsest on; pieces that are still too long are cut with the next one. Small pieces are
merged up to the size, each chunk starting with up to ``overlap`` characters of the one before. Null and blank texts
give no chunk. Offsets are exact: where the stripped chunk stands in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Separators of prose and of languages, coarsest first.
PROSE = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", ""]
_BRACES = ["\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""]
LANGUAGES = {
    "py": ["\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", *_BRACES],
    "js": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", *_BRACES],
    "ts": ["\nenum ", "\ninterface ", "\nnamespace ", "\ntype ", "\nclass ", "\nfunction ", "\nconst ", "\nlet ", "\nvar ", *_BRACES],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", *_BRACES],
    "rs": ["\nfn ", "\nconst ", "\nlet ", "\nloop ", "\nmatch ", *_BRACES],
    "rb": ["\ndef ", "\nclass ", "\nunless ", "\nbegin ", *_BRACES],
    "php": ["\nfunction ", "\nclass ", "\nforeach ", *_BRACES],
    "c": ["\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", *_BRACES],
}
ALIASES = {"jsx": "js", "tsx": "ts", "cpp": "c", "h": "c", "hpp": "c", "cs": "java", "kt": "java", "scala": "java", "swift": "java"}


def _pieces(text: str, start: int, end: int, size: int, separators: list[str]) -> list[tuple[int, int]]:
    """Adjacent (start, end) pieces, each at most ``size`` long where a separator allows it."""
    at = next((i for i, s in enumerate(separators) if s == "" or text.find(s, start, end) >= 0), len(separators) - 1)
    s, rest = separators[at], separators[at + 1 :]
    if s == "":
        return [(i, i + 1) for i in range(start, end)]
    cuts, i = [start], text.find(s, start + 1, end)
    while i >= 0:
        cuts.append(i)
        i = text.find(s, i + len(s), end)
    out = []
    for a, b in zip(cuts, cuts[1:] + [end]):
        if b - a >= size and rest:
            out += _pieces(text, a, b, size, rest)
        elif b > a:
            out.append((a, b))
    return out


def split_text(text: str, size: int, overlap: int, separators: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the chunks, without white space at their ends."""
    chunks: list[tuple[int, int]] = []
    buffer: list[tuple[int, int]] = []
    total = 0

    def emit() -> None:
        a, b = buffer[0][0], buffer[-1][1]
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            chunks.append((a, b))

    for a, b in _pieces(text, 0, len(text), size, separators):
        if buffer and total + b - a > size:
            emit()
            while buffer and (total > overlap or total + b - a > size):
                total -= buffer[0][1] - buffer[0][0]
                buffer.pop(0)
        buffer.append((a, b))
        total += b - a
    if buffer:
        emit()
    return chunks


def separators_of(extension: str | None) -> list[str] | None:
    """Separators of a language, or none if it isn't known."""
    e = (extension or "").lower()
    return LANGUAGES.get(ALIASES.get(e, e))


def recursive_split(df: DataFrame, text: str, key: str, chunk_size: int = 512, overlap: int = 50, extension: str | None = None, offsets: str = "exact") -> DataFrame:
    """``key, chunk_no, chunk_text, start_char, end_char``; sizes are in tokens of 4 (Python code: 5) characters.

    With ``extension``, the column that names the language, code is cut at its definitions; unknown languages and prose
    at paragraphs, lines and sentences. Rows are independent: no shuffle. ``offsets="compat"`` gives each chunk the place
    where its text is next found behind the chunk before or, overlapping it, that chunk's end.
    """
    if offsets not in ("exact", "compat"):
        raise ValueError("offsets must be exact or compat")
    kind = df.schema[key].dataType.simpleString()
    columns = [key, "chunk_no", "chunk_text", "start_char", "end_char"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            extensions = pdf["_ext"] if extension else [None] * len(pdf)
            for k, t, e in zip(pdf[key], pdf["_text"], extensions):
                per_token = 5 if e == "py" else 4
                spans = split_text(t, chunk_size * per_token, overlap * per_token, separators_of(e) or PROSE)
                at = 0
                for i, (a, b) in enumerate(spans):
                    if offsets == "compat":
                        a, b = (found, found + b - a) if (found := t.find(t[a:b], at)) >= 0 else (at, at + b - a)
                        at = b
                    rows.append((k, i, t[spans[i][0] : spans[i][1]], a, b))
            yield pd.DataFrame(rows, columns=columns)

    chosen = [df[key], df[text].alias("_text")] + ([df[extension].alias("_ext")] if extension else [])
    return df.where(df[text].isNotNull()).select(*chosen).mapInPandas(split, f"{key} {kind}, chunk_no int, chunk_text string, start_char int, end_char int")
