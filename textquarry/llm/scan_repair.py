"""Repair of text from scanned pages: page furniture, words broken across lines, misread words.

* A frequency lexicon and bigram counts are taken from all prose of the collection.
* Words of page-wise files that the lexicon makes doubtful meet it through a symmetric-delete index: both sides are
  expanded by deleting up to two characters, and by undoing typical misreadings, and equal remainders are joined. A weighted edit distance in which typical
  misreadings are cheap, the frequency and the neighbouring words pick the repair.
* Lines that hold nothing but a page number or a running title are told from the body by their form and by their
  recurrence in the file; two halves of a word are joined if the lexicon prefers the whole to a hyphenated compound.

A file counts as scanned only if it shows such furniture or broken words, so born-digital files give no row. Null texts
and null paths give no row; equal rows give equal rows under their own ids; repeated defects of a line are one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.source_origin import CODE_EXTENSIONS
from textquarry.runtime import cut

# Extensions of files that are loaded by the page, or that hold recognised text.
PAGE_EXTENSIONS = "pdf txt tif tiff djvu".split()
#: A repair must be at least so frequent, and so many times as frequent as the doubtful word.
MIN_COUNT, MIN_RATIO = 5, 5
#: The most frequent undoubted words, broadcast so that tasks needn't send them to the join; the rest is joined.
TRUSTED_WORDS = 50_000
MAX_COST = 0.95

# What a scanner reads (left) for what is printed (right), and its cost.
_SYMBOLS = str.maketrans({"0": "o", "1": "l", "!": "i", "|": "l", "5": "s", "6": "b", "8": "b", "9": "g"})
_CONFUSIONS = {
    ("c", "e"): 0.3, ("f", "t"): 0.3, ("b", "h"): 0.3, ("l", "i"): 0.3, ("i", "l"): 0.3, ("cl", "d"): 0.3, ("ri", "n"): 0.3, ("rn", "m"): 0.3,
    ("ii", "u"): 0.3, ("vv", "w"): 0.3, ("e", "c"): 0.5, ("t", "f"): 0.5, ("h", "b"): 0.5, ("m", "rn"): 0.5, ("n", "ri"): 0.5, ("d", "cl"): 0.5, ("u", "ii"): 0.5, ("h", "li"): 0.3, ("li", "h"): 0.5,
}
_DIGITS = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "S": "5", "s": "5", "B": "8", "b": "6", "Z": "2", "g": "9"})
_N = r"[0-9OolI|!SsBbZg]{1,4}"
_WORD = re.compile(r"[^\W_]+(?:[!|'’‐-][^\W_]+)*")
_INNER = re.compile(r"(?<![^\W_])[!|][^\W_]+")
_BREAK = re.compile(r"([^\W\d_][^\W_!|]*|[^\W_]+(?:[!|][^\W_]+)*)[-‐¬­][ \t]*$")
_HYPHENS = ("-", "‐", "¬", "\u00ad")
_NEXT = re.compile(r"[ \t]*([^\W_]+(?:[!|][^\W_]+)*)")
_MARKED = re.compile(rf"^(?:[—–-]\s*({_N})\s*[—–-]|\[\s*({_N})\s*\]|(?:p|pg|page|Page|PAGE|P|Pg|S|Seite)(?:\.\s*|\s+)({_N})|({_N})\s*/\s*{_N}|{_N}\s+of\s+({_N}))$")
_BARE = re.compile(r"^[0-9OlISBZ]{1,4}$")
_ROMAN = re.compile(r"^[ivxlc!1|]{1,7}$")
_COMBINED = re.compile(rf"^(?:(?P<a>{_N})\s{{2,}}(?P<t>\S.*\S)|(?P<u>\S.*\S)\s{{2,}}(?P<b>{_N}|[ivxlc]{{1,6}}))$")
_ORDINAL = re.compile(r"^\d+(?:st|nd|rd|th|k|m|g|kb|mb|gb|x|s)?$|^[a-z]?\d[a-z0-9]?$", re.I)


def plain(word: str) -> str:
    """Lower case without ligatures and accents, digits and marks read as the letters they look like."""
    w = unicodedata.normalize("NFKD", word).lower().translate(_SYMBOLS)
    return "".join(ch for ch in w if ch.isalnum() or ch == "-")


def spelling(word: str) -> str:
    return unicodedata.normalize("NFKC", word).lower() if not word.isascii() else word.lower()


def repair_cost(read: str, right: str) -> float:
    """Weighted edit distance in which typical misreadings are cheap."""
    n, m = len(read), len(right)
    best = [[99.0] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            b = best[i][j]
            if b > MAX_COST:
                continue
            if i < n and j < m:
                c = 0.0 if read[i] == right[j] else 1.0
                best[i + 1][j + 1] = min(best[i + 1][j + 1], b + c)
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], b + 1)
            if j < m:
                best[i][j + 1] = min(best[i][j + 1], b + 1)
            for di in (1, 2):
                for dj in (1, 2):
                    c2 = _CONFUSIONS.get((read[i : i + di], right[j : j + dj])) if i + di <= n and j + dj <= m else None
                    if c2 is not None:
                        best[i + di][j + dj] = min(best[i + di][j + dj], b + c2)
    return best[n][m]


def deletions(word: str, most: int = 2) -> set[str]:
    out = level = {word}
    for _ in range(most if len(word) > 4 else 1):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


_WIDE = {a: b for pair in _CONFUSIONS for a, b in (pair, pair[::-1]) if len(a) > len(b)}
_ALIKE = str.maketrans("ethi", "cfbl")


def folded(word: str, most: int = 3) -> set[str]:
    """Forms in which any misreadings within the cost (three at most) agree: some letter pairs read as one letter, letters taken for each other as one."""
    out = level = {(word, 0)}
    for _ in range(most):
        level = {(w[:i] + _WIDE[w[i : i + 2]] + w[i + 2 :], i + 1) for w, start in level for i in range(start, len(w) - 1) if w[i : i + 2] in _WIDE}
        out = out | level
    return {"=" + w.translate(_ALIKE) for w, _ in out}


def _lines(text: str) -> list[str]:
    return [l.rstrip("\r") for l in text.split("\n")]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    on_pages: Counter[str] = Counter()

    def drain() -> pd.DataFrame:
        seen = [(w, "", n, on_pages[w]) for w, n in (words + on_pages).items()]
        out = pd.DataFrame(seen + [(a, b, n, n) for (a, b), n in pairs.items()], columns=["word", "after", "n", "paged"])
        for c in (words, pairs, on_pages):
            c.clear()
        return out

    for pdf in batches:
        for text, paged in zip(pdf["chunk_text"], pdf["paged"]):
            text = spelling(text)
            if not paged:
                words.update(_WORD.findall(text))
                continue
            broken = False
            for line in _lines(text):
                found = _WORD.findall(line)
                if broken:
                    found = found[1:]
                broken = line.rstrip()[-1:] in _HYPHENS and bool(_BREAK.search(line))
                if broken:
                    found = found[:-1]
                on_pages.update(found)
                if "!" in line or "|" in line:
                    on_pages.update(_INNER.findall(line))
                pairs.update(zip(found, found[1:]))
        if len(words) + len(pairs) + len(on_pages) > 200_000:
            yield drain()
    yield drain()


_DELETES = "word string, n long, rest long"


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            # Remainders travel as hashes; a pair that only a hash brings together fails the distance.
            rows = [(w, n, xxhash.xxh3_64_intdigest(d) - (1 << 63)) for w, n in zip(part["word"], part["n"]) for d in deletions(plain(w)) | folded(plain(w))]
            yield pd.DataFrame(rows, columns=["word", "n", "rest"])


def _extension() -> F.Column:
    return F.lower(F.regexp_extract("source_path", r"\.([A-Za-z0-9]+)$", 1))


def word_counts(chunks: DataFrame) -> DataFrame:
    """``word, after, n, paged``: how often each word (``after`` empty) and, in paged files, each pair occurs in the prose; ``paged``: in paged files."""
    prose = chunks.where(F.col("chunk_text").isNotNull() & F.col("source_path").isNotNull() & ~_extension().isin(CODE_EXTENSIONS))
    return prose.select("chunk_text", _extension().isin(PAGE_EXTENSIONS).alias("paged")).mapInPandas(_counts, "word string, after string, n long, paged long").groupBy("word", "after").agg(F.sum("n").alias("n"), F.sum("paged").alias("paged"))


def repair_candidates(words: DataFrame) -> DataFrame:
    """``read, fixed, cost, n``: lexicon words that a doubtful word may stand for, from the symmetric-delete index."""
    letters = words.where(F.length("word").between(2, 30))
    lexicon = letters.where((F.col("n") >= MIN_COUNT) & F.col("word").rlike(r"^\p{L}+(?:-\p{L}+)*$")).select("word", "n").mapInPandas(_expand, _DELETES)
    doubtful = letters.where((F.col("paged") > 0) & ~F.col("word").rlike(_ORDINAL.pattern) & F.col("word").rlike(r"\p{L}.*\p{L}")).select("word", "n").mapInPandas(_expand, _DELETES)
    l, d = lexicon.select(F.col("word").alias("fixed"), F.col("n").alias("n_fixed"), "rest"), doubtful.select(F.col("word").alias("read"), F.col("n").alias("n_read"), "rest")
    # A remainder meets only words longer by at most two letters, so what shares it is bounded by the alphabet (some thousands
    # of spellings for three letters, each once), not by the rows; conditions on frequency and length are part of the join.
    met = d.join(l, "rest").where((F.col("fixed") != F.col("read")) & (F.col("n_fixed") >= MIN_RATIO * F.col("n_read")) & (F.abs(F.length("fixed") - F.length("read")) <= 3)).select("read", "fixed", "n_fixed").distinct()

    @F.pandas_udf("double")
    def cost(read: pd.Series, fixed: pd.Series) -> pd.Series:
        return pd.Series([repair_cost(plain(r), plain(f)) + 0.1 * (spelling(r) != plain(r)) for r, f in zip(read, fixed)], dtype="float64")

    return met.withColumn("cost", cost("read", "fixed")).where(F.col("cost") <= MAX_COST).select("read", "fixed", "cost", F.col("n_fixed").alias("n"))


def _roman(text: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    digits = [values.get(ch, 1) for ch in text]
    return sum(-d if d < e else d for d, e in zip(digits, digits[1:] + [0]))


def _number(text: str | None) -> int | None:
    t = (text or "").translate(_DIGITS)
    return int(t) if t.isdigit() else None


def _title(line: str) -> bool:
    """Whether a line looks like a running title: few words, all capitals or capitalised, no sentence."""
    words = line.split()
    if not 2 <= len(words) <= 7 or len(line) > 60 or re.search(r"[,;:.?!]$", line) or not line[0].isalnum():
        return False
    big = sum(w[0].isupper() or w[0].isdigit() for w in words)
    return big >= 2 and all(w[0].isupper() or w[0].isdigit() or len(w) <= 3 for w in words)


_SIGNS = "source_path string, vec_id long, line_no int, kind string, word string, alt string, before string, after string, value long"


def page_signs(text: str, trusted: frozenset[str]) -> list[tuple]:
    """Candidates of a chunk: (line number, kind, word, alternative, word before, word after, number)."""
    lines = _lines(text)
    bare = [bool(_BARE.match(l.strip())) for l in lines]
    filled = [i for i, l in enumerate(lines) if l.strip()]
    rank = {i: k for k, i in enumerate(filled)}
    # The outermost lines that are no page numbers.
    words = [i for i in filled if not (bare[i] or _MARKED.match(lines[i].strip()) or _ROMAN.match(lines[i].strip()))]
    top, bottom = (words[0], words[-1]) if words else (-1, len(lines))
    out: list[tuple] = []
    skip = ""
    for i in filled:
        line = lines[i].strip()
        short = len(line) <= 60
        m = _MARKED.match(line) if short else None
        c = _COMBINED.match(line) if short and not m and "  " in line else None
        k = rank[i]
        before = filled[k - 1] if k else None
        behind = filled[k + 1] if k + 1 < len(filled) else None
        edge = before is None or behind is None or not lines[i - 1].strip() or i + 1 >= len(lines) or not lines[i + 1].strip()
        value = _number(next(g for g in m.groups() if g)) if m else None
        if value is not None:
            out.append((i + 1, "marked", "", "", "", "", value))
            skip = ""
            continue
        if c and _title(c["t"] or c["u"]):
            out.append((i + 1, "combined", plain(c["t"] or c["u"]), "", "", "", _number(c["a"] or c["b"])))
            skip = ""
            continue
        if bare[i]:
            # Figures of the body stand in blocks of their own: below a one-word caption or another figure.
            caption = before is not None and before == i - 1 and (bare[before] or re.fullmatch(r"[^\W\d_]+", lines[before].strip()))
            if not caption and not (behind == i + 1 and bare[behind]):
                out.append((i + 1, "bare", "", "", "", "", _number(line)))
                skip = ""
                continue
        elif short and edge and _ROMAN.match(line):
            out.append((i + 1, "roman", "", "", "", "", _roman(line)))
            skip = ""
            continue
        elif short and _title(line):
            out.append((i + 1, "title", plain(line), "end" if i <= top or i >= bottom else "edge" if edge else "", "", "", None))
            continue
        tokens = _WORD.findall(lines[i])
        if "!" in line or "|" in line:
            tokens += _INNER.findall(lines[i])
        spelled = [spelling(t) for t in tokens]
        if skip and spelled:
            tokens, spelled = tokens[1:], spelled[1:]
        skip = ""
        b = _BREAK.search(lines[i]) if line[-1] in _HYPHENS else None
        if b and behind is not None:
            n = _NEXT.match(lines[behind])
            if n and not _MARKED.match(lines[behind].strip()):
                one, two = spelling(b[1]), spelling(n[1])
                out.append((i + 1, "hyphen", one + two, f"{one}-{two}", spelled[-2] if len(spelled) > 1 else "", "", None))
                tokens, spelled, skip = tokens[:-1], spelled[:-1], two
        for t, (w, s) in enumerate(zip(tokens, spelled)):
            odd = s not in trusted or not w.isascii() and unicodedata.normalize("NFKC", w) != w
            if odd and not _ORDINAL.match(s) and len(s) > 1 and sum(ch.isalpha() for ch in s) * 2 >= len(s):
                out.append((i + 1, "word", w.lower(), s, spelled[t - 1] if t else "", spelled[t + 1] if t + 1 < len(spelled) else "", None))
    return out


def defects(chunks: DataFrame) -> DataFrame:
    """``vec_id, line_no, defect, fixed``: one row per distinct defect of the chunks of scanned files."""
    counts = cut(word_counts(chunks))
    words = counts.where("after = ''").select("word", "n", "paged")
    candidates = cut(repair_candidates(words))
    trusted = chunks.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in words.where((F.col("n") >= 10 * MIN_COUNT)).join(candidates.select(F.col("read").alias("word")).distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(TRUSTED_WORDS).collect()))

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, v, *s) for p, v, t in zip(pdf["source_path"], pdf["vec_id"], pdf["chunk_text"]) for s in page_signs(t, trusted.value)]
            out = pd.DataFrame(rows, columns=["source_path", "vec_id", "line_no", "kind", "word", "alt", "before", "after", "value"])
            out["value"] = out["value"].astype("Int64")
            yield out

    paged = chunks.where(_extension().isin(PAGE_EXTENSIONS) & F.col("chunk_text").isNotNull() & F.col("vec_id").isNotNull())
    found = cut(paged.select("source_path", "vec_id", "chunk_text").mapInPandas(signs, _SIGNS))

    # Numbers without a mark count if the file has a neighbouring one.
    numbers = found.where("kind in ('marked', 'bare', 'roman', 'combined') and value is not null").select("source_path", "value").distinct()
    near = numbers.select("source_path", F.explode(F.array(*[F.col("value") + d for d in (-2, -1, 1, 2)])).alias("value")).distinct()
    plain_numbers = found.where("kind in ('bare', 'roman')").join(near, ["source_path", "value"], "left_semi")
    page_no = found.where("kind = 'marked'").select("source_path", "vec_id", "line_no").unionByName(plain_numbers.select("source_path", "vec_id", "line_no"))

    # Running titles: with a number, or the outermost line of a chunk, or at another edge and recurring in the file, misread or not.
    titles = found.where("kind in ('title', 'combined')")

    @F.pandas_udf("array<string>")
    def heads(word: pd.Series) -> pd.Series:
        return word.map(lambda w: sorted(folded(w)))

    head = titles.select("source_path", "vec_id", "word", F.explode(heads("word")).alias("head"))
    often = head.groupBy("source_path", "head").agg(F.count_distinct("vec_id").alias("times")).where("times > 1")
    recurring = head.join(often, ["source_path", "head"], "left_semi").select("source_path", "word").distinct()

    # Broken words, and what the lexicon says of their two readings.
    whole = words.select(F.col("word"), F.col("n").alias("n_whole"))
    compound = words.select(F.col("word").alias("alt"), F.col("n").alias("n_alt"))
    broken = (
        found.where("kind = 'hyphen'").join(whole, "word", "left").join(compound, "alt", "left")
        .where(F.coalesce("n_whole", F.lit(0)) >= F.coalesce("n_alt", F.lit(0)))
    )
    # A file is scanned if it has page numbers, or a broken word that is whole in the lexicon.
    signs_of = page_no.select("source_path").unionByName(titles.where("kind = 'combined'").select("source_path")).unionByName(broken.where(F.col("n_whole") >= MIN_COUNT).select("source_path"))
    scanned = signs_of.distinct()
    place = ["source_path", "vec_id", "line_no"]
    header = titles.where("kind = 'combined' or alt = 'end'").select(place).unionByName(titles.where("alt = 'edge'").join(recurring, ["source_path", "word"], "left_semi").select(place))

    # Repairs: the best candidate by cost, frequency and neighbours.
    doubtful = found.where("kind = 'word'").select("source_path", "vec_id", "line_no", F.lit("glyph").alias("defect"), "word", F.col("alt").alias("read"), "before", "after")
    joined = broken.select("source_path", "vec_id", "line_no", F.lit("hyphen").alias("defect"), F.col("word").alias("word"), F.col("word").alias("read"), "before", "after")
    repairs = _repairs(doubtful.unionByName(joined), candidates, counts, words)
    glyphs = repairs.where("defect = 'glyph' and fixed is not null")
    hyphens = repairs.where("defect = 'hyphen'").withColumn("fixed", F.coalesce("fixed", "read"))
    furniture = page_no.withColumn("defect", F.lit("page_no")).unionByName(header.withColumn("defect", F.lit("header"))).withColumn("fixed", F.lit(""))
    columns = ["source_path", "vec_id", "line_no", "defect", "fixed"]
    rows = furniture.select(columns).unionByName(glyphs.select(columns)).unionByName(hyphens.select(columns))
    return rows.join(scanned, "source_path", "left_semi").select("vec_id", "line_no", "defect", "fixed").distinct()


def _repairs(tokens: DataFrame, candidates: DataFrame, counts: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens with ``fixed``: the repair, or null where a word stays as it is."""
    keyed = tokens.withColumn("row", F.xxhash64("vec_id", "line_no", "defect", "word", "before", "after"))
    options = keyed.join(candidates, "read")
    pairs = counts.where("after != ''")
    left = pairs.select(F.col("word").alias("before"), F.col("after").alias("fixed"), F.col("n").alias("n_left"))
    right = pairs.select(F.col("word").alias("fixed"), F.col("after"), F.col("n").alias("n_right"))
    scored = options.join(left, ["before", "fixed"], "left").join(right, ["fixed", "after"], "left").withColumn(
        "score", F.col("cost") - 0.02 * F.log("n") - 0.05 * F.log1p(F.coalesce("n_left", F.lit(0)) + F.coalesce("n_right", F.lit(0)))
    )
    best = scored.groupBy("row").agg(F.min_by("fixed", F.struct("score", "fixed")).alias("fixed"))
    # A ligature or a mark inside a word is a defect even if the plain spelling is all there is to repair.
    same = F.when((F.col("defect") == "glyph") & (F.col("word") != F.col("read")), F.col("read"))
    return keyed.join(best, "row", "left").withColumn("fixed", F.coalesce("fixed", same)).drop("row")


def repair_pages(chunks: DataFrame) -> DataFrame:
    """``vec_id, n_repairs, repaired_text``: scanned chunks as continuous paragraphs of whole, correct words."""
    found = defects(chunks).groupBy("vec_id").agg(F.collect_list(F.struct("line_no", "defect", "fixed")).alias("defects"))

    @F.pandas_udf("string")
    def repaired(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([apply_repairs(t, [(d["line_no"], d["defect"], d["fixed"]) for d in ds]) for t, ds in zip(text, found)])

    joined = chunks.where(F.col("chunk_text").isNotNull()).select("vec_id", "chunk_text").join(found, "vec_id")
    return joined.select("vec_id", F.size("defects").cast("long").alias("n_repairs"), repaired("chunk_text", "defects").alias("repaired_text"))


def apply_repairs(text: str, found: list[tuple[int, str, str]]) -> str:
    """The text without furniture, with broken and misread words repaired and the lines of a paragraph joined."""
    lines = _lines(text)
    gone = {n for n, d, _ in found if d in ("header", "page_no")}
    glyphs: dict[int, list[str]] = {}
    breaks = {n: fixed for n, d, fixed in found if d == "hyphen"}
    for n, d, fixed in found:
        if d == "glyph":
            glyphs.setdefault(n, []).append(fixed)
    out: list[str] = []
    paragraph = ""
    drop_first = False
    for i, raw in enumerate(lines, 1):
        line = raw.strip()
        if i in gone:
            continue
        if not line:
            if paragraph and not drop_first:
                out.append(paragraph)
                paragraph = ""
            continue

        def mend(m: re.Match[str], fixes: list[str] = glyphs.get(i, [])) -> str:
            w = m.group()
            options = [f for f in fixes if spelling(w) != f and repair_cost(plain(w), plain(f)) <= MAX_COST]
            if not options or (spelling(w) == w.lower() and w.lower() in fixes):
                return w
            best = min(options, key=lambda f: repair_cost(plain(w), plain(f)))
            return best.capitalize() if w[0].isupper() else best

        if drop_first:
            line = re.sub(r"^[^\W_]+(?:[!|][^\W_]+)*", "", line, count=1).lstrip() if re.match(r"[\w]", line) else line
        glue = "" if drop_first and re.match(r"[.,;:!?)]", line) else " "
        drop_first = i in breaks
        if drop_first:
            head = _BREAK.sub("", line)
            first = line[len(head) :][:1]
            line = head + (breaks[i].capitalize() if first.isupper() else breaks[i])
        line = re.sub(r"[!|]?" + _WORD.pattern, mend, line)
        paragraph = f"{paragraph}{glue if paragraph else ''}{line}"
    if paragraph:
        out.append(paragraph)
    return "\n\n".join(out)
