"""Files of a code collection that nobody wrote by hand: generated, minified, vendored or data saved as code.

1. *Declared*: attribute files (``.gitattributes``) in the collection say what is generated or vendored; the deepest
   directory wins, and within a file the last matching line.
2. *Mined*: where no attribute file speaks, equivalent patterns do: directory names, name endings and phrases of head
   comments that, over several repositories, go with files known to be made or copied. Known to be made are declared
   files, files that are mostly minified or machine-shaped, and files with a published mark of generators; known to be
   copied are declared files, files in conventional dependency directories and files most of whose text other
   repositories have too. What a pattern matches is taken to be what most known files with it are.
3. Files without a pattern count if they are themselves known to be made, or share their text with a vendored file
   of another repository.

Nulls: rows without ``source_path`` or text give no evidence; a path of which all chunks are null is hand-written.
Repeated rows add to both sides of every share, so they change nothing. An empty table gives an empty result. A path, a
text or a pattern may have any share of the rows: all are counted per part before they are brought together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.runtime import cut, small_or_plain

# Extensions of code and style files.
CODE_EXTENSIONS = "py pyw js mjs cjs jsx ts tsx css scss less go java kt scala c h cc cpp cxx hpp cs rs rb php swift".split()
#: A path counts as machine-made if at least this share of its characters is machine-shaped or minified.
MACHINE_SHARE = 0.6
# Directory names that by convention hold nothing but fetched third-party code.
DEPENDENCY_DIRECTORIES = "node_modules bower_components third_party vendor".split()
#: A mined pattern needs so many files, known ones in so many repositories, and this share of known ones.
MINED_FILES, MINED_REPOSITORIES, MINED_SHARE = 5, 3, 0.7
#: Words of a phrase of a head comment; characters of a chunk from which its text can tell a copy.
PHRASE, COPY_CHARS = 3, 200

_COMMENT = re.compile(r"\s*(?://|#|/\*|\*|<!--|--|;)")
# Published marks by which generators name their output.
_GENERATED = re.compile(r"(?i)code generated\b.*\bdo not edit|@generated\b|<auto-?generated|\bauto-?generated (?:by|from|file|code)\b")
_QUOTED = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?")
_BASE64 = re.compile(r"^[A-Za-z0-9+/=]{40,}[\\\"',;)]*$")
_PLAIN_DATA = re.compile(r"^[\s#S,;:\[\](){}.+-]+$")
_LETTERS = re.compile(r"[^\W\d_]+")
_CODE_MARKS = "(){};,:=."

_FEATURES = "source_path string, total long, minified long, machine long, marked boolean, print long, says array<string>"


def head_comment(text: str) -> list[str]:
    """The comment lines with which a chunk begins."""
    out = []
    inside = False
    for raw in text.replace("\r", "\n").split("\n"):
        line = raw.strip()
        if not line:
            continue
        if not inside and not _COMMENT.match(line):
            break
        inside = (inside or line.startswith(("/*", "<!--"))) and "*/" not in line and "-->" not in line
        out.append(re.split(r"\*/|-->", line, maxsplit=1)[0])
        if out[-1] != line and line.startswith(("/*", "<!--")) and len(line) > len(out[-1]) + 3:
            break
    return out


def phrases_of(lines: list[str]) -> list[str]:
    """The phrases of comment lines, each once."""
    words = [_LETTERS.findall(line.lower()) for line in lines]
    return sorted({" ".join(w[i : i + PHRASE]) for w in words for i in range(len(w) - PHRASE + 1)})


def chunk_features(text: str) -> tuple[int, int, int, bool, list[str]]:
    """Characters, minified and machine-shaped characters of a chunk, whether a generator marked it, and what its head comment says."""
    total = minified = machine = 0
    chars: Counter[str] = Counter()
    times: Counter[str] = Counter()
    marked = False
    for raw in text.replace("\r", "\n").split("\n"):
        line = raw.strip()
        n = len(line)
        if not n:
            continue
        total += n
        if _COMMENT.match(line):
            marked = marked or bool(_GENERATED.search(line))
        if n >= 120 and line.count(" ") < 0.06 * n and sum(map(line.count, _CODE_MARKS)) > 0.12 * n and not _PLAIN_DATA.match(_NUMBER.sub("#", _QUOTED.sub("S", line))):
            minified += n
            continue
        if _BASE64.match(line):
            machine += n
            continue
        shape = _NUMBER.sub("#", _QUOTED.sub("S", line))
        if n >= 20 and _PLAIN_DATA.match(shape) and ("#" in shape or shape.count("S") > 2):
            machine += n
        elif "#" in shape and n >= 8:
            chars[shape] += n
            times[shape] += 1
    machine += sum(chars[s] for s, k in times.items() if k >= 3)
    return total, minified, machine, marked, phrases_of(head_comment(text))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = pd.DataFrame([chunk_features(t) for t in pdf["chunk_text"]], columns=["total", "minified", "machine", "marked", "says"], index=pdf.index)
        yield pd.concat([pdf["source_path"], out, pdf["print"]], axis=1)[["source_path", "total", "minified", "machine", "marked", "print", "says"]]


def _extension(path: str, fallback: str) -> F.Column:
    from_path = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(from_path != "", from_path).otherwise(F.lower(F.regexp_replace(F.coalesce(F.col(fallback), F.lit("")), r"^\.", "")))


def attribute_rules(chunks: DataFrame) -> DataFrame:
    """``dir, lines``: the lines of every attribute file, in order, by the directory that holds it."""
    name = F.substring_index("source_path", "/", -1)
    return (
        chunks.where((name == ".gitattributes") & F.col("chunk_text").isNotNull())
        .select(F.regexp_replace("source_path", r"/?\.gitattributes$", "").alias("dir"), "start_char", "chunk_text")
        .distinct()
        .groupBy("dir")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("start_char", F.lit(0)).alias("at"), "chunk_text"))).alias("parts"))
        .select("dir", F.array_join(F.transform("parts", lambda p: p["chunk_text"]), "\n").alias("lines"))
    )


def glob_regex(glob: str) -> re.Pattern[str] | None:
    """The regular expression of an attribute glob, relative to the directory of its file; None where it can match no file.

    As in attribute files, a directory (a trailing slash) matches nothing below it, and a pattern can't be negated.
    """
    if not glob or glob.endswith("/") or glob.startswith("!"):
        return None
    anchored = "/" in glob
    glob = glob.removeprefix("/")
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z")


_LINE = re.compile(r'\s*(?:"(?P<quoted>(?:[^"\\]|\\.)*)"|(?P<plain>\S+))(?P<rest>(?:\s.*)?)$')
_ATTRIBUTES = ("linguist-generated", "linguist-vendored")


@lru_cache(256)
def parse_attributes(lines: str) -> tuple[list[tuple[re.Pattern[str], list[str]]], dict[str, list[str]]]:
    """(patterns with their attributes, macros) of an attribute file; read once per directory and worker."""
    rules, macros = [], {}
    for line in lines.replace("\r", "\n").split("\n"):
        m = _LINE.match(line)
        if not m or (m["plain"] or "").startswith("#"):
            continue
        attributes = m["rest"].split()
        if (m["plain"] or "").startswith("[attr]"):
            macros[m["plain"][6:]] = attributes
        elif attributes:
            glob = m["plain"] if m["quoted"] is None else re.sub(r'\\(["\\])', r"\1", m["quoted"])
            pattern = glob_regex(glob)
            if pattern:
                rules.append((pattern, attributes))
    return rules, macros


def declared_flags(relative_lines: list[tuple[str, str]]) -> tuple[bool | None, bool | None]:
    """(generated, vendored) of a file from its (relative path, attribute lines), outermost directory first."""
    state: dict[str, bool | None] = dict.fromkeys(_ATTRIBUTES)
    macros: dict[str, list[str]] = {}
    for relative, lines in relative_lines:
        rules, own = parse_attributes(lines)
        macros = macros | own
        for pattern, attributes in rules:
            if not pattern.match(relative):
                continue
            for a in attributes:
                name, _, value = a.lstrip("-!").partition("=")
                off = a.startswith("-") or value.lower() in ("false", "0", "no")
                # A macro sets what it stands for; without it, nothing else is said.
                for b in [name] if name in state else macros.get(name, []) if not off and not a.startswith("!") else []:
                    inner, _, said = b.lstrip("-!").partition("=")
                    if inner in state:
                        state[inner] = None if a.startswith("!") or b.startswith("!") else not (off or b.startswith("-") or said.lower() in ("false", "0", "no"))
    return state["linguist-generated"], state["linguist-vendored"]


def _declared(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``source_path, declared_generated, declared_vendored`` of the paths below a directory with an attribute file."""
    parts = F.split("source_path", "/")
    dirs = paths.select("source_path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir"))
    met = dirs.join(small_or_plain(rules), "dir").groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct(F.length("dir").alias("depth"), "dir", "lines"))).alias("found"))

    @F.pandas_udf("declared_generated boolean, declared_vendored boolean")
    def flags(path: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [declared_flags([(p[r["depth"] + (r["depth"] > 0) :], r["lines"]) for r in rs]) for p, rs in zip(path, found)]
        return pd.DataFrame(rows, columns=["declared_generated", "declared_vendored"], dtype=object)

    return met.select("source_path", flags("source_path", "found").alias("f")).select("source_path", "f.*")


def _repository() -> F.Column:
    return F.substring_index("source_path", "/", 1)


def _copied(measured: DataFrame) -> DataFrame:
    """``source_path, print, spread``: the texts of each path, once, and whether other repositories have them too."""
    prints = measured.where(F.col("print").isNotNull()).select("source_path", "print").distinct()
    spread = prints.select("print", _repository().alias("repository")).distinct().groupBy("print").agg((F.count(F.lit(1)) > 1).alias("spread"))
    return prints.join(spread, "print")


def _tokens(measured: DataFrame, paths: DataFrame) -> DataFrame:
    """``source_path, token``: what a pattern could be made of: directory names, the name's ending, phrases of the head comments."""
    parts = F.split("source_path", "/")
    directories = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda d: F.concat(F.lit("dir:"), d))
    ending = F.regexp_extract(F.substring_index("source_path", "/", -1), r"([._][a-z]{1,5})\.[A-Za-z0-9]+$", 1)
    endings = F.when(ending != "", F.array(F.concat(F.lit("end:"), ending))).otherwise(F.array().cast("array<string>"))
    names = paths.select("source_path", F.explode(F.array_distinct(F.concat(directories, endings))).alias("token"))
    says = measured.select("source_path", F.explode("says").alias("token")).distinct()
    return names.unionByName(says.select("source_path", F.concat(F.lit("say:"), "token").alias("token")))


def file_origins(chunks: DataFrame) -> DataFrame:
    """One row per code path: ``source_path, kind, reason``; ``kind`` is null for hand-written files."""
    rows = chunks.where(F.col("source_path").isNotNull())
    code = rows.where(_extension("source_path", "file_extension").isin(CODE_EXTENSIONS))
    squeezed = F.regexp_replace("chunk_text", r"\s+", " ")
    measured = cut(
        code.where(F.col("chunk_text").isNotNull())
        .select("source_path", "chunk_text", F.when(F.length("chunk_text") >= COPY_CHARS, F.xxhash64(squeezed)).alias("print"))
        .mapInPandas(_features, _FEATURES)
    )
    share = lambda c: (F.col("total") > 0) & (F.col(c) >= MACHINE_SHARE * F.col("total"))
    files = measured.groupBy("source_path").agg(*[F.sum(c).alias(c) for c in ("total", "minified", "machine")], F.max("marked").alias("marked"))
    files = files.select("source_path", F.when(share("minified"), "minified").when(F.col("marked"), "generated").when(share("machine"), "machine").alias("made"))
    texts = cut(_copied(measured))
    copied = texts.groupBy("source_path").agg((F.count_if("spread") * 2 >= F.count(F.lit(1))).alias("copied"))
    declared = _declared(files.select("source_path"), attribute_rules(rows))
    conventional = F.arrays_overlap(F.split(F.regexp_replace("source_path", r"[^/]*$", ""), "/"), F.array(*map(F.lit, DEPENDENCY_DIRECTORIES)))
    known = cut(
        files.join(declared, "source_path", "left").join(copied, "source_path", "left").select(
            "source_path", "made", "declared_generated", "declared_vendored", conventional.alias("conventional"),
            F.coalesce("declared_generated", F.col("made").isNotNull()).alias("is_made"), F.coalesce("declared_vendored", F.col("copied") | conventional, F.lit(False)).alias("is_copied"),
        )
    )
    # Patterns: what known files of several repositories have in common.
    named = cut(_tokens(measured, files).join(known.select("source_path", "is_made", "is_copied"), "source_path"))
    per_repository = named.groupBy("token", _repository().alias("repository")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_made").alias("made"), F.count_if("is_copied").alias("copied"))
    counted = per_repository.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "made", "copied")], F.count_if(F.col("made") > 0).alias("made_in"), F.count_if(F.col("copied") > 0).alias("copied_in"))
    holds = lambda c: (F.col("n") >= MINED_FILES) & (F.col(f"{c}_in") >= MINED_REPOSITORIES) & (F.col(c) >= MINED_SHARE * F.col("n"))
    mined = counted.select("token", F.when(holds("copied") & (~holds("made") | (F.col("copied") > F.col("made"))), "vendored").when(holds("made"), "generated").alias("stands_for"), F.greatest("made", "copied").alias("weight")).where("stands_for is not null")
    matched = named.select("source_path", "token").join(mined, "token").groupBy("source_path").agg(F.max(F.struct("weight", "token", "stands_for")).alias("m")).select("source_path", F.col("m.token").alias("token"), F.col("m.stands_for").alias("mined"))
    full = known.join(matched, "source_path", "left")
    kind = (
        F.when(F.col("declared_generated"), "generated").when(F.col("declared_vendored"), "vendored")
        .when(~F.coalesce("declared_generated", "declared_vendored", F.lit(True)), F.lit(None).cast("string"))
        .when(F.col("mined").isNotNull() & ((F.col("mined") == "vendored") | F.col("made").isNull()), F.col("mined")).otherwise(F.coalesce("made", F.when(F.col("conventional"), "vendored")))
    )
    reason = F.when(F.coalesce("declared_generated", "declared_vendored").isNotNull(), "attributes").otherwise(F.coalesce("token", F.when(F.col("made").isNotNull(), "content").otherwise("convention")))
    judged = cut(full.select("source_path", kind.alias("kind"), reason.alias("reason"), F.coalesce("declared_generated", "declared_vendored").isNull().alias("free")))
    # Text of a vendored copy, elsewhere; one row per (text, file), so a text in a third of all files stays splittable.
    third = texts.where("spread").join(judged.where("kind = 'vendored'"), "source_path", "left_semi").select("print").distinct()
    shared = texts.join(judged.where("kind is null and free"), "source_path", "left_semi").join(third.withColumn("hit", F.lit(1)), "print", "left").groupBy("source_path").agg((F.count("hit") * 2 >= F.count(F.lit(1))).alias("shares"))
    full = judged.join(shared.where("shares"), "source_path", "left")
    kind, reason = F.coalesce("kind", F.when(F.col("shares"), "vendored")), F.when(F.col("shares"), "shared text").otherwise(F.col("reason"))
    return full.select("source_path", kind.alias("kind"), F.when(kind.isNotNull(), reason).alias("reason"))


def not_hand_written(chunks: DataFrame) -> DataFrame:
    """The paths of generated, minified, vendored and data files, one row each."""
    return file_origins(chunks).where(F.col("kind").isNotNull()).select("source_path")


def hand_written_chunks(chunks: DataFrame) -> DataFrame:
    """All chunks but those of files nobody wrote by hand."""
    return chunks.join(not_hand_written(chunks), "source_path", "left_anti")
