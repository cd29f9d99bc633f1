import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.operators.chunking import chunker_of, code_chunks, code_parts, header_sections, token_windows
from textquarry.operators.recursive_split import PROSE, recursive_split, separators_of, split_text


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def windows(text, size, overlap):
    words, out, start = text.split(), [], 0
    width, lap = int(size / 1.3), int(overlap / 1.3)
    while start < len(words) and width:
        end = min(start + width, len(words))
        a = len(" ".join(words[:start])) + (start > 0)
        out.append((" ".join(words[start:end]), a, len(" ".join(words[:end]))))
        if end == len(words):
            break
        start = max(end - lap, start + 1)
    return out


@pytest.mark.parametrize(("size", "overlap"), [(4, 2), (2, 0), (3, 9), (512, 50), (1, 0)])
def test_token_windows(spark, size, overlap):
    values = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 2, 3, 9, 10, 11)] + ["a\t b\n\nc d é", None, "  "]
    got = {}
    for r in token_windows(texts(spark, *values), "text", ["id"], size, overlap).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append((r["chunk_text"], r["start_char"], r["end_char"]))
    assert got == {i: w for i, t in enumerate(values) if (w := windows(t or "", size, overlap))}


def test_long_texts_take_linear_time(spark):
    million, sections, code = "word " * 1_000_000, "# Head\n" + ("# Part\n" + "x" * 60 + "\n") * 60_000, "def f():\n" + ("  x\n" * 6 + "def f():\n") * 60_000
    frame = texts(spark, million, sections, code).cache()
    frame.count()
    start = time.time()
    assert token_windows(frame.where("id = 0"), "text", ["id"], 512, 50).count() > 2000
    assert header_sections(frame.where("id = 1"), "text", ["id"]).count() == 60_000
    assert code_parts(frame.where("id = 2"), "text", ["id"]).count() == 60_001
    assert time.time() - start < 20
    frame.unpersist()


def test_plans_have_no_shuffle_and_no_array(spark):
    frame = texts(spark, "a b")
    for out in (token_windows(frame, "text", ["id"]), header_sections(frame, "text", ["id"]), code_parts(frame, "text", ["id"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "array" not in plan


def test_header_sections(spark):
    body = "x" * 60
    values = [f"# A\nshort\n# B\n{body}\n## C\nend", "# A\nshort\n# B\nx", "plain text", None, "", f"intro {body}\n```\n# Usage\n```\n{body}"]
    got = {}
    for r in header_sections(texts(spark, *values), "text", ["id"]).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append((r["chunk_text"], r["parent_section"], r["start_char"], r["end_char"]))
    assert got[0] == [(f"# B\n{body}", "B", 10, 74), ("## C\nend", "C", 75, 83)]
    assert got[1] == [(values[1], None, 0, 15)] and got[2] == [("plain text", None, 0, 10)] and set(got) == {0, 1, 2, 5}
    assert [s for _, s, _, _ in got[5]] == [None, "Usage"]
    assert all(values[i][a:b] == t for i, rows in got.items() for t, _, a, b in rows)


def boundary_parts(text):
    parts, have, at = [], [], 0
    start = 0
    for line in text.split("\n"):
        s = line.strip()
        cut = s.startswith(("def ", "class ", "function ", "const ", "var ", "let ")) or (s.startswith(("public ", "private ", "protected ")) and any(k in line for k in ("function", "class", "def")))
        if cut and len(have) > 5:
            parts.append(("\n".join(have), start, at - 1))
            have, start = [line], at
        else:
            have.append(line)
        at += len(line) + 1
    return [*parts, ("\n".join(have), start, len(text))]


def test_code_parts(spark):
    block = "def f_%d(self):\n" + "    x = 1\n" * 7
    values = ["import a\n\n" + "".join(block % i for i in range(3)), "x = 1", "public class A {\n" + "  int a;\n" * 8 + "  private def b;\n}", None, ""]
    got = {}
    for r in code_parts(texts(spark, *values), "text", ["id"]).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append((r["chunk_text"], r["start_char"], r["end_char"]))
    assert got == {i: boundary_parts(values[i]) for i in (0, 1, 2)}
    split = code_chunks(texts(spark, values[0], "x = 1"), "text", ["id"], 12, 2).orderBy("id", "chunk_no").collect()
    assert all(len(r["chunk_text"].split()) <= 9 for r in split) and split[-1]["chunk_text"] == "x = 1"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. \n;", max_size=300), st.integers(10, 60), st.integers(0, 9))
def test_recursive_split_model(text, size, overlap):
    spans = split_text(text, size, overlap, PROSE)
    assert all(0 < b - a <= size and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def split_model(text, size, overlap, separators):
    """The same cuts on strings: split before the coarsest separator that occurs, merge, strip."""
    def pieces(t, seps):
        sep = next((s for s in seps if s == "" or s in t), seps[-1])
        if sep == "":
            return list(t)
        rest = seps[seps.index(sep) + 1 :]
        head, *tail = t.split(sep)
        parts = [head] if head else []
        parts += [sep + x for x in tail]
        return [q for p in parts for q in (pieces(p, rest) if len(p) >= size and rest else [p])]

    chunks, held = [], []
    for p in pieces(text, separators):
        if held and sum(map(len, held)) + len(p) > size:
            chunks.append("".join(held).strip())
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                held.pop(0)
        held.append(p)
    chunks.append("".join(held).strip())
    return [c for c in chunks if c]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n;f", max_size=200), st.integers(10, 60), st.integers(0, 9), st.sampled_from(["py", "go", None]))
def test_recursive_split_is_its_model(text, size, overlap, language):
    separators = separators_of(language) or PROSE
    assert [text[a:b] for a, b in split_text(text, size, overlap, separators)] == split_model(text, size, overlap, separators)


def test_recursive_split(spark):
    rows = recursive_split(texts(spark, "One two. " * 200, None, "  ", "é" * 100), "text", "id", 16, 4).collect()
    assert {r["id"] for r in rows} == {0, 3} and max(len(r["chunk_text"]) for r in rows) <= 64
    code = spark.createDataFrame([(1, "class A:\n    x = 1\n\ndef f():\n    return 2\n" * 5, "py")], "id long, text string, ext string")
    assert all(re.match("class|def", r["chunk_text"]) for r in recursive_split(code, "text", "id", 10, 0, "ext").collect())
    assert separators_of("tsx")[0] == "\nenum " and separators_of("xyz") is None


def test_offsets_as_searched(spark):
    text = "aa bb. aa bb. cc dd. " * 6
    rows = {m: recursive_split(texts(spark, text), "text", "id", 5, 2, offsets=m).orderBy("chunk_no").collect() for m in ("exact", "compat")}
    assert [r["chunk_text"] for r in rows["exact"]] == [r["chunk_text"] for r in rows["compat"]]
    at = 0
    for r in rows["compat"]:
        found = text.find(r["chunk_text"], at)
        at = (found if found >= 0 else at) + len(r["chunk_text"])
        assert r["end_char"] == at and r["start_char"] == at - len(r["chunk_text"])
    assert all(text[r["start_char"] : r["end_char"]] == r["chunk_text"] for r in rows["exact"])


def test_dispatch(spark):
    rows = spark.createDataFrame([("code", "py"), ("code", "h"), ("document", "py"), ("document", None)], "k string, e string").select(chunker_of(F.col("k"), F.col("e")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["language", "code", "document", "document"]
