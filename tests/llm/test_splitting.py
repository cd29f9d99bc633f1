from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm.splitting import oversized, pieces, split_oversized


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,é#", max_size=400), st.integers(5, 60), st.integers(0, 40))
def test_pieces_cover_the_text(text, limit, overlap):
    out = pieces(text, limit, overlap)
    end = 0
    for k, (a, b) in enumerate(out):
        assert b - a <= limit and a <= end < b or (not text)
        assert k == 0 or end - a <= overlap
        end = b
    assert end == len(text)


def test_boundaries_and_limits(spark, chunks):
    limits = spark.createDataFrame([("code", 60, 10), ("document", 80, 20)], "source_type string, max_chars int, overlap_chars int")
    prose = "One two three four five.\n\nSix seven eight nine ten eleven twelve.\n\nThirteen fourteen fifteen sixteen seventeen."
    df = chunks([(1, "a.md", prose, 0), (2, "b.md", "x" * 200, 0), (3, "c.md", "short", 0), (4, "d.md", None, 0), (5, "e.md", " " * 100, 0), (6, "f.md", "", 0)])
    rows = split_oversized(df, limits).orderBy("vec_id", "piece_no").collect()
    mine = [r for r in rows if r["vec_id"] == 1]
    assert all(prose[r["start_char"] : r["end_char"]] == r["piece_text"] and len(r["piece_text"]) <= 80 for r in mine)
    assert mine[0]["piece_text"].endswith("\n\n") and [r["piece_no"] for r in mine] == list(range(1, mine[0]["n_pieces"] + 1))
    found = {r["vec_id"]: r["cut"] for r in oversized(df, limits).collect()}
    assert found == {1: "soft", 2: "hard", 5: "soft"}
    code = chunks([(1, "a.py", "y " * 40, 0)], "code")
    assert split_oversized(code, limits).count() >= 2 and oversized(chunks([]), limits).count() == 0


def test_long_text_is_quick(spark, chunks):
    limits = spark.createDataFrame([("document", 1200, 100)], "source_type string, max_chars int, overlap_chars int")
    text = "A sentence of some words, with a clause; and an end. " * 20_000
    assert split_oversized(chunks([(1, "a.md", text, 0)]), limits).count() > len(text) / 1200
