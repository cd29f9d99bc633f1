import pytest

from textquarry.llm.scan_repair import apply_repairs, defects, plain, repair_candidates, repair_cost, repair_pages

CLEAN = "The modern morning during the autumn covered the table, and the hand-made window filled another afternoon while the bridge carried every visitor.\n" * 8
PAGES = [
    "12    Linn Minutes\nThe modcrn morning covered the ta-\nble during the autumn. The win-\ndow filled an0ther hand-\nmade bridge.",
    "13    Linn Minutes\nThe briclge carried every visitor. under H2O 10k.\nTools\n69\n1876\nwhile the rnorning filled it.",
    "Notes of the Bench    14\nAnother afternoon covered the window.",
]


def rows(df):
    return {tuple(r) for r in defects(df).collect()}


def test_costs():
    assert repair_cost(plain("forrnal"), "formal") == pytest.approx(0.3) and repair_cost(plain("thircl"), "third") == pytest.approx(0.3)
    assert repair_cost("cat", "dog") > 1 and plain("ﬁlled") == "filled" and plain("heávy") == "heavy" and plain("a9a!nst") == "against"


def test_candidates_of_wide_misreadings(spark):
    stands_for = {"tlie": "the", "rny": "my", "rnay": "may", "clo": "do", "tbc": "the", "rnornentum": "momentum", "rnornenturn": "momentum", "moming": "morning", "burnt": None}
    right = sorted({w for w in stands_for.values() if w})
    words = spark.createDataFrame([(w, 100, 0) for w in right] + [(w, 1, 1) for w in stands_for], "word string, n long, paged long")
    got = {(r["read"], r["fixed"]) for r in repair_candidates(words).collect()}
    assert got == {(r, f) for r, f in stands_for.items() if f}


def test_defects(chunks):
    df = chunks([(0, "r/a.md", CLEAN, 0)] + [(i + 1, "r/scans/box.pdf", t, 0) for i, t in enumerate(PAGES)] + [(9, "r/docs/report.pdf", CLEAN, 0)])
    got = rows(df)
    assert got == {
        (1, 1, "header", ""), (2, 1, "header", ""), (3, 1, "header", ""), (1, 2, "glyph", "modern"), (1, 2, "hyphen", "table"), (1, 3, "hyphen", "window"), (1, 4, "glyph", "another"),
        (2, 2, "glyph", "bridge"), (2, 6, "glyph", "morning"),
    }
    texts = {r["vec_id"]: r["repaired_text"] for r in repair_pages(df).collect()}
    assert texts[1] == "The modern morning covered the table during the autumn. The window filled another hand- made bridge." and texts[3] == "Another afternoon covered the window."


def test_page_numbers(chunks):
    pages = [(i, "r/scans/p.pdf", f"LINN ANNUAL\n\nThe window covered the table.\n\n{i + 40}", 0) for i in range(1, 4)]
    got = rows(chunks([(0, "r/a.md", CLEAN, 0)] + pages))
    assert got == {(i, 1, "header", "") for i in range(1, 4)} | {(i, 5, "page_no", "") for i in range(1, 4)}
    marked = chunks([(0, "r/a.md", CLEAN, 0), (1, "r/s.pdf", "The window covered the table.\n— 2S —", 0)])
    assert rows(marked) == {(1, 2, "page_no", "")}


def test_running_titles_recur_and_section_headings_stay(chunks):
    page = "The window covered the table.\n\n{}\n\nAnother afternoon covered the bridge.\n\n{}"
    heads = ["Linn Modern Annual", "Linn Modcrn Annual", "Linn Moclern Annual", "Coverage Of Tables"]
    got = rows(chunks([(0, "r/a.md", CLEAN, 0)] + [(i, "r/scans/p.pdf", page.format(h, i + 40), 0) for i, h in enumerate(heads, 1)] + [(9, "r/scans/p.pdf", "45\n\nAppendix Of Notes\n\nThe window covered the table.", 0)]))
    assert {r for r in got if r[2] == "header"} == {(i, 3, "header", "") for i in (1, 2, 3, 9)}


def test_edge_cases(chunks):
    assert rows(chunks([])) == set()
    df = chunks([(1, None, "p. 3", 0), (2, "r/a.pdf", None, 0), (3, "r/a.pdf", "", 0), (4, "r/b.pdf", "p. 3", 0), (4, "r/b.pdf", "p. 3", 0), (5, "r/c.pdf", "word " * 50_000, 0), (None, "r/d.pdf", "p. 4", 0)])
    assert rows(df) == {(4, 1, "page_no", "")}


def test_apply_repairs_keeps_the_rest():
    assert apply_repairs("TITLE\nA line\nand an-\nother.\n\nNext.", [(1, "header", ""), (3, "hyphen", "another")]) == "A line and another.\n\nNext."
