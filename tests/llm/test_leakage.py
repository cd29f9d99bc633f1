import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm import leakage
from textquarry.llm.fm_index import FMIndex
from textquarry.llm.leakage import best_chain, find_leaks, leaked_items, removal_spans, words_of

ITEM = "Read the passage and choose the best answer. While Ebr moved the trial, 61 formal crates behind Grigorin almost covered one injunction. Iskwick counts 50 rows of charter, so one precedent fills 15 pages whenever Grimond crossed another first."
FILL = "The table covered the window during the long break. "
OTHER = "Nobody sings under cold water here. "


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=5))
def test_index_finds_every_occurrence(text, patterns):
    index = FMIndex(np.array(text), 5)
    low, high = index.search(np.array(patterns))
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(text) - 2) if text[i : i + 3] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def frames(spark, docs, items=((1, ITEM),)):
    return spark.createDataFrame(docs, "doc_id long, text string, coverage string, spans string"), spark.createDataFrame([(i, t) for i, t in items], "item_id long, item_text string")


def test_leaks(spark):
    words = ITEM.split()
    half = " ".join(words[9:28])
    variants = {
        1: ITEM, 2: FILL * 3 + half + " " + FILL, 3: ITEM.upper().replace(" ", "  "), 4: "<p>" + ITEM.replace("formal", "<b>formal</b>") + "</p>", 5: ITEM.replace("a", "a​").replace("61", "６１"),
        6: " ".join(w + (" indeed" if i % 7 == 6 else "") for i, w in enumerate(words)), 7: "Read the passage and choose the best answer. " + FILL * 4, 8: " ".join(sorted(words)), 9: " ".join(words[12:20]), 10: None, 11: "", 12: ITEM, 13: FILL * 2000 + ITEM + FILL * 2000,
        14: " ".join(f"{w}&nbsp;" for w in words),
    }
    docs, items = frames(spark, [(i, t, None, None) for i, t in variants.items()])
    assert {r["doc_id"] for r in leaked_items(docs, items).collect()} == {1, 2, 3, 4, 5, 6, 12, 13, 14}
    spans = {r["doc_id"]: (r["start_char"], r["end_char"]) for r in removal_spans(docs, items).collect()}
    assert variants[2][slice(*spans[2])] == half.rstrip(".,") and variants[13][slice(*spans[13])] == ITEM.rstrip(".")


def test_edge_cases(spark):
    docs, items = frames(spark, [])
    assert leaked_items(docs, items).count() == 0
    docs, none = frames(spark, [(1, ITEM, None, None)], [(1, None), (2, "two words"), (3, "")])
    assert find_leaks(docs, none).count() == 0
    docs, twice = frames(spark, [(1, ITEM, None, None), (1, ITEM, None, None)], [(1, ITEM), (2, ITEM)])
    assert {tuple(r) for r in leaked_items(docs, twice).collect()} == {(1, 1), (1, 2)}
    assert words_of("Café café &eacute;té \\u00e9t") == ["café", "café", "été", "ét"]


def test_runs_far_apart(spark):
    words = ITEM.split()
    first, second = " ".join(words[9:19]), " ".join(words[25:35])
    far, farther = OTHER * 60, OTHER * 16_800  # 360 and 100,800 words: the latter crosses windows
    variants = {1: OTHER + first + " " + far + second + " " + OTHER, 2: OTHER + second + " " + far + first + " " + OTHER, 3: OTHER + first + " " + far, 4: first + " " + farther + second, 5: first + " " + far + first, 6: OTHER * 16_665 + " ".join(words[9:35])}
    docs, items = frames(spark, [(i, t, None, None) for i, t in variants.items()])
    found = {r["doc_id"]: r["coverage"] for r in find_leaks(docs, items).collect()}
    assert set(found) == {1, 4, 6} and found[1] == found[4] == round(20 / len(words_of(ITEM)), 6)
    spans = {i: [] for i in found}
    for r in removal_spans(docs, items).orderBy("doc_id", "start_char").collect():
        spans[r["doc_id"]].append(variants[r["doc_id"]][r["start_char"] : r["end_char"]])
    assert spans[1] == spans[4] == [first.rstrip(".,"), second.rstrip(".,")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6), st.integers(0, 14)), max_size=6))
def test_best_chain_is_best(drawn):
    runs = sorted({(b, b + n, n, a, a + n) for b, n, a in drawn})
    want = 0
    for mask in range(1 << len(runs)):
        end, at, words = 0, 0, 0
        for r in (r for j, r in enumerate(runs) if mask >> j & 1):
            fresh = r[2] - max(0, at - r[3])
            if r[0] < end or fresh <= 0:
                break
            end, at, words = r[1], r[4], words + fresh
        else:
            want = max(want, words)
    words, chain = best_chain(20, runs)
    assert words == want and chain == sorted(chain)


@pytest.mark.parametrize("number", [8, 50, 500])
def test_variants_of_one_item_are_all_found(spark, number):
    words = ITEM.split()
    items = [(i, " ".join(f"w{i}" if k == 20 else w for k, w in enumerate(words))) for i in range(number)]
    docs, table = frames(spark, [(1, items[3][1], None, None), (2, " ".join(words[:9]), None, None), (3, FILL * 5, None, None)], items)
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, table).collect()} == {(1, i) for i in range(number)}


def test_a_shared_instruction_is_no_leak(spark):
    items = [(i, "Read the passage and choose the best answer. " + " ".join(f"{a}{i}" for a in "kor lum tas ven dar mik sol ruf pel gan tir bos".split())) for i in range(60)]
    docs, table = frames(spark, [(i, items[i][1], None, None) for i in range(0, 60, 7)], items)
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, table).collect()} == {(i, i) for i in range(0, 60, 7)}


def test_long_item_over_the_edges_of_windows(spark, monkeypatch):
    item = " ".join(f"v{i * 7919 % 3001}" for i in range(3000))
    other = "Nobody sings under cold water here. "
    docs, table = frames(spark, [(1, other * 16_450 + item + " " + other * 10, None, None), (2, other * 16_665 + " ".join(item.split()[500:1750]), None, None)], [(1, item)])
    found = [(r["doc_id"], r["coverage"], len(r["spans"])) for r in find_leaks(docs, table).orderBy("doc_id").collect()]
    assert found == [(1, 1.0, 1), (2, round(1250 / 3000, 6), 1)]


def test_items_in_parts_and_scattered_words(spark, monkeypatch):
    words = [f"u{i}" for i in range(1200)]
    broken = [w if i % 7 else "x y"[:1 + 2 * (i % 2)] for i, w in enumerate(words)]
    cut = [*words[:400]]
    for at in range(20, 400, 25):
        cut[at] += " a b c d e"  # more runs than a few
    items = [(1, " ".join(words)), (2, ITEM), (3, "the the the the the the"), (4, "one two three")]
    docs, table = frames(spark, [(1, " ".join(broken), None, None), (2, " ".join(cut) + " " + " ".join(words[400:500]), None, None), (3, "the " * 5000, None, None), (4, "so one two three", None, None)], items)
    whole = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, table).collect()}
    assert whole == {(1, 1), (2, 1), (3, 3), (4, 4)}
    monkeypatch.setattr(leakage, "PART_CHARS", 300)
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, table).collect()} == whole
