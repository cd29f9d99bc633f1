import random
import time
from collections import Counter, defaultdict

from textquarry.llm import subjects
from textquarry.llm.subjects import PatternTree, Rules, add_patterns, composition, count_patterns, document_subjects, mine_rules, sentences

NOUNS = {"sport": "striker penalty coach stadium referee goal".split(), "law": "verdict tribunal statute witness plaintiff appeal".split()}
PLAIN = "letter window morning folder table reader".split()


def sentence(rng, words):
    return f"The {rng.choice(words)} changed the {rng.choice(words)} near the {rng.choice(PLAIN)}."


def build(spark):
    rng = random.Random(3)
    examples = [(i, s, "en", " ".join([sentence(rng, NOUNS[s][:4]) for _ in range(3)] + [sentence(rng, PLAIN)])) for i, s in enumerate(["sport", "law"] * 12)]
    docs, truth = [], {}
    for i in range(240):
        kind = ["sport", "law", "both", "none"][i % 4]
        parts = {"sport": [NOUNS["sport"]] * 6, "law": [NOUNS["law"]] * 6, "both": [NOUNS["sport"]] * 3 + [NOUNS["law"]] * 3, "none": []}[kind] + [PLAIN] * 2
        docs.append((i, " ".join(sentence(rng, w) for w in parts), "x", "y"))
        truth[i] = {"both": {"sport", "law"}, "none": set()}.get(kind, {kind})
    docs += [(900, None, "x", "y"), (901, "", "x", "y"), (902, "two words", "x", "y"), (903, docs[0][1], "x", "y"), (904, "The table changed. " * 5000, "x", "y")]
    truth[903] = truth[0]
    return spark.createDataFrame(docs, "doc_id long, text string, subject string, label string"), spark.createDataFrame(examples, "example_id long, subject string, lang string, text string"), spark.createDataFrame([("sport", ""), ("law", "")], "subject string, description string"), truth


def test_accuracy_on_held_out_documents(spark):
    docs, examples, subjects, truth = build(spark)
    found = {}
    for r in document_subjects(docs, examples, subjects).collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    want = {(d, s) for d, ss in truth.items() for s in ss}
    got = {(d, s) for d, ss in found.items() for s in ss}
    assert len(want & got) / len(want) >= 0.95 and len(want & got) / len(got) >= 0.95 and not got & {(d, s) for d in (900, 901, 902, 904) for s in NOUNS}
    rows = {r["subject"]: r["documents"] for r in composition(docs, examples, subjects).collect()}
    assert rows["sport"] == sum(s == "sport" for _, s in got)


def test_empty_tables(spark):
    docs, examples, subjects, _ = build(spark)
    assert document_subjects(docs.limit(0), examples, subjects).count() == 0
    assert document_subjects(docs.limit(20), examples.limit(0), subjects).count() == 0


def test_sentences():
    assert sentences("# Title here now\n\nOne two three. Four five six!\n\n- Seven eight nine\n```\ncode code code\n```") == [["one", "two", "three"], ["four", "five", "six"], ["seven", "eight", "nine"]]
    assert sentences("<p>Ein Satz hier.</p>") == [["ein", "satz", "hier"]]


def test_copied_sentences_of_ambiguous_words_cost_little(spark):
    docs, examples, subjects, _ = build(spark)
    words = [f"amb{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    long = " ".join(words) + " striker."
    copies = spark.createDataFrame([(2000 + i, long, "x", "y") for i in range(40)] + [(3000, " ".join(words * 2000), "x", "y")], docs.schema)
    start = time.time()
    found = {r["doc_id"]: r["subject"] for r in document_subjects(docs.unionByName(copies), examples, subjects).collect() if r["doc_id"] >= 2000}
    assert time.time() - start < 60 and {d for d in found if d < 3000} == set(range(2000, 2040)) and set(found.values()) == {"sport"}


def test_pairs_beat_their_words_and_are_counted_once():
    rules = Rules([(("goal",), "sport", 0.9)])
    words = ["goal", "the", "witness"]
    counts = defaultdict(Counter)
    add_patterns(counts, words, *rules.labels(words), rules)
    assert counts["sport"] == {("the", ""): 1, ("the", "witness"): 1, ("witness", ""): 1} and set(counts) == {"sport"}  # nothing confirms "goal" itself
    rules = Rules([(("goal",), "sport", 0.9), (("coach",), "sport", 0.9), (("judge",), "law", 0.7)])
    counts = defaultdict(Counter)
    add_patterns(counts, ["the", "goal", "coach", "judge"], *rules.labels(["the", "goal", "coach", "judge"]), rules)
    assert counts["sport"] == {("the", ""): 1, ("goal", ""): 1, ("coach", ""): 1, ("judge", ""): 1, ("goal", "the"): 1, ("coach", "the"): 1, ("judge", "the"): 1, ("goal", "judge"): 1, ("coach", "judge"): 1}
    assert counts["law"] == {("coach", "goal"): 1}


def test_patterns_grow_from_conditional_trees(spark, monkeypatch):
    tree = PatternTree()
    for path, mark in [((0, 1, 2), "x"), ((0, 1, 2), "y"), ((0, 2), "x"), ((1, 2), "x"), ((0, 1), "")]:
        tree.add(path, mark)
    grown = {body: dict(marks) for body, marks in tree.grown(2, 3)}
    assert grown[(0,)] == {"x": 2, "y": 1, "": 1} and grown[(0, 1)] == {"x": 1, "y": 1, "": 1} and grown[(0, 1, 2)] == {"x": 1, "y": 1} and len(grown) == 7
    assert {body for body, _ in tree.grown(3, 3)} == {(0,), (1,), (2,), (0, 1), (0, 2), (1, 2)}
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["goal", "coach", "judge"]
    sent = [rng.sample(words, rng.randint(1, 9)) for _ in range(400)]
    seeds = [(("goal",), "sport", 0.9), (("coach",), "sport", 0.8), (("judge",), "law", 0.7)]
    want, rules = defaultdict(Counter), Rules(seeds)
    for s in sent:
        add_patterns(want, s, *rules.labels(s), rules)
    full = {(a, b, m): n for m, c in want.items() for (a, b), n in c.items()}
    often = Counter(w for s in sent for w in s)
    reduced = spark.createDataFrame([(i, 1, [s]) for i, s in enumerate(sent)], "doc_id long, n_sentences int, sentences array<array<string>>")
    monkeypatch.setattr(subjects, "NODES", 60)
    for part in (10**6, 50):  # bases whole, and in parts
        monkeypatch.setattr(subjects, "PART", part)
        got = {(r["a"], r["b"], r["mark"]): r["n"] for r in count_patterns(reduced, seeds, often, 1).collect()}
        assert got == full
    monkeypatch.setattr(subjects, "PART", 10**6)
    got = {(r["a"], r["b"]) for r in count_patterns(reduced, seeds, often, 50).where("b != ''").collect()}
    sums = Counter()
    for (a, b, _), n in full.items():
        sums[(a, b)] += n
    assert got == {p for p, n in sums.items() if p[1] and n >= 50} and got


def test_mined_rules_are_pruned(spark):
    rows = [("a", "", "x", 90), ("a", "", "", 10), ("b", "", "x", 50), ("b", "", "", 50), ("a", "b", "x", 30), ("c", "", "x", 60), ("c", "", "", 40), ("b", "c", "x", 20), ("b", "c", "", 1), ("a", "c", "x", 91), ("a", "c", "", 9), ("d", "", "x", 3)]
    got = {(w, s) for w, s, _ in mine_rules(spark.createDataFrame(rows, "a string, b string, mark string, n long"), 8, 0.6)}
    assert got == {(("a",), "x"), (("c",), "x"), (("a", "b"), "x"), (("b", "c"), "x")}
