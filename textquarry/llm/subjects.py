"""Subjects of documents by class-association rules.

Rules "these words, therefore this subject" are mined first in the sentences of the labelled examples, then, to learn the
words that the few examples lack, in the sentences of the whole corpus as the first rules label them. Mining is parallel
frequent-pattern growth, grown to the length of the rules: frequent words are found and ordered by frequency; every task
folds its sentences into a prefix tree with counts per label; the tree gives each word its conditional base, the paths of
more frequent words before it; a shuffle brings the bases of a word together, and the word's conditional tree is built and
grown there by the frequent words in it. The base of a very frequent word is grown in parts whose counts are summed before
the support is tested, and a sentence that stands in every document is one path, so neither makes a large group.

A rule is redundant, and pruned, if a part of its words gives the subject as surely. Confidences are calibrated on labelled
examples from which the rule wasn't mined: those of the corpus on all examples, those of the examples on each part of
them from which the other parts give the rule too. A sentence treats the subject for which its matching rules give the most
evidence, if that is enough; a document has every subject that at least a quarter of its sentences treat.

Null, blank and wordless texts have no subject; copies count like their originals; sentences of fewer than three words
(headings, marks) don't count; what has no sentence end is read in stretches of 200 words. Languages and sources play no
part. An empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.runtime import cut, small_or_plain

#: A document has a subject that this share of its sentences treats.
SHARE = 0.25
#: First rules: occurrences in the examples, and confidence.
SEED_COUNT, SEED_CONFIDENCE = 2, 0.7
#: Corpus rules: occurrences (at least the count, and this share of all sentences, which bounds the items and rules), confidence.
MIN_COUNT, MIN_SUPPORT, CONFIDENCE = 8, 2e-5, 0.6
#: Words are items only if this share of their sentences has one subject.
ITEM_SHARE = 0.4
#: A pair must be so much surer than each of its words.
GAIN = 0.02
#: Parts of the examples, each held out once to calibrate the rules of the others.
FOLDS = 4
#: Weight, in sentences, of a rule's confidence against what the examples say.
PRIOR = 10
EVIDENCE = 0.6
#: Most words of a sentence; labels that a task keeps for sentences of the same rule words.
STRETCH, TOLD = 200, 100_000
#: Nodes of a task's tree, and sentences of a word per part of its conditional base.
NODES, PART = 100_000, 200_000

_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,300}>")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_SPLIT = re.compile(r"(?<=[.?!…])[\"')\]]*\s+|\n\s*\n|\n(?=\s*(?:[-*+#>|]|\d+[.)]))")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_LEAD = re.compile(r"^\s*#{1,6}\s|\n[=~-]{3,}\s*$")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of a text, without mark-up, headings and code blocks."""
    text = text.replace("\r\n", "\n").lower()
    text = _TAG.sub("\n\n", text) if "<" in text else text
    text = _CODE.sub("\n\n", text) if "```" in text else text
    out = []
    for part in _SPLIT.split(text):
        if not part or len(part) < 80 and ("#" in part or "\n" in part) and _LEAD.search(part) and part.rstrip()[-1:] not in (".", "?", "!"):
            continue
        words = _WORD.findall(part)
        if len(words) < 3:
            continue
        for at in range(0, len(words), STRETCH):
            once = list(dict.fromkeys(words[at : at + STRETCH]))
            if len(once) >= 3:
                out.append(once)
    return out


class Rules:
    """Rules by their words, and the evidence they give in a sentence."""

    def __init__(self, rows: list[tuple[tuple[str, ...], str, float]]):
        self.one: dict[str, list[tuple[str, float]]] = defaultdict(list)
        self.two: dict[tuple[str, ...], list[tuple[str, float]]] = defaultdict(list)
        self.first: set[str] = set()
        self.told: dict[tuple[str, ...], tuple[str | None, dict[str, str | None]]] = {}
        for words, subject, confidence in rows:
            if len(words) == 1:
                self.one[words[0]].append((subject, confidence))
            else:
                self.two[tuple(sorted(words))].append((subject, confidence))
                self.first.update(words)

    def evidence(self, words: list[str]) -> dict[str, float]:
        """Per subject the probability that not all of its matching rules err; each word counts once per subject."""
        miss: dict[str, float] = {}
        for w in words:
            for s, c in self.one.get(w, ()):
                miss[s] = miss.get(s, 1.0) * (1 - c)
        if self.two:
            for pair in combinations(sorted(w for w in words if w in self.first), 2):
                for s, c in self.two.get(pair, ()):
                    miss[s] = min(miss.get(s, 1.0), 1 - c)
        return {s: 1 - m for s, m in miss.items()}

    def label(self, words: list[str]) -> str | None:
        """The subject with the most evidence, if it has enough and no other as much."""
        e = self.evidence(words)
        best = max(e.values(), default=0.0)
        first = [s for s, x in e.items() if x == best]
        return first[0] if best >= EVIDENCE and len(first) == 1 else None

    def labels(self, words: list[str]) -> tuple[str | None, dict[str, str | None]]:
        """The label of a sentence, and for each word that is a rule by itself the label that the others give.

        A rule must not confirm itself: what is learned of its word is taken from the other words.
        """
        own = tuple([w for w in words if w in self.one])
        if not own and not self.two:
            return None, {}
        # Only the own words tell one sentence from another, as long as there are no pairs.
        known = None if self.two else self.told.get(own)
        if known is None:
            told = words if self.two else own
            known = self.label(told), {w: self.label([x for x in told if x != w]) for w in own}
            if not self.two:
                if len(self.told) >= TOLD:
                    self.told.clear()
                self.told[own] = known
        return known


class PatternTree:
    """A prefix tree of word numbers, the most frequent first, with counts per label."""

    def __init__(self) -> None:
        self.items, self.parents = [-1], [0]
        self.marks: list[dict[str, int]] = [{}]
        self.children: list[dict[int, int]] = [{}]

    def add(self, path: Iterable[int], mark: str, n: int = 1) -> None:
        at = 0
        for item in path:
            below = self.children[at].get(item)
            if below is None:
                below = self.children[at][item] = len(self.items)
                self.items.append(item)
                self.parents.append(at)
                self.marks.append({})
                self.children.append({})
            at = below
        self.marks[at][mark] = self.marks[at].get(mark, 0) + n

    def _summed(self) -> list[dict[str, int]]:
        """The counts of each node with those below it."""
        out = [dict(m) for m in self.marks]
        for at in range(len(out) - 1, 0, -1):
            above = out[self.parents[at]]
            for mark, n in out[at].items():
                above[mark] = above.get(mark, 0) + n
        return out

    def bases(self) -> Iterator[tuple[int, tuple[int, ...], dict[str, int]]]:
        """The conditional bases: of each node its item, the path to it, and its counts."""
        paths: list[tuple[int, ...]] = [()]
        for at, marks in enumerate(self._summed()):
            if at:
                before = paths[self.parents[at]]
                paths.append((*before, self.items[at]))
                yield self.items[at], before, marks

    def grown(self, count: int, length: int) -> Iterator[tuple[tuple[int, ...], dict[str, int]]]:
        """The patterns of up to ``length`` items in at least ``count`` transactions, each grown in the conditional tree of its last item."""
        per: dict[int, Counter[str]] = defaultdict(Counter)
        below: dict[int, PatternTree] = defaultdict(PatternTree)
        for item, before, marks in self.bases():
            per[item].update(marks)
            if length > 1:
                for mark, n in marks.items():
                    below[item].add(before, mark, n)
        for item, marks in per.items():
            if sum(marks.values()) >= count:
                yield (item,), marks
                if length > 1:
                    yield from (((*body, item), said) for body, said in below[item].grown(count, length - 1))


#: Words of a rule.
RULE_WORDS = 2
_Base = tuple[str, tuple[str, ...], str, bool]


def seed_bases(words: list[str], others: dict[str, str | None], rules: Rules) -> tuple[list[str], list[_Base]]:
    """(the plain words of a sentence; the bases of its first rules as word, words before it, label, whether the word counts alone).

    Patterns with a word that is a first rule take the label of the rest of the sentence, and say nothing where it has none.
    """
    plain = [w for w in words if w not in others]
    seeds = [w for w in words if w in others]
    out: list[_Base] = []
    for i, b in enumerate(seeds):
        if others[b] is not None:
            out.append((b, tuple(plain), others[b], True))
        for a in seeds[:i]:
            rest = rules.label([x for x in seeds if x not in (a, b)]) if len(seeds) > 2 else None
            if rest is not None:
                out.append((b, (a,), rest, False))
    return plain, out


def add_patterns(counts: dict[str, Counter[tuple[str, str]]], words: list[str], label: str | None, others: dict[str, str | None], rules: Rules) -> None:
    """Count a sentence's patterns, under what is said of each ('' for nothing): what growth must give where nothing is too rare."""
    plain, bases = seed_bases(words, others, rules)
    for b, before, said, alone in [*((w, tuple(plain[:i]), label or "", True) for i, w in enumerate(plain)), *bases]:
        counts[said].update([(b, "")] * alone + [(a, b) if a < b else (b, a) for a in before])


def mine_rules(patterns: DataFrame, count: int, confidence: float) -> list[tuple[tuple[str, ...], str, float]]:
    """(words, subject, confidence) of the rules in counted patterns (``a, b, mark, n``), pruned."""
    per = patterns.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max(F.when(F.col("mark") != "", F.struct(F.col("n").alias("k"), "mark"))).alias("top"))
    sure = cut(per.where((F.col("top.k") >= count) & (F.col("top.k") >= confidence * F.col("n"))).select("a", "b", "top.mark", (F.col("top.k") / F.col("n")).alias("c")))
    alone = sure.where("b = ''").select(F.col("a").alias("w"), "mark", F.col("c").alias("c_alone"))
    # Redundant pairs go before anything is collected: their words may give the subject as surely.
    pairs = sure.where("b != ''")
    for side in ("a", "b"):
        single = alone.select(F.col("w").alias(side), "mark", F.col("c_alone").alias(f"c_{side}"))
        pairs = pairs.join(single, [side, "mark"], "left")
    better = pairs.where((F.coalesce("c_a", F.lit(0.0)) < F.col("c") - GAIN) & (F.coalesce("c_b", F.lit(0.0)) < F.col("c") - GAIN)).select("a", "b", "mark", "c")
    # A sentence has few patterns and each rule holds in a fixed share of all sentences: a bounded number of rows.
    rows = sure.where("b = ''").select("a", "b", "mark", "c").unionByName(better).collect()
    return sorted(((r["a"], r["b"]) if r["b"] else (r["a"],), r["mark"], r["c"]) for r in rows)


def _sentence_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(s, ws) for s, t in zip(pdf["subject"], pdf["text"]) for ws in sentences(t)]
        yield pd.DataFrame(rows, columns=["subject", "words"])


def example_sentences(examples: DataFrame) -> DataFrame:
    clean = examples.where(F.col("text").isNotNull() & F.col("subject").isNotNull()).select("subject", "text")
    return clean.mapInPandas(_sentence_rows, "subject string, words array<string>")


def _items(rows: DataFrame, share: float, count: int) -> DataFrame:
    """``word, subject, share, all``: words seen often enough, mostly with one subject, that subject's share, and how often."""
    top = rows.groupBy("word").agg(F.sum("n").alias("all"), F.max(F.when(F.col("subject") != "", F.struct("n", "subject"))).alias("top"))
    told = F.coalesce("top.n", F.lit(0))
    return top.where((F.col("all") >= count) & (told >= share * F.col("all"))).select("word", "top.subject", (told / F.col("all")).alias("share"), "all")


def seed_rules(examples: DataFrame) -> list[tuple[tuple[str, ...], str, float]]:
    """Rules of the labelled examples, of one word each, calibrated: the examples are too few to tell pairs from chance."""
    parts = [example_sentences(examples.where(F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == f)).withColumn("fold", F.lit(f)) for f in range(FOLDS)]
    rows = reduce(DataFrame.unionByName, parts).select("subject", "fold", F.explode("words").alias("word"))
    words = cut(rows.groupBy("word", "subject", "fold").agg(F.count(F.lit(1)).alias("n")))
    found = _items(words.groupBy("word", "subject").agg(F.sum("n").alias("n")), SEED_CONFIDENCE, SEED_COUNT)
    folds = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(FOLDS)]
    hits = [F.sum(F.when((F.col("fold") == f) & (F.col("subject") == F.col("said")), F.col("n")).otherwise(0)).alias(f"k{f}") for f in range(FOLDS)]
    counted = words.join(found.select("word", F.col("subject").alias("said"), "share"), "word").groupBy("word", "said", "share").agg(*folds, *hits)
    n, k = (reduce(lambda x, y: x + y, [F.col(f"{c}{f}") for f in range(FOLDS)]) for c in "nk")
    out_n, out_k = F.lit(0), F.lit(0)
    for f in range(FOLDS):
        others_k, others_n = k - F.col(f"k{f}"), n - F.col(f"n{f}")
        holds = (others_k >= SEED_COUNT) & (others_k >= SEED_CONFIDENCE * others_n)
        out_n, out_k = out_n + F.when(holds, F.col(f"n{f}")).otherwise(0), out_k + F.when(holds, F.col(f"k{f}")).otherwise(0)
    confidence = (PRIOR * F.col("share") + out_k) / (PRIOR + out_n)
    # No more rules than words in the examples, a bounded sample.
    return sorted(((r["word"],), r["said"], r["c"]) for r in counted.select("word", "said", confidence.alias("c")).collect())


def calibrated(rules: list[tuple[tuple[str, ...], str, float]], rows: list[tuple[str, list[str]]]) -> list[tuple[tuple[str, ...], str, float]]:
    """The rules with confidences drawn towards what the labelled sentences say of them."""
    n: Counter[tuple[str, ...]] = Counter()
    k: Counter[tuple[tuple[str, ...], str]] = Counter()
    bodies = {w for w, _, _ in rules}
    pairs = {x for w in bodies if len(w) > 1 for x in w}
    for subject, words in rows:
        for body in [(w,) for w in words if (w,) in bodies] + [p for p in combinations(sorted(x for x in words if x in pairs), 2) if p in bodies]:
            n[body] += 1
            k[(body, subject)] += 1
    return [(w, s, (PRIOR * c + k[(w, s)]) / (PRIOR + n[w])) for w, s, c in rules]


def count_words(documents: DataFrame, seeds: list[tuple[tuple[str, ...], str, float]]) -> DataFrame:
    """``word, subject, n``: sentences of each word by the subject that the first rules give them; all sentences under ''.

    Sentences in which only the word itself speaks for a subject say nothing of it.
    """
    seeded = documents.sparkSession.sparkContext.broadcast(seeds)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = Rules(seeded.value)
        counts: dict[str, Counter[str]] = defaultdict(Counter)
        total = 0

        def drain() -> pd.DataFrame:
            out = pd.DataFrame([(w, s, n) for s, c in counts.items() for w, n in c.items()] + [("", "", total)], columns=["word", "subject", "n"])
            counts.clear()
            return out

        for pdf in batches:
            for text in pdf["text"]:
                for words in sentences(text):
                    s, others = rules.labels(words)
                    total += 1
                    counts[s or ""].update([w for w in words if w not in others] if others else words)
                    for w, o in others.items():
                        if o:
                            counts[o][w] += 1
            if sum(map(len, counts.values())) > 200_000:
                yield drain()
                total = 0
        yield drain()

    texts = documents.where(F.col("text").isNotNull()).select("text")
    return texts.mapInPandas(counted, "word string, subject string, n long").groupBy("word", "subject").agg(F.sum("n").alias("n"))


_REDUCED = "doc_id long, n_sentences int, sentences array<array<string>>"


def reduce_sentences(documents: DataFrame, items: set[str]) -> DataFrame:
    """Per document its number of sentences and, of those with any, the item words."""
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            parts = [sentences(t) for t in pdf["text"]]
            kept = [[k for k in ([w for w in words if w in known] for words in p) if k] for p in parts]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_sentences": [len(p) for p in parts], "sentences": kept})

    return documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(reduced, _REDUCED)


def count_patterns(reduced: DataFrame, seeds: list[tuple[tuple[str, ...], str, float]], often: dict[str, int], count: int) -> DataFrame:
    """``a, b, mark, n``: how many sentences have the pattern, by what the first rules say of it; ``often``: sentences of each word.

    Rarer patterns than ``count`` are left out where the whole base of a word is in one part.
    """
    first = {w for body, _, _ in seeds for w in body}
    # First rules come last: their bases have all plain words, under the labels that leave them out.
    order = sorted(often, key=lambda w: (w in first, -often[w], w))
    shared = reduced.sparkSession.sparkContext.broadcast((seeds, order, [1 + often[w] // PART for w in order]))
    nodes, length = NODES, RULE_WORDS

    def based(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, order, parts = shared.value
        rules, rank = Rules(rows), {w: i for i, w in enumerate(order)}
        tree, own = PatternTree(), Counter()

        def drain() -> pd.DataFrame:
            every = [(i, array("i", before).tobytes(), m, n, True) for i, before, marks in tree.bases() for m, n in marks.items()]
            every += [(i, array("i", before).tobytes(), m, n, alone) for (i, before, m, alone), n in own.items()]
            out = pd.DataFrame(every, columns=["item", "base", "mark", "n", "alone"])
            out["part"] = [crc32(base) % parts[i] for i, base in zip(out["item"], out["base"])]
            return out

        for pdf in batches:
            for kept in pdf["sentences"]:
                for words in kept:
                    words = words.tolist()
                    label, others = rules.labels(words)
                    plain, bases = seed_bases(words, others, rules)
                    ranks = tuple(sorted([rank[w] for w in plain]))
                    tree.add(ranks, label or "")
                    for w, before, said, alone in bases:
                        # A pair of first rules always lies in the base of the same one.
                        i, path = (rank[w], ranks) if alone else (max(rank[w], rank[before[0]]), (min(rank[w], rank[before[0]]),))
                        own[(i, path, said, alone)] += 1
                if len(tree.items) + len(own) > nodes:
                    yield drain()
                    tree, own = PatternTree(), Counter()
        yield drain()

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, order, parts = shared.value
        item = int(key[0])
        least = count if parts[item] == 1 else 1
        tree, alone = PatternTree(), Counter()
        for base, mark, n, counts in zip(pdf["base"], pdf["mark"], pdf["n"].tolist(), pdf["alone"]):
            tree.add(memoryview(base).cast("i"), mark, n)
            if counts:
                alone[mark] += n
        last = order[item]
        out = [(last, "", m, n) for m, n in alone.items()]
        for body, marks in tree.grown(least, length - 1):
            a, b = sorted((order[body[0]], last))
            out += [(a, b, m, n) for m, n in marks.items()]
        return pd.DataFrame(out, columns=["a", "b", "mark", "n"])

    bases = reduced.select("sentences").mapInPandas(based, "item int, base binary, mark string, n long, alone boolean, part int")
    return bases.groupBy("item", "part").applyInPandas(grow, "a string, b string, mark string, n long").groupBy("a", "b", "mark").agg(F.sum("n").alias("n"))


_TREATED = "doc_id long, n_sentences int, subject string, treated int"


def treated_subjects(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, subject, treated``: how many sentences of a document treat a subject."""
    spark = documents.sparkSession
    seeds = seed_rules(examples)
    stats = cut(count_words(documents, seeds))
    total = stats.where("word = ''").agg(F.sum("n")).first()[0] or 0
    count = max(MIN_COUNT, int(MIN_SUPPORT * total))
    # The support bounds the items: a sentence has few words, and an item is in this share of all sentences.
    frequent = {r["word"]: r["all"] for r in _items(stats.where("word != ''"), ITEM_SHARE, count).select("word", "all").collect()}
    # First rules that the corpus refutes are dropped; those it is too small to judge stay.
    words = sorted({w for body, _, _ in seeds for w in body})
    tested = {r["word"]: r["share"] for r in _items(stats.where(F.col("word").isin(words)), 0.0, count).collect()} if words else {}
    seeds = [r for r in seeds if tested.get(r[0][0], 1.0) >= CONFIDENCE]
    kept = {w for body, _, _ in seeds for w in body}
    often = dict.fromkeys(kept, 0) | {r["word"]: r["n"] for r in stats.where(F.col("word").isin(words)).groupBy("word").agg(F.sum("n").alias("n")).collect() if r["word"] in kept} | frequent
    reduced = cut(reduce_sentences(documents, set(often)))
    corpus = mine_rules(count_patterns(reduced, seeds, often, count), count, CONFIDENCE)
    known = {(w, s) for w, s, _ in corpus}
    # A rule of the examples stays where the corpus has too few sentences to say anything.
    final = calibrated(corpus, [(r["subject"], r["words"]) for r in example_sentences(examples).collect()])
    final += [r for r in seeds if (r[0], r[1]) not in known and not all(w in frequent for w in r[0])]
    shared = spark.sparkContext.broadcast(final)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = Rules(shared.value)
        for pdf in batches:
            rows = []
            for doc_id, n, parts in zip(pdf["doc_id"], pdf["n_sentences"], pdf["sentences"]):
                found = Counter(filter(None, (rules.label(list(words)) for words in parts)))
                rows += [(doc_id, n, s, k) for s, k in found.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "n_sentences", "subject", "treated"])

    return reduced.mapInPandas(score, _TREATED)


def document_subjects(documents: DataFrame, examples: DataFrame, subjects: DataFrame) -> DataFrame:
    """``doc_id, subject``: the subjects of each document, of those in ``subjects``."""
    names = subjects.select("subject").distinct()
    found = treated_subjects(documents, examples).where(F.col("treated") >= SHARE * F.col("n_sentences"))
    return found.join(small_or_plain(names), "subject", "left_semi").select("doc_id", "subject").distinct()


def composition(documents: DataFrame, examples: DataFrame, subjects: DataFrame) -> DataFrame:
    """``subject, documents, share``: the make-up of the corpus by subject; several subjects count in each."""
    n = documents.select("doc_id").count()
    per = document_subjects(documents, examples, subjects).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return subjects.select("subject").distinct().join(per, "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.coalesce("documents", F.lit(0)) / F.lit(max(n, 1)), 6).alias("share"))
