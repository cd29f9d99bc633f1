"""Evaluation items inside the texts of a corpus: which document contains which item, and where.

Texts are read as words without case, mark-up, accents of form, zero-width characters and escapes. The documents of a
task are indexed in shards of bounded size (an FM-index over word numbers; words of no item are one symbol); all phrases
of three words of all items are searched backwards at once and located. An item is a candidate for a text that has
enough of its phrases; to find the candidates without going through all items of a phrase that many share, only the
rarest phrases of an item lead to it, so many that no candidate can do without one of them. From the phrases the words
are followed in both directions over a few foreign ones; the runs so found, near each other or far apart, give in order
the coverage and the spans to remove. An instruction that an item shares with many others that are not like it is no leak
by itself: some of the item's own words must be there.

The work needs no shuffle: shards are formed within the tasks that read the table. Longer texts are indexed in
overlapping windows, whose finds are put together before anything is followed. Null and blank texts give no row; copies
of a leaking document leak too; items shorter than three words are ignored, null ids and texts too; an id given with two
texts is found by either. The items are sent to the tasks in parts of bounded size, one pass over the texts each.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.fm_index import FMIndex

#: Words of a shard, words of a window of a very long text.
SHARD_WORDS, WINDOW_WORDS = 200_000, 100_000
PHRASE = 3
#: Share of an item's words that makes a leak; runs may be broken by so many foreign words, and need so many own ones.
COVERAGE, GAP, RUN_WORDS = 0.4, 3, 4
#: Share of an item's phrases, and number of them, that a text must have before the words are compared: few, since words may be scattered.
NEED_SHARE, NEED = 0.12, 2
#: Phrases in so many times as many items as the rarest quarter of an item's phrases are an instruction it shares with others.
SHARED_TIMES = 6
#: A phrase that an item repeats is followed from at most so many of its places, evenly chosen; runs reach beyond them.
PLACES = 16
#: Characters of item text that are sent to the tasks at once.
PART_CHARS = 8 << 20

_BLANK = lambda m: " " * len(m.group())
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>|<!--.{0,300}?-->|&(?:nbsp|quot|amp|lt|gt|apos|#160|#39|#34);|\\[nrt](?![a-z]{0,2}\\)|\\u(?:00a0|200b|2028|2029)|%20", re.S)
_WORD = re.compile(r"(?:[^\W_]|[​-‏­﻿⁠̀-ͯ]|&#?[A-Za-z0-9]{2,8};|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|(?:%[0-9A-F]{2})+)+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_MARKED = re.compile(r"[<&\\%]")
_ODD = re.compile(r"[&\\%]|[^\x00-\x7f]")


def _word(raw: str) -> str:
    if not _ODD.search(raw):
        return raw.lower()
    w = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), html.unescape(raw))
    if "%" in w:
        from urllib.parse import unquote

        w = unquote(w, errors="ignore")
    w = unicodedata.normalize("NFKC", unicodedata.normalize("NFC", w)).casefold()
    return "".join(ch for ch in w if ch.isalnum())


def _raw_words(text: str) -> list[str]:
    return _WORD.findall(_TAG.sub(_BLANK, text) if _MARKED.search(text) else text)


def words_of(text: str) -> list[str]:
    """The normalised words of a text."""
    return [w for w in map(_word, _raw_words(text)) if w]


def placed_words(text: str) -> list[tuple[int, int]]:
    """The (start, end) of each normalised word in the text as it is."""
    return [m.span() for m in _WORD.finditer(_TAG.sub(_BLANK, text)) if _word(m.group())]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Items:
    """Evaluation items as word numbers, and their phrases; built once and sent to the tasks."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.words: list[list[int]] = []
        self.ids: list[int] = []
        for item_id, text in rows:
            ws = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text or "")]
            if len(ws) >= PHRASE:
                self.ids.append(item_id)
                self.words.append(ws)
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        flat = np.array([n for w in self.words for n in w], dtype=np.int64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - PHRASE + 1, 0))
        at = _ranges(ends - sizes, ends - PHRASE + 1)
        base = len(self.number) + 1
        pairs, pair = np.unique(flat[at] * base + flat[at + 1] if len(at) else at, return_inverse=True)
        keys, phrase = np.unique(pair * base + flat[at + 2] if len(at) else at, return_inverse=True)
        first = pairs[keys // base] if len(keys) else keys
        self.phrases = np.stack([first // base, first % base, keys % base], axis=1)
        #: Phrases of each item in the order of its words.
        self.item_phrases = np.split(phrase, np.cumsum(np.bincount(owner, minlength=len(sizes)))[:-1]) if len(sizes) else []
        # Each phrase of an item once, the rarest first.
        once = np.unique(owner * max(len(keys), 1) + phrase)
        item, own = once // max(len(keys), 1), once % max(len(keys), 1)
        spread = np.bincount(own, minlength=len(keys))
        order = np.lexsort((own, spread[own], item))
        item, own = item[order], own[order]
        self.kinds = np.bincount(item, minlength=len(sizes))
        self.need = np.minimum(self.kinds, np.maximum(NEED, (NEED_SHARE * sizes).astype(np.int64)))
        self.starts = np.concatenate([[0], np.cumsum(self.kinds)])
        self.own = own
        # Words of each item before each place that aren't only part of shared phrases; those of variants of one text all are its own.
        self.own_words = []
        for w, ph in zip(self.words, self.item_phrases):
            rare = np.flatnonzero(spread[ph] <= SHARED_TIMES * np.sort(spread[ph])[(len(ph) - 1) // 4])
            mine = np.zeros(len(w), dtype=np.int64)
            for k in range(PHRASE):
                mine[rare + k] = 1
            self.own_words.append(np.concatenate([[0], np.cumsum(mine)]))
        # With one phrase fewer than needed left out, every candidate has one of those that lead to it.
        leads = np.arange(len(own)) - self.starts[item] < (self.kinds - self.need + 1)[item]
        by_phrase = np.argsort(own[leads], kind="stable")
        self.led = item[leads][by_phrase]
        self.led_from = np.concatenate([[0], np.cumsum(np.bincount(own[leads], minlength=len(keys)))])

    def candidates(self, present: np.ndarray) -> np.ndarray:
        """Items of which enough phrases are among these (sorted, each once)."""
        found = np.unique(self.led[_ranges(self.led_from[present], self.led_from[present + 1])])
        if not len(found):
            return found
        own = self.own[_ranges(self.starts[found], self.starts[found + 1])]
        spot = np.minimum(np.searchsorted(present, own), len(present) - 1)
        have = np.add.reduceat((present[spot] == own).astype(np.int64), np.cumsum(self.kinds[found]) - self.kinds[found])
        return found[have >= self.need[found]]


class _Numbers(dict):
    """The number of a word as written: 0 for words of no item, -1 for what isn't a word."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, raw: str) -> int:
        if len(self) > 500_000:
            self.clear()
        w = _word(raw)
        n = self[raw] = self.number.get(w, 0) if w else -1
        return n

    def of(self, text: str) -> list[int]:
        return [n for n in map(self.__getitem__, _raw_words(text)) if n >= 0]


Run = tuple[int, int, int, int, int]


def _follow(item: list[int], text: list[int], p: int, w: int, way: int) -> list[tuple[int, int]]:
    """Matches (place in the text, in the item) from a place on, forwards or backwards, over at most GAP foreign words at a time.

    They end where they outnumber the foreign words most: words that are foreign every other time are no longer the item's.
    """
    out: list[tuple[int, int]] = []
    score = most = end = 0
    while score > most - 2 * GAP:
        for dw, dp in _STEPS:
            x, y = w + way * dw, p + way * dp
            if 0 <= x < len(text) and 0 <= y < len(item) and text[x] == item[y]:
                out.append((x, y))
                w, p = x + way, y + way
                score += 1 - max(dw, dp)
                break
        else:
            break
        if score > most:
            most, end = score, len(out)
    return out[:end]


#: Words left out in the text and in the item before the next match: replaced words first.
_STEPS = sorted(((a, b) for a in range(GAP + 1) for b in range(GAP + 1)), key=lambda s: (max(s), abs(s[0] - s[1])))


def matched_runs(item: list[int], text: list[int], seeds: list[tuple[int, int]]) -> list[Run]:
    """(start in the text, end, matched words, start in the item, end) of the runs through the seeds (place in the text, in the item) of a phrase."""
    seen: dict[int, int] = {}  # by difference of the places: how far in the text it is part of a run
    runs = []
    for w, p in sorted(seeds):
        if seen.get(w - p, -1) >= w:
            continue
        back, ahead = _follow(item, text, p - 1, w - 1, -1), _follow(item, text, p, w, 1)
        for x, y in ahead:
            seen[x - y] = max(x, seen.get(x - y, -1))
        first = back[-1] if back else ahead[0]
        runs.append((first[0], ahead[-1][0] + 1, len(back) + len(ahead), first[1], ahead[-1][1] + 1))
    return [r for r in runs if r[2] >= min(RUN_WORDS, len(item))]


def best_chain(length: int, runs: list[Run]) -> tuple[int, list[Run]]:
    """(words, runs) of the runs that together give most of an item of ``length`` words, in order in text and item.

    Where the next run repeats words of the item that the chain already has, these count once.
    """
    runs = sorted(set(runs))
    best = np.full(length + 1, -1, dtype=np.int64)  # words of a chain that ends at a word of the item
    last = np.full(length + 1, -1, dtype=np.int64)  # its last run
    best[0] = 0
    behind = np.full(len(runs), -1, dtype=np.int64)
    open_: list[tuple[int, int, int]] = []  # by end: runs that may not be continued yet
    steps = np.arange(length + 1)

    def close(upto: float) -> None:
        while open_ and open_[0][0] <= upto:
            _, j, words = heapq.heappop(open_)
            if words > best[runs[j][4]]:
                best[runs[j][4]], last[runs[j][4]] = words, j

    for j, (start, end, size, a, b) in enumerate(runs):
        close(start)
        fresh = size - np.maximum(0, steps[:b] - a)
        gain = np.where((best[:b] >= 0) & (fresh > 0), best[:b] + fresh, -1)
        at = int(gain.argmax())
        behind[j] = last[at]
        heapq.heappush(open_, (end, j, int(gain[at])))
    close(float("inf"))
    at = int(best.argmax())
    chain, j = [], int(last[at])
    while j >= 0:
        chain.append(runs[j])
        j = int(behind[j])
    return int(best[at]), chain[::-1]


_LEAKS = "doc_id long, item_id long, coverage double, spans array<struct<start_char:int,end_char:int>>"


class _Text:
    """A text of a task, with the (phrase, place) pairs that its windows gave so far."""

    def __init__(self, doc_id: int, text: str, numbers: list[int]):
        self.doc_id, self.text, self.numbers = doc_id, text, numbers
        self.phrases: list[np.ndarray] = []
        self.places: list[np.ndarray] = []


def _search(items: Items, windows: list[tuple[_Text, int]]) -> None:
    """Add the phrases found in the windows (text, first word) of a shard to their texts."""
    kept: list[np.ndarray] = []
    spots: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    for d, (text, start) in enumerate(windows):
        a = np.array(text.numbers[start : start + WINDOW_WORDS] + [0], dtype=np.int64)
        # Foreign words in a row are one symbol.
        use = np.flatnonzero((a > 0) | (np.concatenate([[1], a[:-1]]) > 0))
        kept.append(a[use])
        spots.append(use + start)
        owner.append(np.full(len(use), d))
    tokens, spot, own = np.concatenate(kept), np.concatenate(spots), np.concatenate(owner)
    index = FMIndex(tokens, len(items.number) + 1)
    low, high = index.search(items.phrases)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return
    at = index.locate(_ranges(low[hit], high[hit]))
    which = np.repeat(hit, (high - low)[hit])
    by_window = np.argsort(own[at], kind="stable")
    which, at = which[by_window], at[by_window]
    bounds = np.searchsorted(own[at], np.arange(len(windows) + 1))
    for d, (text, _) in enumerate(windows):
        if bounds[d] < bounds[d + 1]:
            text.phrases.append(which[bounds[d] : bounds[d + 1]])
            text.places.append(spot[at[bounds[d] : bounds[d + 1]]])


def _text_leaks(items: Items, text: _Text) -> Iterator[tuple]:
    """Leaks of a text all windows of which were searched."""
    if not text.phrases:
        return
    phrases, places = np.concatenate(text.phrases), np.concatenate(text.places)
    order = np.lexsort((places, phrases))
    phrases, places = phrases[order], places[order]
    spans: list[tuple[int, int]] = []
    for i in items.candidates(np.unique(phrases)).tolist():
        item, mine = items.words[i], items.item_phrases[i]
        low, high = np.searchsorted(phrases, mine), np.searchsorted(phrases, mine, "right")
        chosen = np.flatnonzero(high > low)
        if len(chosen) > len(np.unique(mine[chosen])):
            # Places of a repeated phrase of the item.
            by_phrase = np.split(chosen[np.argsort(mine[chosen], kind="stable")], np.unique(np.sort(mine[chosen]), return_index=True)[1][1:])
            chosen = np.concatenate([g if len(g) <= PLACES else g[np.linspace(0, len(g) - 1, PLACES).astype(np.int64)] for g in by_phrase])
        at = places[_ranges(low[chosen], high[chosen])]
        seeds = set(zip(at.tolist(), np.repeat(chosen, (high - low)[chosen]).tolist()))
        words, chain = best_chain(len(item), matched_runs(item, text.numbers, seeds))
        mine = items.own_words[i]
        own = sum(min(r[2], int(mine[r[4]] - mine[r[3]])) for r in chain)
        if words >= COVERAGE * len(item) and own >= min(int(mine[-1]), max(RUN_WORDS, NEED_SHARE * int(mine[-1]))):
            spans = spans or placed_words(text.text)
            yield text.doc_id, items.ids[i], round(words / len(item), 6), [{"start_char": spans[r[0]][0], "end_char": spans[r[1] - 1][1]} for r in chain]


def _find_part(documents: DataFrame, shared: Broadcast) -> DataFrame:
    """Leaks of the items of a part."""

    def leaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: Items = shared.value
        numbers = _Numbers(items.number)
        windows: list[tuple[_Text, int]] = []
        whole: list[_Text] = []
        total = 0

        def shard() -> pd.DataFrame:
            """Search the windows; the leaks of the texts that end in them. The one still being read stays."""
            _search(items, windows)
            rows = [row for t in whole for row in _text_leaks(items, t)]
            windows.clear()
            whole.clear()
            return pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage", "spans"])

        if not len(items.phrases):
            return
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                t = _Text(doc_id, text, numbers.of(text))
                # Windows overlap so that no phrase is cut; an item may lie across any number of them.
                starts = range(0, max(1, len(t.numbers) - PHRASE + 1), WINDOW_WORDS - PHRASE + 1)
                for start in starts:
                    windows.append((t, start))
                    total += min(WINDOW_WORDS, len(t.numbers) - start)
                    if start == starts[-1]:
                        whole.append(t)
                    if total >= SHARD_WORDS:
                        yield shard()
                        total = 0
        if windows:
            yield shard()

    return documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(leaks, _LEAKS)


def find_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id, item_id, coverage, spans`` of every document that contains enough of an item."""
    sc = documents.sparkSession.sparkContext
    clean = eval_items.select("item_id", "item_text").where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).distinct()
    size = clean.agg(F.sum(F.length("item_text"))).first()[0] or 0
    parts = max(1, -(-size // PART_CHARS))
    found = []
    for part in range(parts):
        rows = clean.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts)) == part).collect()
        found.append(_find_part(documents, sc.broadcast(Items(sorted(map(tuple, rows))))))
    return reduce(DataFrame.unionByName, found)


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id, item_id``, one row per pair."""
    return find_leaks(documents, eval_items).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id, start_char, end_char``: the passages to remove, overlapping and touching ones merged."""
    spans = find_leaks(documents, eval_items).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    empty = F.array().cast("array<struct<start_char:int,end_char:int>>")

    def step(done: F.Column, s: F.Column) -> F.Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start_char"].alias("start_char"), F.greatest(last["end_char"], s["end_char"]).alias("end_char"))))
        return F.when((F.size(done) > 0) & (s["start_char"] <= F.try_element_at(done, F.lit(-1))["end_char"] + 1), joined).otherwise(F.concat(done, F.array(s)))

    merged = F.aggregate("spans", empty, step)
    return spans.select("doc_id", F.explode(merged).alias("s")).select("doc_id", "s.start_char", "s.end_char")
