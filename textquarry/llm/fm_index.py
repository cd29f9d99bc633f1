"""An FM-index over integer tokens: backward search by ranks in a wavelet matrix, location by sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: One suffix position in so many is stored; the others are reached by walking backwards.
SAMPLING = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order, by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = new
        step *= 2
        if rank.max() == n - 1 or step >= n:
            return order


class FMIndex:
    """Index of a token sequence (values from 0); 0 is reserved for what no pattern contains."""

    def __init__(self, tokens: np.ndarray, alphabet: int):
        s = np.concatenate([tokens.astype(np.int64) + 1, [0]])  # a unique smallest end
        self.n, self.size = len(s), alphabet + 1
        sa = suffix_array(s)
        self.last = s[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=self.size))])
        self.bits = max(1, int(self.size - 1).bit_length())
        self.ranks: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = self.last
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int32))
            self.zeros.append(int(len(one) - one.sum()))
            level = np.concatenate([level[one == 0], level[one == 1]])
        marked = sa % SAMPLING == 0
        self.marked = marked
        self.mark_rank = np.concatenate([[0], np.cumsum(marked)])
        self.kept = sa[marked]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position of the last column."""
        low, high = np.zeros_like(at), at.copy()
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            r = self.ranks[k]
            rl, rh = r[low], r[high]
            low, high = np.where(one, self.zeros[k] + rl, low - rl), np.where(one, self.zeros[k] + rh, high - rh)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each pattern (one per row, equal lengths)."""
        count = len(patterns)
        low, high = np.zeros(count, dtype=np.int64), np.full(count, self.n, dtype=np.int64)
        alive = np.arange(count)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k].astype(np.int64) + 1
            if k == patterns.shape[1] - 1:
                low[alive], high[alive] = self.first[c], self.first[c + 1]
            else:
                low[alive] = self.first[c] + self.rank(c, low[alive])
                high[alive] = self.first[c] + self.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        rows = rows.astype(np.int64).copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        out = np.empty(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.marked[rows[open_]]
            ready = open_[done]
            out[ready] = self.kept[self.mark_rank[rows[ready]]] + steps[ready]
            open_ = open_[~done]
            c = self.last[rows[open_]]
            rows[open_] = self.first[c] + self.rank(c, rows[open_])
            steps[open_] += 1
        return out
