"""Inverted index with block maxima: exact threshold and top-k search for sparse vectors.

Items are numbered and cut into blocks of consecutive numbers. For every term the index holds the blocks that contain it with the largest
weight there, and the postings of each such block. A search adds block maxima first; a block whose bound stays below the threshold is
never opened. Terms whose largest weight is very small (``light``) are not even looked up for the bounds: their sum is added as slack.
Results are the same as scoring every item.

A threshold search takes many queries at once and works on whole arrays; a top-k search opens blocks in the order of their bounds
and keeps long posting lists as whole rows.
"""

from __future__ import annotations

import numpy as np

from .common import ship

BLOCK = 8
DENSE = 16


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return np.arange(total) + jump


def sum_by(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(value, first)


class BlockMax:
    """Index over vectors given as (item, term, weight) triples; weights are positive, a pair (item, term) occurs once."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, items: int, terms: int, block: int = BLOCK):
        order = np.lexsort((item, term))
        self.item, term, self.weight = item[order].astype(np.int64), term[order].astype(np.int64), weight[order].astype(np.float64)
        self.items, self.terms, self.block = items, terms, block
        self.blocks = max(1, -(-items // block))
        key = term * self.blocks + self.item // block
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.key = key[first]  # sorted: term, block
        self.at = np.concatenate([first, [len(key)]]).astype(np.int64)  # where its postings begin
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.own = self.key % self.blocks
        bounds = np.searchsorted(self.key, np.arange(terms + 1) * self.blocks)
        self.start, self.size = bounds[:-1], np.diff(bounds)
        self.most = np.zeros(terms)
        np.maximum.at(self.most, self.key // self.blocks, self.top)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] | None = None

    def search(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, least: float, light: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) with score >= least > 0. A pair (query, term) occurs once; rows sorted by query."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(query) or not len(self.item):
            return none
        least -= 1e-9
        bound = self.most[term] * weight
        heavy = bound > light
        slack_at, slack_of = sum_by(query[~heavy], bound[~heavy])
        # a query that light terms alone could carry to the threshold has none
        heavy |= np.isin(query, slack_at[slack_of >= least / 2])
        slack_at, slack_of = sum_by(query[~heavy], bound[~heavy])
        q, t, w = query[heavy], term[heavy], weight[heavy]
        size = self.size[t]
        posting = ranges(self.start[t], size)
        key, bound = sum_by(np.repeat(q, size) * self.blocks + self.own[posting], np.repeat(w, size) * self.top[posting])
        kq = key // self.blocks
        if len(slack_at):
            spot = np.minimum(np.searchsorted(slack_at, kq), len(slack_at) - 1)
            bound = bound + np.where(slack_at[spot] == kq, slack_of[spot], 0.0)
        key = key[bound >= least]
        if not len(key):
            return none
        # open the blocks that are left, for all terms of their queries
        kq, kb = key // self.blocks, key % self.blocks
        lo, hi = np.searchsorted(query, kq), np.searchsorted(query, kq, side="right")
        rows = ranges(lo, hi - lo)
        pair = np.repeat(np.arange(len(key)), hi - lo)
        want = term[rows] * self.blocks + kb[pair]
        spot = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = self.key[spot] == want
        spot, pair, rows = spot[hit], pair[hit], rows[hit]
        size = self.at[spot + 1] - self.at[spot]
        posting = ranges(self.at[spot], size)
        found, score = sum_by(np.repeat(kq[pair], size) * self.items + self.item[posting], np.repeat(weight[rows], size) * self.weight[posting])
        good = score >= least
        return found[good] // self.items, found[good] % self.items, score[good]

    def dense(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """term -> its weights as (block, place in the block) and their maxima, for terms that one item in ``DENSE`` has; at most ``DENSE`` numbers a posting.
        Built when first asked for and not sent along."""
        if self.rows is None:
            self.rows = {}
            count = self.at[self.start + self.size] - self.at[self.start]
            for t in np.flatnonzero(count * DENSE >= self.items).tolist():
                lo, hi = self.at[self.start[t]], self.at[self.start[t] + self.size[t]]
                row = np.zeros(self.blocks * self.block)
                row[self.item[lo:hi]] = self.weight[lo:hi]
                row = row.reshape(self.blocks, self.block)
                self.rows[t] = row, row.max(axis=1)
        return self.rows

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rows": None}

    def best(self, term: np.ndarray, weight: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k items with the largest positive scores, largest first; ties by item number."""
        dense, query = self.dense(), list(zip(term.tolist(), weight.tolist()))
        bounds = np.zeros(self.blocks)
        for t, x in query:
            if t in dense:
                bounds += x * dense[t][1]
            else:
                at = slice(self.start[t], self.start[t] + self.size[t])
                bounds[self.own[at]] += x * self.top[at]
        block = np.flatnonzero(bounds)
        bound = bounds[block]
        items, scores = np.zeros(0, np.int64), np.zeros(0)
        order = np.lexsort((block, -bound))
        bound = bound[order]
        block = block[order]
        place = np.full(self.blocks, -1, np.int64)
        start, step, end = 0, 16, len(block)
        while start < end:
            part = block[start:min(start + step, end)]
            start, step = start + step, step * 4
            place[:] = -1
            place[part] = np.arange(len(part))
            every = np.zeros((len(part), self.block))
            for t, x in query:
                if t in dense:
                    every += x * dense[t][0].take(part, axis=0)
                else:
                    lo, hi = self.at[self.start[t]], self.at[self.start[t] + self.size[t]]
                    spot = place[self.item[lo:hi] // self.block]
                    here = spot >= 0
                    every[spot[here], self.item[lo:hi][here] % self.block] += x * self.weight[lo:hi][here]
            at, inside = np.nonzero(every)
            more, score = part[at] * self.block + inside, every[at, inside]
            if len(more) > k:  # only what reaches the k-th best can stay
                enough = score >= np.partition(score, len(score) - k)[len(score) - k]
                more, score = more[enough], score[enough]
            items, scores = np.concatenate([items, more]), np.concatenate([scores, score])
            order = np.lexsort((items, -scores))[:k]
            items, scores = items[order], scores[order]
            if len(items) == k:
                end = int(np.searchsorted(-bound, 1e-12 - scores[-1], side="right"))  # blocks with bound >= the k-th best
        return list(zip(items.tolist(), scores.tolist()))


ship(__name__)
