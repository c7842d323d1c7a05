"""Pair merging over ragged NumPy arrays: many symbol sequences advance together, a round at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NONE = np.iinfo(np.int64).max


class PairTable:
    """Mergeable pairs of symbols: their rank (lowest merges first) and the symbol they become."""

    def __init__(self, left, right, rank, result, n_symbols: int):
        left, right, rank, result = (np.asarray(x, np.int64) for x in (left, right, rank, result))
        self.n, self.rank, self.result = n_symbols, rank, result
        self._index(left * n_symbols + right)
        # A merge may be done at all its places at once unless what it makes
        # takes part in a pair of lower rank, which would then come first.
        lowest = np.full(n_symbols, NONE)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.settled = lowest[self.result] > self.rank

    def _index(self, keys: np.ndarray) -> None:
        """Open-addressing hash table of the keys: slot -> key, index."""
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_pair = np.full(1 << bits, -1, np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 1
        while todo.size:
            free = self.slot_key[slot] < 0
            _, lead = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[lead]
            self.slot_key[slot[put]], self.slot_pair[slot[put]] = keys[todo[put]], todo[put]
            left = np.ones(todo.size, bool)
            left[put] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask
            self.probes += bool(todo.size)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, -1 where it does not merge."""
        key = left * self.n + right
        slot = self._slot(key)
        found = self.slot_key[slot]
        out = np.where(found == key, self.slot_pair[slot], -1).astype(np.int64)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        slot = slot[open_]
        for _ in range(self.probes):
            if not open_.size:
                break
            slot = (slot + 1) & self.mask
            found, want = self.slot_key[slot], key[open_]
            hit = found == want
            out[open_[hit]] = self.slot_pair[slot[hit]]
            more = ~hit & (found >= 0)
            open_, slot = open_[more], slot[more]
        return out


def merge(table: PairTable, symbols: np.ndarray, lengths: np.ndarray,
          dropped: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray] | None = None,
          ) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its end; returns the surviving symbols and their number per sequence.

    In each round every sequence applies its lowest-rank pair (leftmost first,
    without overlap).  ``dropped(sequence, place, pair, round)`` marks candidates
    to skip in this round; a sequence whose candidates are all skipped is done.
    """
    n = len(lengths)
    seq = np.repeat(np.arange(n, dtype=np.int64), lengths)
    sym = np.asarray(symbols, np.int64)
    pair = np.full(sym.size, -1, np.int64)
    if sym.size:
        pair[:-1] = np.where(seq[1:] == seq[:-1], table.find(sym[:-1], sym[1:]), -1)
    out_sym, out_seq, turn = [], [], 0
    while sym.size:
        lead = np.ones(sym.size, bool)
        np.not_equal(seq[1:], seq[:-1], out=lead[1:])
        first = np.flatnonzero(lead)
        seg = np.cumsum(lead) - 1
        cand = np.flatnonzero(pair >= 0)
        if dropped is not None and cand.size:
            cand = cand[~dropped(seq[cand], cand - first[seg[cand]], pair[cand], turn)]
        rank = np.full(sym.size, NONE)
        rank[cand] = table.rank[pair[cand]]
        best = np.minimum.reduceat(rank, first)
        live = (best < NONE)[seg]
        if not live.all():
            out_sym.append(sym[~live])
            out_seq.append(seq[~live])
        at = cand[rank[cand] == best[seg[cand]]]
        if at.size:
            # leftmost only, where a merge at all places could come out of order
            loose = ~table.settled[pair[at]]
            if loose.any():
                front = np.ones(at.size, bool)
                front[1:] = seg[at[1:]] != seg[at[:-1]]
                at = at[~loose | front]
            run = np.concatenate([[True], np.diff(at) != 1])
            start = np.maximum.accumulate(np.where(run, np.arange(at.size), 0))
            at = at[(np.arange(at.size) - start) % 2 == 0]
            sym[at] = table.result[pair[at]]
            live[at + 1] = False
        now = (np.cumsum(live) - 1)[at]
        sym, seq, pair = sym[live], seq[live], pair[live]
        # only pairs with a new symbol have to be looked up again
        touched = np.zeros(sym.size, bool)
        touched[now] = True
        touched[now[now > 0] - 1] = True
        near = np.flatnonzero(touched)
        pair[near] = -1
        near = near[near + 1 < sym.size]
        near = near[seq[near] == seq[near + 1]]
        pair[near] = table.find(sym[near], sym[near + 1])
        turn += 1
    if not out_sym:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    sym, seq = np.concatenate(out_sym), np.concatenate(out_seq)
    order = np.argsort(seq, kind="stable")
    return sym[order], np.bincount(seq, minlength=n).astype(np.int64)
