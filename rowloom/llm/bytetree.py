"""Byte context trees over words, as sorted arrays that numpy can search.

A word is spelled START, its bytes, STOP; the end of a text is START, END. An item is a string of symbols and the context
before it; its symbols' contexts may reach back to the beginning of the item's own context. A context of depth d and the symbol after it make one integer key: depth in bits 56 and up, the context's bytes
below (the oldest highest), the symbol in the lowest eight bits. START, STOP and END are white space and so in no word.
"""

from __future__ import annotations

import numpy as np

START, STOP, END = b"\n", b" ", b"\r"
DEPTH = 6


def _symbols(contexts: list[bytes], strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All items in one buffer, the places of their symbols, how many bytes of context each has, and its item."""
    buffer = np.frombuffer(b"".join([c + s for c, s in zip(contexts, strings, strict=True)]), np.uint8)
    lead = np.fromiter(map(len, contexts), np.int64, len(contexts))
    sizes = lead + np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(sizes) - sizes
    item = np.repeat(np.arange(len(contexts)), sizes)
    room = np.arange(len(buffer)) - starts[item]
    at = np.flatnonzero(room >= lead[item])
    return buffer, at, room[at], item[at]


def counts_of(contexts: list[bytes], strings: list[bytes], weights: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of all contexts up to depth in items that occur so many times."""
    buffer, at, room, item = _symbols(contexts, strings)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    weights = np.asarray(weights, np.int64)[item]
    keys_out, counts_out = [], []
    context = np.zeros(len(at), np.int64)
    symbol = buffer[at].astype(np.int64)
    for d in range(depth + 1):
        if d:
            keep = room >= d
            at, room, weights, context, symbol = at[keep], room[keep], weights[keep], context[keep], symbol[keep]
            if not len(at):
                break
            context = context | buffer[at - d].astype(np.int64) << (8 * (d - 1))
        keys = (d << 56) | (context << 8) | symbol
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys_out.append(keys[first])
        counts_out.append(np.add.reduceat(weights[order], first))
    return np.concatenate(keys_out), np.concatenate(counts_out)


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, there) of each wanted key."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


class Tree:
    """Next-symbol distributions with back-off: a symbol that its longest state lacks costs that state's escape and is sought in shorter ones; at last all 256 symbols are alike."""

    def __init__(self, entries: np.ndarray, logs: np.ndarray, states: np.ndarray, escapes: np.ndarray, depth: int):
        """entries: sorted keys; states: sorted keys without symbol (key >> 8). Logs are natural."""
        self.entries, self.logs, self.states, self.escapes, self.depth = entries, logs.astype(np.float32), states, escapes.astype(np.float32), depth

    @classmethod
    def ppm(cls, keys: np.ndarray, counts: np.ndarray, depth: int) -> Tree:
        """Escape method C: a state's total and its number of distinct symbols share the code space."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        contexts = keys >> 8
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if not len(keys):
            return cls(keys, counts, keys, counts, depth)
        total, kinds = np.add.reduceat(counts, first), np.diff(np.append(first, len(keys)))
        room = np.repeat(total + kinds, kinds)
        return cls(keys, np.log(counts / room), contexts[first], np.log(kinds / (total + kinds)), depth)

    @classmethod
    def suffix(cls, keys: np.ndarray, counts: np.ndarray, depth: int, weight: float) -> Tree:
        """Each state's counts are smoothed with its longest shorter state's distribution, which counts as `weight` symbols for each distinct symbol of the state, and one more."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        tree = cls(keys[:0], counts[:0], keys[:0], counts[:0], depth)
        for d in range(depth + 1):
            own = (keys >> 56) == d
            k, c = keys[own], counts[own]
            if not len(k):
                continue
            first = np.flatnonzero(np.concatenate([[True], (k[1:] >> 8) != (k[:-1] >> 8)]))
            kinds = np.diff(np.append(first, len(k)))
            total = np.add.reduceat(c, first)
            below = np.exp(tree._look(k & 255, (k >> 8) & ((1 << 48) - 1), np.full(len(k), d - 1)))
            share = weight * kinds + 1
            logs = np.log((c + np.repeat(share, kinds) * below) / np.repeat(total + share, kinds))
            tree = cls(np.concatenate([tree.entries, k]), np.concatenate([tree.logs, logs]), np.concatenate([tree.states, k[first] >> 8]), np.concatenate([tree.escapes, np.log(share / (total + share))]), depth)
        return tree

    def _look(self, symbol: np.ndarray, context: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Log probability of each symbol after a context, of which the last `room` bytes may be used (-1: none, all symbols alike)."""
        out = np.full(len(symbol), 0.0)
        open_ = np.arange(len(symbol))
        for d in range(min(self.depth, int(room.max(initial=-1))), -1, -1):
            at = open_[room[open_] >= d]
            if not len(at):
                continue
            state = (d << 48) | (context[at] & ((1 << (8 * d)) - 1))
            place, there = _find(self.states, state)
            at, state, place = at[there], state[there], place[there]
            entry, found = _find(self.entries, (state << 8) | symbol[at])
            out[at[found]] += self.logs[entry[found]]
            out[at[~found]] += self.escapes[place[~found]]
            done = np.zeros(len(symbol), bool)
            done[at[found]] = True
            open_ = open_[~done[open_]]
        out[open_] -= np.log(256)
        return out

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each key's symbol after its context."""
        return self._look(keys & 255, (keys >> 8) & ((1 << 48) - 1), keys >> 56)


class Scorer:
    """Natural log probabilities of items under several trees.

    A symbol's probability depends on its last `depth` bytes only, so each distinct key is looked up in the trees once and
    kept; `most` bounds what is kept, beyond it the store starts anew.
    """

    def __init__(self, trees: list[Tree], most: int = 1_000_000):
        self.trees, self.depth, self.most = trees, max((t.depth for t in trees), default=0), most
        self.keys, self.values = np.zeros(0, np.int64), np.zeros((0, len(trees)), np.float32)

    def _of(self, keys: np.ndarray) -> np.ndarray:
        at, there = _find(self.keys, keys)
        if not there.all():
            new = np.unique(keys[~there])
            values = np.stack([t.of_keys(new) for t in self.trees], axis=1).astype(np.float32)
            if len(self.keys) > self.most:
                known, at = np.unique(keys, return_inverse=True)
                self.keys, self.values = known, np.stack([t.of_keys(known) for t in self.trees], axis=1).astype(np.float32)
                return self.values[at]
            merged = np.concatenate([self.keys, new])
            order = np.argsort(merged, kind="stable")
            self.keys, self.values = merged[order], np.concatenate([self.values, values])[order]
            at, _ = _find(self.keys, keys)
        return self.values[at]

    def score(self, contexts: list[bytes], strings: list[bytes]) -> np.ndarray:
        """One row for each item, one column for each tree."""
        out = np.zeros((len(contexts), len(self.trees)))
        for low in range(0, len(contexts), 15_000):
            n = len(contexts[low : low + 15_000])
            buffer, at, room, item = _symbols(contexts[low : low + n], strings[low : low + n])
            keys = buffer[at].astype(np.int64)
            for d in range(1, self.depth + 1):
                use = room >= d
                keys[use] |= buffer[at[use] - d].astype(np.int64) << (8 * d)
            keys |= np.minimum(room, self.depth) << 56
            values = self._of(keys)
            for k in range(len(self.trees)):
                out[low : low + n, k] = np.bincount(item, values[:, k], n)
        return out
