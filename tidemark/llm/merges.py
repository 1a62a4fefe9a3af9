"""Byte-pair merging of many ragged sequences at once, each by its lowest rank at a time."""

from __future__ import annotations

import numpy as np

#: No pair of these symbols merges.
NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class MergeTable:
    """Ranks of the pairs of a byte-level BPE vocabulary and the symbols that they make, as sorted arrays."""

    def __init__(self, model: dict) -> None:
        """From the model of a tokenizer file; raises ValueError where it does more than merge bytes."""
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("no plain byte-level BPE model")
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters, end = byte_letters(), model.get("end_of_word_suffix") or ""
        if missing := [x for x in letters.values() if x not in vocab or x + end not in vocab]:
            raise ValueError(f"bytes {missing} are no symbols")
        #: Symbols of bytes inside a sequence, and at its end.
        self.of_byte, self.at_end = (np.array([vocab[letters[b] + tail] for b in range(256)], np.int32) for tail in ("", end))
        made = {x + tail for x in letters.values() for tail in ("", end)}
        for left, right in merges:
            # Then a pair that a merge brings about never ranks before it, and all places of one pair can be merged at once.
            if left not in made or right not in made or left + right in made:
                raise ValueError(f"{left!r} and {right!r} are merged out of turn")
            made.add(left + right)
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of_key = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        # First ranks by left and right byte, inside and at the end: most lookups are of these.
        pair = lambda a, b: self.ranks(np.repeat(a, 256), np.tile(b, 256)).reshape(256, 256)
        self.first = np.stack([pair(self.of_byte, self.of_byte), pair(self.of_byte, self.at_end)])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge."""
        wanted = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of_key[at], NONE)

    def merged(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that survive of sequences of bytes (flat, one after the other, none empty), one after the other, and how many of each.

        All sequences lie in one array.  A round merges, in every sequence at once, all places of its lowest pair (every other one where
        they overlap, from the left); finished sequences leave the array.
        """
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        sym, own = self.of_byte[flat], np.repeat(np.arange(len(size), dtype=np.int32), size)
        last = np.cumsum(size) - 1
        sym[last] = self.at_end[flat[last]]
        ends = np.zeros(len(flat), np.uint8)
        ends[last] = 1
        rank = np.full(len(flat), NONE, np.int32)
        rank[:-1] = self.first[ends[1:], flat[:-1], flat[1:]]
        rank[last] = NONE
        done = []
        while len(sym):
            first = np.flatnonzero(np.diff(own, prepend=-1))
            each = np.diff(first, append=len(sym))
            least = np.minimum.reduceat(rank, first)
            alive = least != NONE
            if not alive.all():
                stay = np.repeat(alive, each)
                done.append((sym[~stay], own[~stay]))
                sym, own, rank, least, each = sym[stay], own[stay], rank[stay], least[alive], each[alive]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, each))
            gap = np.diff(at, prepend=-2) != 1
            if not gap.all():
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(gap, k, 0))) % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, own, rank = sym[stay], own[stay], rank[stay]
            moved = at - np.arange(len(at))
            around = np.concatenate((moved, moved[moved > 0] - 1))
            rank[around] = self._ranked(sym, own, around)
        sym, own = (np.concatenate(parts) for parts in zip(*done, strict=True))
        return sym[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(size))

    def _ranked(self, sym: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at these places; none across the end of a sequence."""
        out = np.full(len(at), NONE, np.int32)
        inside = np.flatnonzero(at + 1 < len(sym))
        inside = inside[own[at[inside]] == own[at[inside] + 1]]
        out[inside] = self.ranks(sym[at[inside]], sym[at[inside] + 1])
        return out
