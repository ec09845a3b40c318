"""A minimal perfect hash over 64-bit keys with compact fingerprint and count arrays.

Keys are placed level by level: at each level a key sets one bit of a bit array twice as long as the
keys that remain; keys that meet another key go on to the next level. A key's place is the number of
set bits before its own, so n keys get the places 0 to n - 1 at about four bits a key.
"""

from __future__ import annotations

import io

import numpy as np

from repovigil.llm.common import mix

_GAMMA = 2.0
_LEVELS = 64


class CountIndex:
    """Counts of a fixed set of keys, without the keys: places, 16-bit fingerprints, 16-bit counts."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int], prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.prints, self.counts = sizes, prints, counts
        self.bits = [np.unpackbits(b)[:m].astype(bool) for b, m in zip(levels, sizes)]
        self.levels = levels
        before, self.ranks = 0, []
        for b in self.bits:
            self.ranks.append(np.cumsum(b, dtype=np.int64) + (before - 1))
            before += int(b.sum())

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> CountIndex:
        """From distinct keys; counts above 65535 are held as 65535."""
        levels, sizes, rest, level = [], [], keys.astype(np.uint64), 0
        while len(rest):
            if level == _LEVELS:
                raise ValueError("keys are not distinct")
            m = int(_GAMMA * len(rest)) + 1
            at = (mix(rest, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(np.packbits(alone))
            sizes.append(m)
            rest = rest[~alone[at]]
            level += 1
        index = CountIndex(levels, sizes, np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint16))
        at = index.places(keys)
        index.prints[at] = index._prints(keys)
        index.counts[at] = np.minimum(counts, 65535).astype(np.uint16)
        return index

    @staticmethod
    def _prints(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 1000) >> np.uint64(48)).astype(np.uint16)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for keys that are surely not in the set."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (m, bits, rank) in enumerate(zip(self.sizes, self.bits, self.ranks)):
            if not len(open_):
                break
            at = (mix(keys[open_], level) % np.uint64(m)).astype(np.int64)
            here = bits[at]
            out[open_[here]] = rank[at[here]]
            open_ = open_[~here]
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Counts; 0 where the fingerprint says that the key is not in the set."""
        at = self.places(keys)
        known = at >= 0
        known[known] = self.prints[at[known]] == self._prints(keys[known])
        out = np.zeros(len(keys), np.int64)
        out[known] = self.counts[at[known]]
        return out

    def dumps(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"level{k}": b for k, b in enumerate(self.levels)}
        np.savez(out, sizes=np.array(self.sizes, np.int64), prints=self.prints, counts=self.counts, **arrays)
        return out.getvalue()

    @staticmethod
    def loads(data: bytes) -> CountIndex:
        with np.load(io.BytesIO(data)) as z:
            sizes = z["sizes"].tolist()
            return CountIndex([z[f"level{k}"] for k in range(len(sizes))], sizes, z["prints"], z["counts"])
