"""Minimal perfect hashing of 64-bit keys, built shard by shard.

A shard's keys are thrown into a bit array of a level; keys that fall on a place of their own
stay there, the others go on to the next, smaller level. The place of a key among all set bits
is its number: n keys get the numbers 0 to n - 1. Keys that were not built in get some number
or none, so lookups compare the key stored under the number.
"""

from __future__ import annotations

ROOM = 1.5                # bits of a level for each of its keys
MOST_LEVELS = 200


def mixed(keys, seed: int):
    """64 mixed bits of each key (uint64 array)."""
    import numpy as np

    x = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys, shards: int):
    import numpy as np
    return (mixed(keys, -1) % np.uint64(shards)).astype(np.int64)


def build(keys):
    """(64-bit words of each level, all words, the keys in the order of their numbers)."""
    import numpy as np

    sizes, words, ordered, rest = [], [], [], keys
    while len(rest):
        if len(sizes) == MOST_LEVELS:
            raise ValueError("a key is repeated")
        n_words = max(1, int(ROOM * len(rest)) // 64 + 1)
        at = mixed(rest, len(sizes)) % np.uint64(64 * n_words)
        alone = np.bincount(at.astype(np.int64), minlength=64 * n_words) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(n_words)
        stays = alone[at.astype(np.int64)]
        placed = rest[stays]
        ordered.append(placed[np.argsort(at[stays])])
        rest = rest[~stays]
    none = np.zeros(0, dtype=np.uint64)
    return sizes, np.concatenate([none, *words]), np.concatenate([none, *ordered])


class PerfectHash:
    """Shards put together: ``shards`` lists what ``build`` returned for shard 0, 1, ..."""

    def __init__(self, shards):
        import numpy as np

        depth = max([len(sizes) for sizes, _, _ in shards] + [1])
        self.size = np.zeros((len(shards), depth), dtype=np.uint64)
        for s, (sizes, _, _) in enumerate(shards):
            self.size[s, :len(sizes)] = sizes
        ends = np.cumsum(self.size.ravel()).reshape(self.size.shape)
        self.first = ends - self.size
        none = np.zeros(0, dtype=np.uint64)
        self.words = np.concatenate([none, *(w for _, w, _ in shards)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])[:-1]
        self.keys = np.concatenate([none, *(k for _, _, k in shards)])

    def numbers(self, keys):
        """Number of each key (uint64 array), -1 for keys that were not built in."""
        import numpy as np

        out = np.full(len(keys), -1, dtype=np.int64)
        at, shard = np.arange(len(keys)), shard_of(keys, len(self.size))
        for level in range(self.size.shape[1]):
            live = self.size[shard[at], level] > 0
            at = at[live]
            if not len(at):
                break
            s = shard[at]
            place = mixed(keys[at], level) % (np.uint64(64) * self.size[s, level])
            word = (self.first[s, level] + (place >> np.uint64(6))).astype(np.int64)
            bit = place & np.uint64(63)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[at[here]] = (self.before[word] + np.bitwise_count(below))[here]
            at = at[~here]
        found = out >= 0
        out[found] = np.where(self.keys[out[found]] == keys[found], out[found], -1)
        return out
