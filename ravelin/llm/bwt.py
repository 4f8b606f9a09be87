"""Burrows-Wheeler transforms of shards and their merging by interleave refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Transform:
    """A cyclic text in the order of its suffixes: where each begins, the two symbols before it (one in the lower
    byte), the symbol before it, and the ranks of the suffixes that begin two and one symbols earlier."""

    order: np.ndarray
    two: np.ndarray
    one: np.ndarray
    back_two: np.ndarray
    back_one: np.ndarray


def transform(text: np.ndarray, depth: int) -> Transform:
    """The transform of a cyclic text of bytes, its suffixes sorted by the first ``depth`` symbols at least: by seven
    at once, then, by the ranks of what follows, by 14, 28 and so on."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(8) | np.roll(text, -k).astype(np.uint64)
    reach = 7
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        if reach >= depth or rank[order[-1]] == n - 1:
            break
        key, reach = rank * np.uint64(n) + np.roll(rank, -reach), reach * 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    one = text[order - 1]
    return Transform(order, text[order - 2].astype(np.uint16) << 8 | one, one, place[order - 2], place[order - 1])


def merge(transforms: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, block) of the merged transform: shards' suffixes, numbered on from shard to shard, in their new order.

    The interleave starts as the shards in turn, alike in no symbol. A round deals it out, stably, by the two symbols
    before each suffix, and each suffix gives way to the one that begins there: that orders all suffixes by two
    symbols more. Suffixes of one block agree in all symbols so far, so where a new border appears says how long the
    common prefix of its two sides is. After ``depth`` symbols a block holds the suffixes, of all shards, that begin
    with the same ``depth`` symbols. The suffixes themselves are neither compared nor sorted anew.
    """
    sizes = np.array([len(t.order) for t in transforms])
    before = np.cumsum(sizes) - sizes
    two, one = (np.concatenate([getattr(t, a) for t in transforms]) for a in ("two", "one"))
    back_two, back_one = (np.concatenate([getattr(t, a) + np.int32(b) for t, b in zip(transforms, before)]) for a in ("back_two", "back_one"))
    at = np.arange(len(two), dtype=np.int32)
    block = np.zeros(len(two), np.int32)
    border = np.zeros(len(two), np.int32)
    for symbols, back in [(two, back_two)] * (depth // 2) + [(one, back_one)] * (depth % 2):
        dealt = np.argsort(symbols[at], kind="stable")
        at, block = at[dealt], block[dealt]
        symbol = symbols[at]
        border[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(border, dtype=np.int32)
        at = back[at]
    return at, block


def repeated_prefixes(texts: list[bytes], shard: np.ndarray, length: int, value: np.ndarray) -> list[np.ndarray]:
    """For every text, per start of a string of ``length`` bytes: the least ``value`` of a text that holds the string.

    ``shard`` says which shard a text belongs to. Each shard's transform is made by itself, then all are merged. The
    texts of a shard are joined by a byte that ends each; a string has no end in it, so which byte does not matter.
    """
    made, owners, offsets = [], [], []
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        sizes = np.array([len(texts[i]) + 1 for i in own])
        made.append(transform(np.frombuffer(b"\0".join([texts[i] for i in own]) + b"\0", np.uint8), length))
        places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        owners.append(np.repeat(own, sizes)[made[-1].order]), offsets.append(places[made[-1].order])
    suffix, block = merge(made, length)
    owner, offset = np.concatenate(owners)[suffix], np.concatenate(offsets)[suffix]
    sizes = np.array([len(t) for t in texts])
    whole = sizes[owner] - offset >= length
    owner, offset, block = owner[whole], offset[whole], block[whole]
    windows = np.maximum(0, sizes - length + 1)
    first = np.cumsum(windows) - windows
    out = np.empty(windows.sum(), np.int64)
    if len(block):
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        out[first[owner] + offset] = np.repeat(np.minimum.reduceat(value[owner], starts), np.diff(np.append(starts, len(block))))
    return np.split(out, first[1:])
