"""Links inside groups of token sets by signature trees, for many groups at once.

A group's sets are the leaves of a tree. A node has the OR of its sets' token
bitmaps and the range of their sizes. Two trees (or one with itself) are walked
together from the top; a pair of nodes is dropped when no pair of sets below
could share enough tokens, or when all sets below are in one component already.
What is left is counted exactly.
"""

from __future__ import annotations

import numpy as np

from pagelake.llm.textbatch import U64, mix

FAN_OUT = 8
BITS_RANGE = (512, 8192)
#: Pairs of nodes that are looked at in one step.
STEP_PAIRS = 100_000


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least number of common tokens of sets of these sizes with the given Jaccard percentage."""
    return -(-(percent * (a + b)) // (100 + percent))


class Forest:
    """Trees over sets that are sorted by group.

    ``sizes`` are the sets' full sizes; ``tokens`` (sets one after the other,
    limits in ``offsets``) may leave out tokens that no other set has.
    """

    def __init__(self, groups: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, tokens: np.ndarray, percent: int):
        self.sizes, self.offsets, self.percent = sizes, offsets, percent
        self.counts = np.diff(offsets)
        names, self.tokens = np.unique(tokens, return_inverse=True)
        self.marks = np.zeros(len(names), dtype=bool)
        bits = 1 << int(2 * max(1, self.counts.max(initial=1))).bit_length()
        bits = min(max(bits, BITS_RANGE[0]), BITS_RANGE[1])
        owner = np.repeat(np.arange(len(sizes)), self.counts)
        maps = np.zeros((len(sizes), bits), dtype=bool)
        maps[owner, (mix(names.astype(U64)) & U64(bits - 1)).astype(np.int64)[self.tokens]] = True
        leaves = np.packbits(maps, axis=1).view(np.uint64)
        spare = self.counts - np.bitwise_count(leaves).sum(axis=1)
        self.groups = groups
        self.levels = [{"map": leaves, "least": sizes, "most": sizes, "spare": spare, "count": self.counts, "group": groups}]
        while True:
            below = self.levels[-1]
            group = below["group"]
            new = np.concatenate([[True], group[1:] != group[:-1]])
            first = np.flatnonzero(new)
            within = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            starts = np.flatnonzero(within % FAN_OUT == 0)
            if len(starts) == len(group):
                break
            self.levels.append({
                "map": np.bitwise_or.reduceat(below["map"], starts, axis=0),
                "least": np.minimum.reduceat(below["least"], starts), "most": np.maximum.reduceat(below["most"], starts),
                "spare": np.maximum.reduceat(below["spare"], starts), "count": np.maximum.reduceat(below["count"], starts),
                "group": group[starts], "first": starts, "end": np.append(starts[1:], len(group)),
            })
        self.labels = np.arange(len(sizes))

    def overlaps(self, a: int, others: np.ndarray) -> np.ndarray:
        """Exact numbers of tokens that set ``a`` shares with each of the others."""
        own = self.tokens[self.offsets[a] : self.offsets[a + 1]]
        self.marks[own] = True
        counts = self.counts[others]
        limits = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(self.offsets[others] - limits[:-1], counts) + np.arange(limits[-1])
        hits = np.concatenate([[0], np.cumsum(self.marks[self.tokens[places]])])
        self.marks[own] = False
        return hits[limits[1:]] - hits[limits[:-1]]

    def link(self, a: int, others: np.ndarray) -> None:
        """Join the components of ``a`` and of those of the others that are similar to it."""
        linked = others[self.overlaps(a, others) >= needed(self.sizes[a], self.sizes[others], self.percent)]
        if len(linked):
            old = np.unique(np.append(self.labels[linked], self.labels[a]))
            low, high = np.searchsorted(self.groups, [self.groups[a], self.groups[a] + 1])
            part = self.labels[low:high]
            part[np.isin(part, old)] = old[0]

    def components(self) -> np.ndarray:
        """For each set the first set of its component."""
        first = np.flatnonzero(np.concatenate([[True], self.groups[1:] != self.groups[:-1]]))
        ends = np.append(first[1:], len(self.groups))
        for a, end in zip(first, ends, strict=True):  # copies of one text mostly link with the first of them
            if end - a > 1:
                self.link(a, np.arange(a + 1, end))
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top]["group"]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > STEP_PAIRS:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            keep = self.possible(level, a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level:
                stack.append((level - 1, *self.children(level, a, b)))
                continue
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            begins = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            for i, j in zip(begins, np.append(begins[1:], len(a)), strict=True):
                others = b[i:j]
                others = others[self.labels[others] != self.labels[a[i]]]
                if len(others):
                    self.link(int(a[i]), others)
        return self.labels

    def uniform(self, level: int) -> np.ndarray:
        """The component of all sets below each node, or -1."""
        low = high = self.labels
        for upper in self.levels[1 : level + 1]:
            low, high = np.minimum.reduceat(low, upper["first"]), np.maximum.reduceat(high, upper["first"])
        return np.where(low == high, low, -1)

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets below the two nodes can be similar and are not yet in one component."""
        at = self.levels[level]
        least, most = at["least"], at["most"]
        ok = (100 * most[a] >= self.percent * least[b]) & (100 * most[b] >= self.percent * least[a])
        label = self.uniform(level)
        ok &= (label[a] < 0) | (label[a] != label[b])
        if level == 0:
            ok &= a != b
        left = np.flatnonzero(ok)
        x, y = a[left], b[left]
        shared = np.bitwise_count(at["map"][x] & at["map"][y]).sum(axis=1, dtype=np.int64) + np.minimum(at["spare"][x], at["spare"][y])
        shared = np.minimum(shared, np.minimum(at["count"][x], at["count"][y]))
        ok[left] = shared >= needed(least[x], least[y], self.percent)
        return ok

    def children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, end = self.levels[level]["first"], self.levels[level]["end"]
        wide, high = end[a] - first[a], end[b] - first[b]
        number = wide * high
        pair = np.repeat(np.arange(len(a)), number)
        within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        x, y = first[a][pair] + within // high[pair], first[b][pair] + within % high[pair]
        keep = (a != b)[pair] | (x <= y)
        return x[keep], y[keep]


def link_components(
    groups: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, tokens: np.ndarray, percent: int
) -> np.ndarray:
    """For each set (sorted by group) the place of a set that stands for its component inside the group."""
    if not len(groups):
        return np.zeros(0, dtype=np.int64)
    counts = np.diff(offsets)
    # like sets stand side by side: by size, then by their least token
    least = np.full(len(sizes), np.iinfo(np.uint64).max, dtype=U64)
    filled = counts > 0
    least[filled] = np.minimum.reduceat(mix(tokens.astype(U64)), offsets[:-1][filled])
    step = np.log(np.maximum(sizes, 1)) // 0.05
    order = np.lexsort((least, step, groups))
    places = np.repeat(offsets[:-1][order] - (np.cumsum(counts[order]) - counts[order]), counts[order]) + np.arange(counts.sum())
    forest = Forest(groups[order], sizes[order], np.concatenate([[0], np.cumsum(counts[order])]), tokens[places], percent)
    labels = forest.components()
    result = np.empty(len(order), dtype=np.int64)
    result[order] = order[labels]
    return result
