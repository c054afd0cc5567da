"""An R-tree packed by sorting and tiling (Leutenegger, Edgington and Lopez, 1997), in
memory, and a search in it for the largest inner products.

A box holds the smallest and the largest value of each coordinate and of the label. For
a vector, each coordinate's part of the inner product lies between its products with
the two ends, and so the sum does.
"""

import heapq
import sys
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF_ROWS = 256
FAN = 16
TILED = 3  # coordinates that are sorted and cut
BLOCK = 512  # vectors that share a queue


class Boxes(NamedTuple):
    """The boxes of one level; ``first`` and ``last`` delimit what each holds, of the
    level below or of the rows."""

    low: np.ndarray
    high: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Tree(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    levels: list[Boxes]  # leaves first; the last has one box


def _tiled(keys: list[np.ndarray], rows: np.ndarray, leaves: int) -> list[np.ndarray]:
    """``rows`` in slabs of the first key, each cut in turn by the next one."""
    if leaves <= 1:
        return [rows]
    ordered = rows[np.argsort(keys[0][rows], kind="stable")]
    slabs = leaves if len(keys) == 1 else int(np.ceil(leaves ** (1 / len(keys))))
    parts = np.array_split(ordered, slabs)
    if len(keys) == 1:
        return parts
    return [leaf for part in parts for leaf in _tiled(keys[1:], part, int(np.ceil(leaves / slabs)))]


def pack(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """The tree of the rows, of which there must be some. Tiles are cut by label first,
    then by the coordinates that vary most."""
    spread = np.argsort(-vectors.var(axis=0), kind="stable")[: TILED - 1]
    leaves = _tiled([labels, *[vectors[:, d] for d in spread]], np.argsort(ids, kind="stable"), -(-len(ids) // leaf_rows))
    leaves = [leaf for leaf in leaves if len(leaf)]
    rows = np.concatenate(leaves)
    ids, labels, vectors = ids[rows], labels[rows], vectors[rows]
    last = np.cumsum([len(leaf) for leaf in leaves])
    first = np.concatenate([[0], last[:-1]])
    at = first
    level = Boxes(
        np.minimum.reduceat(vectors, at), np.maximum.reduceat(vectors, at),
        np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at), first, last,
    )
    levels = [level]
    while len(level.first) > 1:
        first = np.arange(0, len(level.first), FAN)
        last = np.minimum(first + FAN, len(level.first))
        level = Boxes(
            np.minimum.reduceat(level.low, first), np.maximum.reduceat(level.high, first),
            np.minimum.reduceat(level.label_low, first), np.maximum.reduceat(level.label_high, first), first, last,
        )
        levels.append(level)
    return Tree(ids, labels, vectors, levels)


class Search:
    """The first ``k`` rows of each window of each vector, over any number of trees.

    Windows are ``low`` to ``high``, one column each, both ends included; higher scores
    come first, ties by smaller id. ``same`` looks at rows of the vector's label, other
    than the row of its id, otherwise at rows of other labels.
    """

    def __init__(self, ids, labels, vectors, low, high, k: int, same: bool):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.positive, self.negative = np.maximum(vectors, 0.0), np.minimum(vectors, 0.0)
        self.low, self.high, self.k, self.same = low, high, k, same
        self.kth = np.full(low.shape, -np.inf)
        self.owner = np.empty(0, np.int64)  # vector times windows plus window
        self.score, self.found = np.empty(0), np.empty(0, np.int64)
        self.boxes = self.rows = 0  # looked into

    def _wanted(self, who: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether a box of scores from ``least`` to ``most`` can add to some window."""
        low, high = self.low[who], self.high[who]
        meets = (most[:, None] >= low) & (least[:, None] <= high)
        return (meets & (np.minimum(most[:, None], high) >= self.kth[who])).any(axis=1)

    def _labelled(self, who: np.ndarray, boxes: Boxes, box: int) -> np.ndarray:
        low, high, own = boxes.label_low[box], boxes.label_high[box], self.labels[who]
        return (low <= own) & (own <= high) if self.same else (low != own) | (own != high)

    def _children(self, tree: Tree, who: np.ndarray, height: int, first: int, last: int, queue: list) -> None:
        boxes = tree.levels[height]
        low, high = boxes.low[first:last].T, boxes.high[first:last].T
        most = self.positive[who] @ high + self.negative[who] @ low
        least = self.positive[who] @ low + self.negative[who] @ high
        for at, box in enumerate(range(first, last)):
            keep = self._labelled(who, boxes, box) & self._wanted(who, least[:, at], most[:, at])
            if keep.any():
                entry = (-most[keep, at].max(), height, box, who[keep], least[keep, at], most[keep, at])
                heapq.heappush(queue, entry)

    def visit(self, tree: Tree) -> None:
        for start in range(0, len(self.ids), BLOCK):
            queue: list = []
            everyone = np.arange(start, min(start + BLOCK, len(self.ids)))
            self._children(tree, everyone, len(tree.levels) - 1, 0, 1, queue)
            while queue:
                _, height, box, who, least, most = heapq.heappop(queue)
                who = who[self._wanted(who, least, most)]  # the k-th may have risen since
                if not len(who):
                    continue
                self.boxes += len(who)
                first, last = tree.levels[height].first[box], tree.levels[height].last[box]
                if height:
                    self._children(tree, who, height - 1, first, last, queue)
                else:
                    self._leaf(tree, who, slice(first, last))

    def _leaf(self, tree: Tree, who: np.ndarray, rows: slice) -> None:
        ids, labels = tree.ids[rows], tree.labels[rows]
        self.rows += len(who) * len(ids)
        scores = self.vectors[who] @ tree.vectors[rows].T
        own = self.labels[who][:, None] == labels
        fits = own & (self.ids[who][:, None] != ids) if self.same else ~own
        windows, added = self.low.shape[1], []
        for w in range(windows):
            low, high, kth = (part[who, w][:, None] for part in (self.low, self.high, self.kth))
            inside = np.where(fits & (scores >= np.maximum(low, kth)) & (scores <= high), scores, -np.inf)
            if len(ids) > self.k:  # what is below the leaf's own k-th cannot count either
                inside[inside < np.partition(inside, -self.k, axis=1)[:, -self.k :].min(axis=1)[:, None]] = -np.inf
            at, column = np.nonzero(inside > -np.inf)
            added.append((who[at] * windows + w, inside[at, column], ids[column]))
        self._merge(*[np.concatenate(part) for part in zip(*added)])

    def _merge(self, owner: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        if not len(owner):
            return
        owner = np.concatenate([self.owner, owner])
        score, found = np.concatenate([self.score, score]), np.concatenate([self.found, found])
        order = np.lexsort((found, -score, owner))
        owner, score, found = owner[order], score[order], found[order]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(owner)]])))
        full = rank == self.k - 1
        self.kth.flat[owner[full]] = score[full]
        kept = rank < self.k
        self.owner, self.score, self.found = owner[kept], score[kept], found[kept]
