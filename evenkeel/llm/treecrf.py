"""A graphical model over trees with two labels: node scores and parent-child scores, with exact marginals by passing messages
from the leaves to the roots and back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np


@dataclass
class Forest:
    """Nodes of many trees: parents come first and are -1 at roots; the features of node i are ``feature[start[i] : start[i + 1]]``."""

    parent: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    feature: np.ndarray

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """The nodes by depth; those of one parent are neighbours."""
        level, out = np.flatnonzero(self.parent < 0), []
        order = np.argsort(self.parent, kind="stable")
        ordered = self.parent[order]
        while level.size:
            out.append(level)
            lo, hi = np.searchsorted(ordered, level, "left"), np.searchsorted(ordered, level, "right")
            n = hi - lo
            level = order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        return out

    @cached_property
    def owner(self) -> np.ndarray:
        """The node of each feature."""
        return np.repeat(np.arange(len(self.parent)), np.diff(self.start))


@dataclass
class TreeModel:
    names: dict[str, int]  # features
    node: np.ndarray  # by feature: for label 1 against label 0
    edge: np.ndarray  # by kind of the child, label of the parent, label of the child

    def forest(self, trees: Sequence[tuple[Sequence[int], Sequence[int], Sequence[Sequence[str]]]]) -> Forest:
        """The trees (parents, kinds, features of each node) side by side; unknown features count for nothing."""
        parent, kind, sizes, feature, base = [], [], [], [], 0
        get = self.names.get
        for parents, kinds, features in trees:
            parent += [p + base if p >= 0 else -1 for p in parents]
            kind += kinds
            for own in features:
                known = [i for f in own if (i := get(f)) is not None]
                sizes.append(len(known))
                feature += known
            base += len(parents)
        return Forest(np.array(parent, np.int64), np.array(kind, np.int64), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int64), np.array(feature, np.int64))

    def scores(self, f: Forest) -> np.ndarray:
        return np.bincount(f.owner, self.node[f.feature], len(f.parent))

    def beliefs(self, f: Forest, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """P(label 1) of each node, and where wanted P(parent's label, own label) of each node, zeros at roots."""
        n, levels = len(f.parent), f.levels
        up, message, down = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
        up[:, 1] = self.scores(f)
        for level in reversed(levels[1:]):
            sent = up[level][:, None, :] + self.edge[f.kind[level]]
            message[level] = sent = np.logaddexp(sent[:, :, 0], sent[:, :, 1])
            p = f.parent[level]
            heads = np.flatnonzero(np.diff(p, prepend=-1))
            up[p[heads]] += np.add.reduceat(sent, heads)
        joint = np.zeros((n, 2, 2)) if pairs else None
        for level in levels[1:]:
            p = f.parent[level]
            rest = (up[p] + down[p] - message[level])[:, :, None] + self.edge[f.kind[level]]
            down[level] = np.logaddexp(rest[:, 0], rest[:, 1])
            if joint is not None:
                both = rest + up[level][:, None, :]
                both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
                joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        total = up + down
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -700, 700))), joint


def fit(trees: Sequence[tuple[Sequence[int], Sequence[int], Sequence[Sequence[str]], Sequence[int]]], kinds: int, epochs: int = 25, batch: int = 50, rate: float = 0.05, decay: float = 1e-5) -> TreeModel:
    """The model of greatest likelihood less a penalty, for trees (parents, kinds, features, labels); Adam on exact gradients of
    batches of trees, in steps that shrink to nothing."""
    names: dict[str, int] = {}
    for _, _, features, _ in trees:
        for own in features:
            for x in own:
                names.setdefault(x, len(names))
    model = TreeModel(names, np.zeros(len(names)), np.zeros((kinds, 2, 2)))
    batches = []
    for first in range(0, len(trees), batch):
        part = trees[first : first + batch]
        f = model.forest([t[:3] for t in part])
        label = np.array([y for t in part for y in t[3]])
        child = np.flatnonzero(f.parent >= 0)
        seen = np.zeros_like(model.edge)
        np.add.at(seen, (f.kind[child], label[f.parent[child]], label[child]), 1.0)
        batches.append((f, label, child, seen, len(part)))
    steps, step = epochs * len(batches), 0
    first, second = np.zeros(len(names) + 4 * kinds), np.zeros(len(names) + 4 * kinds)
    for _ in range(epochs):
        for f, label, child, seen, n in batches:
            step += 1
            belief, joint = model.beliefs(f, pairs=True)
            by_feature = np.bincount(f.feature, (label - belief)[f.owner], len(names))
            expected = np.stack([np.bincount(f.kind[child], joint[child, a, b], kinds) for a in (0, 1) for b in (0, 1)], axis=1).reshape(kinds, 2, 2)
            slope = np.concatenate((by_feature, (seen - expected).ravel())) / n - decay * np.concatenate((model.node, model.edge.ravel()))
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
            move = rate * (1 - (step - 1) / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            model.node += move[: len(names)]
            model.edge += move[len(names) :].reshape(model.edge.shape)
    return model
