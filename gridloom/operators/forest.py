"""A random forest that grows where its rows are: the driver holds few nodes while it is fitted.

The rules are MLlib's: borders between bins from a sample, bootstrap counts, the gain of the Gini
impurity over a few features drawn for each node, siblings that predict the same merged.  The tops of
the trees grow from histograms that are summed over all tasks.  A node with few enough rows is
finished by one task, to which its rows are sent once, as bins of a byte each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from gridloom.session import cut, task_count

BINS = 32
SAMPLE = 10_000  # rows that place the borders, as in MLlib
GROUP = 262_144  # drawn rows of a node that one task finishes
BLOCK = 2_048  # rows that share a stream of bootstrap counts
CHUNK = 65_536  # rows that go down a tree together
CELLS = 2**21  # counts of nodes, bins and classes that are made at a time
GAINS = 2**18  # and of those whose gains are computed at a time
EPSILON = np.finfo(float).eps  # an impurity below counts as none

BLOCKS = "part int, seq int, bins binary, labels binary"
COUNTED = "tree int, node long, counts binary"
CHOSEN = "tree int, node long, gain double, feature int, border int, here array<double>, left array<double>"
SHIPPED = "tree int, node long, packed binary, size long"
GROWN = "tree int, node long, feature binary, border binary, left binary, votes binary"


@dataclass
class Rules:
    """What all tasks have to know."""

    width: int  # features
    classes: int
    trees: int
    depth: int
    seed: int
    bootstrap: bool
    drawn: int  # features looked at in a node


def _matrix(lists: pa.Array) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = pc.min_max(pc.list_value_length(lists)).as_py()
    values = lists.flatten()
    if lists.null_count or values.null_count or lengths["min"] != lengths["max"]:
        raise ValueError("features have to be arrays of one length, without NULL")
    return values.to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def borders_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Borders halfway between neighbouring values, so that the bins hold about the same number."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) < bins:
        return middles
    kept, seen, target = [], int(counts[0]), len(values) / bins
    for k, n in enumerate(counts[1:].tolist()):
        if abs(seen - target) < abs(seen + n - target):
            kept.append(middles[k])
            target += len(values) / bins
        seen += n
    return np.array(kept[: bins - 1])


def _binned(values: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    if values.shape[1] != len(borders):
        raise ValueError(f"{values.shape[1]} features, fitted on {len(borders)}")
    out = np.empty(values.shape, dtype=np.uint8)
    for k, b in enumerate(borders):
        out[:, k] = np.searchsorted(b, values[:, k])
    return out


def _blocks(borders: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _binned(_matrix(batch["features"]), borders)
            labels = batch["label"].to_numpy(zero_copy_only=False).astype(np.uint8)
            for lo in range(0, len(bins), BLOCK):
                raw = bins[lo : lo + BLOCK].tobytes(), labels[lo : lo + BLOCK].tobytes()
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                    "bins": pa.array([raw[0]], pa.binary()), "labels": pa.array([raw[1]], pa.binary()),
                })
                seq += 1

    return run


def _chunks(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bins, labels and how often each tree drew a row; a block's draws are the same in every pass."""
    bins, labels, weights, n = [], [], [], 0
    for batch in batches:
        for part, seq, b, y in zip(*(batch[c].to_pylist() for c in ("part", "seq", "bins", "labels"))):
            bins.append(np.frombuffer(b, dtype=np.uint8).reshape(-1, rules.width))
            labels.append(np.frombuffer(y, dtype=np.uint8))
            shape = rules.trees, len(labels[-1])
            stream = np.random.Generator(np.random.PCG64([rules.seed, part, seq]))
            weights.append((stream.poisson(1.0, shape) if rules.bootstrap else np.ones(shape)).astype(np.uint8))
            n += shape[1]
            if n >= CHUNK:
                yield np.concatenate(bins), np.concatenate(labels), np.concatenate(weights, axis=1)
                bins, labels, weights, n = [], [], [], 0
    if n:
        yield np.concatenate(bins), np.concatenate(labels), np.concatenate(weights, axis=1)


def _descend(
    feature: np.ndarray, border: np.ndarray, left: np.ndarray, flat: np.ndarray, base: np.ndarray
) -> np.ndarray:
    """The place where each row ends: nodes with a negative ``left`` have no children."""
    at = np.zeros(len(base), dtype=np.int32)
    while True:
        down = left[at]
        inner = down >= 0
        if not inner.any():
            return at
        at = np.where(inner, down + (flat[base + feature[at]] > border[at]), at)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_features(rules: Rules, tree: int, nodes: np.ndarray) -> np.ndarray:
    """The features that each node looks at, whichever task asks."""
    if rules.drawn >= rules.width:
        return np.tile(np.arange(rules.width), (len(nodes), 1))
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        start = _mixed(np.array([rules.seed, tree], dtype=np.int64).astype(np.uint64) * step)
        start = _mixed(_mixed(start[:1] + start[1:] * step) + nodes.astype(np.uint64) * step)
        keys = _mixed(start[:, None] + np.arange(1, rules.width + 1, dtype=np.uint64) * step)
    return np.sort(np.argpartition(keys, rules.drawn, axis=1)[:, : rules.drawn], axis=1)


def _counts(flat, base, feature, node, labels, weights, nodes: int, classes: int) -> np.ndarray:
    """Drawn rows by node, bin of the node's feature, and class."""
    cell = (node * BINS + flat[base + feature[node]]) * classes + labels
    return np.bincount(cell, weights=weights, minlength=nodes * BINS * classes).reshape(nodes, BINS, classes)


def _gini(counts: np.ndarray) -> np.ndarray:
    total, out = counts.sum(axis=-1), np.ones(counts.shape[:-1])
    with np.errstate(invalid="ignore", divide="ignore"):
        for c in range(counts.shape[-1]):
            share = counts[..., c] / total
            out -= share * share
    return np.where(total > 0, out, 0.0)


def _best(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, last bin that goes left, and what goes left, of the best border of each node."""
    n = len(counts)
    gain, border, went = np.empty(n), np.empty(n, dtype=np.int64), np.empty((n, counts.shape[2]))
    step = max(1, GAINS // counts[:1].size) if n else 1
    for lo in range(0, n, step):
        left = counts[lo : lo + step].cumsum(axis=1)
        here, left = left[:, -1:], left[:, :-1]
        right = here - left
        to_left, to_right, total = left.sum(axis=2), right.sum(axis=2), here.sum(axis=2)
        with np.errstate(invalid="ignore", divide="ignore"):
            won = _gini(here) - to_left / total * _gini(left) - to_right / total * _gini(right)
        won = np.where((to_left >= 1) & (to_right >= 1), won, -np.inf)
        k, each = won.argmax(axis=1), np.arange(len(won))
        gain[lo : lo + step], border[lo : lo + step], went[lo : lo + step] = won[each, k], k, left[each, k]
    return gain, border, went


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a, b], axis=1).reshape(2 * len(a), *a.shape[1:])


def grown(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, tree: int, root: int, rules: Rules):
    """The tree below ``root``: feature, border, left child and the votes of its leaves.

    The right child follows the left one; a leaf has -1 - (its place in the votes) as left child.
    """
    flat, base = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    labels, weights, node = labels.astype(np.int64), weights.astype(float), np.zeros(len(bins), dtype=np.int64)
    here = np.bincount(labels, weights=weights, minlength=rules.classes)[None]
    level, nodes, open_, first, levels = root.bit_length() - 1, np.array([root]), np.zeros(1, dtype=np.int64), 0, []
    if level >= rules.depth:
        open_ = open_[:0]
    while True:
        feature, border = np.zeros(len(here), dtype=np.int16), np.zeros(len(here), dtype=np.uint8)
        left = np.full(len(here), -1, dtype=np.int32)
        levels.append((first, feature, border, left, here))
        if not len(open_):
            break
        n, step = len(open_), max(1, CELLS // (BINS * rules.classes))
        gain, by, at = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        went, ends = np.zeros((n, rules.classes)), [0, len(node)]
        if n > step:
            order = np.argsort(node, kind="stable")
            base, labels, weights, node = base[order], labels[order], weights[order], node[order]
            ends = np.searchsorted(node, np.arange(0, n + step, step))
        for lo, a, b in zip(range(0, n, step), ends, ends[1:]):
            rows, m = (base[a:b], node[a:b] - lo, labels[a:b], weights[a:b]), min(step, n - lo)
            for looked in drawn_features(rules, tree, nodes[lo : lo + m]).T:
                won, k, to_left = _best(_counts(flat, rows[0], looked, *rows[1:], m, rules.classes))
                more = np.flatnonzero(won > gain[lo : lo + m])
                gain[lo + more], by[lo + more], at[lo + more] = won[more], looked[more], k[more]
                went[lo + more] = to_left[more]
        good = gain > 0
        split, place = open_[good], np.cumsum(good) - 1
        feature[split], border[split] = by[good], at[good]
        first += len(here)
        left[split] = first + 2 * np.arange(len(split))
        here = _pairs(went[good], here[split] - went[good])
        level += 1
        open_ = np.flatnonzero((level < rules.depth) & (_gini(here) >= EPSILON))
        slot = np.full(len(here), -1)
        slot[open_] = np.arange(len(open_))
        nodes = _pairs(2 * nodes[good], 2 * nodes[good] + 1)[open_]
        on = good[node]
        base, labels, weights, node = base[on], labels[on], weights[on], node[on]
        node = slot[2 * place[node] + (flat[base + by[node]] > at[node])]
        on = node >= 0
        base, labels, weights, node = base[on], labels[on], weights[on], node[on]
    for (_, _, _, left, _), (below, _, _, under, counts) in zip(levels[-2::-1], levels[:0:-1]):
        split = np.flatnonzero(left >= 0)
        a = left[split] - below
        says = counts.argmax(axis=1)
        left[split[(under[a] < 0) & (under[a + 1] < 0) & (says[a] == says[a + 1])]] = -1
    feature, border, left, counts = (np.concatenate(x) for x in zip(*(x[1:] for x in levels)))
    met = np.zeros(len(left), dtype=bool)
    met[0] = True
    for first, _, _, below, _ in levels:
        inner = np.flatnonzero(met[first : first + len(below)] & (below >= 0))
        met[below[inner]] = met[below[inner] + 1] = True
    renumbered, leaf = (np.cumsum(met) - 1).astype(np.int32), left < 0
    left = np.where(leaf, -np.cumsum(leaf & met), renumbered[left]).astype(np.int32)
    votes = counts[leaf & met]
    return feature[met], border[met], left[met], votes / votes.sum(axis=1, keepdims=True)


@dataclass
class Top:
    """The nodes of a tree that the driver holds while it is fitted: those with many rows, and their children."""

    nodes: list[int] = field(default_factory=lambda: [1])
    feature: list[int] = field(default_factory=lambda: [0])
    border: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    here: list[np.ndarray | None] = field(default_factory=lambda: [None])
    waiting: set[int] = field(default_factory=set)  # places of nodes with many rows, not split yet
    ready: set[int] = field(default_factory=set)  # places of nodes that a task finishes

    def arrays(self):
        return np.array(self.feature), np.array(self.border), np.array(self.left, dtype=np.int32)

    def marked(self, places: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each marked place (-1 for the others), and their nodes."""
        order = sorted(places)
        slot = np.full(len(self.nodes), -1)
        slot[order] = np.arange(len(order))
        return slot, np.array([self.nodes[k] for k in order])

    def split(self, row, rules: Rules, group: int) -> None:
        k = self.nodes.index(row.node)
        self.waiting.discard(k)
        self.here[k] = np.array(row.here)
        if row.gain <= 0:
            return
        self.feature[k], self.border[k], self.left[k] = row.feature, row.border, len(self.nodes)
        for node, here in ((2 * row.node, np.array(row.left)), (2 * row.node + 1, self.here[k] - row.left)):
            if node.bit_length() - 1 < rules.depth and _gini(here) >= EPSILON:
                (self.waiting if here.sum() > group else self.ready).add(len(self.nodes))
            kept = self.nodes, self.feature, self.border, self.left, self.here
            for own, value in zip(kept, (node, 0, 0, -1, here)):
                own.append(value)

    def whole(self, below: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The whole tree, as of ``grown``, from the trees below the ready nodes."""
        parts, votes, size, voted = [self.arrays()], [], len(self.nodes), 0
        feature, border, left = parts[0]
        for k in range(len(self.nodes)):
            if k in self.ready:
                f, b, l, v = below.pop(self.nodes[k])
                l = np.where(l >= 0, l + size - 1, l - voted)
                feature[k], border[k], left[k] = f[0], b[0], l[0]
                parts.append((f[1:], b[1:], l[1:]))
                size += len(f) - 1
            elif left[k] < 0:
                v = (self.here[k] / self.here[k].sum())[None]
                left[k] = -1 - voted
            else:
                continue
            votes.append(v)
            voted += len(v)
        votes = np.concatenate(votes)
        for k in reversed(range(len(self.nodes))):  # those that were split have their children behind them
            if self.left[k] >= 0 and (left[[left[k], left[k] + 1]] < 0).all():
                a, b = -1 - left[[left[k], left[k] + 1]]
                if votes[a].argmax() == votes[b].argmax():
                    left[k] = -1 - len(votes)
                    votes = np.concatenate([votes, (self.here[k] / self.here[k].sum())[None]])
        f, b, l = (np.concatenate(x) for x in zip(*parts))
        return f.astype(np.int16), b.astype(np.uint8), l.astype(np.int32), votes


def _histograms(rules: Rules, tops: dict[int, Top]):
    shapes = {t: (*top.arrays(), *top.marked(top.waiting)) for t, top in tops.items()}

    def run(batches):
        sums = {}
        for bins, labels, weights in _chunks(batches, rules):
            flat, base = bins.ravel(), np.arange(len(bins)) * rules.width
            for t, (feature, border, left, slot, nodes) in shapes.items():
                node = slot[_descend(feature, border, left, flat, base)]
                on = np.flatnonzero((node >= 0) & (weights[t] > 0))
                some = base[on], node[on], labels[on].astype(np.int64), weights[t][on]
                if t not in sums:
                    sums[t] = np.zeros((len(nodes), rules.drawn, BINS, rules.classes))
                for j, looked in enumerate(drawn_features(rules, t, nodes).T):
                    sums[t][:, j] += _counts(flat, some[0], looked, *some[1:], len(nodes), rules.classes)
        for t, counts in sums.items():
            nodes = shapes[t][-1]
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([t] * len(nodes), pa.int32()), "node": pa.array(nodes, pa.int64()),
                "counts": pa.array([c.tobytes() for c in counts], pa.binary()),
            })

    return run


def _chosen(rules: Rules):
    def run(key, table):
        tree, node = (k.as_py() for k in key)
        counts = sum(np.frombuffer(c.as_buffer()) for c in table["counts"])
        counts = counts.reshape(rules.drawn, BINS, rules.classes)
        gain, border, went = _best(counts)
        j = int(gain.argmax())
        feature = int(drawn_features(rules, tree, np.array([node]))[0, j])
        return pa.Table.from_pydict({
            "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()), "gain": [float(gain[j])],
            "feature": pa.array([feature], pa.int32()), "border": pa.array([int(border[j])], pa.int32()),
            "here": [counts[0].sum(axis=0).tolist()], "left": [went[j].tolist()],
        })

    return run


def _shipped(rules: Rules, tops: dict[int, Top]):
    shapes = {t: (*top.arrays(), *top.marked(top.ready)) for t, top in tops.items()}

    def run(batches):
        for bins, labels, weights in _chunks(batches, rules):
            flat, base = bins.ravel(), np.arange(len(bins)) * rules.width
            for t, (feature, border, left, slot, nodes) in shapes.items():
                node = slot[_descend(feature, border, left, flat, base)]
                on = np.flatnonzero((node >= 0) & (weights[t] > 0))
                on = on[np.argsort(node[on], kind="stable")]
                rows = np.column_stack([bins[on], labels[on], weights[t][on]])
                ends = np.searchsorted(node[on], np.arange(len(nodes) + 1))
                found = [k for k in range(len(nodes)) if ends[k] < ends[k + 1]]
                raw = [rows[ends[k] : ends[k + 1]].tobytes() for k in found]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([t] * len(found), pa.int32()), "node": pa.array(nodes[found], pa.int64()),
                    "packed": pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary()),
                    "size": pa.array([len(x) for x in raw], pa.int64()),
                })

    return run


def _grown(rules: Rules):
    def run(key, table):
        tree, node = (k.as_py() for k in key)
        rows = b"".join(
            pa.decompress(x.as_buffer(), n.as_py(), codec="zstd", asbytes=True)
            for x, n in zip(table["packed"], table["size"])
        )
        rows = np.frombuffer(rows, dtype=np.uint8).reshape(-1, rules.width + 2)
        bins = np.ascontiguousarray(rows[:, :-2])
        out = grown(bins, rows[:, -2], rows[:, -1], tree, node, rules)
        return pa.Table.from_pydict({
            "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()),
            **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("feature", "border", "left", "votes"), out)},
        })

    return run


class Forest:
    """A fitted forest: at most trees x 2^(depth + 1) nodes, shipped to each worker once."""

    def __init__(self, spark, borders: list[np.ndarray], trees: list[tuple], classes: int):
        self.shipped = spark.sparkContext.broadcast((borders, trees, classes))

    def transform(self, df: DataFrame, features: str, out: str = "prediction") -> DataFrame:
        """``df`` with the class that most trees vote for, each by the shares of its leaf."""
        shipped = self.shipped

        def run(batches):
            borders, trees, classes = shipped.value
            for batch in batches:
                votes = np.zeros((batch.num_rows, classes))
                if batch.num_rows:
                    flat = _binned(_matrix(batch.column(batch.num_columns - 1)), borders).ravel()
                    base = np.arange(batch.num_rows) * len(borders)
                    for feature, border, left, shares in trees:
                        votes += shares[-1 - left[_descend(feature, border, left, flat, base)]]
                found = pa.array(votes.argmax(axis=1).astype(float))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], out])

        schema = StructType([*df.schema.fields]).add(out, DoubleType())
        values = F.col(features).cast("array<double>").alias("features_")
        return df.select("*", values).mapInArrow(run, schema)


def grow(
    df: DataFrame, label: str, features: str, rows: int, classes: int, trees: int, depth: int, seed: int,
    bootstrap: bool = True, group: int = GROUP,
) -> Forest:
    """Fit on ``rows`` rows with labels from 0 to ``classes`` - 1."""
    spark = df.sparkSession
    values = F.col(features).cast("array<double>").alias("features")
    data = df.select(values, F.col(label).cast("double").alias("label"))
    some = data if rows <= SAMPLE else data.sample(SAMPLE / rows, seed)
    borders = [borders_of(v) for v in _matrix(some.select("features").toArrow()["features"]).T]
    width = len(borders)
    rules = Rules(width, classes, trees, depth, seed, bootstrap, width if trees == 1 else math.ceil(math.sqrt(width)))
    parts = max(task_count(spark), math.ceil(rows / (4 * CHUNK)))
    blocks = cut(data.mapInArrow(_blocks(borders), BLOCKS).repartition(parts))

    tops = {t: Top() for t in range(trees)}
    for top in tops.values():
        (top.waiting if rows > group else top.ready).add(0)
    while active := {t: top for t, top in tops.items() if top.waiting}:
        counted = blocks.mapInArrow(_histograms(rules, active), COUNTED)
        for row in counted.groupBy("tree", "node").applyInArrow(_chosen(rules), CHOSEN).collect():
            tops[row.tree].split(row, rules, group)
    shipped = blocks.mapInArrow(_shipped(rules, {t: top for t, top in tops.items() if top.ready}), SHIPPED)
    parts = max(task_count(spark), math.ceil(rows * trees / (16 * GROUP)))
    dealt = shipped.repartition(parts, "tree", "node").groupBy("tree", "node")
    below: dict[int, dict[int, tuple]] = {t: {} for t in tops}
    for row in cut(dealt.applyInArrow(_grown(rules), GROWN)).toLocalIterator():
        kinds = ((row.feature, np.int16), (row.border, np.uint8), (row.left, np.int32), (row.votes, np.float64))
        f, b, l, v = (np.frombuffer(x, dtype=kind) for x, kind in kinds)
        below[row.tree][row.node] = f, b, l, v.reshape(-1, classes)
    return Forest(spark, borders, [top.whole(below.pop(t)) for t, top in tops.items()], classes)
