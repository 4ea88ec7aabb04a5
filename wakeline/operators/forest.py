"""Importances of features from random forests, for several labels at once.

The forests of all labels share their bags, so one pass over the rows serves a level of every tree. A worker goes
tree by tree over a chunk of rows, so that the counts it adds to stay in the processor's cache; only the counts
of a task are shuffled, and each tree's splits are chosen where its counts meet.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from wakeline.sources.scratch import materialize

#: What workers run is sent to them, so that they need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
CHUNK_ROWS = 1 << 14
#: Bytes of counts that a worker holds; a level with more is done in several passes.
COUNT_BYTES = 128 << 20
#: Gain of a split, as a part of the squares it is the difference of, that rounding alone can give.
ROUNDING = 1e-12
WORD = (1 << 64) - 1
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
COUNTS = pa.schema([("unit", pa.int32()), ("task", pa.int32()), ("n", pa.binary()), ("s", pa.binary())])
SPLITS = pa.schema([("unit", pa.int32()), *[(c, pa.list_(pa.float64())) for c in ("node", "feature", "cut", "gain", "left", "right")]])


def row_draws(rows: np.ndarray, seed: int) -> np.ndarray:
    """64 random bits for each row number."""
    return _mixed(rows.astype(np.uint64) + np.uint64(seed * 0xD1B54A32D192ED03 & WORD))


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def times_drawn(draws: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in the bag of a tree: Poisson with mean 1, the same in every pass."""
    z = _mixed(draws + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & WORD))
    return np.searchsorted(POISSON, (z >> np.uint64(11)) * 2.0**-53, side="right")


def split_points(slim: DataFrame, features: Sequence[str], labels: Sequence[str], bins: int = BINS) -> tuple[list[np.ndarray], np.ndarray]:
    """At most bins - 1 ascending cuts of each feature, and the mean of each label.

    A feature with few values is cut between any two of them, others at the quantiles of all rows.
    """
    steps = [i / bins for i in range(1, bins)]
    found = slim.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.approx_count_distinct(f) for f in features]).alias("values"),
        F.array(*[F.percentile_approx(f, steps, 10_000) for f in features]).alias("cuts"),
        F.array(*[F.avg(w) for w in labels]).alias("means"),
    ).first()
    if not found["n"]:
        raise ValueError("A forest needs at least one row")
    cuts = []
    for f, values, at in zip(features, found["values"], found["cuts"]):
        cut = np.unique(np.array(at, float))
        if values <= 2 * bins:
            exact = np.array(sorted(r[0] for r in slim.select(f).distinct().collect()))
            if len(exact) <= bins:
                cut = (exact[:-1] + exact[1:]) / 2
        cuts.append(cut)
    return cuts, np.array(found["means"], float)


@contextmanager
def fine_splits(spark: SparkSession, least: int) -> Iterator[None]:
    """Scans that run meanwhile are cut in at least so many parts where files allow, so that tasks can share them evenly."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(least))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


class Level:
    """One level of the trees of some units (a unit is a label and a tree), as the workers see it.

    feature, cut: splits of the levels above, by unit and node; open: nodes of this level that may be split;
    chosen: the features that each of them looks at.
    """

    def __init__(self, features, labels, trees, seed, min_leaf, cuts, means, level, units, feature, cut, open_, chosen, bins=BINS):
        self.features, self.labels, self.trees, self.seed, self.min_leaf, self.bins = features, labels, trees, seed, min_leaf, bins
        self.cuts, self.means, self.level, self.units = cuts, means, level, units
        self.feature, self.cut, self.open, self.chosen = feature, cut, open_, chosen

    def at_nodes(self, binned: np.ndarray, at: np.ndarray, i: int) -> np.ndarray:
        """Node of this level that each row reaches; below a node that was not split no node is open."""
        feature, cut = self.feature[i].astype(np.int64), self.cut[i]
        node = np.zeros(len(at), np.int64)
        for d in range(self.level):
            inner = node + (2**d - 1)
            node = node * 2 + (binned.take(at + feature.take(inner)) > cut.take(inner))
        return node

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows drawn, and the sum of their label, by unit, chosen feature, node and bin."""
        nodes, k, bins = 2**self.level, self.chosen.shape[2], self.bins
        n, s = np.zeros((2, len(self.units), k, nodes * bins))
        order: dict[int, list[int]] = {}
        for i, u in enumerate(self.units):
            order.setdefault(u % self.trees, []).append(i)
        # a node that is not open has a number above the open ones and is cut off
        rank = [np.where(o, np.cumsum(o) - 1, nodes) for o in self.open]
        for chunk in _chunks(batches):
            values = [chunk[f].to_numpy() for f in self.features]
            binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, values)], axis=1).astype(np.uint8).ravel()
            y = [chunk[w].to_numpy() - m for w, m in zip(self.labels, self.means)]
            draws = row_draws(chunk["_row"].to_numpy(), self.seed)
            for tree, members in order.items():
                times = times_drawn(draws, tree)
                rows = np.flatnonzero(times)
                starts, drawn = rows * len(self.features), times[rows].astype(float)
                for i in members:
                    at, weight, label = starts, drawn, drawn * y[self.units[i] // self.trees][rows]
                    node = rank[i].take(self.at_nodes(binned, at, i))
                    if not self.open[i].all():
                        kept = np.flatnonzero(node < nodes)
                        at, weight, label, node = at[kept], weight[kept], label[kept], node[kept]
                    chosen = self.chosen[i][self.open[i]].astype(np.int64)
                    size, first = len(chosen) * bins, node * bins
                    for j in range(k):
                        key = binned.take(at + chosen[:, j].take(node)) + first
                        n[i, j, :size] += np.bincount(key, weight, size)
                        s[i, j, :size] += np.bincount(key, label, size)
        task = TaskContext.get().partitionId()
        for i, u in enumerate(self.units):
            size = int(self.open[i].sum()) * bins
            row = [u], [task], [n[i, :, :size].astype(np.uint32).tobytes()], [s[i, :, :size].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, COUNTS.types)], schema=COUNTS)

    def best(self, counts: pa.Table) -> pa.Table:
        """The split of each open node of a unit that gains most, where one gains anything."""
        u = counts["unit"][0].as_py()
        i, bins = self.units.index(u), self.bins
        ids = np.flatnonzero(self.open[i])
        shape = self.chosen.shape[2], len(ids), bins
        n, s = np.zeros((2, *shape))
        for row in sorted(counts.to_pylist(), key=lambda r: r["task"]):
            n += np.frombuffer(row["n"], np.uint32).reshape(shape)
            s += np.frombuffer(row["s"]).reshape(shape)
        n, s = n.transpose(1, 0, 2).cumsum(axis=2), s.transpose(1, 0, 2).cumsum(axis=2)
        left, right = n, n[:, :, -1:] - n
        fits = (left >= self.min_leaf) & (right >= self.min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            squares = s**2 / left + (s[:, :, -1:] - s) ** 2 / right
            gain = squares - s[:, :, -1:] ** 2 / n[:, :, -1:]
            gain = np.where(fits & (gain > ROUNDING * squares), gain, 0.0).reshape(len(ids), -1)
        top = gain.argmax(axis=1)
        split = np.flatnonzero(gain.max(axis=1) > 0)
        top, node = top[split], ids[split]
        flat = lambda a: a.reshape(len(ids), -1)[split, top]
        out = [node, self.chosen[i][node, top // bins], top % bins, flat(gain), flat(left), flat(right)]
        return pa.table([pa.array([u], pa.int32()), *[pa.array([c.astype(float)], t) for c, t in zip(out, SPLITS.types[1:])]], schema=SPLITS)


def importances(
    table: DataFrame, features: Sequence[str], labels: Sequence[str], *, trees: int, depth: int, min_leaf: int, seed: int
) -> np.ndarray:
    """Importance by label and feature: the gain in variance of its splits, as a part of each tree's, averaged over trees.

    Each tree has a bag of all rows, drawn with replacement, and looks at a third of the features in a node. Rows
    without a feature are left out; a label must not be missing.
    """
    spark, features, labels = table.sparkSession, list(features), list(labels)
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    whole = table.select(*[F.col(c).cast("double").alias(c) for c in [*features, *labels]])
    # Written, so that every pass sees the same row numbers; filtered when read, as a filter below would repeat expressions.
    slim = materialize(whole.withColumn("_row", F.monotonically_increasing_id()), "forest")
    for f in features:
        slim = slim.filter(~missing(f))
    refused = [F.when(missing(w), F.raise_error(F.lit(f"{w} must not be null or NaN")).cast("double")).otherwise(F.col(w)).alias(w) for w in labels]
    slim = slim.select(*features, *refused, "_row")
    cuts, means = split_points(slim, features, labels)

    units, k = len(labels) * trees, len(features) if trees == 1 else math.ceil(len(features) / 3)
    feature, cut = np.zeros((2, units, 2**depth - 1), np.uint16)
    open_ = np.ones((units, 1), bool)
    gains = np.zeros((units, len(features)))
    tasks = 2 * max(1, spark.sparkContext.defaultParallelism)
    for level in range(depth):
        rng = np.random.default_rng([seed, level])
        chosen = rng.random((units, 2**level, len(features))).argsort(axis=2)[:, :, :k].astype(np.uint16)
        live = np.flatnonzero(open_.any(axis=1))
        # members of a tree stay together: they share its bag
        live = live[np.lexsort((live, live % trees))]
        per = max(1, COUNT_BYTES // (2**level * k * BINS * 16))
        above = open_
        open_ = np.zeros((units, 2 ** (level + 1)), bool)
        for start in range(0, len(live), per):
            part = live[start : start + per]
            inner = 2**level - 1
            step = Level(
                features, labels, trees, seed, max(1, min_leaf), cuts, means, level, part.tolist(),
                feature[part, :inner], cut[part, :inner], above[part], chosen[part],
            )
            counts = slim.coalesce(tasks).mapInArrow(step.count, "unit int, task int, n binary, s binary")
            schema = "unit int, " + ", ".join(f"{f.name} array<double>" for f in SPLITS if f.name != "unit")
            best = counts.groupBy("unit").applyInArrow(lambda met: step.best(met), schema)
            with fine_splits(spark, 2 * tasks):
                found = best.collect()
            for r in found:
                u, (node, by, at) = r["unit"], (np.array(r[c], np.int64) for c in ("node", "feature", "cut"))
                feature[u, inner + node], cut[u, inner + node] = by, at
                np.add.at(gains[u], by, r["gain"])
                # a child that could not give two leaves is one
                for side, name in enumerate(("left", "right")):
                    open_[u, 2 * node + side] = np.array(r[name]) >= 2 * max(1, min_leaf)
    total = gains.sum(axis=1, keepdims=True)
    shares = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).reshape(len(labels), trees, -1).sum(axis=1)
    whole_share = shares.sum(axis=1, keepdims=True)
    return np.divide(shares, whole_share, out=np.zeros_like(shares), where=whole_share > 0)
