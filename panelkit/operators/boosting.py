"""Boosted trees over binned features, for many models at once.

A back-test refits one model for each forecast origin, a search one for each candidate. They share the panel, so it is binned once
and lies in blocks; every pass over the blocks takes all models one level further. A task adds up its rows' gradients by model,
node, feature and bin. These histograms do not grow with the rows; they are summed by model and feature, where the best split
of every node is found by second-order gain with L1 and L2 terms. Only splits, a row for each node and feature, reach the driver.

What the months before an origin have in common is taken from sums by month: the base of every model is a prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.months import month_number
from panelkit.session import written

#: Trees that passes evaluate besides the stored predictions, before these are written anew; models that are fitted together.
RECENT, TOGETHER = 8, 128
#: Bytes of histograms that may come together on the driver; larger ones are summed up in tasks.
COLLECTED = 1 << 25
#: Features whose histograms go together.
PART = 8
_HISTOGRAM = "model int, part int, task long, nodes binary, g binary, h binary"
_SPLIT = "model int, node int, feature int, bin int, gain double, gl double, hl double, g double, h double"


@dataclass(frozen=True)
class Settings:
    """subsample and columns are the shares of rows and features that each tree sees; min_weight is the least number of rows on either side of a split."""

    trees: int = 50
    depth: int = 5
    rate: float = 0.1
    subsample: float = 0.8
    columns: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    min_weight: float = 5.0
    seed: int = 42

    def __post_init__(self) -> None:
        if self.trees < 1 or not 1 <= self.depth <= 12 or not 0 < self.subsample <= 1 or not 0 < self.columns <= 1 or self.l1 < 0 or self.l2 < 0:
            raise ValueError(f"out of range: {self}")


# The settings of the production model.
PRODUCTION = Settings(trees=799, depth=9, rate=0.056808, subsample=0.8729982015899902, columns=0.6559009934437239, l1=0.014724539502011025, l2=1.9993115185633124, min_weight=4.0, seed=42)


@dataclass
class Tree:
    """Nodes in heap order from 1: feature -1 is a leaf. Rows with a bin of at most `bin` go left."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = 2 << self.depth
        self.feature, self.bin = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.value, self.gain = np.zeros(n), np.zeros(n)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Each row's node, as deep as there are splits."""
        at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + (bins[rows, np.maximum(f, 0)] > self.bin[at]), at)
        return at


@dataclass
class Model:
    """A model that learns from the rows of months before `before`, all of them if it is None; features are places in the common list."""

    settings: Settings
    before: int | None = None
    features: tuple[int, ...] | None = None
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)


def shrunk(g, l1: float):
    """g less l1 in size, 0 if it is smaller."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def leaf_value(g: float, h: float, s: Settings) -> float:
    return float(-shrunk(g, s.l1) / (h + s.l2)) * s.rate if h + s.l2 > 0 else 0.0


def split_gains(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    """The gain of cutting after each bin but the last; -inf where a side has too few rows. g and h are sums by bin, along the last axis."""
    score = lambda a, b: shrunk(a, s.l1) ** 2 / np.maximum(b + s.l2, 1e-300)
    gl, hl = np.cumsum(g, axis=-1), np.cumsum(h, axis=-1)
    g, h, gl, hl = gl[..., -1:], hl[..., -1:], gl[..., :-1], hl[..., :-1]
    gr, hr = g - gl, h - hl
    gain = (score(gl, hl) + score(gr, hr) - score(g, h)) / 2
    return np.where((hl >= max(s.min_weight, 1)) & (hr >= max(s.min_weight, 1)), gain, -np.inf)


def sampled_features(s: Settings, tree: int, features: Sequence[int]) -> list[int]:
    k = max(1, round(s.columns * len(features)))
    return sorted(np.random.default_rng((s.seed, tree)).permutation(features)[:k].tolist())


def sampled_rows(s: Settings, tree: int, h: np.ndarray) -> np.ndarray:
    """True for the rows that a tree sees; h hashes a row's content, so that the choice does not hang on where rows lie."""
    if s.subsample >= 1:
        return np.ones(len(h), bool)
    x = h.astype(np.uint64) + np.uint64((s.seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) < s.subsample * 2.0**64


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = 64) -> list[np.ndarray]:
    """For each feature at most bins - 1 increasing values; bin k has what is above k of them. All values, if there are few."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 20_000).alias(f"q{k}") for k, f in enumerate(features)], *[F.max(F.col(f).cast("double")).alias(f"m{k}") for k, f in enumerate(features)]).first()
    return [np.array(sorted({x for x in found[f"q{k}"] or [] if x < found[f"m{k}"]}), float) for k in range(len(features))]


def _pack(edges: list[np.ndarray], models: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(f"f{k}").to_numpy(zero_copy_only=False) for k in range(len(edges))]
                bins = np.stack([np.searchsorted(e, x, "left") for e, x in zip(edges, columns)], axis=1).astype(np.uint8)
                uid = batch.column("uid").to_numpy()
                row = [uid.tobytes(), batch.column("h").to_numpy().tobytes(), batch.column("m").to_numpy().astype(np.int32).tobytes(), batch.column("y").to_numpy().tobytes(), bins.tobytes(), np.zeros((len(uid), models)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([int(uid[0])]), *[pa.array([x], pa.binary()) for x in row]], ["block", "uid", "h", "m", "y", "bins", "preds"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple]:
    """(block, uid, hashes, months, targets, bins, predictions) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            raw = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            uid = np.frombuffer(raw["uid"], np.int64)
            yield raw["block"], uid, np.frombuffer(raw["h"], np.int64), np.frombuffer(raw["m"], np.int32), np.frombuffer(raw["y"]), np.frombuffer(raw["bins"], np.uint8).reshape(len(uid), features), np.frombuffer(raw["preds"]).reshape(len(uid), -1)


def _now(model: Model, stored: np.ndarray, done: int, bins: np.ndarray) -> np.ndarray:
    """The predictions of a model's finished trees, of which the first `done` are in those that are stored."""
    out = stored + (model.base if done == 0 else 0)
    for tree in model.trees[done:]:
        out = out + tree.value[tree.nodes(bins)]
    return out


def _histograms(shared, features: int, bins: int):
    """Sums of gradients and rows by model, feature, node and bin over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active, done = shared.value
        sums: dict[int, list] = {}
        first = None
        for block, _, h, m, y, b, preds in _blocks(batches, features):
            first = block if first is None else min(first, block)
            offsets = np.arange(features) * bins
            for k, (model, tree, level, listed) in active.items():
                used = sampled_rows(model.settings, len(model.trees), h)
                if model.before is not None:
                    used &= m < model.before
                at = tree.nodes(b)
                used &= at >= 1 << level  # rows whose node has become a leaf are done
                own = b[used][:, listed]
                g = _now(model, preds[used, k], done, b[used]) - y[used]
                wide = len(listed) * bins
                codes = (at[used] - (1 << level))[:, None] * wide + offsets[: len(listed)] + own
                size = (1 << level) * wide
                grad = np.bincount(codes.ravel(), np.repeat(g, len(listed)), size)
                count = np.bincount(codes.ravel(), minlength=size)
                if k in sums:
                    sums[k][0] += grad
                    sums[k][1] += count
                else:
                    sums[k] = [grad, count]
        for k, (grad, count) in sums.items():
            _, _, level, listed = active[k]
            shape = (1 << level, len(listed), bins)
            grad, count = grad.reshape(shape), count.reshape(shape)
            nodes = np.flatnonzero(count[:, 0].sum(axis=1))
            if len(nodes):
                cut = lambda x, i: np.ascontiguousarray(x[nodes, i : i + PART], np.float64).tobytes()
                rows = [(k, i, first, nodes.astype(np.int32).tobytes(), cut(grad, i), cut(count, i)) for i in range(0, len(listed), PART)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["model", "part", "task", "nodes", "g", "h"])

    return run


def _splits(active: dict, bins: int):
    """The best split of each node in each part of the features; the tasks' histograms come sorted by model, part and task, so that sums are the same in every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, []
        g = h = np.zeros(0)

        def closed() -> None:
            model, _, level, listed = active[key[0]]
            full = np.flatnonzero(h[:, 0].any(axis=1))
            gain = split_gains(g[full], h[full], model.settings)
            best = gain.reshape(len(full), -1).argmax(axis=1)  # of equal gains the first feature, and its first bin
            at, f, cut = np.arange(len(full)), best // (bins - 1), best % (bins - 1)
            gl, hl = (np.cumsum(x[full, f], axis=1)[at, cut] for x in (g, h))
            ints = (np.full(len(full), key[0]), full + (1 << level), np.array(listed)[key[1] + f], cut)
            out.append(([x.astype(np.int32) for x in ints], [gain[at, f, cut], gl, hl, g[full, 0].sum(axis=1), h[full, 0].sum(axis=1)]))

        for batch in batches:
            for model, part, nodes, more_g, more_h in zip(*(batch.column(c).to_pylist() for c in ("model", "part", "nodes", "g", "h"))):
                if (model, part) != key:
                    if key is not None:
                        closed()
                    key = model, part
                    g, h = np.zeros((2, 1 << active[model][2], min(PART, len(active[model][3]) - part), bins))
                nodes = np.frombuffer(nodes, np.int32)
                shape = (len(nodes), *g.shape[1:])
                g[nodes] += np.frombuffer(more_g).reshape(shape)
                h[nodes] += np.frombuffer(more_h).reshape(shape)
        if key is not None:
            closed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*(a + b for a, b in out))], _SPLIT_NAMES)

    return run


_SPLIT_NAMES = [x.split()[0] for x in _SPLIT.split(", ")]


class Boosting:
    """Models that are fitted together, and the blocks with their predictions."""

    def __init__(self, panel: DataFrame, features: Sequence[str], target: str, models: Sequence[Model], date: str = "date", bins: int = 64, edges: list[np.ndarray] | None = None) -> None:
        """panel is complete in features and target; targets below 0 count as 0. The rows keep their numbers in `rows` as __uid."""
        self.spark, self.features, self.bins = panel.sparkSession, list(features), bins
        self.models, self.done = list(models), 0
        self.rows = written(panel.withColumns({"__uid": F.monotonically_increasing_id(), "__m": month_number(F.col(date)).cast("int"), "__y": F.greatest(F.col(target).cast("double"), F.lit(0.0)), "__h": F.xxhash64(F.col(date).cast("string"), F.col(target).cast("double"), *[F.col(f).cast("double") for f in features])}))
        self.edges = edges or bin_edges(self.rows, features, bins)
        narrow = self.rows.select(F.col("__uid").alias("uid"), F.col("__m").alias("m"), F.col("__y").alias("y"), F.col("__h").alias("h"), *[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)])
        self.blocks = written(narrow.mapInArrow(_pack(self.edges, len(self.models)), "block long, uid binary, h binary, m binary, y binary, bins binary, preds binary"))
        self.tasks = len(self.blocks.inputFiles())
        months = self.rows.groupBy("__m").agg(F.sum("__y").alias("y"), F.count("*").alias("n")).orderBy("__m").collect()  # a row for each month
        self.months = [(r["__m"], r["n"]) for r in months]
        for model in self.models:
            known = [r for r in months if model.before is None or r["__m"] < model.before]
            model.base = sum(r["y"] for r in known) / max(sum(r["n"] for r in known), 1)

    def _tree_of(self, model: Model) -> tuple[Tree, list[int]]:
        return Tree(model.settings.depth), sampled_features(model.settings, len(model.trees), model.features or range(len(self.features)))

    def grow(self, which: Sequence[int]) -> None:
        """One more tree for each of the models."""
        if len({len(self.models[k].trees) for k in which}) > 1:
            raise ValueError("models that grow together have as many trees")
        grown = {k: self._tree_of(self.models[k]) for k in which}
        for level in range(max((self.models[k].settings.depth for k in which), default=0)):
            active = {k: (self.models[k], tree, level, listed) for k, (tree, listed) in grown.items() if level < tree.depth and (level == 0 or (tree.feature[1 << level - 1 : 1 << level] >= 0).any())}
            if not active:
                break
            shared = self.spark.sparkContext.broadcast((active, self.done))
            summed = self.blocks.mapInArrow(_histograms(shared, len(self.features), self.bins), _HISTOGRAM)
            found = self._best(summed, shared).sort_by([("model", "ascending"), ("node", "ascending"), ("gain", "descending"), ("feature", "ascending")])
            last = None
            for r in found.to_pylist():  # a row for each model, node and feature, whatever the number of the panel's rows
                if (r["model"], r["node"]) == last:
                    continue
                model, tree, s = self.models[r["model"]], grown[r["model"]][0], self.models[r["model"]].settings
                last = r["model"], r["node"]
                node = r["node"]
                if r["gain"] > 1e-12:
                    tree.feature[node], tree.bin[node], tree.gain[node] = r["feature"], r["bin"], r["gain"]
                    tree.value[2 * node], tree.value[2 * node + 1] = leaf_value(r["gl"], r["hl"], s), leaf_value(r["g"] - r["gl"], r["h"] - r["hl"], s)
                elif node == 1:
                    tree.value[1] = leaf_value(r["g"], r["h"], s)
            shared.unpersist()
        for k, (tree, _) in grown.items():
            self.models[k].trees.append(tree)
        if max(len(m.trees) for m in self.models) - self.done >= RECENT:
            self._store()

    def _best(self, summed: DataFrame, shared) -> pa.Table:
        """Every node's best split in each feature. Small histograms are summed up here, as their size is known beforehand; others by model and feature in tasks."""
        active = shared.value[0]
        size = self.tasks * sum(len(listed) * self.bins * 16 << level for _, _, level, listed in active.values())
        run = _splits(active, self.bins)
        if size <= COLLECTED:
            table = summed.toArrow().sort_by([("model", "ascending"), ("part", "ascending"), ("task", "ascending")])
            return pa.Table.from_batches(list(run(iter(table.to_batches()))), pa.schema([*[(c, pa.int32()) for c in _SPLIT_NAMES[:4]], *[(c, pa.float64()) for c in _SPLIT_NAMES[4:]]]))
        parts, bins = self.spark.sparkContext.defaultParallelism, self.bins
        dealt = summed.repartition(parts, "model", "part").sortWithinPartitions("model", "part", "task")
        return dealt.mapInArrow(lambda batches: _splits(shared.value[0], bins)(batches), _SPLIT).toArrow()

    def _store(self) -> None:
        """Write the blocks anew, with the predictions of all trees so far."""
        shared, features = self.spark.sparkContext.broadcast((self.models, self.done)), len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, done = shared.value
            for batch in batches:
                stored = [np.stack([_now(m, preds[:, k], done, b) for k, m in enumerate(models)], axis=1).tobytes() for *_, b, preds in _blocks([batch], features)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array(stored, pa.binary())], batch.schema.names)

        self.blocks = written(self.blocks.mapInArrow(run, self.blocks.schema))
        self.done = max(len(m.trees) for m in self.models)

    def fit(self) -> Boosting:
        """All trees of all models."""
        while which := [k for k, m in enumerate(self.models) if len(m.trees) < m.settings.trees]:
            fewest = min(len(self.models[k].trees) for k in which)
            self.grow([k for k in which if len(self.models[k].trees) == fewest])
        return self

    def predictions(self, months: Sequence[tuple[int, int, int]]) -> DataFrame:
        """(__uid, model, predicted) of the rows of months low <= m < high for each (model, low, high); not below 0."""
        shared, features = self.spark.sparkContext.broadcast((self.models, self.done, list(months))), len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, done, months = shared.value
            for _, uid, _, m, _, b, preds in _blocks(batches, features):
                for k, low, high in months:
                    at = np.flatnonzero((m >= low) & (m < high))
                    if len(at):
                        found = np.maximum(_now(models[k], preds[at, k], done, b[at]), 0)
                        yield pa.RecordBatch.from_arrays([pa.array(uid[at]), pa.array(np.full(len(at), k, np.int32)), pa.array(found)], ["__uid", "model", "predicted"])

        return self.blocks.mapInArrow(run, "__uid long, model int, predicted double")

    def errors(self, which: Sequence[int], low: int, high: int) -> dict[int, float]:
        """The mean absolute error of each model over the months low <= m < high: a row for each model comes back."""
        found = self.predictions([(k, low, high) for k in which]).join(self.rows.select("__uid", "__y"), "__uid")
        return {r["model"]: r["mae"] for r in found.groupBy("model").agg(F.avg(F.abs(F.col("predicted") - F.col("__y"))).alias("mae")).collect()}


@dataclass
class Trees:
    """A fitted model on its own: base, thresholds in the features' own terms, and what its splits have gained."""

    features: list[str]
    settings: Settings
    base: float
    edges: list[np.ndarray]
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1)
        return self.base + sum((t.value[t.nodes(bins)] for t in self.trees), np.zeros(len(x)))

    def column(self) -> Column:
        """The prediction of a row that has all features, not below 0."""

        @F.pandas_udf("double")
        def scored(x: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(self.predict(np.stack(x.to_numpy()).astype(float)), 0) if len(x) else [], dtype=float)

        return scored(F.array(*[F.col(f).cast("double") for f in self.features]))

    def importance(self) -> list[tuple[str, float]]:
        """(feature, its part of all gain), the highest first."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        shares = total / total.sum() if total.sum() > 0 else total
        return sorted(zip(self.features, shares.tolist()), key=lambda x: (-x[1], x[0]))

    def table(self, spark) -> DataFrame:
        """(tree, node, feature, threshold, value, gain): all nodes that a row can reach."""
        rows = []
        for k, t in enumerate(self.trees):
            reached = [1]
            for n in reached:
                f = int(t.feature[n])
                rows.append((k, n, self.features[f] if f >= 0 else None, float(self.edges[f][t.bin[n]]) if f >= 0 else None, None if f >= 0 else float(t.value[n]), float(t.gain[n]) if f >= 0 else None))
                reached += [2 * n, 2 * n + 1] if f >= 0 else []
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, value double, gain double")

    @staticmethod
    def from_table(rows: DataFrame, features: Sequence[str], settings: Settings, base: float) -> Trees:
        """The model that table() lists; its size is bounded by the settings."""
        found = rows.collect()
        edges = [np.array(sorted({r["threshold"] for r in found if r["feature"] == f}), float) for f in features]
        trees = [Tree(settings.depth) for _ in range(1 + max((r["tree"] for r in found), default=-1))]
        for r in found:
            t, n = trees[r["tree"]], r["node"]
            if r["feature"] is None:
                t.value[n] = r["value"]
            else:
                k = list(features).index(r["feature"])
                t.feature[n], t.bin[n], t.gain[n] = k, int(np.searchsorted(edges[k], r["threshold"])), r["gain"]
        return Trees(list(features), settings, base, edges, trees)


def train(panel: DataFrame, features: Sequence[str], target: str, settings: Settings = Settings(), bins: int = 64, date: str = "date") -> Trees:  # noqa: B008
    """The production model, on all complete rows of the panel."""
    fitted = Boosting(panel.dropna(subset=[*features, target]), features, target, [Model(settings)], date, bins).fit()
    (model,) = fitted.models
    return Trees(list(features), settings, model.base, fitted.edges, model.trees)


def walk_forward(panel: DataFrame, features: Sequence[str], target: str, gaps: Sequence[int] = (0,), settings: Settings = Settings(), min_months: int = 12, min_rows: int = 10, date: str = "date", bins: int = 64, sets: dict[str, Sequence[str]] | None = None) -> DataFrame:  # noqa: B008
    """(entity, date, gap, predicted, actual), and `features` with several sets: each month by trees that are refitted on the months before it, less the gap.

    sets names parts of `features`; every origin, gap and set is a model, and up to TOGETHER of them are fitted at once.
    """
    rows = written(panel.dropna(subset=[*features, target]).select("entity", date, *dict.fromkeys([*features, target])))
    counts = dict(sorted((r["m"], r["n"]) for r in rows.groupBy(month_number(F.col(date)).alias("m")).agg(F.count("*").alias("n")).collect()))  # a row for each month
    named = sets or {"": features}
    wanted = []
    for name, listed in named.items():
        places = tuple(list(features).index(f) for f in listed)
        for gap in gaps:
            for origin in counts:
                known = [n for m, n in counts.items() if m < origin - gap]
                if len(known) >= min_months and sum(known) >= min_rows:
                    wanted.append((name, gap, origin, Model(settings, origin - gap, places)))
    edges = bin_edges(rows, features, bins) if wanted else []
    out = None
    for start in range(0, len(wanted), TOGETHER):
        part = wanted[start : start + TOGETHER]
        fitted = Boosting(rows, features, target, [w[3] for w in part], date, bins, edges).fit()
        models = rows.sparkSession.createDataFrame([(k, w[0], w[1]) for k, w in enumerate(part)], "model int, features string, gap int")
        found = fitted.predictions([(k, w[2], w[2] + 1) for k, w in enumerate(part)]).join(F.broadcast(models), "model").join(fitted.rows, "__uid")
        found = found.select("entity", date, "gap", *(["features"] if sets else []), "predicted", F.col("__y").alias("actual"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = rows.limit(0)
        out = none.select("entity", date, F.lit(0).alias("gap"), *([F.lit("").alias("features")] if sets else []), F.lit(0.0).alias("predicted"), F.lit(0.0).alias("actual"))
    return out


#: What the random search draws from, evenly; whole numbers where both ends are.
SEARCHED = {"trees": (20, 60), "depth": (3, 7), "rate": (0.05, 0.3), "min_weight": (1, 10), "subsample": (0.6, 1.0), "columns": (0.6, 1.0), "l2": (0.5, 8.0), "l1": (0.0, 0.2)}


def drawn_settings(n: int, seed: int = 42, searched: dict = SEARCHED) -> list[Settings]:
    draw = np.random.default_rng(seed)
    one = lambda low, high: int(draw.integers(low, high + 1)) if isinstance(low, int) else float(draw.uniform(low, high))
    return [Settings(**{k: one(*v) for k, v in searched.items()}, seed=seed) for _ in range(n)]


def halving(panel: DataFrame, features: Sequence[str], target: str, candidates: Sequence[Settings], train_before: int, test_before: int, rungs: Sequence[float] = (1 / 9, 1 / 3, 1.0), keep: float = 1 / 3, date: str = "date", bins: int = 64) -> list[dict]:
    """{candidate, rung, trees, mae} of every candidate at the last rung that it reached, the best first.

    All candidates grow together, each to a share of its trees at every rung; the best `keep` of them go on growing from where they are. With
    keep = 1 the search is exhaustive.
    """
    fitted = Boosting(panel, features, target, [Model(s, train_before) for s in candidates], date, bins)
    alive, found = list(range(len(candidates))), {}
    for rung, share in enumerate(rungs):
        goal = {k: max(1, round(share * candidates[k].trees)) for k in alive}
        while which := [k for k in alive if len(fitted.models[k].trees) < goal[k]]:
            fewest = min(len(fitted.models[k].trees) for k in which)
            fitted.grow([k for k in which if len(fitted.models[k].trees) == fewest])
        for k, mae in fitted.errors(alive, train_before, test_before).items():
            found[k] = {"candidate": k, "rung": rung, "trees": len(fitted.models[k].trees), "mae": mae}
        alive = sorted(sorted(alive, key=lambda k: (found[k]["mae"], k))[: max(1, round(keep * len(alive)))])
    return sorted(found.values(), key=lambda x: (-x["rung"], x["mae"], x["candidate"]))


def tune(panel: DataFrame, features: Sequence[str], target: str, n: int = 60, seed: int = 42, pool: float = 0.78, inner: float = 0.6, rungs: Sequence[float] = (1 / 9, 1 / 3, 1.0), keep: float = 1 / 3, steps: tuple[int, int, float] = (10, 1, 0.02), date: str = "date", searched: dict = SEARCHED) -> DataFrame:
    """(candidate, stage, mae, trees, depth, rate, min_weight, subsample, columns, l2, l1), the best first.

    The first `pool` of the months are searched: their first `inner` part trains, the rest scores. Stage 1 is halving() over n
    random candidates, stage 2 a grid of 27 around its winner: trees, depth and rate a step less, equal, and a step more. Candidates of the
    grid that differ in trees alone are one model at three lengths. Of equal errors the first candidate wins.
    """
    rows = written(panel.dropna(subset=[*features, target]).select("entity", date, *dict.fromkeys([*features, target])))
    months = sorted(r["m"] for r in rows.select(month_number(F.col(date)).alias("m")).distinct().collect())
    pooled = months[: int(len(months) * pool)]
    first_test, end = pooled[int(len(pooled) * inner)], pooled[-1] + 1
    drawn = drawn_settings(n, seed, searched)
    tried = [(x["mae"], drawn[x["candidate"]], 1, x["candidate"]) for x in halving(rows, features, target, drawn, first_test, end, rungs, keep, date) if x["rung"] == len(rungs) - 1]
    best = min(tried, key=lambda x: (x[0], x[3]))[1]
    lengths = sorted({max(5, best.trees + k * steps[0]) for k in (-1, 0, 1)})
    grid = [replace(best, depth=d, rate=r, trees=lengths[-1]) for d in sorted({min(12, max(2, best.depth + k * steps[1])) for k in (-1, 0, 1)}) for r in sorted({max(0.003, best.rate + k * steps[2]) for k in (-1, 0, 1)})]
    fitted = Boosting(rows, features, target, [Model(s, first_test) for s in grid], date)
    for length in lengths:
        while len(fitted.models[0].trees) < length:
            fitted.grow(range(len(grid)))
        tried += [(mae, replace(grid[k], trees=length), 2, n + k * len(lengths) + lengths.index(length)) for k, mae in fitted.errors(range(len(grid)), first_test, end).items()]
    names = ("trees", "depth", "rate", "min_weight", "subsample", "columns", "l2", "l1")
    table = [(k, stage, mae, *[type_(getattr(s, c)) for c, type_ in zip(names, (int, int, *[float] * 6))]) for mae, s, stage, k in tried]
    return rows.sparkSession.createDataFrame(table, "candidate long, stage int, mae double, trees long, depth long, " + ", ".join(f"{c} double" for c in names[2:])).orderBy("mae", "candidate")
