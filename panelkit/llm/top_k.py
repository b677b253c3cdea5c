"""Exact top-k search by inner product, by a uniform threshold in three phases.

A vector is cut into segments; a segment's inner product is a partial score, and each node (a group of candidate blocks) has
a list of partial scores by query and segment.

1. Every node sends, for each query, the scores of the k highest entries of each of its lists. The k-th of all that is sent
   for a query is its cutoff t: at least k candidates reach it.
2. The cutoffs go out with the queries. A score of t needs a partial score of t / segments somewhere, so each node collects
   just the entries at or above that in any list.
3. The remaining segments of the collected entries are added exactly; those that reach t compete, k of each node at most.

All numbers are integers. They are multiplied as floats only where a bound shows that no sum leaves the floats' whole numbers.

Queries and candidates meet in blocks: candidates are dealt into groups, every query block goes to every group. No vector
passes through the driver, and no node sends more than k entries for a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import written

#: Vectors in a block of candidates and of queries.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Cutoffs of a task are sent on when they have this many numbers.
HELD = 1 << 24
_LONG = (-(2**63), 2**63 - 1)
#: Stands for a row without an id, and comes after all ids.
NO_ID = 2**63 - 1
_BLOCKS = "g int, block long, n int, dim int, kind string, uids binary, ids binary, data binary, cuts binary"


def scaled(embedding: Column, factor: float = 64) -> Column:
    """The vector as longs, floor(factor * x); null where it is null or holds a null or a component that is not finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(~F.exists(embedding, bad), F.transform(embedding, lambda x: F.floor(x.cast("double") * factor)))


def _matrix(x: pa.ListArray) -> np.ndarray:
    """The vectors as rows, the shorter ones filled up with 0."""
    size = x.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(x), size.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(groups: int, block: int, queries: bool):
    """mapInArrow function: rows (uid, id, x, cut) to blocks. A block of candidates goes to one group, one of queries to all."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, done = [np.zeros(0, np.int64)] * 3 + [np.zeros((0, 0), np.int64)], 0

        def closed(uid: np.ndarray, vid: np.ndarray, cut: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            kind = next((k for k in ("int8", "int16", "int32") if data.min(initial=0) >= np.iinfo(k).min and data.max(initial=0) <= np.iinfo(k).max), "int64")
            to = range(groups) if queries else [(int(uid[0] >> 33) + done) % groups]
            row = (int(uid[0]), len(uid), data.shape[1], kind, uid.tobytes(), vid.tobytes(), data.astype(kind).tobytes(), cut.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(g, *row) for g in to]), _TYPES)], _NAMES)

        for batch in batches:
            more = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "id", "cut")), _matrix(batch.column("x"))]
            dim = max(kept[3].shape[1], more[3].shape[1])
            kept[3], more[3] = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (kept[3], more[3]))
            kept = [np.concatenate(pair) for pair in zip(kept, more)]
            while len(kept[0]) >= block:
                yield closed(*(c[:block] for c in kept))
                kept, done = [c[block:] for c in kept], done + 1
        if len(kept[0]):
            yield closed(*kept)

    return pack


_NAMES = [x.split()[0] for x in _BLOCKS.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


class _Block:
    """A block as arrays, with products by segment."""

    def __init__(self, row: dict) -> None:
        n = row["n"]
        self.key, self.n, self.dim = row["block"], n, row["dim"]
        self.uids = np.frombuffer(row["uids"], np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.no_id = self.ids == NO_ID
        self.cuts = np.frombuffer(row["cuts"], np.int64)
        self.data = np.frombuffer(row["data"], row["kind"]).reshape(n, self.dim)
        self.size = max(abs(int(self.data.min())), abs(int(self.data.max()))) if self.data.size else 0
        self.forms: dict = {}

    def part(self, low: int, high: int, kind) -> np.ndarray:
        if (low, high, kind) not in self.forms:
            self.forms[low, high, kind] = np.ascontiguousarray(self.data[:, low:high]).astype(kind)
        return self.forms[low, high, kind]


def partial_scores(q: _Block, c: _Block, segments: int) -> list[np.ndarray]:
    """For each segment the products of all queries and candidates, exact; components that one side lacks count as 0."""
    dim = min(q.dim, c.dim)
    bound = q.size * c.size * max(dim, 1)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    ends = [dim * k // segments for k in range(segments + 1)]
    return [q.part(a, b, kind) @ c.part(a, b, kind).T for a, b in zip(ends, ends[1:])]


def _whole(x: np.ndarray) -> np.ndarray:
    """Exact scores as longs; what is beyond them counts as the last long."""
    if x.dtype == object:
        return np.clip(x, *_LONG).astype(np.int64)
    return x.astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, _Block]]:
    seen: dict[str, _Block] = {"q": None, "c": None}
    for batch in batches:
        for k in range(batch.num_rows):
            pair = []
            for side in "qc":
                key = batch.column(f"{side}_block")[k].as_py()
                if seen[side] is None or seen[side].key != key:
                    seen[side] = _Block({n: batch.column(f"{side}_{n}")[k].as_py() for n in _NAMES if n != "g"})
                pair.append(seen[side])
            yield pair[0], pair[1]


def _local_scores(k: int, segments: int):
    """Phase 1: (uid, scores): the exact scores of the k highest entries of each list, the k highest of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for uids, best in held.values():
                some = [row[row > _LONG[0]].tolist() for row in best]
                yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(some, pa.list_(pa.int64()))], ["uid", "scores"])
            held.clear()

        for q, c in _pairs(batches):
            parts = partial_scores(q, c, segments)
            own = q.uids[:, None] == c.uids[None, :] if np.intersect1d(q.uids, c.uids).size else None
            top = min(k + (own is not None), c.n)
            at = [np.argpartition(p, c.n - top, axis=1)[:, c.n - top :] if top < c.n else np.broadcast_to(np.arange(c.n), (q.n, c.n)) for p in parts]
            at = np.sort(np.concatenate(at, axis=1), axis=1)
            rows = np.arange(q.n)[:, None]
            scores = _whole(sum(p[rows, at] for p in parts))
            scores[:, 1:][at[:, 1:] == at[:, :-1]] = _LONG[0]  # an entry that leads in more than one list counts once
            if own is not None:
                scores[own[rows, at]] = _LONG[0]
            if q.key in held:
                scores = np.concatenate([held[q.key][1], scores], axis=1)
            held[q.key] = q.uids, np.sort(scores, axis=1)[:, ::-1][:, :k]
            if sum(b.size for _, b in held.values()) > HELD:
                yield from sent()
        yield from sent()

    return run


def _collected(k: int, segments: int):
    """Phases 2 and 3: (query_id, uid, vec_id, score) of the entries that reach their query's cutoff, at most k of a pair of blocks for a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, c in _pairs(batches):
            parts = partial_scores(q, c, segments)
            needed = (q.cuts // segments).astype(parts[0].dtype)  # a cutoff that the type has to round is above all its scores here
            over = parts[0] >= needed[:, None]
            for p in parts[1:]:
                over |= p >= needed[:, None]
            i, j = np.nonzero(over)
            scores = _whole(sum(p[i, j] for p in parts))
            good = (scores >= q.cuts[i]) & (q.uids[i] != c.uids[j])
            i, j, scores = i[good], j[good], scores[good]
            order = np.lexsort((c.uids[j], c.ids[j], ~scores, i))  # ~x falls as x grows, and does not overflow
            i, j, scores = i[order], j[order], scores[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, scores = (x[place < k] for x in (i, j, scores))
            vec = pa.array(c.ids[j], mask=c.no_id[j])
            yield pa.RecordBatch.from_arrays([pa.array(q.uids[i]), pa.array(q.ids[i]), pa.array(c.uids[j]), vec, pa.array(scores)], ["query", "query_id", "uid", "vec_id", "score"])

    return run


def _met(queries: DataFrame, candidates: DataFrame, groups: int) -> DataFrame:
    """Every query block beside every candidate block of a group, for all groups; a merge join can put the query blocks of a group on disk."""
    q, c = (df.withColumnsRenamed({n: f"{side}_{n}" for n in _NAMES if n != "g"}).repartition(groups, "g") for side, df in (("q", queries), ("c", candidates)))
    return c.join(q.hint("merge"), "g")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", segments: int = 2, factor: float = 64, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner products for every row of which is_query holds, all if there are fewer.

    Components become floor(factor * x). Ties go to the smaller id, then to the earlier row; rows without an id come last. Repeated rows
    are rows of their own: each is a candidate for the others and, if a query, answered for itself. A vector that is null, or holds a null
    or a component that is not finite, takes no part; an empty one scores 0 with all, and where lengths differ the components that
    one lacks count as 0. Scores beyond a long count as the last long. An empty table, or one row alone, gives no rows.
    """
    x = scaled(F.col(vector_col), factor)
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = written(rows.where(F.col("x").isNotNull()).withColumn("id", F.coalesce("id", F.lit(NO_ID))))
    groups = max(1, min(-(-rows.count() // block), 3 * vectors.sparkSession.sparkContext.defaultParallelism))
    candidates = written(rows.select("uid", "id", "x", F.lit(_LONG[0]).cast("long").alias("cut")).mapInArrow(_packed(groups, block, False), _BLOCKS))
    asked = rows.where("query").select("uid", "id", "x")

    def blocks(queries: DataFrame) -> DataFrame:
        return queries.mapInArrow(_packed(groups, QUERY_BLOCK, True), _BLOCKS)

    sent = _met(blocks(asked.withColumn("cut", F.lit(_LONG[0]).cast("long"))), candidates, groups).mapInArrow(_local_scores(k, segments), "uid long, scores array<long>")
    merged = sent.groupBy("uid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("scores")), False), 1, k).alias("best"))  # k numbers from each task
    cutoffs = merged.select("uid", F.get("best", F.lit(k - 1)).alias("cut"))
    asked = written(asked.join(cutoffs, "uid", "left").withColumn("cut", F.coalesce("cut", F.lit(_LONG[0]).cast("long"))))  # with fewer than k, all come
    found = _met(blocks(asked), candidates, groups).mapInArrow(_collected(k, segments), "query long, query_id long, uid long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
