"""Collocations: frequent phrases that hold together more than their parts make likely, by direct-address tiling.

Words that are frequent enough get ids by their rank within their language. A pair of neighbours is a cell of the matrix of ids,
which is cut into square tiles: a tile with many pairs is counted into a dense array by its cells' addresses (bincount),
all others as sorted coordinates. Counts leave a task summed up, and are added by cell. Frequent pairs are ranked and
get ids in their turn, so that a phrase of k + 1 words is a pair of overlapping phrases of k words, and the same counting finds it.

Tables of ids go out to the tasks in blocks of a bounded number of entries; with more entries there are more passes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.text import with_small_batches
from panelkit.session import written

TILE_BITS = 10
#: A tile is dense from this part of its cells on (one in DENSE).
DENSE = 16
#: Pairs that are counted at once, words that a task holds before it sends their counts, entries of a table of ids that go out at once.
CHUNK, HELD, ENTRIES = 1 << 21, 400_000, 400_000
#: Ids from which on a row ends at the next break, so that readers and batches, which count rows, hold a bounded number of ids; ids that leave a task at once.
ROW, SENT = 512, 1 << 18
#: Longer words stand in the table of ids as checksums.
LONG_WORD = 64
SALT = 16
BREAK = "\n"
_BREAKS = re.compile("[.,;:!?\n-\r]+")


def tokens(text: str | None) -> list[str]:
    """The words of a text with A-Z in lower case; BREAK stands between pieces."""
    lowered = (text or "").encode().lower().decode()  # of bytes, only A-Z has lower case
    return [w for w in _BREAKS.sub(f" {BREAK} ", lowered).replace("\t", " ").split(" ") if w]


def _key(word: str) -> str | bytes:
    return word if len(word) <= LONG_WORD else hashlib.blake2b(word.encode(), digest_size=16).digest()


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, one at a time: texts may be long."""
    return zip(*((x.as_py() for x in column) for column in batch.columns))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            words.pop(BREAK, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["lang", "phrase", "a"])
        held.clear()

    for batch in batches:
        for lang, text in _rows_of(batch):
            words = held.setdefault(lang, Counter())
            size -= len(words)
            words.update(tokens(text))
            size += len(words)
            if size > HELD:
                yield from sent()
                size = 0
    yield from sent()


def _ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with an id from 1 by their order, with no window over all of them."""
    dealt = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))  # a row for each range
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return written(dealt.withColumn("id", place.cast("long")).join(F.broadcast(starts), "part").withColumn("id", F.col("id") + F.col("before")).drop("part", "before"))


def _squeezed(ids: np.ndarray) -> np.ndarray:
    """ids without those that have no neighbour, one 0 between runs."""
    full = ids != 0
    near = np.zeros(len(ids), bool)
    near[:-1] |= full[1:]
    near[1:] |= full[:-1]
    ids = np.where(full & near, ids, 0)
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0
    return ids[keep]


def _ended(ids: np.ndarray) -> np.ndarray:
    """ids with a break at the end."""
    return np.append(ids, 0) if len(ids) and ids[-1] else ids


def _cut(ids: np.ndarray) -> np.ndarray:
    """Where rows of the ids, which end with a break, begin and end: a row goes on to the last break before its next ROW ids, or to its first one."""
    breaks = np.flatnonzero(ids == 0)
    return np.append(0, breaks[np.append(np.diff(breaks // ROW) > 0, True)] + 1)


def _lists(arrays: list[np.ndarray], offsets: np.ndarray, names: list[str], kinds: list[str]) -> pa.RecordBatch:
    """Rows with a list from each array."""
    columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(a, k)) for a, k in zip(arrays, kinds)]
    return pa.RecordBatch.from_arrays(columns, names)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(offsets, the lists of each column one after another) of rows with some CHUNK / 4 ids at once."""
    ends = np.append(0, np.cumsum(batch.column(0).value_lengths().to_numpy()))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + CHUNK // 4, "right")) - 1)
        part = batch.slice(start, stop - start)
        yield ends[start : stop + 1] - ends[start], [c.flatten().to_numpy() for c in part.columns]
        start = stop


def _encode_words(shared: Broadcast, kind: str, first: bool, last: bool):
    """Texts, or what the block before has left of them, to ids: 0 for a break, -1 for a word that is still to be found."""

    def found(batch: pa.RecordBatch, tables: dict[str, dict]) -> Iterator[tuple[str, list[int], list[str]]]:
        if first:
            for lang, text in _rows_of(batch):
                get, words = tables.get(lang, {}).get, tokens(text)
                ids = [0 if w == BREAK else get(w if len(w) <= LONG_WORD else _key(w), -1) for w in words]
                yield lang, ids, [] if last else [w for w, i in zip(words, ids) if i < 0]
        else:
            for lang, ids, rest in _rows_of(batch):
                get = tables.get(lang, {}).get
                more = [get(_key(w), -1) for w in rest]
                it = iter(more)
                yield lang, [next(it) if i < 0 else i for i in ids], [w for w, i in zip(rest, more) if i < 0]

    def sent(held: list) -> pa.RecordBatch:
        if last:
            ids = np.concatenate(held)
            return _lists([ids], _cut(ids), ["ids"], [kind])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())))], ["lang", "ids", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            held, size = [], 0
            for row in found(batch, tables):
                if last:
                    ids = _ended(_squeezed(np.maximum(np.array(row[1], np.int64), 0)))
                    if not len(ids):
                        continue
                held.append(ids if last else row)
                size += len(row[1])
                if size > SENT:
                    yield sent(held)
                    held, size = [], 0
            if held:
                yield sent(held)

    return run


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, n) of the different pairs: crowded tiles by bincount over their cells, the others as sorted coordinates."""
    side = (int(max(left.max(initial=0), right.max(initial=0))) >> TILE_BITS) + 1
    tile = (left >> TILE_BITS) * side + (right >> TILE_BITS)
    names, at, sizes = np.unique(tile, return_inverse=True, return_counts=True)
    crowded = np.flatnonzero(sizes >= (1 << 2 * TILE_BITS) // DENSE)
    parts = []
    low = (1 << TILE_BITS) - 1
    if len(crowded):
        place = np.full(len(names), len(crowded))
        place[crowded] = np.arange(len(crowded))
        at = place[at]
        order = np.argsort(at.astype(np.uint16), kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(crowded) + 1))
        for k, t in enumerate(names[crowded]):
            own = order[ends[k] : ends[k + 1]]
            cells = np.bincount((left[own] & low) << TILE_BITS | right[own] & low, minlength=1 << 2 * TILE_BITS)
            full = np.flatnonzero(cells)
            parts.append((((t // side) << TILE_BITS) + (full >> TILE_BITS), ((t % side) << TILE_BITS) + (full & low), cells[full]))
        left, right = (x[order[ends[-1] :]] for x in (left, right))
    wide = side << TILE_BITS
    codes, n = np.unique(left * wide + right, return_counts=True)
    parts.append((codes // wide, codes % wide, n))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        counted = tile_counts(*(np.concatenate(x).astype(np.int64) for x in zip(*held)))
        held.clear()
        for k in range(0, len(counted[0]), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + SENT]) for x in counted], ["left", "right", "a"])

    for batch in batches:
        for _, (ids,) in _slices(batch):  # every row ends with a 0
            both = (ids[:-1] != 0) & (ids[1:] != 0)
            held.append((ids[:-1][both], ids[1:][both]))
            size += len(held[-1][0])
            if size > CHUNK:
                yield from sent()
                size = 0
    if held:
        yield from sent()


def _encode_pairs(shared: Broadcast, kind: str, out_kind: str, first: bool, last: bool):
    """Each place's pair to its id, 0 where it has none; ids of the shorter phrases go along until the last block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, wide, start = shared.value
        for batch in batches:
            for offsets, (ids, *more) in _slices(batch):
                ids = ids.astype(np.int64)
                found = np.zeros(len(ids), np.int64) if first else more[0].astype(np.int64)
                both = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
                code = ids[:-1][both] * wide + ids[1:][both]
                at = np.minimum(np.searchsorted(codes[0], code), len(codes[0]) - 1)
                same = codes[0][at] == code
                found[both[same]] = codes[1][at[same]] + start
                if not last:
                    yield _lists([ids, found], offsets, ["ids", "found"], [kind, out_kind])
                elif len(found := _ended(_squeezed(found))):
                    yield _lists([found], _cut(found), ["ids"], [out_kind])

    return run


def _kind(n: int) -> str:
    return "int32" if n < 2**31 else "int64"


def _array(kind: str) -> str:
    return "array<int>" if kind == "int32" else "array<long>"


def _words_to_ids(docs: DataFrame, words: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """(rows of ids, the number of words): every row's ids are those of frequent words, with 0 between runs of them."""
    n, spark = words.count(), docs.sparkSession
    kind, rows = _kind(n), docs
    for start in range(0, max(n, 1), entries):
        first, last = start == 0, start + entries >= n
        table: dict[str, dict] = {}
        for r in words.where(F.col("id").between(start + 1, start + entries)).select("lang", "phrase", "id").toLocalIterator():
            table.setdefault(r["lang"], {})[_key(r["phrase"])] = r["id"]
        schema = f"ids {_array(kind)}" if last else "lang string, ids array<long>, rest array<string>"
        rows = written(rows.mapInArrow(_encode_words(spark.sparkContext.broadcast(table), kind, first, last), schema))
    return rows, n


def _pairs_to_ids(rows: DataFrame, pairs: DataFrame, wide: int, entries: int) -> tuple[DataFrame, int]:
    """(rows of the pairs' ids, the number of pairs)."""
    n, spark = pairs.count(), rows.sparkSession
    kind, out = _kind(wide), _kind(n)
    for start in range(0, max(n, 1), entries):
        first, last = start == 0, start + entries >= n
        block = pairs.where(F.col("id").between(start + 1, start + entries)).select("left", "right", "id").toArrow()
        code = block["left"].to_numpy() * wide + block["right"].to_numpy()
        order = np.argsort(code)
        codes = (code[order], (block["id"].to_numpy()[order] - start).astype(np.int32)) if n else (np.full(1, -1), np.zeros(1, np.int32))
        schema = f"ids {_array(out)}" if last else f"ids {_array(kind)}, found {_array(out)}"
        rows = written(rows.mapInArrow(_encode_pairs(spark.sparkContext.broadcast((codes, wide, start)), kind, out, first, last), schema))
    return rows, n


def _with(rows: DataFrame, facts: DataFrame, key: str, large: bool = True) -> DataFrame:
    """rows with the facts of their key. Very many rows may have one key, so each fact goes to SALT places and the rows of a key to all of them.

    The planner takes large facts for no more than their compressed table and may broadcast SALT times as many, hence the hint.
    """
    salted = facts.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALT)])))
    return rows.withColumn("salt", F.pmod("id", F.lit(SALT)).cast("int")).join(salted.hint("merge") if large else salted, [key, "salt"]).drop("salt")


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text", entries: int = ENTRIES) -> DataFrame:
    """(lang, n, phrase, words, a, pre, suf, inside): every phrase of 1 to `longest` words that occurs `least` times in its language.

    pre and suf are the counts of its first and last 1, 2 ... words, itself included; inside is the highest count of a longer phrase here
    that holds it, null without one. Null texts are empty, rows without a language are of `und`; ids, repeated rows and further columns
    have no part. Empty tables give no rows.
    """
    source = with_small_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = written(source.mapInArrow(_count_words, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a")))
    words = _ranked(counted.where(F.col("a") >= least), "lang", F.desc("a"), "phrase")
    sizes = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    once = F.array("a")
    level = _with(words, sizes, "lang", large=False).select("id", "lang", "n", "phrase", F.col("phrase").alias("last"), "a", once.alias("pre"), once.alias("suf"))
    rows, n = _words_to_ids(source, words, entries)
    levels = [level]
    for k in range(2, longest + 1):
        counts = rows.mapInArrow(_count_pairs, "left long, right long, a long").groupBy("left", "right").agg(F.sum("a").alias("a"))
        pairs = _ranked(counts.where(F.col("a") >= least), F.desc("a"), "left", "right")
        if k < longest:
            rows, n = _pairs_to_ids(rows, pairs, n + 1, entries)
        left = level.select(F.col("id").alias("left"), "lang", "n", "phrase", "pre")
        right = level.select(F.col("id").alias("right"), "last", "suf")
        longer = _with(_with(pairs, left, "left"), right, "right")
        own = F.array("a")
        level = written(longer.select("id", "left", "right", "lang", "n", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", F.concat("pre", own).alias("pre"), F.concat("suf", own).alias("suf")))
        levels.append(level)
    out = []
    for k, level in enumerate(levels, 1):
        found = level.withColumn("inside", F.lit(None).cast("long"))
        if k < len(levels):
            holders = levels[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("inside")).groupBy("id").agg(F.max("inside").alias("inside"))
            found = level.join(holders, "id", "left")
        out.append(found.select("lang", "n", "phrase", F.lit(k).alias("words"), "a", "pre", "suf", "inside"))
    return reduce(DataFrame.unionByName, out)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, **columns) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two words or more.

    A phrase is cut in two where floor(1000 * a * n / (l * r)) is lowest, at the first such place; l and r count the parts and n all words of
    the language. A phrase goes if a longer one that holds it is as frequent. Ranks are by score, then a, then phrase in order of
    bytes. Nulls, repeats and empty tables are as in phrases().
    """
    number = lambda c: c.cast("decimal(19,0)")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda j: F.struct(F.element_at("pre", j).alias("l"), F.element_at("suf", F.col("words") - j).alias("r"), j.alias("j")))
    rows = phrases(docs, least, longest, **columns).where((F.col("words") > 1) & (F.col("inside").isNull() | (F.col("inside") < F.col("a"))))
    rows = rows.select("lang", "n", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "n", "phrase", "a", "cut.*")
    above, below = number(F.col("a")) * number(F.col("n")) * F.lit(1000).cast("decimal(4,0)"), number(F.col("l")) * number(F.col("r"))
    rows = rows.withColumns({"above": above.cast("decimal(38,0)"), "below": below.cast("decimal(38,0)")}).withColumn("score", F.expr("above div below"))
    best = rows.groupBy("lang", "phrase").agg(F.min(F.struct("score", "j", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
