"""Benchmark decontamination with suffix arrays over the training shards.

The benchmark is read in blocks of bounded size; each block goes to all shards, and a shard is as many documents of a
partition as make up SHARD_WORDS words. The words of a shard become numbers of the block's vocabulary. A suffix that holds a word
from outside the vocabulary within its first `window` words matches nothing; the other suffixes are
sorted into the shard's suffix array by these first words. Every different window that a test suffix begins with is found in
it by binary search, which marks whole ranges of the array at once; words that are hit follow from the marked places.

At marked places the match is extended to the longest verbatim one by binary search in the sorted suffixes of the block. A match within
the one that began before it is passed over, so that a place costs a few searches, however often its words are repeated.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.text import LAST, documents_of, with_small_batches
from panelkit.session import written

WINDOW = 10
#: Bounds of what is sent to the executors at once: UTF-8 bytes of benchmark text (an item may exceed it alone).
BLOCK_BYTES = 16_000_000
#: Words of a shard; a document may exceed it alone.
SHARD_WORDS = 2_000_000

_TO_WORDS = bytes(
    c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of digits, letters a-z and all characters from U+0080 on, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def sorted_suffixes(ids: np.ndarray) -> np.ndarray:
    """The places of all suffixes in their order, by doubling the length that is sorted by."""
    rank, length = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while length < len(ids):
        after = np.zeros_like(rank)
        after[:-length] = rank[length:] + 1
        pairs = rank * (len(ids) + 1) + after
        order = np.argsort(pairs, kind="stable")
        new = np.append(0, np.cumsum(np.diff(pairs[order]) > 0))
        rank[order] = new
        if new[-1] == len(ids) - 1:
            return order
        length *= 2
    return np.argsort(rank, kind="stable")


class Block:
    """A block of test items: numbers of its words from 1, its different windows ready for the search, and its sorted suffixes."""

    def __init__(self, items: list[tuple], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names, parts = [], []
        for name, text in items:
            if words := words_of(text):
                self.names.append(name)
                parts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], ">u4"))
        lengths = np.array([len(x) for x in parts], np.int64)
        self.begins = np.cumsum(np.append(0, lengths + 1))[:-1]
        ids = np.full(int(lengths.sum()) + len(parts), 2**32 - 1, ">u4")  # a number that no document holds ends each item
        for x, b in zip(parts, self.begins):
            ids[b : b + len(x)] = x
        self.data, self.order = ids.tobytes(), sorted_suffixes(ids)
        #: depth -> (the windows of that many words as sorted bytes, the set of items of each); short items are whole windows of their own depth
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.item_sets: list[tuple[int, ...]] = []
        sets: dict[tuple[int, ...], int] = {}
        for depth in sorted(set(np.minimum(window, lengths).tolist())):
            owners: dict[bytes, dict[int, None]] = {}
            for k in np.flatnonzero(np.minimum(window, lengths) == depth).tolist():
                data = parts[k].tobytes()
                for p in range(len(parts[k]) - depth + 1):
                    owners.setdefault(data[4 * p : 4 * (p + depth)], {})[k] = None
            keys = sorted(owners)
            self.windows[depth] = (np.array(keys, f"S{4 * depth}"), np.array([sets.setdefault(tuple(owners[w]), len(sets)) for w in keys], np.int64))
        self.item_sets = list(sets)

    def find(self, words: bytes) -> int | None:
        """A place of these words in the items: that of the first suffix that begins with them."""
        data, order, n = self.data, self.order, len(words)
        k = bisect_left(range(len(order)), words, key=lambda i: data[4 * order[i] : 4 * order[i] + n])
        if k < len(order) and data[4 * order[k] : 4 * order[k] + n] == words:
            return int(order[k])
        return None

    def located(self, place: int) -> tuple[str, int]:
        """The item's name and its word at a place."""
        k = int(np.searchsorted(self.begins, place, "right")) - 1
        return self.names[k], place - int(self.begins[k])


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The given suffixes sorted by their first `depth` words: (those words as bytes, starts)."""
    windows = np.lib.stride_tricks.sliding_window_view(ids, depth)[starts]
    keys = np.ascontiguousarray(windows).view(f"S{4 * depth}").ravel()
    order = np.argsort(keys, kind="stable")
    return keys[order], starts[order]


def numbered(block: Block, text: str | None) -> np.ndarray:
    """The words of a text as numbers of the block's vocabulary, 0 for others."""
    words = words_of(text)
    return np.fromiter(map(block.vocabulary.get, words, [0] * len(words)), np.int64, len(words)).astype(">u4")


class Shard:
    """A few documents and where windows of a block's items occur in them."""

    def __init__(self, block: Block, texts: list[np.ndarray]) -> None:
        self.block, self.lengths = block, np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(np.append(0, self.lengths + 1))[:-1]
        self.ids = np.zeros(int(self.lengths.sum()) + len(texts) + 1, ">u4")  # a 0 after each document ends its suffixes
        for t, b in zip(texts, self.begins):
            self.ids[b : b + len(t)] = t
        known = np.append(0, np.cumsum(self.ids > 0))
        change = np.zeros(len(self.ids) + 1, np.int64)
        #: depth -> the places where a window of it begins, in order
        self.starts: dict[int, np.ndarray] = {}
        docs, sets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for depth, (keys, item_sets) in block.windows.items():
            if len(self.ids) < depth:
                continue
            starts = np.flatnonzero(known[depth:] - known[:-depth] == depth)
            array, at = suffix_array(self.ids, starts, depth)
            lows, highs = np.searchsorted(array, keys, "left"), np.searchsorted(array, keys, "right")
            found = np.flatnonzero(highs > lows)
            sizes = highs[found] - lows[found]
            places = np.arange(sizes.sum()) + np.repeat(lows[found] - np.cumsum(np.append(0, sizes[:-1])), sizes)
            begin = at[places]
            change += np.bincount(begin, minlength=len(change)) - np.bincount(begin + depth, minlength=len(change))
            self.starts[depth] = np.sort(begin)
            docs.append(self.doc_of(begin))
            sets.append(np.repeat(item_sets[found], sizes))
        self.hit = np.cumsum(change)[:-1] > 0
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(sets)], 1), axis=0)
        self.items: list[set[str]] = [set() for _ in texts]
        for d, k in pairs.tolist():
            self.items[d].update(block.names[i] for i in block.item_sets[k])

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, "right") - 1

    def spans(self) -> list[list[list[int]]]:
        """For each document the runs [start, end) of words that are hit."""
        edges = np.diff(np.concatenate([[0], self.hit.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        out: list[list[list[int]]] = [[] for _ in self.lengths]
        for d, a, b in zip(self.doc_of(first).tolist(), first.tolist(), last.tolist()):
            begin = int(self.begins[d])
            out[d].append([a - begin, b - begin])
        return out

    def matches(self) -> Iterator[tuple[int, int, int, str, int]]:
        """(document's place, its word, words, item, item's word) of the longest verbatim match at each marked place, but for those within the one before."""
        data, block = self.ids.tobytes(), self.block
        for depth, starts in self.starts.items():
            end = -1
            for start, doc in zip(starts.tolist(), self.doc_of(starts).tolist()):
                n = depth
                if depth == block.window:
                    n = max(n, end + 1 - start)
                at = block.find(data[4 * start : 4 * (start + n)])
                if at is None:
                    continue
                if depth == block.window:
                    step = 1
                    while step:  # longer by powers of two as long as the words occur, then by smaller ones
                        longer = block.find(data[4 * start : 4 * (start + n + step)]) if 4 * (start + n + step) <= len(data) else None
                        if longer is not None:
                            n, at, step = n + step, longer, step * 2
                        else:
                            step //= 2
                end = start + n
                yield doc, start - int(self.begins[doc]), n, *block.located(at)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Block]:
    """Items in blocks of bounded size, one after another."""
    items, size = [], 0
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    for name, text in rows.toLocalIterator():
        if items and size + len(text) * 4 > BLOCK_BYTES:
            yield Block(items, window)
            items, size = [], 0
        items.append((name, text))
        size += len(text) * 4
    if items:
        yield Block(items, window)


def _in_shards(block: Block, column: str, report: Callable[[Shard, pa.RecordBatch | pa.Table], pa.RecordBatch | Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that gathers batches to shards and reports each of them."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0
        for part in parts:
            held.append(part)
            for t in part.column(column):
                texts.append(numbered(block, t.as_py()))
                size += len(texts[-1])
            if size > SHARD_WORDS:
                yield from report(Shard(block, texts), pa.Table.from_batches(held))
                held, texts, size = [], [], 0
        if held:
            yield from report(Shard(block, texts), pa.Table.from_batches(held))

    return batches


def _block_by_block(blocks: Iterator[Block], run: Callable[[Block], DataFrame]) -> DataFrame | None:
    """The union of what run() gives for each block. Where there are several, each one's rows are written
    before the one after the next is read, so that two blocks are on the driver at most."""
    block, after, found = next(blocks, None), next(blocks, None), None
    if block is None or after is None:
        return run(block) if block else None
    while block:
        rows = written(run(block))
        found = rows if found is None else found.unionByName(rows)
        block, after = after, next(blocks, None)
    return found


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_word, n_words, item_id, item_word): the longest verbatim matches of test suffixes in documents.

    A match has at least `window` words, or all words of a shorter item; of matches that begin one after another, those
    that reach no further than the one before are left out, and of several items that have the words one is named. item_id is text; items without
    words, and null ones, match nothing. Null or empty texts and tables give no rows; repeated rows give theirs one by one.
    """
    schema = "doc_id long, doc_word long, n_words long, item_id string, item_word long"

    def report(shard: Shard, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, word, n, item, place = zip(*found) if (found := list(shard.matches())) else ([],) * 5
        ids = rows.column("doc_id").combine_chunks().take(pa.array(doc, pa.int64()))
        columns = [ids, pa.array(word, pa.int64()), pa.array(n, pa.int64()), pa.array(item, pa.string()), pa.array(place, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc_word", "n_words", "item_id", "item_word"])

    rows = documents_of(docs, id_col, text_col)
    found = _block_by_block(_blocks(benchmark, item_col, "text", window), lambda block: rows.mapInArrow(_in_shards(block, "text", report), schema))
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def document_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest.

    n_hit counts the words inside any match, `longest` the words of the longest one (0 without). Repeated
    rows are reported one by one, null ids too.
    """

    def report(shard: Shard, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        longest = np.zeros(len(shard.lengths), np.int64)
        for doc, _, n, *_ in shard.matches():
            longest[doc] = max(longest[doc], n)
        columns = [
            rows.column("doc_id").combine_chunks(), rows.column("row").combine_chunks(), pa.array(shard.lengths),
            pa.array(shard.spans(), pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in shard.items], pa.list_(pa.string())), pa.array(longest),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_words", "spans", "items", "longest"])

    rows = documents_of(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    schema = "doc_id long, row long, n_words long, spans array<array<long>>, items array<string>, longest long"
    run = lambda block: rows.mapInArrow(_in_shards(block, "text", report), schema)
    blocks = _blocks(benchmark, item_col, "text", window)
    first, second = next(blocks, Block([], window)), next(blocks, None)
    if second is None:
        found = run(first)
    else:  # a row's findings from all blocks meet again by its number in the table
        found = _block_by_block(_and_then([first, second], blocks), run).groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"),
        )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s[1] - F.greatest(s[0], acc["end"]))).alias("n"), F.greatest(acc["end"], s[1]).alias("end")
        ),
        lambda acc: acc["n"],
    )
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        "longest",
    )


def _and_then(held: list[Block], rest: Iterator[Block]) -> Iterator[Block]:
    while held:
        yield held.pop(0)
    yield from rest


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of a test item.

    With one block of items the decision is made row by row, with no shuffle. With several, the contaminated rows of each block are written
    as (document, hash of the text) and taken out at the end. Null ids and repeated rows are judged by their texts.
    """
    blocks = _blocks(benchmark, item_col, "text", window)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        k = docs.columns.index(text_col)

        def clean(shard: Shard, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from rows.filter(pa.array([not x for x in shard.items], pa.bool_())).to_batches()

        return with_small_batches(docs).mapInArrow(_in_shards(first, docs.columns[k], clean), docs.schema)
    row = [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("__doc"), F.xxhash64(F.col(text_col).cast("string")).alias("__text_id")]
    slim = with_small_batches(docs).select(*row, F.col(text_col).cast("string").alias("text"))

    def contaminated(shard: Shard, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from rows.select(["__doc", "__text_id"]).filter(pa.array([bool(x) for x in shard.items], pa.bool_())).to_batches()

    run = lambda block: slim.mapInArrow(_in_shards(block, "text", contaminated), "__doc long, __text_id long")
    gone = _block_by_block(_and_then([first, second], blocks), run).distinct()
    return docs.withColumns({"__doc": row[0], "__text_id": row[1]}).join(gone, ["__doc", "__text_id"], "left_anti").drop("__doc", "__text_id")
