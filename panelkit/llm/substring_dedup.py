"""Repeated passages: MinHash banding of paragraphs, exact verification, and components of what is removed.

A paragraph is a line of MIN_PARAGRAPH words or more, and also a block of consecutive lines of fewer than WRAPPED words
each that makes up as many words (an empty line or a longer one ends it), as in hard-wrapped text. Its shingles of five words are sketched by
ROWS * BANDS minima, cut into bands; paragraphs that collide in a band are joined, their Jaccard similarity is
worked out from all their shingles, and those at SIMILARITY or more are linked. Of a component of links,
the paragraphs of the smallest doc_id stay and the others are removed. With 8 bands of 3 rows a pair at
0.8 collides with probability 0.997, one at 0.9 with probability 0.99997.

A passage may also stand in the middle of a paragraph, so sliding windows of CERTAIN words are banded too: the sketch of
a window is the one minimum of the hashes of its runs of SEED words, and the run that has it is a seed. As it depends on
nothing but these words, the same run is the seed wherever the window stands. A seed that an earlier document has too is extended
word by word to both sides as far as the smallest such document agrees, by up to REACH words: what agrees beyond
holds a further seed. What is removed from a document is merged, and runs of fewer than MIN_RUN words stay.

No bucket emits its pairs. Equal paragraphs are one row from the start. Each paragraph's shingles are drawn into
a map of MAP_BITS bits: bits that only one of two paragraphs has set are shingles that the other one lacks, which bounds their common ones from above.
In every bucket all members are first compared with one leader, the one that shares most buckets with others. What is
in one component by then, by way of leaders, need not be compared again; of the rest, the pairs that
pass the bound are compared exactly. In a crowded bucket (paragraphs of one template that are too different to be linked) members
meet by their rarest shingles instead of two by two. Neither bound loses a pair, so that the components are those of all pairs that collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.components import connected_components
from panelkit.llm.prefilter import likely_in
from panelkit.llm.skew import join_facts
from panelkit.llm.text import LAST, documents_of
from panelkit.session import Scratch, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 8, 3
MIN_PARAGRAPH, MIN_RUN = 12, 14
#: Lines of fewer words may be parts of a wrapped paragraph.
WRAPPED = 25
#: Words of a seed; a repeated passage of CERTAIN words or more holds one; words to each side of it that are compared.
SEED, CERTAIN = 14, 50
REACH = CERTAIN - SEED + 1
#: A bucket whose members have more partners in other components than this, on the average, is crowded.
PER_MEMBER = 64
#: Cells of the table that ranks shingles by how rare they are, and of a page of it.
CELLS, PAGE = 1 << 18, 64
#: Bits of the map that a paragraph's shingles are drawn into.
MAP_BITS = 512
#: Words of the documents that are worked on at once.
BATCH_WORDS = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(8)
_A = (_RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def paragraphs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds of the lines in words). Words are runs without ASCII blanks, A-Z lower-cased."""
    lines = [x.split() for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]
    words = [w for x in lines for w in x]
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.cumsum([0, *map(len, lines)])


def blocks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in words of the text's paragraphs, from the bounds of its lines."""
    size = np.diff(bounds)
    short = np.concatenate([[0], (size > 0) & (size < WRAPPED), [0]]).astype(np.int8)
    first, last = np.flatnonzero(np.diff(short) == 1), np.flatnonzero(np.diff(short) == -1)
    several = last - first > 1
    start, end = np.append(bounds[:-1], bounds[first[several]]), np.append(bounds[1:], bounds[last[several]])
    long = end - start >= MIN_PARAGRAPH
    return start[long], end[long]


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash for every five consecutive words."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, SHINGLE):
        out = out * _ODD + words[k : n + k]
    return _mix(out)


def bands(found: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bands of the paragraphs whose shingles lie in [start, end) of the text's; one row for each paragraph."""
    padded = np.append(found, np.uint64(2**64 - 1))
    edges = np.stack([starts, ends], 1).ravel()
    out = np.zeros((len(starts), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat(_mix(padded * _A[k] + _B[k]), edges)[::2]
        out[:, k // ROWS] = _mix(out[:, k // ROWS] * _ODD + least + np.uint64(k + 1))
    return out


def grams(words: np.ndarray) -> np.ndarray:
    """A hash above 0 for every SEED consecutive words."""
    n = len(words) - SEED + 1
    out = words[: max(n, 0)].copy()
    for k in range(1, SEED if n > 0 else 0):
        out = out * _ODD + words[k : n + k]
    return _mix(out) | np.uint64(1)


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The best of every `width` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def seeds(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, hash) of the seeds; [begin, end) are the texts' words, one text after another.

    All of equal smallest hashes are seeds, but of words that repeat over and over only some within CERTAIN words.
    """
    hashes, width = grams(words), REACH
    chosen = np.zeros(len(hashes), bool)
    if len(hashes) >= width:
        least = _sliding(np.minimum, hashes, width)
        at = np.arange(len(least))
        doc = np.searchsorted(begins, at, "right") - 1
        least[at + width - 1 + SEED > ends[doc]] = 0
        none = np.zeros(width - 1, np.uint64)
        chosen = _sliding(np.maximum, np.concatenate([none, least, none]), width) == hashes
    counts = ends - begins - SEED + 1
    brief = (counts > 0) & (counts < width)  # a text with less than one full choice has its smallest
    if brief.any():
        least = np.minimum.reduceat(np.append(hashes, np.uint64(2**64 - 1)), np.stack([begins, begins + counts], 1)[brief].ravel())[::2]
        at = np.concatenate([np.arange(a, a + n) for a, n in zip(begins[brief], counts[brief])])
        chosen[at] = hashes[at] == np.repeat(least, counts[brief])
    start = np.flatnonzero(chosen)
    doc = np.searchsorted(begins, start, "right") - 1
    found = hashes[start]
    new = np.append(True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1]))[: len(start)]
    first = np.maximum.accumulate(np.where(new, start, 0))
    part = (start - first) // width
    keep = new | np.append(new[1:], True)[: len(start)] | np.append(True, part[1:] != part[:-1])[: len(start)]
    return doc[keep], start[keep], found[keep]


def around(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """32-bit hashes of the words of each seed and of REACH words to both sides, 0 beyond the text; a row for each seed."""
    short = (words ^ (words >> np.uint64(32))).astype(np.uint32)
    padded = np.pad(np.where(short == 0, np.uint32(1), short), REACH)
    return padded[starts[:, None] + np.arange(SEED + 2 * REACH)]


def extended(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether the seeds agree, words that agree before, words that agree after) of rows of around()."""
    same = (a == b) & (a != 0)
    run = lambda x: np.cumprod(x, 1, np.int64).sum(1)
    return same[:, REACH : REACH + SEED].all(1), run(same[:, :REACH][:, ::-1]), run(same[:, REACH + SEED :])


UNIT_SCHEMA = "doc long, text_id long, start long, length long, key long, bands array<long>"


def _batch(docs: list, text_ids: list, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The paragraphs and the seeds of a few documents, each as one batch."""
    words = np.concatenate([w for w, _ in texts])
    ends = np.cumsum([len(w) for w, _ in texts])
    begins = ends - [len(w) for w, _ in texts]
    data, names, ids = words.tobytes(), np.array(docs, np.int64), np.array(text_ids, np.int64)
    found = [blocks(b) for _, b in texts]
    doc = np.repeat(np.arange(len(texts)), [len(a) for a, _ in found])
    start, end = (np.concatenate(x) + begins[doc] for x in zip(*found))

    def rows(d: np.ndarray, a: np.ndarray, n: np.ndarray, keys: pa.Array, sketch: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(names[d]), pa.array(ids[d]), pa.array(a - begins[d]), pa.array(n), keys, sketch], names=["doc", "text_id", "start", "length", "key", "bands"]
        )

    if len(doc):
        sketch = bands(shingles(words), start, end - SHINGLE + 1).view(np.int64)
        keys = [xxhash.xxh64_intdigest(data[8 * x : 8 * y]) - 2**63 for x, y in zip(start.tolist(), end.tolist())]
        yield rows(doc, start, end - start, pa.array(keys, pa.int64()), pa.ListArray.from_arrays(np.arange(0, len(doc) * BANDS + 1, BANDS, dtype=np.int32), sketch.ravel()))
    filled = np.flatnonzero(ends > begins)  # so that the begins are all different
    doc, start, keys = seeds(words, begins[filled], ends[filled])
    if len(doc):
        yield rows(filled[doc], start, np.full(len(doc), SEED), pa.array(keys.view(np.int64)), pa.nulls(len(doc), pa.list_(pa.int64())))


def _units(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        docs, ids, texts, size = [], [], [], 0
        for d, i, text in zip(part.column("doc").to_pylist(), part.column("text_id").to_pylist(), part.column("text")):
            docs.append(d)
            ids.append(i)
            texts.append(paragraphs(text.as_py()))
            size += len(texts[-1][0])
            if size > BATCH_WORDS:
                yield from _batch(docs, ids, texts)
                docs, ids, texts, size = [], [], [], 0
        if docs:
            yield from _batch(docs, ids, texts)


def drawn(found: np.ndarray) -> np.ndarray:
    """The map of a set of shingles, as longs."""
    marked = np.zeros(MAP_BITS, np.uint8)
    marked[found & np.uint64(MAP_BITS - 1)] = 1
    return np.packbits(marked).view(np.int64)


def _may_be_similar(a: str, b: str) -> Column:
    """False only for paragraphs (structs n, map) whose Jaccard similarity cannot be SIMILARITY."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")

    def lacking(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"{x}.map")[k].bitwiseAND(F.bitwise_not(F.col(f"{y}.map")[k]))) for k in range(1, MAP_BITS // 64)),
                   F.bit_count(F.col(f"{x}.map")[0].bitwiseAND(F.bitwise_not(F.col(f"{y}.map")[0]))))

    def enough(common: Column) -> Column:
        return common >= SIMILARITY * (n + m - common)

    return (F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & enough(n - lacking(a, b)) & enough(m - lacking(b, a))


def _by_prefix(members: DataFrame, facts: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): the pairs of different components among members(key, u, u_root) that may be similar, by the shingles that are rarest among them.

    With their shingles in one order, two sets of n >= m shingles can only be similar if one of the first n - SIMILARITY * n + 1 of the larger is among the
    first m - 2 * SIMILARITY / (1 + SIMILARITY) * m + 1 of the smaller. What sets a paragraph of a template apart from the others is rare, so it
    fills these places, and paragraphs that are too different have none in common.
    """
    own = scratch.written(members.join(facts.select("key", "found"), "key"))
    # how rare a shingle is, by the cell of a fixed table that it falls into: any order will do that is the same for all, and a count of 1 is never too low

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for part in parts:
            cells += np.bincount(part.column("found").flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
        if cells.any():
            pages = np.minimum(cells, 2**31 - 1).reshape(-1, PAGE)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int32()), pa.array(pages.tolist(), pa.list_(pa.int64()))], ["page", "cells"])

    pages = own.select("found").mapInArrow(counted, "page int, cells array<long>").groupBy("page").agg(*[F.sum(F.col("cells")[k]).alias(f"c{k}") for k in range(PAGE)])
    table = np.zeros((CELLS // PAGE, PAGE), np.int64)
    for r in pages.toLocalIterator():  # CELLS numbers in all, whatever the input
        table[r[0]] = r[1:]
    rarity = members.sparkSession.sparkContext.broadcast(table.ravel())

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, hashes, index = [], [], []
            for row, found in enumerate(part.column("found")):
                x = found.values.to_numpy()
                n = len(x)
                probes, listed = n - ceil(SIMILARITY * n - 1e-9) + 1, n - ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - 1e-9) + 1
                often = rarity.value[x & (CELLS - 1)]
                order = np.lexsort((x, often))[:probes]
                held = often[order] > 1  # others have no second paragraph
                at += [row] * int(held.sum())
                hashes.append(x[order][held])
                index.append((np.arange(len(order)) < listed)[held])
            rows = part.select(["u", "u_root"]).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *hashes])), pa.array(np.concatenate([np.zeros(0, bool), *index]))], ["u", "u_root", "shingle", "index"])

    kind = members.select("u", "u_root").schema.add("shingle", "long").add("index", "boolean")
    placed = scratch.written(own.select("u", "u_root", "found").mapInArrow(first, kind))
    roots = placed.groupBy("shingle", "u_root").agg(F.count("*").alias("size"), F.count_if("index").alias("indexed"))
    shared = roots.groupBy("shingle").agg(F.count("*").alias("roots"), F.sum("indexed").alias("indexed"), F.sum("size").alias("rows"), F.max_by("u_root", "size").alias("main"))
    met = scratch.written(join_facts(placed, shared.where("roots > 1 and indexed > 0").drop("roots", "indexed"), "shingle", "rows"))
    listed = met.where("index").select("shingle", F.col("u").alias("v"), F.col("u_root").alias("v_root"), "main")
    apart = (F.col("u_root") != F.col("v_root")) & (F.struct("u.n", "u.key") > F.struct("v.n", "v.key")) & _may_be_similar("u", "v")
    on_shingle = lambda probing, held: probing.select("shingle", "u", "u_root").join(held.drop("main"), "shingle").where(apart)
    is_main = F.col("v_root") == F.col("main")
    pairs = on_shingle(met, listed.where(~is_main)).unionByName(on_shingle(met.where("u_root <> main"), listed.where(is_main)))
    return pairs.select("u", "v")


def _links(kinds: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(u, v): keys of different paragraphs that collide in a band and are similar enough, but for pairs that others link.

    scratch gets the tables in between. kinds: key, bands of every paragraph; classes: key, n_rows, at (where one of its paragraphs is); docs: doc, text_id, text.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    placed = kinds.select("key", F.explode("bands").alias("bucket"))
    buckets = scratch.written(placed.groupBy("bucket").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("size")).where("least < most").select("bucket", "size"))
    shared = scratch.written(join_facts(placed.where(likely_in(buckets, "bucket")(F.col("bucket"))), buckets.withColumn("rows", F.col("size")), "bucket", "rows").distinct())
    wanted = shared.groupBy("key").agg(F.sum("size").alias("weight")).join(classes.select("key", "n_rows", "at.*"), "key")
    span = F.struct("key", "start", "length", "weight", "n_rows")
    by_doc = scratch.written(wanted.groupBy("doc", "text_id").agg(F.collect_list(span).alias("spans")))
    needed = docs.where(likely_in(by_doc, "text_id")(F.col("text_id")))

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text, spans in zip(part.column("text"), part.column("spans").to_pylist()):
                words, _ = paragraphs(text.as_py())
                for s in spans:
                    found = np.unique(shingles(words[s["start"] : s["start"] + s["length"]]))
                    rows.append((s["key"], s["weight"], s["n_rows"], len(found), drawn(found), found.view(np.int64)))
            columns = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["key", "weight", "n_rows", "n", "map", "found"])

    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
    sized = needed.join(by_doc, ["doc", "text_id"]).select("text", "spans").mapInArrow(sets, "key long, weight long, n_rows long, n long, map array<long>, found array<long>")
    facts = scratch.written(sized.dropDuplicates(["key"]))
    members = scratch.written(shared.drop("size").join(facts.drop("found"), "key").select("bucket", F.struct("key", "n", "map").alias("u"), F.struct("weight", "n_rows", F.xxhash64("key", "bucket")).alias("rank")))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (facts.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("found").alias(f"found_{x}")) for x in "uv")
        both = pairs.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("found_u", "found_v")))
        return both.where(F.col("common") >= SIMILARITY * (F.col("n_u") + F.col("n_v") - F.col("common"))).select("u", "v")

    pair = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    leaders = members.groupBy("bucket").agg(F.max_by("u", "rank").alias("v"), F.count("*").alias("rows"))
    led = join_facts(members, leaders, "bucket", "rows").where((F.col("u.key") != F.col("v.key")) & _may_be_similar("u", "v"))
    linked = scratch.written(verified(led.select(*pair("u.key", "v.key")).distinct()))
    # what is in one component by now need not be compared again: copies of one paragraph have met by way of their leaders
    roots = connected_components(linked).withColumnRenamed("node", "key")
    known = scratch.written(members.join(roots, F.col("u.key") == F.col("key"), "left").select("bucket", "u", "rank", F.coalesce("root", "u.key").alias("u_root")))
    by_root = known.groupBy("bucket", "u_root").agg(F.count("*").alias("size"), F.max("rank").alias("rank"))
    sizes = by_root.groupBy("bucket").agg(F.count("*").alias("roots"), F.sum("size").alias("rows"), F.sum(F.col("size") * F.col("size")).alias("inside"), F.max_by("u_root", "rank").alias("main"))
    crowded = F.col("rows") * F.col("rows") - F.col("inside") > PER_MEMBER * F.col("rows")
    known = scratch.written(join_facts(known.drop("rank"), sizes.where("roots > 1").select("bucket", "main", "rows", F.col("rows").alias("count"), crowded.alias("crowded")), "bucket", "count"))
    few = known.where("not crowded")
    others = few.where("u_root <> main").drop("main")
    met = few.select("bucket", F.col("u").alias("v"), F.col("u_root").alias("v_root"), "main")
    once = (F.col("v_root") == F.col("main")) | (F.col("u.key") < F.col("v.key"))
    rest = others.join(met, (others["bucket"] == met["bucket"]) & (F.col("u_root") != F.col("v_root")) & once & _may_be_similar("u", "v"))
    many = scratch.written(known.where("crowded").groupBy("u.key").agg(F.first("u").alias("u"), F.first("u_root").alias("u_root")))
    rest = rest.select("u", "v")
    if not many.isEmpty():
        rest = rest.unionByName(_by_prefix(many, facts, scratch))
    return linked.unionByName(verified(rest.select(*pair("u.key", "v.key")).distinct()))


def _extended(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, text_id, start, end, component, kept): the seeds with the words around them that the kept document has as well.

    found: doc, text_id, start, key of repeated seeds, and kept_at (doc, text_id, start) of the one that stays; docs: doc, text_id, text.
    """
    mine = found.select("doc", "text_id", "start", "key", F.lit(True).alias("mine"))
    of_kept = found.groupBy("key").agg(F.min("kept_at").alias("at")).select("at.*", "key", F.lit(False).alias("mine"))
    by_doc = written(mine.unionByName(of_kept).groupBy("doc", "text_id").agg(F.collect_list(F.struct("start", "key", "mine")).alias("spans")))
    fields = ["doc", "text_id", "start", "key", "mine", "words"]

    def contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc, text_id, text, spans in zip(part.column("doc").to_pylist(), part.column("text_id").to_pylist(), part.column("text"), part.column("spans")):
                words, _ = paragraphs(text.as_py())
                start, key, mine = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                for i in range(0, len(start), 5000):
                    at = start[i : i + 5000]
                    names = (np.full(len(at), doc), np.full(len(at), text_id))
                    cells = pa.array([x.tobytes() for x in around(words, at)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (*names, at, key[i : i + 5000], mine[i : i + 5000])), cells], names=fields)

    needed = docs.where(likely_in(by_doc, "text_id")(F.col("text_id"))).join(by_doc, ["doc", "text_id"]).select("doc", "text_id", "text", "spans")
    placed = written(needed.mapInArrow(contexts, "doc long, text_id long, start long, key long, mine boolean, words binary"))
    out = ["doc", "text_id", "start", "end", "component", "kept"]

    def extend(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, SEED + 2 * REACH) for c in ("words", "kept_words"))
            doc, text_id, start, key, kept = (part.column(c).to_numpy() for c in ("doc", "text_id", "start", "key", "kept"))
            good, before, after = extended(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (doc, text_id, start - before, start + SEED + after, key, kept)], names=out)

    kept_words = placed.where("not mine").groupBy("key").agg(F.min(F.struct("doc", "words")).alias("x")).select("key", F.col("x.doc").alias("kept"), F.col("x.words").alias("kept_words"))
    both = placed.where("mine").join(kept_words, "key").select("doc", "text_id", "start", "key", "kept", "words", "kept_words")
    return both.mapInArrow(extend, "doc long, text_id long, start long, end long, component long, kept long")


def _in_runs(parts: DataFrame) -> DataFrame:
    """parts(doc, text_id, start, end, component) with `run`, the number of the run of touching parts within the text."""
    order = Window.partitionBy("doc", "text_id").orderBy("start", "end", "component")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("long")).withColumn("run", F.sum("new").over(order)).drop("new")


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_id, text); rows without an id have the largest long, and text_id is a hash of the text."""
    return documents_of(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_id"), "text")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each run of words to be removed: doc_id, text_id, start_word, n_words, kept_doc_id, component.

    kept_doc_id is the smallest document that has the passage and keeps it; component names the group of the run's
    first part; text_id is xxhash64 of the text that the words are counted in, as rows of one doc_id may have different texts.
    Every document that shares CERTAIN words in a row with an earlier one has a row within them. Repetition within one document is
    no ground for removal; rows of equal doc_id, and all rows without one (which sort last), count as one document, each text of which
    has its own runs. Null and empty texts and tables give no rows; repeated rows give each run once.
    """
    rows = _identified(docs, id_col, text_col)
    units = written(rows.mapInArrow(_units, UNIT_SCHEMA))
    is_paragraph = F.col("bands").isNotNull()
    at = F.struct("doc", "text_id", "start", "length")
    classes = written(units.where(is_paragraph).groupBy("key").agg(F.min(at).alias("at"), F.max("doc").alias("last_doc"), F.count("*").alias("n_rows")))
    scratch = Scratch(docs.sparkSession)
    roots = connected_components(_links(units.where(is_paragraph).select("key", "bands"), classes, rows, scratch))
    scratch.drop()  # the components lie in a checkpoint of their own
    rooted = classes.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    kept = rooted.groupBy("root").agg(F.min("at.doc").alias("kept"), F.max("last_doc").alias("last")).where("kept < last").drop("last")
    place = "struct<doc: long, text_id: long, start: long>"
    of_paragraphs = rooted.join(kept, "root").select("key", F.lit(True).alias("paragraph"), F.col("root").alias("component"), "kept", F.lit(None).cast(place).alias("kept_at"))
    of_seeds = units.where(~is_paragraph).groupBy("key").agg(F.min(F.struct("doc", "text_id", "start")).alias("kept_at"), F.max("doc").alias("last")).where("kept_at.doc < last")
    of_seeds = of_seeds.select("key", F.lit(False).alias("paragraph"), F.col("key").alias("component"), F.col("kept_at.doc").alias("kept"), "kept_at")
    repeated = written(of_paragraphs.unionByName(of_seeds))
    found = (
        units.where(likely_in(repeated, "key")(F.col("key")))
        .select("doc", "text_id", "start", (F.col("start") + F.col("length")).alias("end"), "key", is_paragraph.alias("paragraph"))
        .join(repeated, ["key", "paragraph"])
        .where("doc > kept")
        .distinct()
    )
    run = Window.partitionBy("doc", "text_id", "run")
    found = written(_in_runs(found).withColumns({"run_start": F.min("start").over(run), "run_end": F.max("end").over(run)}))
    # a seed deep within a run is only extended over words that are removed anyhow
    outer = found.where(~F.col("paragraph") & ((F.col("start") < F.col("run_start") + REACH) | (F.col("end") > F.col("run_end") - REACH)))
    removed = found.select("doc", "text_id", "start", "end", "component", "kept").unionByName(_extended(outer, rows)).distinct()
    merged = _in_runs(removed).groupBy("doc", "text_id", "run").agg(
        F.min("start").alias("start_word"), (F.max("end") - F.min("start")).alias("n_words"), F.min("kept").alias("kept_doc_id"), F.min_by("component", "start").alias("component")
    )
    doc_id = F.nullif(F.col("doc"), F.lit(LAST)).alias("doc_id")
    return merged.where(F.col("n_words") >= MIN_RUN).select(doc_id, "text_id", "start_word", "n_words", "kept_doc_id", "component")


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed words of repeated_passages() taken out of the text; lines left without words go too.

    Only the text that a run was found in loses it: rows of one doc_id, or without one, that have other texts keep theirs.
    """
    spans = repeated_passages(docs, id_col, text_col).groupBy(F.coalesce("doc_id", F.lit(LAST)).alias("__doc"), F.col("text_id").alias("__text_id"))
    spans = spans.agg(F.collect_list(F.struct("start_word", "n_words")).alias("__spans"))
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)) == F.col("__doc")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__text_id"))
    joined = docs.join(spans, same, "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([t if s is None else without(t, [(x["start_word"], x["n_words"]) for x in s]) for t, s in zip(texts, spans)])

    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("__spans")))).drop("__doc", "__text_id", "__spans")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words start .. start + n - 1 of each span."""
    gone = {k for a, n in spans for k in range(a, a + n)}
    lines, k = [], 0
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        kept = [w for i, w in enumerate(words, k) if i not in gone]
        if len(kept) == len(words):
            lines.append(line)
        elif kept:
            lines.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        k += len(words)
    return "\n".join(lines)
