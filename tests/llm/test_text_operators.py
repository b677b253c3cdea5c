import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import components, decontamination, line_dedup, packing, quality_rules, queries, sharding, simhash, skew
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


ODD = [
    (1, None), (2, ""), (3, "   \n\t\n"), (4, "A long line here\nA long line here\nshort"), (5, "  a LONG line here \nother words of this one"),
    (6, "É à la carte ÉÉÉÉÉ\né à la carte ééééé"), (7, "x" * 200_000), (8, "one two\n" * 3000), (9, "\n"), (10, "A long line here\n\nlast"),
]


def test_line_dedup(spark, rows):
    for given in (rows, ODD):
        got = {r.doc_id: (r.kept_lines_before, r.kept_lines_dropped, r.s) for r in line_dedup.dedup_lines(frame(spark, given)).withColumn("s", F.sha2("kept_text", 256)).collect()}
        assert got == brute.line_dedup(given)


def test_line_dedup_hot_lines_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LINES", 3)
    given = [(d, "a very common line\nrare line %d\nhalf common %d" % (d, d % 20)) for d in range(200)]
    got = {r.doc_id: (r.kept_lines_before, r.kept_lines_dropped, r.s) for r in line_dedup.dedup_lines(frame(spark, given)).withColumn("s", F.sha2("kept_text", 256)).collect()}
    assert got == brute.line_dedup(given)


def test_line_dedup_null_ids_repeats_and_clashing_columns(spark):
    df = frame(spark, [(None, "the same long line"), (5, "the same long line"), (5, "the same long line"), (5, None)]).withColumns({"doc": F.lit(1), "pos": F.lit(2), "h1": F.lit(3), "key": F.lit(4)})
    got = sorted(((r.doc_id is None, r.kept_text) for r in line_dedup.dedup_lines(df).collect()))
    assert got == [(False, ""), (False, "the same long line"), (False, "the same long line"), (True, "")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_keep_bitmaps_are_sparse(spark):
    given = [(1, "\n".join(f"line number {i:05d}" for i in range(300))), (2, "\n".join(f"line number {i:05d}" if i == 130 else f"own line {i:05d}" for i in range(300)))]
    found = line_dedup.keep_bitmaps(frame(spark, given)).collect()
    assert [(r.doc, r.n_dropped, [(w.word, w.bits) for w in r.keep]) for r in found] == [(2, 1, [(2, ~(1 << 2))])]


def test_quality_rules(spark, rows):
    given = [*rows, *ODD, (11, "a b c d e f g h " * 30), (12, "a b c d e f g h i a b c d e f g h i")]
    given = [(i, t) for i, (_, t) in enumerate(given)]
    got = quality_rules.apply_rules(frame(spark, given)).collect()
    for r, (d, t) in zip(sorted(got, key=lambda r: r.doc_id), given):
        want = brute.quality_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, d
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(frame(spark, [(None, None)]).withColumn("words", F.lit(1))).first().base_failed
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0


def test_stop_words_of_other_languages(spark):
    known = {"it": "il gatto e la volpe sono " * 10, "EN": "The Cat AND The Dog Were IN " * 10, "ru": "кошка собака лес река гора поле " * 10, "junk": "xqzv qqrt zzzk vvbn ppll wwrr " * 10}
    rows = [(k, " ".join(f"{w}{i}" if i % 7 and name in ("ru", "junk") else w for i, w in enumerate(t.split()))) for k, (name, t) in enumerate(known.items())]
    got = quality_rules.measures(frame(spark, rows)).orderBy("doc_id").collect()
    passed = quality_rules.measures(frame(spark, rows)).orderBy("doc_id").select(quality_rules.verdict([r for r in quality_rules.THRESHOLDS if r.numerator == "n_stop_words"]).alias("ok")).collect()
    assert got[0].n_stop_words >= 20 and got[1].n_stop_words >= 30 and got[2].n_stop_words is None and got[3].n_stop_words == 0
    assert [r.ok for r in passed] == [True, True, True, False]


def test_quality_rules_run_without_user_functions(spark, rows):
    plan = quality_rules.apply_rules(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_simhash(spark, rows):
    given = [*rows, (100_001, None), (100_002, " "), (100_003, "A b"), (100_004, "a B")]
    fps = {d: brute.fingerprint(t) for d, t in given}
    roots = brute.components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, given)).collect()}
    assert got == {d: (f"{fps[d]:016x}", roots[d]) for d, _ in given}


@pytest.mark.parametrize("per_cell", [256, 0.0001])
def test_links_of_crowded_cells(spark, per_cell, monkeypatch):
    monkeypatch.setattr(simhash, "blocks_for", lambda n, distance: blocks(n, distance, per_cell))
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), False)) for b in base[:6] for _ in range(20)]
    fps = dict(enumerate({*base, *near}))
    edges = simhash.fingerprint_links(frame(spark, [(simhash._signed(x), 1) for x in fps.values()], "fp long, n long"))
    assert all(((r.u ^ r.v) % 2**64).bit_count() <= 4 for r in edges.collect())
    found = {r.node: r.root for r in components.connected_components(edges).collect()}
    want = brute.components(fps)
    groups, wanted = defaultdict(set), defaultdict(set)
    for i, x in fps.items():
        groups[found.get(simhash._signed(x), simhash._signed(x))].add(i)
        wanted[want[i]].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


blocks = simhash.blocks_for


def test_copies_grow_slowly():
    assert [len(simhash._cells(blocks(n, 4), 4)) for n in (10**6, 10**8, 10**10)] == [15, 35, 210]


def test_unlinked_texts_of_one_id_stay(spark):
    a, b, long = "a b c d e f g", "q r s t u v w", "one two three four five " * 20_000
    df = frame(spark, [(5, a), (5, b), (5, b), (6, a), (7, long), (8, long), (9, None), (9, "")])
    kept = sorted((r.doc_id, r.text or "") for r in simhash.keep_one_of_each(df).collect())
    assert kept == [(5, a), (5, b), (7, long), (9, "")]


def test_hot_keys_are_joined_whole(spark):
    rows = frame(spark, [(k, "x" if k % 3 else f"k{k}") for k in range(3000)] + [(0, None), (1, "none")]).withColumnRenamed("text", "key")
    facts = rows.where("key <> 'none'").groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    got = sorted((r.doc_id, r.key, r["last"]) for r in skew.join_facts(rows, facts, "key", "n").collect())
    assert got == sorted((k, "x" if k % 3 else f"k{k}", 2999 if k % 3 else k) for k in range(3000))


def test_manhattan_is_a_lower_bound(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(a) ^ int(b)) for a, b in zip(rng.integers(-(2**63), 2**63, 500), rng.integers(-(2**63), 2**63, 500) & rng.integers(-(2**63), 2**63, 500))]
    df = frame(spark, pairs, "a long, b long").select("a", "b", simhash.manhattan(simhash.segment_counts(F.col("a")), simhash.segment_counts(F.col("b"))).alias("d"))
    for a, b, d in df.collect():
        counts = [[(x >> 2 * s & 3).bit_count() for s in range(32)] for x in (a % 2**64, b % 2**64)]
        assert d == sum(abs(x - y) for x, y in zip(*counts)) <= ((a ^ b) % 2**64).bit_count()


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (None, 3)]
    found = {r.node: r.root for r in components.connected_components(frame(spark, path, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}
    assert components.connected_components(frame(spark, [], "u long, v long")).count() == 0


def test_near_duplicates_with_nulls_and_repeats(spark):
    df = frame(spark, [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "z")]).withColumn("fp", F.lit("x"))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in simhash.keep_one_of_each(df).collect()) == ["7", "None", "None"]


def test_decontamination(spark, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "Hidden short item"), (901, None), (902, "?!")]
    given = [*rows, (100_001, None), (100_002, ""), (100_003, "a HIDDEN, short-item b"), (100_004, "hidden short"), (100_005, items[0][1] + " " + items[0][1])]
    want = brute.contamination(given, items)
    report = decontamination.document_report(frame(spark, given), frame(spark, items, "item_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in report} == want
    kept = decontamination.drop_contaminated(frame(spark, given), frame(spark, items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, x in want.items() if not x[4])


def test_decontamination_in_several_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 3000)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    report = decontamination.document_report(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in report} == brute.contamination(rows, items)


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "x " + " ".join(f"w{i}" for i in range(5, 25)) + " y"), (2, " ".join(f"w{i}" for i in range(9)))]
    found = decontamination.verbatim_matches(frame(spark, docs), frame(spark, [(1, item)], "item_id long, text string")).collect()
    assert [tuple(r) for r in found] == [(1, 1, 20, "1", 5)]


def longest_matches(docs, items, window=10):
    """{(document, its word, words)} of the longest matches that no match before them holds, by trying all."""
    words = lambda t: brute.ascii_lower(t or "").split()
    runs = {tuple(w[p : p + n]) for _, t in items for w in [words(t)] for n in range(min(window, max(1, len(w))), len(w) + 1) for p in range(len(w) - n + 1)}
    out = set()
    for d, t in docs:
        w, end = words(t), 0
        for p in range(len(w)):
            n = max((n for n in range(1, len(w) - p + 1) if tuple(w[p : p + n]) in runs), default=0)
            if n and p + n > end:
                out.add((d, p, n))
                end = p + n
    return out


def test_longest_matches_against_all(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abc")
    items = [(k, " ".join(word() for _ in range(rng.randint(10, 40)))) for k in range(8)] + [(90, "a " * 30), (91, None), (92, "")]
    docs = [(k, " ".join(word() for _ in range(60)) + " " + items[k % 8][1][: rng.randint(0, 80)].strip() + " z a a") for k in range(20)] + [(50, "a " * 100), (51, items[0][1]), (52, items[1][1])]
    found = decontamination.verbatim_matches(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.doc_word, r.n_words) for r in found} == longest_matches(docs, items)
    text = {str(k): (t or "").split() for k, t in items}
    whole = {d: t.split() for d, t in docs}
    assert all(whole[r.doc_id][r.doc_word : r.doc_word + r.n_words] == text[r.item_id][r.item_word : r.item_word + r.n_words] for r in found)


def test_words_that_repeat_cost_little():
    item = decontamination.Block([("1", "same " * 1000)], 10)
    start = time.perf_counter()
    shard = decontamination.Shard(item, [decontamination.numbered(item, "same " * 20_000)])
    assert shard.hit.sum() == 20_000 and shard.items == [{"1"}]
    assert max(n for _, _, n, *_ in shard.matches()) == 1000
    assert time.perf_counter() - start < 3  # about half a second; a walk over all pairs of places takes minutes


def test_decontamination_with_nulls_long_texts_repeats_and_clashing_columns(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    given = [(None, item), (None, item), (7, "x " * 300_000 + item), (7, "clean text"), (7, "clean text"), (8, None)]
    items = frame(spark, [(1, item), (1, item), (2, " ".join(f"v{i}" for i in range(30)))], "item_id long, text string").withColumn("row", F.lit(1))
    df = frame(spark, given).withColumns({"row": F.lit("r"), "item_id": F.lit(1), "items": F.lit(2), "spans": F.lit(3)})
    for size in (decontamination.BLOCK_BYTES, 100):  # one block, and several
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        report = sorted((str(r.doc_id), r.n_words, r.n_hit, r.longest) for r in decontamination.document_report(df, items).collect())
        assert report == sorted([("None", 20, 20, 20)] * 2 + [("7", 300_020, 20, 20), ("7", 2, 0, 0), ("7", 2, 0, 0), ("8", 0, 0, 0)])
        kept = decontamination.drop_contaminated(df, items)
        assert kept.columns == df.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(7, "clean text"), (7, "clean text"), (8, "")]
        assert decontamination.drop_contaminated(df.limit(0), items).count() == 0


def test_decontamination_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b"), (None, "c")]), frame(spark, [], "item_id long, text string")
    assert [r.contaminated for r in decontamination.document_report(docs, items).collect()] == [False, False]
    assert decontamination.document_report(docs.limit(0), items).count() == 0
    assert decontamination.verbatim_matches(docs, items).count() == 0


def test_packing_is_a_round_trip(spark, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    odd = ["Don't, stop.", "tab\there and there", "É, é.", "<|endoftext|> a<|startoftext|>b", "x.,. y...", "THSTON$$$ word### end!! a,### ok?!.;: b***** &&& c&&& it's#", "Émenttion Ícico, ÄÖÜß!! Łódź İstanbul. ŉ ǅ e\u0301a É\u0301x Ǆ. ΑΣ. Å ſt, ĳ", "ΑΣ, ΟΔΟΣ. İ", "12,3.", "a" * 5000, "日本語, です。", "\x1c a\x1fb"]
    given = [*rows, *((100_000 + i, t) for i, t in enumerate(odd)), (200_000, None), (200_001, "")]
    pieces = packing.pack_documents(frame(spark, given), path).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.offset == 0 for p in pieces)
    assert all(p.length == 2048 or p.length & (p.length - 1) == 0 and p.length < 2048 for p in pieces)
    got = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        got[p.doc_id].append(p)
    for d, t in given:
        parts = sorted(got[d], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist()
        assert ids == [*whole.encode(t or "", add_special_tokens=False).ids, 1], d
        assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist() and parts[0].doc_tokens == len(ids)
    p = pieces[0]
    assert packing.piece_report(packing.pack_documents(frame(spark, given), path)).where(f"doc_id = {p.doc_id} and start = {p.start}").first().ids_crc32 == zlib.crc32(p.ids)


def test_packing_of_repeats_empty_tables_and_clashing_columns(spark):
    path = queries.tokenizer_path()
    df = frame(spark, [(1, "a b c"), (1, "a b c"), (None, None)]).withColumns({"ids": F.lit(1), "start": F.lit(2), "sequence_id": F.lit("x")})
    pieces = packing.piece_report(packing.pack_documents(df, path)).collect()
    assert sorted((str(p.doc_id), p.doc_tokens) for p in pieces if p.start == 0) == [("1", 4), ("1", 4), ("None", 1)]
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    t = packing.WordTokenizer(queries.tokenizer_path())
    texts = [" ".join(f"Word{chr(97 + i % 26)}{chr(97 + k)}," for k in range(26)) for i in range(500)]
    assert list(t.ids_of(texts)) == [np.array(t.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_slices_with_more_new_words_than_are_remembered(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    t = packing.WordTokenizer(queries.tokenizer_path())
    new = lambda slice_, n: " ".join(f"Word{chr(97 + slice_)}{chr(97 + k % 26)}{chr(97 + k // 26)}, x{slice_}{k}" for k in range(n))
    texts = [f"known words, {new(i // 200, 30 * (1 + i // 200)) if i % 200 < 2 else ''}" for i in range(1000)]
    assert list(t.ids_of(texts)) == [np.array(t.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert len(t.memory) <= 50


def test_sharding(spark, rows):
    given = [*rows, (100_001, None), (100_002, "")]
    report = sharding.shard_report(frame(spark, given), 8).collect()
    texts = dict(given)
    slots = defaultdict(list)
    for r in report:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    shares = Counter(r.shard for r in sharding.assign_shards(spark.range(20_000), [1, 2, 1, 0], "id").select("shard").collect())
    assert 3 not in shares and abs(shares[1] / 20_000 - 0.5) < 0.02


def test_sharding_of_nulls_and_repeats(spark):
    df = frame(spark, [(None, None)] * 3 + [(1, "a")] * 4 + [(1, "b" * 3_000_000)]).withColumn("shard", F.lit("x"))
    report = sharding.shard_report(df, 8).collect()
    assert max(r["size"] for r in report) == 3_000_001
    assert len(report) == 8 and len({r.shard for r in report if r.doc_id is None}) == 1 and len({r.shard for r in report if r.doc_id == 1}) == 1
    for k in {r.shard for r in report}:
        s = sorted(r.slot for r in report if r.shard == k)
        assert s == list(range(len(s)))
    assert sharding.shard_report(df.limit(0), 8).count() == 0
