import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelkit.llm import collocations, conversation_repair, top_k

# --- search -------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def plain_top_k(rows, k=20, factor=64):
    """[(query_id, rank, vec_id, score)]; rows are (vec_id, vector) in their order."""
    good = [(i, [int(np.floor(factor * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i is not None and i % 20 == 0:
            scored = [(min(max(sum(x * y for x, y in zip(q, v)), -(2**63)), 2**63 - 1), j, b) for b, (j, v) in enumerate(good) if b != a]
            scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0, s[2]))
            out += [(i, r, j, s) for r, (s, j, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, **more):
    df = spark.createDataFrame(rows, VECTORS).withColumns({"uid": F.lit(1), "score": F.lit("x"), "g": F.lit(None).cast("int")})
    return sorted((tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 20 == 0, **more).collect()), key=str)


@pytest.mark.parametrize("segments,block", [(1, 4096), (2, 16), (5, 7)])
def test_top_k_against_all_pairs(spark, segments, block):
    draw = random.Random(segments)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(12)]) for i in range(300)]
    rows += [(i, [0.5] * 12) for i in range(300, 400)]  # a hot vector: ties everywhere
    assert searched(spark, rows, segments=segments, block=block) == plain_top_k(rows)


def test_top_k_of_few_rows_nulls_repeats_lengths_and_sizes(spark):
    rows = [(0, [1.0, -2.0]), (0, [1.0, -2.0]), (20, []), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf")]), (None, [3.0, 1.0]), (7, [1.0, 1.0, 9.0]), (-20, [-5.0, 0.0])]
    assert searched(spark, rows) == plain_top_k(rows)
    assert searched(spark, rows, k=2) == plain_top_k(rows, 2)
    assert searched(spark, rows[:1]) == [] == searched(spark, [])
    large = [(20 * i, [x, -x, 1.0]) for i, x in enumerate((3e3, 2e5, 7e8, 4e15))]
    assert searched(spark, large) == plain_top_k(large)


# --- phrases ------------------------------------------------------------------------------------------------------

DOCS = "lang string, text string"


def plain_collocations(rows, least=100, longest=5, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            counts[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * candidates[p[i : i + k]]}
        rated = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, sizes[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(rated)[:top], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, DOCS).withColumns({"id": F.lit(1), "phrase": F.lit("x"), "n": F.lit(2), "salt": F.lit(3)})
    return sorted(tuple(r) for r in collocations.collocations(df, **more).collect())


def test_collocations_against_counting(spark):
    draw = random.Random(3)
    words = ["a", "B", "c", "Ée", "d e", "x" * 300, "F"]
    rows = [(draw.choice(["en", "fr", None, "und"]), "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", " , ", "\x0b"]) for _ in range(draw.randrange(60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), ("en", " \n "), (None, "a a a a a a a a")] + [("de", "one two three four five six seven")] * 120 + [("es", "y " * 5000)]
    want = plain_collocations(rows)
    assert mined(spark, rows) == want
    assert mined(spark, rows, entries=2) == want  # tables of ids in many passes
    assert mined(spark, rows, least=20, longest=3, top=4) == plain_collocations(rows, 20, 3, 4)


def test_collocations_hold_few_ids_at_once(spark, monkeypatch):
    """Rows of ids are short, and a batch with many of them is counted in portions."""
    docs = spark.createDataFrame([("a", "one two three four five, six seven " * 4)] * 2000, "lang string, text string").coalesce(1)
    words = spark.createDataFrame([("a", w, k) for k, w in enumerate("one two three four five six seven".split(), 1)], "lang string, phrase string, id long")
    rows, _ = collocations._words_to_ids(docs, words, 400_000)
    assert [tuple(r) for r in rows.selectExpr("max(size(ids)) <= 1100", "sum(size(filter(ids, x -> x > 0)))").collect()] == [(True, 2000 * 28)]
    calls, counts = [], collocations.tile_counts
    monkeypatch.setattr(collocations, "CHUNK", 1000)
    monkeypatch.setattr(collocations, "tile_counts", lambda left, right: calls.append(len(left)) or counts(left, right))
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2] * 50 + [0]] * 100)], ["ids"])
    got = [sum(x.column("a").to_numpy()[x.column("left").to_numpy() == k].sum() for x in collocations._count_pairs(iter([batch]))) for k in (1, 2)]
    assert got == [5000, 4900] and max(calls) <= 1250


def test_collocations_of_sparse_and_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [("en", None)]) == [] == mined(spark, [("en", "too rare to count")])


def test_scores_beyond_a_long_are_exact(spark):
    rows = spark.createDataFrame([("en", 9 * 10**17, "p q", 2, 8 * 10**12 + 1, [10**15 + 1, 8 * 10**12 + 1], [9 * 10**14 + 7, 8 * 10**12 + 1], None)], "lang string, n long, phrase string, words int, a long, pre array<long>, suf array<long>, inside long")
    old, collocations.phrases = collocations.phrases, lambda *_, **__: rows
    try:
        (got,) = collocations.collocations(rows).collect()
    finally:
        collocations.phrases = old
    assert got.score == 1000 * (8 * 10**12 + 1) * 9 * 10**17 // ((10**15 + 1) * (9 * 10**14 + 7))


def test_crowded_and_sparse_tiles_count_alike():
    draw = np.random.default_rng(5)
    left, right = (np.concatenate([draw.integers(1, 900, 200_000), draw.integers(1, 10**6, 3000), np.full(80_000, 5000)]) for _ in "ab")
    want = Counter(zip(left.tolist(), right.tolist()))
    got = list(zip(*(x.tolist() for x in collocations.tile_counts(left, right))))
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


# --- turns --------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def cheapest(signs):
    """(cost, audit) over whole strings, from the end; signs are (initial, truncated, must go)."""
    to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @cache
    def best(i, state, inserts=0):
        options = [(0, "")] if i == len(signs) and state in ("", "a") else []
        more = []
        if i < len(signs):
            initial, late, go = signs[i]
            more.append((3, "D", i + 1, state, 0))
            if not go:
                if (state, initial) in to:
                    more.append((late, "K", i + 1, to[state, initial], 0))
                more += [(2 + late, "R", i + 1, to[state, r], 0) for r in "ua" if (state, r) in to]
        if inserts < 3:
            more += [(2, "I", i, to[state, r], inserts + 1) for r in "ua" if (state, r) in to]
        for c, e, *rest in more:
            cost, audit = best(*rest)
            options.append((c + cost, e + audit))
        return min(options, default=(10**9, ""))

    return best(0, "")


def plain_repair(rows, originals):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest(), text))
    out = {}
    for conv in {r[0] for r in originals}:
        seen, signs, count, turns = set(), [], Counter(), []
        for known, turn, role, _, text in sorted(by[conv]):
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            signs.append((role[:1], int(fault == "truncated"), fault in ("blank", "duplicate")))
            turns.append((role, text))
        known = [t for k, t, *_ in by[conv] if k]
        cost, audit = cheapest(tuple(signs))
        n, done, it = len(audit) - audit.count("D"), [], iter(turns)
        want = ["s"] * (n % 2) + ["u", "a"] * (n // 2)
        for e in audit:
            role, text = next(it) if e != "I" else (None, "")
            if e != "D":
                done.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[want[len(done)]]}:{text}")
        assert LEGAL.fullmatch("".join(x[:1] for x in done))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def drawn_turns(n, seed):
    draw = random.Random(seed)
    role = lambda: draw.choice(["system", "user", "assistant", "assistant", "user", "tool", None, ""])
    text = lambda: draw.choice(["Fine.", "Fine.", "yes", "What? \n", " \t", None, "Ünd so weiter", "Ok!", f"No {draw.randrange(9)}."])
    return [(c if c else None, draw.choice([None, t, t, t, t + draw.randrange(3)]), role(), text()) for c in range(n) for t in range(draw.randrange(1, 9))]


def test_conversation_repair_against_strings(spark):
    rows = drawn_turns(300, 1)
    df = spark.createDataFrame(rows, TURNS).withColumns({"first": F.lit(1), "audit": F.lit("x"), "digest": F.lit(None).cast("string"), "gone": F.lit(7)})
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_report(conversation_repair.damage(df)).collect()}
    assert got == plain_repair(plain_damage(rows), rows)
    turns = defaultdict(list)
    for r in conversation_repair.repaired_rows(conversation_repair.damage(df)).collect():
        turns[r.conv_id].append((r.position, f"{r.role}:{r.text}"))
    for conv, facts in got.items():
        assert hashlib.sha256("\n".join(x for _, x in sorted(turns[conv])).encode()).hexdigest() == facts[-1]


def test_conversation_repair_of_the_tables_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_report(conversation_repair.damage(df)).collect()} == plain_repair(plain_damage(rows), rows)


def test_conversation_repair_of_empty_long_and_lost_conversations(spark):
    def repaired(rows):
        return {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_report(conversation_repair.damage(spark.createDataFrame(rows, TURNS))).collect()}

    assert repaired([]) == {}
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired([(lost, 0, "user", "Hello.")]) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    rows = [(5, t, ("user", "assistant")[t % 2], f"Turn {t}" + "." * (t % 7 != 0) + "y" * (100_000 if t == 8 else 0)) for t in range(3000)]
    (found,) = repaired(rows).values()
    kept = plain_damage(rows)
    assert len(found[6]) - found[6].count("I") == len(kept) and found[4] > 0
    clean = [(6, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(2000)]
    got = conversation_repair.repair_report(spark.createDataFrame(clean, TURNS)).collect()
    assert [(r.cost, r.audit, r.repaired_sha256) for r in got] == [(0, "K" * 2000, hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in clean).encode()).hexdigest())]


def test_audits_share_suffixes():
    draw = random.Random(9)
    words = sorted({"".join(draw.choices("suaoSUAOx", k=draw.randrange(9))) for _ in range(3000)}, key=lambda s: s[::-1])
    for s, cost, audit in conversation_repair.cheapest_audits(iter(words)):
        assert (cost, audit) == cheapest(tuple((c.lower(), int(c.isupper()), c == "x") for c in s))
    auto = conversation_repair.Automaton()
    node = 0
    for c in "suaoSUAOx" * 200:
        node, _ = auto.step(node, c)
    assert len(auto.costs) < 200  # entries are values, however long the conversations are
