"""Repair of the turn structure of conversations, by one suffix-shared automaton over all of them.

A row is one of nine signs: its role's initial (s, u, a, or o for any other), in capitals if the text is truncated, or x
where it has to go (blank, or a duplicate). What a repair costs from some row on depends on the signs from there to the
end alone, so the automaton shares suffixes: the different signatures are dealt by ranges of their reversed form and
sorted, and each goes on from the nodes of the suffix that it has in common with the one before. Every node has the cost
to go and the best next edit for each of the four states of the grammar `(s?(ua)+)?`; costs less their least take few
values, so a node is one entry of a small table.

Edits: K(eep) 0, R(erole to user or assistant) 2, D(elete) 3, I(nsert an empty user or assistant) 2; a truncated row that
stays adds 1. The four edits that may come first have different initials, so that the ASCII-least of the cheapest audits
follows from the least initial at each node.

Rows are in order of turn (nulls first), then role, then the md5 of the text. A null role or text is one blank, a null turn
has no part in gaps, and rows without a conversation's id are one conversation. Rows of any further columns are ignored.
A conversation is streamed through one task, as its checksum needs; of each row only one character is held.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.skew import join_facts
from panelkit.llm.text import BLANKS
from panelkit.session import written

DELETE, INSERT, KEEP, REROLE = "DIKR"
#: States of the grammar: at the start, after s, after u, after a. What a role leads to, and what an insertion can only be.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
LEADS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
INSERTED = ((AFTER_U, "u"), (AFTER_U, "u"), (AFTER_A, "a"), (AFTER_U, "u"))
#: Characters of a reversed signature by which signatures are dealt; longer ones with equal ends are spread by a hash.
DEALT_BY = 64


def _with_insertions(base: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The best (cost, edit) in each state, where an insertion may come before what base has."""
    best = list(base)
    for q in (AFTER_U, AFTER_A):
        best[q] = min(base[q], (2 + base[INSERTED[q][0]][0], INSERT))
    for q in (START, AFTER_S):
        best[q] = min(base[q], (2 + best[AFTER_U][0], INSERT))
    return best


class Automaton:
    """Nodes by what is left to do: entries of (costs less their least, edits, the costs' number), and the steps between them."""

    def __init__(self) -> None:
        never = 1 << 20
        self.costs: list[tuple[int, ...]] = []
        self.edits: list[tuple[str, ...]] = []
        self.vector: list[int] = []
        self.vectors: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self._add(_with_insertions([(0, ""), (never, "~"), (never, "~"), (0, "")]))

    def _add(self, best: list[tuple[int, str]]) -> tuple[int, int]:
        least = min(c for c, _ in best)
        costs = tuple(c - least for c, _ in best)
        self.costs.append(costs)
        self.edits.append(tuple(e for _, e in best))
        self.vector.append(self.vectors.setdefault(costs, len(self.vectors)))
        return len(self.costs) - 1, least

    def step(self, node: int, sign: str) -> tuple[int, int]:
        """(the node with one more sign before it, what its costs have over the entry's)."""
        found = self.steps.get(key := (self.vector[node], sign))
        if found is None:
            after, role, late = self.costs[node], sign.lower(), int(sign.isupper())
            base = []
            for q in range(4):
                options = [(3 + after[q], DELETE)]
                if role != "x":
                    if (q, role) in LEADS:
                        options.append((late + after[LEADS[q, role]], KEEP))
                    options += [(2 + late + after[LEADS[q, r]], REROLE) for r in "ua" if r != role and (q, r) in LEADS]
                base.append(min(options))
            found = self.steps[key] = self._add(_with_insertions(base))
        return found


def cheapest_audits(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit); a signature goes on from what it shares with the end of the one before it, so let them be in reversed order."""
    auto, last = Automaton(), ""
    nodes, costs = array("i", [0]), array("q", [0])
    for s in signatures:
        depth, most = 0, min(len(s), len(last))
        while depth < most and s[-1 - depth] == last[-1 - depth]:
            depth += 1
        del nodes[depth + 1 :], costs[depth + 1 :]
        for k in range(depth, len(s)):
            node, more = auto.step(nodes[k], s[-1 - k])
            nodes.append(node)
            costs.append(costs[k] + more)
        audit, q, k, signs = [], START, len(s), iter(s)
        while e := auto.edits[nodes[k]][q]:
            audit.append(e)
            if e == INSERT:
                q = INSERTED[q][0]
                continue
            role = next(signs).lower()
            k -= 1
            if e == KEEP:
                q = LEADS[q, role]
            elif e == REROLE:
                q = INSERTED[q][0]
        yield s, costs[len(s)] + auto.costs[nodes[len(s)]][START], "".join(audit)
        last = s


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with the faults that crc32(`conv_id:turn`) % 20 plants, a null as one blank.

    0 drops the row (it stays with gone = true, as its conversation stays), 1 empties the text, 2 takes `.!?` out of it, 3 doubles
    the row, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("d"))
    d = F.col("d")
    text = F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (d == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _plain(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, gone) without nulls in role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"), gone.alias("gone"))


ORDER = ("turn", "role", "digest")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of rows(conv_id, turn, role, text, and gone where that is true of no row that is there).

    The texts themselves are not shuffled: a row has its role, the md5 of its text, and what its text lacks.
    """
    plain = _plain(rows)
    kept = F.rtrim("text", F.lit(BLANKS))
    narrow = plain.select(
        "conv_id", "turn", "role", "digest", "gone",
        F.when(kept == "", "blank").when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("").alias("lacks"),
    )
    seen = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("turn")
    marked = narrow.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1).sortWithinPartitions("conv_id", *ORDER)
    kind = marked.schema["conv_id"].dataType
    names = ("gaps", "blank", "duplicate", "truncated", "illegal")
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, T.LongType()) for n in names], T.StructField("signature", T.StringType())])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        current, facts, out = nothing, {"signs": []}, []
        for batch in batches:
            ids = batch.column("conv_id")
            for conv, turn, role, gone, lacks, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "gone", "lacks", "again"))):
                if conv != current:
                    if current is not nothing:
                        out.append(closed(current, facts))
                    current, facts = conv, {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "signs": [], "initial": None}
                if gone:
                    continue
                if turn is not None:
                    if facts["low"] is None:
                        facts["low"] = turn
                    if turn != facts["high"]:
                        facts["turns"] += 1
                    facts["high"] = turn
                initial = role[:1]
                if facts["initial"] is not None and facts["initial"] + initial not in ("su", "ua", "au"):
                    facts["illegal"] += 1
                facts["initial"] = initial
                fault = "blank" if lacks == "blank" else "duplicate" if again else lacks
                if fault:
                    facts[fault] += 1
                sign = initial if initial in ("s", "u", "a") else "o"
                facts["signs"].append("x" if fault in ("blank", "duplicate") else sign.upper() if fault else sign)
            if len(facts["signs"]) > 100_000:
                facts["signs"] = ["".join(facts["signs"])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], ids.type), *[pa.array([r[k] for r in out], pa.int64()) for k in range(1, 6)], pa.array([r[6] for r in out], pa.string())], schema.names)
                out = []
        if current is not nothing:
            r = closed(current, facts)
            yield pa.RecordBatch.from_arrays([pa.array([r[0]], ids.type), *[pa.array([x], pa.int64()) for x in r[1:6]], pa.array([r[6]], pa.string())], schema.names)

    def closed(conv, f: dict) -> tuple:
        gaps = 0 if f["low"] is None else f["high"] - f["low"] + 1 - f["turns"]
        return conv, gaps, f["blank"], f["duplicate"], f["truncated"], f["illegal"], "".join(f["signs"])

    return marked.mapInArrow(streamed, schema)


def plan_repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): what each conversation lacks, and its cheapest edits.

    No rows give none; a conversation whose rows are all gone has zeros and an empty audit.
    """
    found = written(signatures(rows))
    different = found.groupBy("signature").agg(F.count("*").alias("n"))
    end = F.reverse(F.right("signature", F.lit(DEALT_BY)))
    dealt = different.withColumns({"end": end, "h": F.xxhash64("signature")}).repartitionByRange("end", "h").withColumn("reversed", F.reverse("signature")).sortWithinPartitions("reversed")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[int] = []

        def read() -> Iterator[str]:
            for batch in batches:
                for n, s in zip(batch.column("n").to_pylist(), batch.column("signature").to_pylist()):
                    counts.append(n)
                    yield s

        rows, size = [], 0
        for k, (s, cost, audit) in enumerate(cheapest_audits(read())):
            rows.append((s, counts[k], cost, audit))
            size += len(s)
            if len(rows) >= 10_000 or size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["signature", "n", "cost", "audit"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["signature", "n", "cost", "audit"])

    audits = written(dealt.select("signature", "n").mapInArrow(solved, "signature string, n long, cost long, audit string"))
    return join_facts(found, audits, "signature", "n").drop("signature")


def _streamed(rows: DataFrame, plans: DataFrame, walk: Callable, schema: T.StructType) -> DataFrame:
    """walk() over batches of each conversation's plan (first is true) and then its rows, in order; each conversation in one task."""
    names = [c for c in plans.columns if c != "conv_id"]
    texts = _plain(rows).where("not gone").drop("gone").withColumn("first", F.lit(False))
    texts = texts.withColumns({c: F.lit(None).cast(plans.schema[c].dataType) for c in names})
    heads = plans.withColumns({"first": F.lit(True), **{c: F.lit(None).cast(texts.schema[c].dataType) for c in ("turn", "role", "text", "digest")}})
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("first"), *ORDER)
    return both.mapInArrow(walk, schema)


def _edited(audit: str) -> Iterator[tuple[str, str | None]]:
    """(edit, new role) for every edit in order; the role is None where the row keeps its own or goes."""
    at = -((len(audit) - audit.count(DELETE)) % 2)  # an odd number of rows begins with a kept s
    for e in audit:
        yield e, None if e in (KEEP, DELETE) else "assistant" if at % 2 else "user"
        at += e != DELETE


def _turns(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows."""
    for e, role in _edited(audit):
        if e == INSERT:
            yield e, role, ""
            continue
        old, text = next(rows)
        if e != DELETE:
            yield e, old if e == KEEP else role, text


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the rows of the repaired conversations, positions from 0; edit is K, R or I."""
    plans = plan_repairs(rows).select("conv_id", "audit")
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("position", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, _, turns, id_type in _conversations(batches):
            out, size = [], 0
            for k, turn in enumerate(turns):
                out.append((k, *turn))
                size += len(turn[2])
                if len(out) >= 10_000 or size > 1 << 24:
                    yield _batch(conv, id_type, out, schema)
                    out, size = [], 0
            if out:
                yield _batch(conv, id_type, out, schema)

    return _streamed(rows, plans, walk, schema)


def _batch(conv, id_type: pa.DataType, out: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    k, *texts = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array([conv] * len(out), id_type), pa.array(k, pa.int64()), *[pa.array(t, pa.string()) for t in texts]], schema.names)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, plan, repaired turns, type of the id) of each conversation; its turns have to be read before the next one is."""

    def read() -> Iterator[tuple]:
        for batch in batches:
            heads = {c: batch.column(c) for c in batch.schema.names if c not in ("conv_id", "first", "turn", "role", "text", "digest")}
            for k, (conv, first, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "first", "role", "text")))):
                yield batch.schema.field("conv_id").type, conv, {c: x[k].as_py() for c, x in heads.items()} if first else None, role, text

    stream = read()
    for id_type, conv, plan, _, _ in stream:
        yield conv, plan, _turns(plan["audit"], ((role, text) for _, _, _, role, text in stream)), id_type


def repair_report(rows: DataFrame) -> DataFrame:
    """plan_repairs() with repaired_sha256, the checksum of the repaired `role:text` joined by newlines (UTF-8)."""
    plans = plan_repairs(rows)
    schema = T.StructType([*plans.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    kinds = {f.name: pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in schema.fields[1:]}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, id_type, size = [], None, 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], id_type), *[pa.array([r[1][c] for r in out], t) for c, t in kinds.items()]], schema.names)

        for conv, plan, turns, id_type in _conversations(batches):
            digest = hashlib.sha256()
            for k, (_, role, text) in enumerate(turns):
                digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            out.append((conv, plan | {"repaired_sha256": digest.hexdigest()}))
            size += len(plan["audit"])
            if len(out) >= 10_000 or size > 1 << 24:
                yield full()
                out, size = [], 0
        if out:
            yield full()

    return _streamed(rows, plans, walk, schema)
