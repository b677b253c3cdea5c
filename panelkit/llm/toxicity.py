"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two words counts their common subsequences of three letters, each weighted by
DECAY ** span; spans go up to SPAN, so that a subsequence may skip letters, and it is normalised. A
sentence is the words in it and those that come of single letters set apart ("i d i o t") or of letters with
marks between them. A document is the bag of these pieces: its score comes from its three highest decision values, from what all of them
reach into the margin together and on the average, so that a long clean text is not judged by its one unlucky word.

Labels are of documents, so training takes them as bags: of the beginnings found nearly only in toxic
documents, the fewest that explain these witness for them; all words of clean ones are counterexamples. Landmarks
are witnesses, frequent clean words and the clean words that come nearest to a witness. In their Nyström space a linear machine with squared
hinge loss is fitted over all words of either kind: tasks add up loss, gradient and Hessian of their share of the words, and Newton's steps
are taken on the driver, where nothing grows with the words. As the kernel has an explicit map onto letter
triples, the machine folds into one weight for each triple of the landmarks, and a word costs a few lookups.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.sampling import labelled_ids
from panelkit.llm.text import documents_of, held_out
from panelkit.session import Scratch, checkpointed

FOLD = (4, 2)
THRESHOLD = 0.3
#: Most labelled documents that the machine is fitted on.
SAMPLE = 10_000
#: Landmarks of either kind.
LANDMARKS = 96
#: The weight of a clean word in the fit; the witnesses weigh one in all.
CLEAN_COST = 1 / 8000
#: Tasks that the words of the fit are spread over, and the most Newton steps.
TASKS, STEPS = 16, 40
ORDER, SPAN, DECAY = 3, 6, 0.6
#: Letters of a beginning, which stands for all forms of a word.
BEGIN = 4
#: Words longer than this are cut into overlapping pieces, when fitted as when scored.
LONGEST = 32
#: Words whose values a worker remembers.
REMEMBERED = 700_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_in(chunk: str) -> list[str]:
    """The words of a piece of text between blanks, in small letters: its runs of letters, and all its letters together."""
    runs = _LETTERS.findall(chunk)
    if len(runs) > 1:
        runs.append("".join(runs))
    return runs


def chunks_of(text: str | None) -> set[str]:
    """The pieces between blanks, in small letters and without a full stop or comma at the end, and the joined runs of single characters."""
    text = (text or "").lower().replace(". ", " ").replace(", ", " ").replace(".\n", " ")
    words = text.split()
    found = set(words)
    single = [i for i, w in enumerate(words) if len(w) == 1]
    if len(single) > 2:
        start = 0
        for k in range(1, len(single) + 1):
            if k == len(single) or single[k] != single[k - 1] + 1:
                if k - start > 2:
                    found.add("".join(words[single[start] : single[k - 1] + 1]))
                start = k
    return found


def _pieces(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of a word of n letters, and their weights."""
    at = [(i, i + j, i + k) for i in range(n - 2) for j, k in combinations(range(1, SPAN), 2) if i + k < n]
    at = np.array(at, np.intp).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


#: Bits that number the subsequences of a word of up to LONGEST letters, and bits of a letter's code point; no letter lies beyond these.
_SHIFT, _CODE = 9, 18
_PLACES = {n: _places(n) for n in range(ORDER, LONGEST + 1)}


def triples(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (places of the words in the list, their triples, the triples' weights, the squared norms). A triple is made of three code points."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if ORDER <= len(w) <= LONGEST:
            by_length.setdefault(len(w), []).append(k)
    for n, where in by_length.items():
        at, weights = _PLACES[n]
        for s in range(0, len(where), 4096):
            part = where[s : s + 4096]
            codes = np.array([[ord(c) & ((1 << _CODE) - 1) for c in words[k]] for k in part], np.int64)
            ids = (codes[:, at[:, 0]] << 2 * _CODE) | (codes[:, at[:, 1]] << _CODE) | codes[:, at[:, 2]]
            packed = np.sort((ids << _SHIFT) | np.arange(len(weights)), axis=1)  # 54 bits of triple, 9 of place
            ordered, w = packed >> _SHIFT, weights[packed & ((1 << _SHIFT) - 1)]
            first = np.ones(ordered.shape, bool)
            first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
            starts = np.flatnonzero(first)  # of equal triples of a word, whose weights add up
            norms = np.bincount(starts // len(weights), np.add.reduceat(w.ravel(), starts) ** 2, len(part))
            yield np.array(part), ids, weights, norms


def places_in(known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each triple stands among the known ones, which are in order; len(known) for those that are not there."""
    at = np.searchsorted(known, ids)
    return np.where(np.append(known, -1)[at] == ids, at, len(known))


def feature_map(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(known, map): the triples of a few words, in order, and the words' normalised maps over them, one row each; a last column is empty."""
    found = list(triples(words))
    known = np.unique(np.concatenate([ids.ravel() for _, ids, _, _ in found])) if found else np.zeros(0, np.int64)
    out = np.zeros((len(words), len(known) + 1))
    for where, ids, weights, norms in found:
        for k, x, norm in zip(where, ids, norms):
            np.add.at(out[k], np.searchsorted(known, x), weights / np.sqrt(norm))
    return known, out


def kernel(words: list[str], known: np.ndarray, mapped: np.ndarray) -> np.ndarray:
    """Kernel values of words and landmarks, which feature_map() has mapped."""
    out, columns = np.zeros((len(words), len(mapped))), np.ascontiguousarray(mapped.T)
    for where, ids, weights, norms in triples(words):
        for s in range(0, len(where), 64):
            part = slice(s, s + 64)
            out[where[part]] = weights @ columns[places_in(known, ids[part])] / np.sqrt(norms[part])[:, None]
    return out


#: Highest decision values of a document that its score is made of.
TOP = 3


@dataclass(frozen=True)
class Machine:
    """The folded machine: a weight for each letter triple of the landmarks, 0 for others, and the logistic model from a document's measures to its score."""

    known: np.ndarray
    weights: np.ndarray
    bias: float
    slopes: np.ndarray = field(default_factory=lambda: np.eye(1, TOP + 2)[0])
    offset: float = 0.0

    def values(self, words: list[str]) -> np.ndarray:
        """Decision values; words of fewer than three letters have the bias."""
        out = np.full(len(words), self.bias)
        for where, ids, weights, norms in triples(words):
            out[where] += (self.weights[places_in(self.known, ids)] * weights).sum(1) / np.sqrt(norms)
        return out

    def measures(self, values: np.ndarray) -> np.ndarray:
        """The measures of a document with these decision values: the highest ones, the sum of what reaches into the margin, and its mean."""
        top = np.full(TOP, self.bias)
        highest = np.sort(np.partition(values, -TOP)[-TOP:] if len(values) > TOP else values)[::-1]
        top[: len(highest)] = highest
        reach = np.maximum(0, values + 1).sum()
        return np.r_[top, np.log1p(reach), np.sqrt(reach / max(1, len(values)))]

    def scores(self, measures: np.ndarray) -> np.ndarray:
        """Scores of rows of measures."""
        return 1 / (1 + np.exp(-np.clip(measures @ self.slopes + self.offset, -30, 30)))


class Scorer:
    """Measures of texts; the decision value of each different chunk is worked out once and remembered."""

    def __init__(self, machine: Machine) -> None:
        self.machine, self.memory = machine, {}

    def measures(self, texts: list[str | None]) -> np.ndarray:
        bags = [chunks_of(t) for t in texts]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = list({c for bag in bags for c in bag if c not in self.memory})
        words, owners = [], []
        for k, c in enumerate(new):
            for w in words_in(c):
                for piece in _pieces(w):
                    words.append(piece)
                    owners.append(k)
        best = np.full(len(new), self.machine.bias)
        np.maximum.at(best, np.array(owners, np.intp), self.machine.values(words))
        self.memory.update(zip(new, best.tolist()))
        get = self.memory.__getitem__
        found = np.array([self.machine.measures(np.fromiter(map(get, bag), float, len(bag))) for bag in bags]).reshape(-1, TOP + 2)
        for c in new:
            if len(c) > 2 * LONGEST:  # too long to be worth the memory
                del self.memory[c]
        return found


def _in_batches(scorer: Scorer, texts: list[str | None], size: int = 200) -> np.ndarray:
    return np.concatenate([scorer.measures(texts[i : i + size]) for i in range(0, len(texts), size)] or [np.zeros((0, TOP + 2))])


def hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, Hessian) of the squared hinge at w over rows x, of which the last column is 1; y is 1 or -1."""
    slack = np.maximum(0, 1 - y * (x @ w))
    a = x[slack > 0]
    c = cost[slack > 0]
    return float((cost * slack**2).sum()), -2 * a.T @ (c * (y * slack)[slack > 0]), 2 * (a * c[:, None]).T @ a


def newton(sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], size: int, penalty: float) -> np.ndarray:
    """The w that makes penalty * |w|^2 / 2, without its last entry, and the loss of `sums` least. A step that does not help is halved."""
    ridge = np.append(np.full(size - 1, penalty), 1e-9)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, g, h = sums(w)
        return loss + (ridge * w * w).sum() / 2, g + ridge * w, h + np.diag(ridge)

    w = np.zeros(size)
    loss, g, h = at(w)
    step = np.linalg.solve(h, g)
    for _ in range(STEPS):
        if (tried := at(w - step))[0] > loss:
            step = step / 2
            continue
        w, gained, (loss, g, h) = w - step, loss - tried[0], tried
        if gained <= 1e-7 * loss:
            break
        step = np.linalg.solve(h, g)
    return w


def fit_machine(words: DataFrame, marks: list[str], penalty: float = 1e-4) -> Machine:
    """A machine from all rows of words(word, y, cost), y 1 or -1, and landmarks."""
    known, mapped = feature_map(marks)
    values, vectors = np.linalg.eigh(mapped @ mapped.T)
    root = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])  # K^(-1/2) up to a rotation
    size = root.shape[1] + 1

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = kernel(part.column("word").to_pylist(), known, mapped).astype(np.float32)  # mostly zeros, which take little room when written
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in values], pa.binary()), part.column("y"), part.column("cost")], names=["kernel", "y", "cost"])

    scratch = Scratch(words.sparkSession)
    rows = scratch.written(words.repartition(TASKS, "word").sortWithinPartitions("word").mapInArrow(near, "kernel binary, y double, cost double"))

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + size + size * size)
            for part in parts:
                values = np.frombuffer(b"".join(part.column("kernel").to_pylist()), np.float32).reshape(-1, len(root))
                x = np.c_[values @ root, np.ones(len(part))]
                loss, g, h = hinge(x, part.column("y").to_numpy(), part.column("cost").to_numpy(), w)
                total += np.concatenate([[loss], g, h.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        # a row of less than a megabyte from each of TASKS tasks; in order, so that sums do not depend on which ends first
        total = sum(np.frombuffer(v) for v in sorted(bytes(r[0]) for r in rows.coalesce(TASKS).mapInArrow(added, "total binary").collect()))
        return float(total[0]), total[1 : 1 + size], total[1 + size :].reshape(size, size)

    w = newton(sums, size, penalty)
    scratch.drop()
    return Machine(known, ((root @ w[:-1]) @ mapped).astype(np.float32), float(w[-1]))


def witnesses(found: list[tuple[int, str, str]], least: int = 3) -> dict[str, int]:
    """Words that explain toxic documents, with their numbers of documents, from (document, word, key) rows.

    A key stands for the forms of a word: its beginning, or itself where others begin like it. Keys are taken one after another, always the one found in most documents that none yet explains, until
    it explains fewer than `least` of them; so words that merely accompany an insult are passed over. A frequent
    one whose documents have been explained by different others, none of them by most, is an insult too.
    """
    by_key: dict[str, set[int]] = {}
    for doc, _, key in found:
        by_key.setdefault(key, set()).add(doc)
    open_docs = {doc for doc, *_ in found}
    chosen, taken = set(), {}
    while by_key:
        best = max(sorted(by_key), key=lambda b: (len(by_key[b] & open_docs), len(by_key[b])))
        docs = by_key.pop(best)
        if len(docs & open_docs) < least:
            by_key[best] = docs
            break
        chosen.add(best)
        open_docs -= docs
        taken[best] = docs
    for key, docs in by_key.items():
        if len(docs) >= 4 * least and max((len(docs & x) for x in taken.values()), default=0) <= 0.7 * len(docs):
            chosen.add(key)
    out: dict[str, int] = {}
    for _, word, key in found:
        if key in chosen:
            out[word] = out.get(word, 0) + 1
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD, bound: int = SAMPLE) -> Machine:
    """A machine from at most `bound` labelled documents outside the held-out fold.

    Null ids and labels, and labels without a document, are left out; of repeated labels the highest
    counts. Without labels of both kinds every text gets one low score.
    """
    chosen = labelled_ids(labels, "toxic", fold, bound)
    rows = documents_of(docs).join(F.broadcast(chosen), "doc_id")

    def words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc, t, y in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                found = list({p for c in chunks_of(t) for w in words_in(c) for p in _pieces(w) if len(p) >= ORDER})
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], names=["doc_id", "word", "label"])

    pairs = checkpointed(rows.mapInArrow(words, "doc_id long, word string, label int"))
    begin = F.substring("word", 1, BEGIN)
    clean_docs, toxic_docs = (F.count_distinct(F.when(F.col("label") == y, F.col("doc_id"))) for y in (0, 1))
    telling = "t >= 3 and c <= 0.02 * t"
    begins = pairs.groupBy(begin.alias("begin")).agg(toxic_docs.alias("t"), clean_docs.alias("c")).where(telling).select("begin")
    alone = pairs.groupBy(F.col("word").alias("alone")).agg(toxic_docs.alias("t"), clean_docs.alias("c")).where(telling).select("alone")
    keyed = pairs.where("label = 1").join(begins, begin == F.col("begin"), "left").join(alone, F.col("word") == F.col("alone"), "left")
    found = keyed.select("doc_id", "word", F.coalesce("begin", "alone").alias("key")).where("key is not null")
    toxic = witnesses([tuple(r) for r in found.collect()])
    counter = pairs.groupBy("word").agg(F.sum(1 - F.col("label")).alias("c"), F.sum("label").alias("t")).where("c > 0 and c >= 2 * t")
    frequent = [r["word"] for r in counter.orderBy(F.desc("c"), "word").limit(LANDMARKS // 2).collect()]
    if not toxic or not frequent:
        return calibrated(Machine(np.zeros(0, np.int64), np.zeros(1, np.float32), -1.0), rows)
    marks = list(toxic)[:LANDMARKS]
    nearest = counter.select("word", _likeness(marks, F.col("word")).alias("v")).orderBy(F.desc("v"), "word").limit(LANDMARKS // 2)
    marks = list(dict.fromkeys([*marks, *frequent, *(r["word"] for r in nearest.collect())]))
    cost = {w: n**0.5 for w, n in toxic.items()}
    whole = sum(cost.values())
    for_toxic = docs.sparkSession.createDataFrame([(w, 1.0, c / whole) for w, c in cost.items()], "word string, y double, cost double")
    against = counter.select("word", F.lit(-1.0).alias("y"), F.lit(CLEAN_COST).alias("cost"))
    return calibrated(fit_machine(for_toxic.unionByName(against), marks), rows)


def _likeness(marks: list[str], word: Column) -> Column:
    """The largest kernel value of a word with one of the marks."""
    known, mapped = feature_map(marks)

    @F.pandas_udf("double")
    def likeness(words: pd.Series) -> pd.Series:
        return pd.Series(kernel(words.tolist(), known, mapped).max(1).round(9))

    return likeness(word)


def calibrated(machine: Machine, rows: DataFrame) -> Machine:
    """The machine with the logistic model from the measures of the sampled rows(text, label) to probabilities."""

    def measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for part in parts:
            x = _in_batches(scorer, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), part.column("label")], names=["x", "label"])

    found = rows.select("text", "label").mapInArrow(measured, "x array<double>, label int").toPandas()  # as many rows as the sample has
    found = sorted(zip(found["label"], map(tuple, found["x"])))  # sums do not depend on the order of tasks
    x, y = np.array([v for _, v in found], float).reshape(-1, TOP + 2), np.array([label for label, _ in found], float)
    if y.sum() == 0 or y.sum() == len(y):
        return replace(machine, slopes=np.zeros(TOP + 2), offset=-3.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(TOP + 2, 0.1), 1e-3]
    for _ in range(100):  # Newton's steps on the cross entropy
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = p * (1 - p) + 1e-6
        step = np.linalg.solve((z * h[:, None]).T @ z + np.diag(penalty), z.T @ (p - goal) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return replace(machine, slopes=w[:-1] / scale, offset=float(w[-1] - (w[:-1] * mean / scale).sum()))


def classify(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null and empty texts have the score of a text without words. Repeated rows get equal scores; an empty table gives no rows.
    """
    machine = train(docs, labels, fold)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # one megabyte, whatever the input

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in parts:
            yield pd.Series(scorer.machine.scores(_in_batches(scorer, texts.tolist())))

    rows = documents_of(docs).select("doc_id", held_out(F.col("doc_id"), *fold).alias("held_out"), scores("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
