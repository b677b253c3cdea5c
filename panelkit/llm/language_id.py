"""Language identification of web pages by Bayesian fusion of evidence.

Four kinds of evidence are multiplied: the likelihood of the page's text under letter-trigram models,
tempered so that a page counts as at most EVIDENCE independent letters; the probability of the language that
the markup declares, given the true one; and a prior of the host, which is smoothed towards that of its
domain, that one towards the address suffix, and that one towards all pages. The counts behind the last two
are sums of the pages' own text posteriors, gathered by grouped aggregation over all pages; a page's own
share is taken out of its host's before it is judged.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.skew import join_facts
from panelkit.llm.text import let, with_small_batches
from panelkit.session import checkpointed, written

BUCKETS = 1 << 15
#: Most documents of each language that the letter models are fitted on.
SAMPLE = 2000
#: Languages whose models are sent to the executors at once (BUCKETS numbers each); more of them take more passes over the pages.
LANGUAGES = 64
#: Most languages, and most sampled ids, that are broadcast to find their documents; more of them meet the documents by a shuffle.
BROADCAST_ROWS = 500_000
EVIDENCE = 60
_TAG = re.compile(r"<[^>]*>")
#: How many pages of evidence a level has to weigh as much as the level above it.
STRENGTH = 4.0
_HIDDEN = ("script", "style", "nav", "footer", "header", "aside", "noscript")
_ADVERT = re.compile(r"""class=["']?(?:ad|ads|advert)\b""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?\s*([a-z]{2,3})\b""", re.I)
_CONTENT = re.compile(r"""content-language["']|\bcontent\s*=\s*["']?\s*([a-z]{2,3})\b""", re.I)


@lru_cache(64)
def _opening(names: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"<(?:({'|'.join(names)})\b|!--)" if "!--" in names else rf"<({'|'.join(names)})\b", re.I)


@lru_cache(64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def _elements(page: str, names: tuple[str, ...]) -> Iterator[tuple[int, int, int, int]]:
    """(start, start of its content, end of its content, end) of the outermost elements of these names; '!--' are comments, div only advertisements.

    Every character is looked at a few times at most: where an element is never closed, no further one of its name is looked for.
    """
    at, open_names = 0, names
    while open_names and (found := _opening(open_names).search(page, at)):
        name = (found[1] or "!--").lower()
        inner = found.end() if name == "!--" else page.find(">", found.end()) + 1
        if not inner:
            return
        if name == "div" and not _ADVERT.search(page, found.end(), inner):
            at = inner
            continue
        if name == "!--":
            close = page.find("-->", inner)
            ends = (close, close + 3) if close >= 0 else None
        else:
            close = _closing(name).search(page, inner)
            ends = close.span() if close else None
        if ends is None:
            open_names = tuple(x for x in open_names if x != name)
            at = inner
        else:
            yield found.start(), inner, *ends
            at = ends[1]


def visible_text(page: str | None) -> str:
    """The text of a page's article or, without one, of the whole page; scripts, navigation and advertisements are left out.

    An element that is never closed hides nothing. The time is in proportion to the page.
    """
    page, parts, at = page or "", [], 0
    for start, _, _, end in _elements(page, ("!--", *_HIDDEN, "div")):
        parts.append(page[at:start])
        at = end
    page = " ".join([*parts, page[at:]])
    page = " ".join(page[a:b] for _, a, b, _ in _elements(page, ("article", "main"))) or page
    closed = page.rfind(">") + 1  # no tag begins after it
    return markup.unescape(_TAG.sub(" ", page[:closed]) + page[closed:])


def declared_language(page: str | None) -> str | None:
    """The first language that the markup declares, in small letters without a region."""
    page, at = page or "", 0
    while found := _opening(("html", "meta")).search(page, at):
        at = page.find(">", found.end()) + 1 or len(page)
        if found[1].lower() == "html":
            if said := _LANG.search(page, found.end(), at):
                return said[1].lower()
        else:
            named = False
            for said in _CONTENT.finditer(page, found.end(), at):
                if said[1] and named:
                    return said[1].lower()
                named = named or not said[1]
    return None


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the text in small letters; everything but letters counts as one blank."""
    data = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    x = np.frombuffer(f" {data} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    mixed = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64)


@dataclass(frozen=True)
class LetterModels:
    """Languages, and the log probability of every bucket in each."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    def mean_log_likelihoods(self, text: str) -> tuple[int, list[float]]:
        """(number of trigrams, mean log likelihood in each language); zeros without any."""
        ids = trigrams(text)
        if not len(ids):
            return 0, [0.0] * len(self.languages)
        counts = np.bincount(ids, minlength=BUCKETS)
        seen = np.flatnonzero(counts)
        return len(ids), (self.log_p[:, seen] @ counts[seen] / len(ids)).tolist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = SAMPLE) -> LetterModels:
    """Letter models of all languages, from at most `bound` documents of each.

    Rows without text or language are left out. Trigrams are counted where the documents are; one row of
    counts for each language and bucket comes to the driver.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    # of a frequent language a part of the ids about twice the bound is ranked; part of the ids is taken by their hash
    parts = checkpointed(rows.groupBy("lang").agg((F.lit(2.0 * bound + 100) / F.count("*")).alias("part")))
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    some = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).join(parts, "lang").where(F.shiftrightunsigned("hash", 33) <= F.col("part") * 2.0**31)
    ranked = some.select("doc_id", "lang", "hash").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id")))
    chosen = written(ranked.where(F.col("rank") <= bound).select("doc_id", "lang"))
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text")):
                counts = np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
                sums[lang] = sums[lang] + counts if lang in sums else counts
        for lang, x in sums.items():
            seen = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(x[seen])], names=["lang", "bucket", "n"])

    sample = rows.join(chosen, ["doc_id", "lang"]).select("lang", "text")
    counts = sample.mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    if not languages:
        return LetterModels(("und",), np.zeros((1, BUCKETS), np.float32))
    place = {x: k for k, x in enumerate(languages)}
    table = np.full((len(languages), BUCKETS), 0.5, np.float32)
    table[counts["lang"].map(place), counts["bucket"]] += counts["n"].to_numpy(np.float32)
    return LetterModels(languages, np.log(table / table.sum(1, keepdims=True, dtype=np.float64)).astype(np.float32))


def _normal(logs: Column) -> Column:
    """exp(logs), scaled to the sum 1."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return let(raised, lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))


def _sums(of: str, n: int) -> list[Column]:
    return [F.sum(F.col(of)[i]).alias(f"s{i}") for i in range(n)]


def identify(pages: DataFrame, docs: DataFrame, url_col: str = "url", html_col: str = "html", page_col: str = "page_id") -> DataFrame:
    """One row for each page: page_id, host, declared, n_letters, text_lang, lang, probability.

    docs(doc_id, text, lang) are what the letter models learn from. A page without a usable address belongs to a
    host of its own kind, ''; one without text is judged by the other evidence; declared languages that no model
    knows count as another language. Repeated rows are judged one by one; null ids stay; ties go to the language that
    comes last in the alphabet. An empty table of pages gives no rows.
    """
    models = train(docs)
    n = len(models.languages)
    seen = _read(pages, models, url_col, html_col, page_col)
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    tempered = F.transform("means", lambda x: x * F.least(F.col("n_letters"), F.lit(EVIDENCE)))
    seen = checkpointed(
        seen.select(
            "page_id", host.alias("host"), F.regexp_extract(host, r"([^.]+\.)?[^.]+$", 0).alias("domain"), F.regexp_extract(host, r"[^.]+$", 0).alias("suffix"),
            "declared", F.when(F.col("declared").isNull(), "-").when(F.col("declared").isin(list(models.languages)), F.col("declared")).otherwise("*").alias("said"),
            "n_letters", tempered.alias("logs"), let(tempered, _normal).alias("own"),
        )
    )
    by_host = checkpointed(seen.groupBy("suffix", "domain", "host").agg(F.count("*").alias("n_pages"), *_sums("own", n)))
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    all_pages = by_host.agg(*[F.coalesce(x, F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(sums)]).first()
    everywhere = (np.array(all_pages) + STRENGTH / n) / (sum(all_pages) + STRENGTH)
    total = sum((F.col(f"s{i}") for i in range(1, n)), F.col("s0"))

    def drawn(counts: DataFrame, keys: list[str], up: list[Column]) -> DataFrame:
        return counts.select(*keys, F.array(*[(F.col(f"s{i}") + STRENGTH * up[i]) / (total + STRENGTH) for i in range(n)]).alias("up"))

    above = [F.col("up")[i] for i in range(n)]
    suffixes = drawn(by_host.groupBy("suffix").agg(*sums), ["suffix"], [F.lit(float(x)) for x in everywhere])
    domains = drawn(by_host.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix"), ["suffix", "domain"], above)
    hosts = by_host.join(domains, ["suffix", "domain"]).select("host", "n_pages", "up", *[f"s{i}" for i in range(n)])
    said = _said_given_true(seen, models.languages)
    joined = join_facts(seen, hosts, "host", "n_pages").join(F.broadcast(said), "said")
    without_own = F.array(*[(F.greatest(F.col(f"s{i}") - F.col("own")[i], F.lit(0.0)) + STRENGTH * F.col("up")[i]) / (total - 1 + STRENGTH) for i in range(n)])
    fused = F.zip_with(F.zip_with("logs", "log_said", lambda a, b: a + b), F.transform(without_own, lambda x: F.log(F.greatest(x, F.lit(1e-9)))), lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in models.languages])
    best = lambda p: F.array_max(F.zip_with(p, names, lambda x, lang: F.struct(x.alias("p"), lang.alias("lang"))))
    return joined.withColumn("best", best(let(fused, _normal))).select(
        "page_id", F.nullif("host", F.lit("")).alias("host"), "declared", "n_letters",
        F.when(F.col("n_letters") > 0, best(F.col("own"))["lang"]).alias("text_lang"), F.col("best.lang").alias("lang"), F.col("best.p").alias("probability"),
    )


def _read(pages: DataFrame, models: LetterModels, url_col: str, html_col: str, page_col: str) -> DataFrame:
    """(page_id, url, declared, n_letters, means) of every page; means are the mean log likelihoods in all languages.

    At most LANGUAGES models go to the executors at once. Where there are more, each pass is written, and they meet by a row's number.
    """

    def reader(shared):
        def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                declared, letters, means = [], [], []
                for page in part.column("html"):
                    page = page.as_py()
                    declared.append(declared_language(page))
                    count, mean = shared.value.mean_log_likelihoods(visible_text(page))
                    letters.append(count)
                    means.append(mean)
                found = [pa.array(declared, pa.string()), pa.array(letters, pa.int64()), pa.array(means, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "page_id", "url")), *found], names=["row", "page_id", "url", "declared", "n_letters", "means"])

        return read

    columns = [F.col(page_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")]
    slim = with_small_batches(pages).select(F.monotonically_increasing_id().alias("row"), *columns)
    seen = None
    for k in range(0, len(models.languages), LANGUAGES):
        block = LetterModels(models.languages[k : k + LANGUAGES], models.log_p[k : k + LANGUAGES])
        shared = pages.sparkSession.sparkContext.broadcast(block)  # LANGUAGES x BUCKETS numbers at most
        found = slim.mapInArrow(reader(shared), "row long, page_id long, url string, declared string, n_letters long, means array<double>")
        if len(models.languages) > LANGUAGES:
            found = written(found)
        if seen is None:
            seen = found
        else:
            seen = seen.join(found.select("row", F.col("means").alias("more")), "row").withColumn("means", F.concat("means", "more")).drop("more")
    return seen.drop("row")


def _said_given_true(seen: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(said, log_said): for every declaration, the log probability of it in pages of each language; a row for each language and two more.

    Counts are sums of text posteriors; 5 pages that declare the truth are added to each language, and a half of one of each kind.
    """
    n, kinds = len(languages), [*languages, "-", "*"]
    table = np.full((len(kinds), n), 0.5)
    table[np.arange(n), np.arange(n)] += 5
    for r in seen.groupBy("said").agg(*_sums("own", n)).collect():
        table[kinds.index(r["said"])] += [r[f"s{i}"] for i in range(n)]
    logs = np.log(table / table.sum(0))
    return seen.sparkSession.createDataFrame([(k, x.tolist()) for k, x in zip(kinds, logs)], "said string, log_said array<double>")
