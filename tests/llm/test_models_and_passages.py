import random
import re
import time
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelkit.llm import components, language_id, packing, prefilter, quality_classifier, queries, simhash, substring_dedup, toxicity
from tests.llm import brute

SMALL, SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    n1, n0 = label.sum(), len(label) - label.sum()
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


# --- quality classifier ---


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert all(h == brute.held_out(d, 5, 0) for d, h in zip(got.doc_id, got.held_out))
    known = got.merge(labels.toPandas(), on="doc_id")
    known = known[known.held_out]
    assert auc(known.score.to_numpy(), known.quality.to_numpy()) > 0.99
    assert (known.predicted == known.quality).mean() > 0.97


def plain_quality(docs, labels, order):
    """{doc_id: score}: the risk written out row by row and minimised by the same steps; docs {id: text}, labels {id: 0 or 1}, order: ids by hash."""
    learnt = [d for d in order if not brute.held_out(d, 5, 0)]
    x = {d: np.array(quality_classifier.features(t)) for d, t in docs.items()}
    positives, unlabelled = [x[d] for d in learnt if labels.get(d) == 1], [x[d] for d in learnt]

    def adam(base, gradient, steps):
        mean, scale = np.mean(base, 0), np.std(base, 0) + 1e-6
        of = lambda v: np.r_[z := np.clip((v - mean) / scale, -8, 8), z * z / 8, 1.0]
        w = m = v = np.zeros(2 * len(mean) + 1)
        for k in range(1, steps + 1):
            g = gradient(w, of)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return lambda t: 1 / (1 + np.exp(-np.clip(of(t) @ w, -30, 30)))

    def parts(p, u, of):
        return np.array([of(t) for t in p]), np.array([of(t) for t in u])

    def telling(w, of, held={}):  # noqa: B006
        p, u = held.setdefault("x", parts(positives[::2], unlabelled[::2], of))
        return np.mean([(1 / (1 + np.exp(-t @ w)) - 1) * t for t in p], 0) + np.mean([t / (1 + np.exp(-t @ w)) for t in u], 0) + 1e-2 * w

    tells = adam(positives[::2] + unlabelled[::2], telling, 200)
    p, u = ([tells(t) for t in held[1::2]] for held in (positives, unlabelled))
    margin = sum((np.log(4 / 0.1) / (2 * len(held))) ** 0.5 for held in (p, u))
    _, prior = min(((sum(b >= c for b in u) / len(u) + margin) / (sum(a >= c for a in p) / len(p)), (sum(b >= c for b in u) / len(u)) / (sum(a >= c for a in p) / len(p))) for c in sorted(p))

    def risk(w, of, held={}):  # noqa: B006
        p, u = held.setdefault("x", parts(positives, unlabelled, of))
        loss = lambda t: np.logaddexp(0, t)
        bad = np.mean([loss(t @ w) for t in u]) - prior * np.mean([loss(t @ w) for t in p])
        on_bad = np.mean([t / (1 + np.exp(-t @ w)) for t in u], 0) - prior * np.mean([t / (1 + np.exp(-t @ w)) for t in p], 0)
        on_good = prior * np.mean([(1 / (1 + np.exp(-t @ w)) - 1) * t for t in p], 0)
        return (on_good + on_bad if bad >= 0 else -on_bad) + 1e-3 * w

    score = adam(positives + unlabelled, risk, 400)
    return {d: score(t) for d, t in x.items()}, prior


def test_quality_query_against_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    order = [r.doc_id for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want, prior = plain_quality({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}, order)
    got = queries.QUERIES["op3_quality_classifier"](spark, SMALL).collect()
    assert len(got) == len(want) and 0.5 < prior < 1
    assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-4) and r.predicted == (r.score >= 0.3) for r in got)


def test_prior_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        good, bad = rng.normal(0, 1, (4000, 2)), rng.normal(3, 1, (4000, 2))
        n = int(2000 * share)
        found = quality_classifier.estimate_prior(good[:2000], rng.permutation(np.r_[good[2000 : 2000 + n], bad[: 2000 - n]]))
        assert abs(found - share) < 0.06
    assert quality_classifier.estimate_prior(good[:5], bad) == quality_classifier.UNKNOWN


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    for module, column, fold in ((quality_classifier, "quality", (5, 0)), (toxicity, "toxic", (4, 2))):
        out = F.crc32(F.col("doc_id").cast("string")) % fold[0] == fold[1]
        flipped = labels.withColumn(column, F.when(out, 1 - F.col(column)).otherwise(F.col(column)))
        a, b = (module.classify(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
        assert a.equals(b)


def test_nonnegative_risk_finds_the_negatives_among_unlabelled():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (600, 3)), rng.normal(3, 1, (150, 3))
    model = quality_classifier.fit(good[:300], np.r_[good[300:], bad], 0.65)
    assert (model.scores(good) > 0.3).mean() > 0.95 and (model.scores(bad) < 0.3).mean() > 0.9


def test_classifiers_with_nulls_repeats_and_no_labels(spark):
    docs = frame(spark, [(1, None), (1, None), (None, ""), (2, "x" * 100_000), (3, "a b c " * 2000)]).withColumns({"label": F.lit(1), "positive": F.lit(2), "word": F.lit(3)})
    labels = frame(spark, [(1, 1, 0), (1, 1, 0), (2, None, 1), (None, 1, 1), (99, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        for given in (labels, labels.limit(0)):
            got = module.classify(docs, given).collect()
            assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
            assert module.classify(docs.limit(0), given).count() == 0


# --- toxicity ---


def kernel(s, t):
    """Common subsequences of three letters with spans up to SPAN, by counting them all."""

    def count(w):
        out = defaultdict(float)
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    a, b = count(s), count(t)
    dot = lambda x, y: sum(v * y[u] for u, v in x.items() if u in y)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def test_kernel_against_counting():
    words = ["idiot", "idxiot", "banana", "anana", "stupidest", "tit", "идиот", "идиотка", "바보같은", "𠀀𠀁𠀂𠀀"]
    known, mapped = toxicity.feature_map(words)
    got = toxicity.kernel(words, known, mapped)
    assert got == pytest.approx(np.array([[kernel(a, b) for b in words] for a in words]))


def toxic_corpus(seed=0, n=400):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "in", "at", "nd", "sh", "re", "ou", "ti"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows, labels = [], []
    for d in range(n):
        words = [word() for _ in range(40)]
        if bad := d % 5 == 0:
            words[rng.randrange(40)] = rng.choice(["idiot", "clown", "stupid"])
        rows.append((d, " ".join(words) + "."))
        labels.append((d, int(bad)))
    return rows, labels


def test_gapped_and_inserted_letters_are_caught(spark):
    rows, labels = toxic_corpus()
    machine = toxicity.train(frame(spark, rows), frame(spark, labels, "doc_id long, toxic int"))
    score = lambda *texts: machine.scores(toxicity.Scorer(machine).measures(list(texts)))
    assert (score("there is an idiot here", "i d i o t", "id-iot ronti", "i*d*i*o*t", "the idxiot thon", "sstupid", "CLOWN!", "clo.wn") > 0.3).all()
    assert (score("theron shatin onre", "", "a b", "tionsh 555 ???") < 0.3).all()


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = toxicity.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert all(h == brute.held_out(d, 4, 2) for d, h in zip(known.doc_id, known.held_out))
    known = known[known.held_out]
    assert (known.predicted == known.toxic).mean() > 0.9 and known[known.toxic == 0].predicted.sum() <= 2


def test_toxicity_catches_held_out_documents_in_every_language(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    known = toxicity.classify(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    caught = known[(known.predicted == 1) & (known.toxic == 1)]
    assert len(caught) >= 0.9 * known.toxic.sum() and len(caught) >= 0.95 * known.predicted.sum()
    assert auc(known.score.to_numpy(), known.toxic.to_numpy()) > 0.98
    for lang, rows in known.groupby("lang"):
        assert (caught.lang == lang).sum() >= 0.8 * rows.toxic.sum(), lang
        assert ((rows.predicted == 1) & (rows.toxic == 0)).sum() <= 0.03 * len(rows), lang


def plain_score(machine, text):
    """The score of a text by loops over its words' subsequences."""
    value, weights = {}, dict(zip(machine.known.tolist(), machine.weights.tolist()))
    for chunk in toxicity.chunks_of(text):
        values = [machine.bias]
        for word in toxicity.words_in(chunk):
            for piece in toxicity._pieces(word):
                found = defaultdict(float)
                for i in range(len(piece)):
                    for j in range(i + 1, min(len(piece), i + toxicity.SPAN)):
                        for k in range(j + 1, min(len(piece), i + toxicity.SPAN)):
                            a, b, c = (ord(piece[x]) for x in (i, j, k))
                            found[(a << 36) + (b << 18) + c] += toxicity.DECAY ** (k - i + 1)
                if found:
                    norm = sum(x * x for x in found.values()) ** 0.5
                    values.append(machine.bias + sum(x * weights.get(t, 0.0) for t, x in found.items()) / norm)
        value[chunk] = max(values)
    found = sorted(value.values(), reverse=True)
    top = (found + [machine.bias] * toxicity.TOP)[: toxicity.TOP]
    reach = sum(max(0, v + 1) for v in found)
    x = [*top, np.log1p(reach), (reach / max(1, len(found))) ** 0.5]
    return 1 / (1 + np.exp(-(np.dot(x, machine.slopes) + machine.offset)))


def test_hinge_fit_against_plain_descent(spark):
    rng = np.random.default_rng(1)
    toxic, clean = ["idiot", "clown", "stupid", "idiots"], sorted({"".join(rng.choice(list("aeiodtnsr"), 6)) for _ in range(60)})
    marks = [*toxic, *clean[:6]]
    rows = [(w, 1.0, 0.25) for w in toxic] + [(w, -1.0, 0.01) for w in clean]
    machine = toxicity.fit_machine(spark.createDataFrame(rows, "word string, y double, cost double").repartition(5), marks, 0.05)
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    x = np.array([[kernel(w, m) for m in marks] for w, _, _ in rows]) @ (vectors / np.sqrt(values))
    y, cost, w, b = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.zeros(len(marks)), 0.0
    for _ in range(20000):
        pull = 2 * cost * y * np.maximum(0, 1 - y * (x @ w + b))
        w, b = w - 0.1 * (0.05 * w - x.T @ pull), b + 0.1 * pull.sum()
    assert machine.values([r[0] for r in rows]) == pytest.approx(x @ w + b, abs=1e-3)


def test_machine_knows_every_script_and_long_words(spark):
    rows, labels = toxic_corpus()
    long = "überlangesschimpfwortmitvielenbuchstabendahinter"
    cyrillic = "".join(chr(c) for c in range(0x430, 0x450))
    rows = [(d, t.replace("idiot", "негодяй").replace("clown", long) + f" {cyrillic[d % 28:d % 28 + 4]} 가나다라마바사") for d, t in rows]
    machine = toxicity.train(frame(spark, rows), frame(spark, labels, "doc_id long, toxic int"))
    score = lambda *texts: machine.scores(toxicity.Scorer(machine).measures(list(texts)))
    assert (score("thon негодяй onre", "негxодяй", "н е г о д я й", long) > 0.3).all()
    assert (score("theron shatin onre", "가나다라마바사", "абвг где") < 0.3).all()


def test_toxicity_query_against_loops(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = queries.QUERIES["op9_toxicity"](spark, SMALL).collect()
    assert len(got) == len(text)
    for r in got:
        assert r.score == pytest.approx(plain_score(machine, text[r.doc_id]), abs=1e-5) and r.predicted == (r.score >= 0.3)


# --- language ---


def test_language_of_pages(spark):
    pages, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    got = language_id.identify(pages, docs).toPandas().merge(pages.toPandas(), on="page_id")
    truth = got.url.str.extract(r"://[^/]+/(\w\w)/")[0]
    assert len(got) == pages.count() and (got.lang == truth).mean() > 0.99 and (got.text_lang == truth).mean() > 0.97


def test_evidence_is_fused(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", "n_chars").alias("text")).collect()}
    rows = [(k, f"http://h{k % 3}.example.de/x", f"<html lang='de-AT'><body>{texts['de'][200 * k:200 * k + 300]}</body></html>") for k in range(9)]
    rows += [(100, "http://h1.example.de/y", "<html><body>12 34</body></html>"), (101, "http://h1.example.de/y", f"<html lang=en>{texts['fr'][:3000]}"), (102, None, None), (103, "not an address", "")]
    got = {r.page_id: r for r in language_id.identify(frame(spark, rows, "page_id long, url string, html string"), docs).collect()}
    assert all(got[k].lang == "de" for k in range(9))
    assert got[100].lang == "de" and got[100].text_lang is None  # the host alone
    assert got[101].lang == "fr" and got[101].declared == "en"  # much text outweighs the declaration
    assert got[102].host is None and 0 < got[102].probability <= 1
    assert language_id.identify(frame(spark, [], "page_id long, url string, html string"), docs).count() == 0


def plain_fusion(pages, models):
    """{page_id: (language, probability)} by loops over pages."""
    strength, evidence, rows = language_id.STRENGTH, language_id.EVIDENCE, []
    n = len(models.languages)
    for page_id, url, html in pages:
        count, means = models.mean_log_likelihoods(language_id.visible_text(html))
        logs = np.array(means) * min(count, evidence)
        own = np.exp(logs - logs.max())
        host = (re.match(r"\w+://([^/:]+)", url or "") or ["", ""])[1].lower()
        parts = host.split(".")
        said = language_id.declared_language(html)
        kind = "-" if said is None else said if said in models.languages else "*"
        rows.append((page_id, (parts[-1],), (parts[-1], ".".join(parts[-2:])), (parts[-1], ".".join(parts[-2:]), host), kind, logs, own / own.sum()))
    kinds = [*models.languages, "-", "*"]
    table = np.full((n + 2, n), 0.5)
    table[np.arange(n), np.arange(n)] += 5
    sums = defaultdict(lambda: np.zeros(n))
    for _, suffix, domain, host, kind, _, own in rows:
        table[kinds.index(kind)] += own
        for level in {(), suffix, domain, ("host", *host)}:
            sums[level] += own
    log_said = np.log(table / table.sum(0))
    out = {}
    for page_id, suffix, domain, host, kind, logs, own in rows:
        prior = (sums[()] + strength / n) / (sums[()].sum() + strength)
        for level in (suffix, domain):
            prior = (sums[level] + strength * prior) / (sums[level].sum() + strength)
        of_host = sums[("host", *host)]
        prior = (np.maximum(of_host - own, 0) + strength * prior) / (of_host.sum() - 1 + strength)
        total = logs + log_said[kinds.index(kind)] + np.log(np.maximum(prior, 1e-9))
        p = np.exp(total - total.max())
        out[page_id] = max(zip(p / p.sum(), models.languages))
    return out


@pytest.mark.parametrize("languages", [64, 3])
def test_fusion_against_loops(spark, monkeypatch, languages):
    monkeypatch.setattr(language_id, "LANGUAGES", languages)  # with 3 the models go out in two passes
    pages, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()] + [(10_001, None, None), (10_002, "http://x.example.org/", "<html lang=zz>"), (10_003, "nothing", "")]
    want = plain_fusion(rows, language_id.train(docs))
    got = language_id.identify(frame(spark, rows, "page_id long, url string, html string"), docs).collect()
    assert len(got) == len(rows)
    assert all(r.lang == want[r.page_id][1] and r.probability == pytest.approx(want[r.page_id][0], abs=1e-9) for r in got)


def test_pages_with_repeats_long_texts_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"hash": F.lit(1), "part": F.lit(2), "rank": F.lit("r")})
    long = "<!-- <div class=ad> <script <nav> " * 30_000 + "the end"
    rows = [(1, "http://a.example.com/", "<p>the same page"), (1, "http://a.example.com/", "<p>the same page"), (None, None, long)]
    df = frame(spark, rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "row": F.lit(2), "up": F.lit(3), "n_pages": F.lit(4)})
    got = language_id.identify(df, docs).collect()
    assert len(got) == 3 and len({(r.lang, r.probability) for r in got if r.page_id == 1}) == 1
    assert language_id.identify(df, docs.limit(0)).count() == 3


@pytest.mark.parametrize("part", ["<!--", "<div", "<div class=ad>", "<script>", "<nav", "<article>", "<html ", "<meta content-language' "])
def test_pages_of_unclosed_tags_are_read_in_linear_time(part):
    page = part * (10_000_000 // len(part))
    start = time.perf_counter()
    language_id.visible_text(page), language_id.declared_language(page)
    assert time.perf_counter() - start < 10  # about a second; a rescan at every opening takes hours


def test_visible_text_and_declarations():
    unclosed = "<nav>a <div class='ad'>b</div><!-- c --> d <script> e"
    assert language_id.visible_text(unclosed).split() == ["a", "d", "e"]
    assert language_id.declared_language("<html><meta name=content-language content=en-GB>") is None
    page = "<html><head><meta http-equiv='content-language' content='fr'></head><nav>menu</nav><article>a &amp; b<script>x</script></article><footer>f</footer>"
    assert language_id.visible_text(page).split() == ["a", "&", "b"] and language_id.declared_language(page) == "fr"


# --- repeated passages ---


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def passages(rows, n=51):
    """{doc_id} that hold n words in a row which an earlier document has."""
    first, hit = {}, defaultdict(set)
    for d, t in sorted(rows):
        w = words_of(t)
        for p in range(len(w) - n + 1):
            if first.setdefault(tuple(w[p : p + n]), d) < d:
                hit[d].update(range(p, p + n))
    return hit


def test_long_passages_are_found_and_others_left_alone(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows if len(set(words_of(t))) > 0.5 * len(words_of(t))]  # no word repeated over and over
    got = defaultdict(set)
    for r in substring_dedup.repeated_passages(frame(spark, rows)).collect():
        assert r.kept_doc_id < r.doc_id and r.n_words >= substring_dedup.MIN_RUN
        got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    want = passages(rows)
    assert want and len(want.keys() - got.keys()) <= 0.02 * len(want)
    covered = sum(len(got[d] & w) for d, w in want.items()) / sum(map(len, want.values()))
    assert covered > 0.75
    near = passages(rows, 6)
    assert got.keys() <= near.keys()


def test_passages_in_the_middle_of_paragraphs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    rows, planted = [], []
    for k in range(60):
        passage = text(60)
        for j in range(3):
            w = text(200)
            at = rng.randrange(200)
            rows.append((3 * k + j, " ".join(w[:at] + passage + w[at:])))
        planted += [3 * k + 1, 3 * k + 2]
    rows += [(1000 + k, " ".join(text(150))) for k in range(60)]
    got = {r.doc_id for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert got <= set(planted) and len(got) >= 0.97 * len(planted)


def test_near_paragraphs_form_components(spark):
    rng = random.Random(4)
    base = ["w%d" % rng.randrange(10**6) for _ in range(90)]
    rows = [(10, "intro\n" + " ".join(base))]
    for d in (7, 11, 12):
        w = list(base)
        w[rng.randrange(90)] = "changed"
        rows.append((d, " ".join(w)))
    got = {(r.doc_id, r.kept_doc_id) for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert got == {(10, 7), (11, 7), (12, 7)}


def test_each_passage_of_fifty_words_is_removed_to_its_ends(spark):
    rng = random.Random(6)
    text = lambda n: ["u%d" % rng.randrange(10**9) for _ in range(n)]
    rows, want = [], set()
    for k in range(0, 600, 2):
        passage = text(rng.choice([50, 51, 60, 150]))
        before, a, b, c = text(rng.randrange(100)), text(80), text(80), text(80)
        rows += [(k, " ".join(a + passage + b)), (k + 1, " ".join(before + passage + c))]
        want.add((k + 1, len(before), len(passage), k))
    few = "one two three one two one four".split()
    rows += [(1000, " ".join(text(40) + few * 9 + text(40))), (1001, " ".join(text(30) + few * 9 + text(50)))]
    want.add((1001, 30, 63, 1000))
    got = {(r.doc_id, r.start_word, r.n_words, r.kept_doc_id) for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert got == want


def test_seeds_of_words_that_repeat_are_few():
    words = np.full(20_000, 7, np.uint64)
    doc, start, _ = substring_dedup.seeds(words, np.array([0, 40]), np.array([40, 20_000]))
    assert len(start) < 700 and set(doc.tolist()) == {0, 1} and np.diff(start).max() < 100


def test_edited_copies_of_short_and_wrapped_lines(spark):
    rng = random.Random(5)
    text = lambda n: ["v%d" % rng.randrange(10**6) for _ in range(n)]
    rows, want = [], set()
    for k in range(0, 60, 3):
        line, wrapped = text(24), text(90)
        rewrapped = [*wrapped[:44], "changed", *wrapped[45:]]
        lay = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
        rows += [(k, f"{' '.join(line)}\n\n{lay(wrapped, 9)}"), (k + 1, " ".join(["changed", *line[1:]])), (k + 2, lay(rewrapped, 7))]
        want |= {(k + 1, 24), (k + 2, 90)}
    got = {(r.doc_id, r.n_words) for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert len(want - got) <= 1


def test_paragraphs_are_lines_and_blocks_of_short_lines():
    lines = lambda *n: list(zip(*(x.tolist() for x in substring_dedup.blocks(np.cumsum([0, *n])))))
    assert lines(12, 30, 5) == [(0, 12), (12, 42)]
    assert lines(5, 6, 7, 0, 5, 4, 30, 11) == [(27, 57), (0, 18)]
    assert lines(13, 9) == [(0, 13), (0, 22)] and lines(0) == lines() == []


def test_passages_with_nulls_and_repeats(spark):
    line = " ".join(f"word{k}" for k in range(60))
    df = frame(spark, [(None, line), (4, line), (4, line), (5, None), (6, "")]).withColumns({"key": F.lit(1), "doc": F.lit(2)})
    got = substring_dedup.repeated_passages(df).collect()
    assert [(r.doc_id, r.start_word, r.n_words, r.kept_doc_id) for r in got] == [(None, 0, 60, 4)]
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0
    cut = {(r.doc_id, r.text) for r in substring_dedup.cut_passages(df).collect()}
    assert cut == {(None, ""), (4, line), (5, None), (6, "")}


def test_no_text_is_lost_where_ids_are_equal_or_missing(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    df = frame(spark, [(4, a), (9, a), (9, b), (None, a), (None, b), (None, "only " + " ".join(f"c{k}" for k in range(60)))])
    cut = sorted((str(r.doc_id), r.text) for r in substring_dedup.cut_passages(df).collect())
    assert cut == sorted([("4", a), ("9", ""), ("9", b), ("None", ""), ("None", ""), ("None", "only " + " ".join(f"c{k}" for k in range(60)))])
    spans = {(r.doc_id, r.start_word, r.n_words, r.kept_doc_id) for r in substring_dedup.repeated_passages(df).collect()}
    assert spans == {(9, 0, 80, 4), (None, 0, 80, 4), (None, 0, 80, 9)}


def test_paragraph_components_against_all_pairs(spark):
    """Families of edited copies: of all links (Jaccard of five-word shingles from 0.8 on) at least 98 in 100 lie within one component, and no component holds more."""
    rng = random.Random(11)
    word = lambda: "x%d" % rng.randrange(10**9)
    paragraphs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([14, 40, 90, 700]))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(2 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice([word(), base[0]])
            paragraphs.append(copy)
    paragraphs = list({tuple(p) for p in paragraphs})
    sets = [{tuple(p[i : i + 5]) for i in range(len(p) - 4)} for p in paragraphs]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for i, j in links:
        root = [root[j] if r == root[i] else r for r in root] if root[i] != root[j] else root
    rows = substring_dedup._identified(frame(spark, [(i, " ".join(p)) for i, p in enumerate(paragraphs)]), "doc_id", "text")
    units = rows.mapInArrow(substring_dedup._units, substring_dedup.UNIT_SCHEMA).where("bands is not null")
    key = {r.key: r.doc for r in units.collect()}
    classes = units.groupBy("key").agg(F.min(F.struct("doc", "text_id", "start", "length")).alias("at"), F.count("*").alias("n_rows"))
    found = components.connected_components(substring_dedup._links(units.select("key", "bands"), classes, rows)).collect()
    got = {key[r.node]: key[r.root] for r in found}
    together = sum(got.get(i, i) == got.get(j, j) for i, j in links)
    assert len(links) > 500 and together >= 0.98 * len(links)
    assert all(root[i] == root[r] for i, r in got.items())


@pytest.mark.parametrize("per_member", [64, 0])
def test_crowded_buckets_against_all_pairs(spark, monkeypatch, per_member):
    monkeypatch.setattr(substring_dedup, "PER_MEMBER", per_member)
    draw = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(60):
        words = list(base)
        for p in draw.sample((5, 20, 35, 50), draw.choice((1, 2, 3))):
            words[p] = f"s{draw.randrange(6)}"
        texts.append(" ".join(words))
    sets = {t: {tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts}
    root = {t: t for t in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {t: min(x, y) if r in (x, y) else r for t, r in root.items()}
    rows = frame(spark, list(enumerate(texts)))
    units = substring_dedup.written(substring_dedup._identified(rows, "doc_id", "text").mapInArrow(substring_dedup._units, substring_dedup.UNIT_SCHEMA)).where("bands is not null")
    classes = units.groupBy("key").agg(F.min(F.struct("doc", "text_id", "start", "length")).alias("at"), F.count("*").alias("n_rows"))
    one = units.select("key", F.array(F.lit(1).cast("long")).alias("bands"))  # all of them in one bucket
    links = substring_dedup._links(one, classes, substring_dedup._identified(rows, "doc_id", "text"), substring_dedup.Scratch(spark))
    found = {r.node: r.root for r in substring_dedup.connected_components(links).collect()}
    key = {r.doc: r.key for r in units.collect()}
    got = {t: found.get(key[k], key[k]) for k, t in enumerate(texts)}
    same = lambda labels: {frozenset(t for t in labels if labels[t] == r) for r in set(labels.values())}
    assert same(got) == same(root) and 1 < len(same(root))


def test_the_bound_of_maps_loses_no_pair():
    rng = np.random.default_rng(5)
    for n in (10, 100, 1000):
        for edits in range(0, n // 4, max(1, n // 40)):
            x = rng.integers(0, 2**63, n, dtype=np.uint64)
            y = np.r_[x[edits:], rng.integers(0, 2**63, edits, dtype=np.uint64)]
            a, b = (substring_dedup.drawn(v).view(np.uint64) for v in (x, y))
            assert n - np.bitwise_count(a & ~b).sum() >= n - edits and n - np.bitwise_count(b & ~a).sum() >= n - edits


def test_prefilter_loses_nothing(spark):
    values = spark.range(0, 5000, 7).withColumnRenamed("id", "v")
    kept = {r.id for r in spark.range(5000).where(prefilter.likely_in(values, "v")(F.col("id"))).collect()}
    assert set(range(0, 5000, 7)) <= kept and len(kept) < 800


# --- queries and pipeline ---


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SMALL).toPandas()
        want = con.sql(sql).df()[list(got.columns)]
        assert sorted(map(tuple, got.astype(str).values.tolist())) == sorted(map(tuple, want.astype(str).values.tolist()))


def test_pipeline_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = {r.doc_id for r in quality_classifier.classify(docs, labels).where("predicted = 1").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    first = {}
    key = lambda x: brute.ascii_lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    for d in sorted(rows):
        for x in (rows[d] or "").split("\n"):
            first.setdefault(key(x), d)
    rows = {d: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == d) for d, t in rows.items()}
    roots = brute.components({d: brute.fingerprint(t) for d, t in rows.items()})
    rows = {d: t for d, t in rows.items() if roots[d] == d}
    hit = brute.contamination(rows.items(), [(r.item_id, r.text) for r in benchmark.collect()])
    rows = {d: t for d, t in rows.items() if not hit[d][4]}
    tokenizer = packing.WordTokenizer(queries.tokenizer_path())
    want = {d: sum(1 for _ in packing.pieces_of(len(ids) // 4 + 1)) for d, ids in zip(rows, tokenizer.ids_of(list(rows.values())))}
    got = {r.doc_id: r["count"] for r in corpus_pipeline.run(spark, SMALL).groupBy("doc_id").count().collect()}
    assert got == want and 0 < len(want) < docs.count()


def test_stages_keep_the_columns_and_handle_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, "en", None, None), (2, "", None, "s", 0), (None, "plain words here", "en", "s", 16), (3, "plain words here", "en", "s", 16), (3, "plain words here", "en", "s", 16)], schema)
    for given in (docs, docs.limit(0)):
        current = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, SMALL)
            assert current.columns == given.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, current, SMALL).count() >= 0


def test_simhash_columns(spark):
    assert simhash.near_duplicates(frame(spark, [(1, "a")])).columns == ["doc_id", "fingerprint", "component_id"]
