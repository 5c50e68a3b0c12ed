"""Quality rules, the classifier and language identification."""

import re
import zlib
from collections import Counter
from math import log
from pathlib import Path

import numpy as np
import pytest

from pointweave.llm import language_id as L
from pointweave.llm import quality_classifier as Q
from pointweave.llm import quality_rules as R

from .conftest import EDGES

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


REPEATS = [(20, "a b c d e\n" * 4), (21, "a b c d e f a b c d e x y z q r s t u v w " + " ".join(map(str, range(60)))), (22, "| x # y\nline one\nline one\n\n\n"), (23, "one two three four " * 3)]


def test_base_counts(spark, docs_of):
    rows = [*EDGES, *REPEATS]
    got = R.quality_rules(docs_of(rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    want = sorted(((i, *base(t)) for i, t in rows), key=repr)
    assert sorted((tuple(r[:6]) for r in got), key=repr) == want
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)  # no trusted texts: the ratio is 0


def spark_hash(spark, rows):
    """xxhash64 as Spark has it, for tuples of strings or of hashes."""
    import pyspark.sql.functions as F

    width = max(map(len, rows))
    kind = "string" if isinstance(rows[0][0], str) else "long"
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{i} {kind}" for i in range(width)))
    return [r[0] for r in df.orderBy("k").select(F.xxhash64(*[f"c{i}" for i in range(width)])).collect()]


@pytest.mark.parametrize("broadcast", [None, 0])
def test_log_ratio_against_brute_force(spark, docs_of, monkeypatch, broadcast):
    if broadcast is not None:
        monkeypatch.setattr(R, "BROADCAST_IDS", broadcast)
    texts = {k: " ".join(["good" if k % 2 else "bad", *(f"w{(k * 7 + j * (1 + k % 2)) % 13}" for j in range(14))]) for k in range(12)}
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    buckets = 1 << 14
    vocabulary = sorted({w for t in texts.values() for w in t.split()})
    h = dict(zip(vocabulary, spark_hash(spark, [(w,) for w in vocabulary]), strict=True))
    pairs = sorted({p for t in texts.values() for p in zip(t.split(), t.split()[1:], strict=False)})
    h2 = dict(zip(pairs, spark_hash(spark, [(h[a], h[b]) for a, b in pairs]), strict=True))

    def grams(t):
        w = t.split()
        return [h[x] % buckets for x in w] + [h2[p] % buckets for p in zip(w, w[1:], strict=False)]

    corpus, trusted = Counter(g for t in texts.values() for g in grams(t)), Counter(g for k in range(1, 8, 2) for g in grams(texts[k]))
    n, g = sum(corpus.values()), sum(trusted.values())
    ratio = {b: round(R.STEPS * log((trusted[b] + R.PRIOR) / (corpus[b] * g / n + R.PRIOR))) for b in corpus}
    got = {r["doc_id"]: r for r in R.quality_rules(docs_of(list(texts.items())), labels, threshold=0.0).collect()}
    for k, t in texts.items():
        total = sum(ratio[b] for b in grams(t))
        assert got[k]["mean_log_ratio"] == pytest.approx(total / (R.STEPS * (2.0 * len(t.split()) - 1)))
        assert got[k]["kept"] == (not got[k]["base_failed"] and total >= 0)


def test_rules_use_no_python(spark, docs_of):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    plan = R.quality_rules(docs_of(EDGES), labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_keep_passing_returns_the_columns(spark, docs_of):
    docs = docs_of([*EDGES, *REPEATS])
    kept = R.keep_passing(docs, R.trusted_ids(spark.createDataFrame([], "doc_id long, quality int")))
    passing = sorted(i for i, t in [*EDGES, *REPEATS] if (n := base(t))[0] >= 10 and 100 * n[4] <= 20 * n[0])
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == passing


CLASHING = ["_doc", "_t", "_w", "_h", "_id", "_gate", "kept", "a.b", "n_words", "bucket", "x", "score"]


def test_stages_keep_columns_of_any_name(spark):
    text = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, *CLASHING), (2, None, *CLASHING), (None, text, *CLASHING)], f"doc_id long, text string, {', '.join(f'`{c}` string' for c in CLASHING)}")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = R.keep_passing(docs, R.trusted_ids(labels))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, text, *CLASHING), (None, text, *CLASHING)], key=repr)
    good = Q.keep_good(docs, labels)
    assert good.columns == docs.columns and good.count() == 3  # one label only: its share is the score


def test_classifier_on_edges(spark, docs_of):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs_of(EDGES), labels).collect()
    assert len(got) == len(EDGES)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert Q.classify(docs_of([]), labels).count() == 0


def test_statistics_are_finite():
    for _, t in EDGES:
        x = Q.statistics(t or "")
        assert len(x) == len(Q.FEATURES) and np.isfinite(x).all()


def test_score_is_the_density_difference():
    rng = np.random.default_rng(0)
    d, x = len(Q.FEATURES), rng.normal(size=(4, len(Q.FEATURES)))
    model, odds = {"scale": np.ones(d), "odds": 0.7}, np.full(4, 0.7)
    for y, sign in ((0, -1), (1, 1)):
        a = rng.normal(size=(d, d))
        c, mean = a @ a.T + np.eye(d), rng.normal(size=d)
        factor = np.linalg.cholesky(c)
        model[y] = (mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))
        z = x - mean
        odds += sign * (-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1])
    assert Q.score(x, model) == pytest.approx(1 / (1 + np.exp(-odds)))


def labelled_texts(n=160):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(n):
        good = k % 2
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(15, 60))]
        rows.append((k, " ".join(words if good else [w.upper() + rng.choice(["!", "", "$#"]) for w in words])))
        labels.append((k, good))
    return rows, labels


def test_fit_and_scores_against_brute_force(spark, docs_of):
    """Moments, shrinkage and scores computed plainly; labels of a null or unknown id, other values and the held-out fold don't count."""
    rows, labels = labelled_texts()
    extra = [(None, 1), (999, 0), (3, None), (5, 7), (8, 1), (8, 1)]  # id 8 has three labels
    df = spark.createDataFrame([(i, y, 0) for i, y in labels + extra], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in Q.classify(docs_of(rows), df).collect()}
    x = {i: np.array(Q.statistics(t)) for i, t in rows}
    train = [(i, y) for i, y in labels + extra if i in x and y in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    m = {y: np.array([x[i] for i, z in train if z == y]) for y in (0, 1)}
    cov = {y: np.cov(m[y].T, bias=True) for y in m}
    pooled = sum(len(m[y]) * cov[y] for y in m) / len(train)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    d = len(scale)
    odds = {i: np.log(len(m[1]) / len(m[0])) for i in x}
    for y, sign in ((0, -1), (1, 1)):
        c = ((1 - Q.TO_POOLED) * cov[y] + Q.TO_POOLED * pooled) / np.outer(scale, scale)
        c = (1 - Q.TO_IDENTITY) * c + Q.TO_IDENTITY * np.trace(c) / d * np.eye(d)
        for i in x:
            z = (x[i] - m[y].mean(0)) / scale
            odds[i] += sign * (-0.5 * z @ np.linalg.solve(c, z) - 0.5 * np.linalg.slogdet(c)[1])
    for i in x:
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(odds[i], -500, 500))), abs=1e-6)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_a_score_at_the_cut_is_good(spark, docs_of):
    """Three labels of 1 and seven of 0 over one class too small to fit: every score is the share 0.3, which passes."""
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5][:10]
    labels = spark.createDataFrame([(i, 1, 0) for i in ids[:1]] + [(i, 0, 0) for i in ids[1:4]], "doc_id long, quality int, toxic int")
    docs = docs_of([(i, "some words") for i in ids])
    assert {(r["score"], r["predicted"]) for r in Q.classify(docs, labels, cut_at=0.25).collect()} == {(0.25, 1)}
    assert Q.keep_good(docs, labels, cut_at=0.25).count() == len(ids) and Q.keep_good(docs, labels, cut_at=0.2501).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not there")
def test_classifier_held_out(spark):
    """Held-out rows: the area under the curve, and how many are told apart at the cut."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = Q.classify(spark.read.parquet(f"{DATA}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    wins = (good.score.to_numpy()[:, None] > bad.score.to_numpy()).mean() + 0.5 * (good.score.to_numpy()[:, None] == bad.score.to_numpy()).mean()
    assert wins > 0.9
    assert (good.predicted == 1).mean() > 0.95 and (bad.predicted == 0).mean() > 0.6


def segmentations(word, pieces, p):
    if not word:
        return 1.0
    total = 0.0
    for j in range(1, len(word) + 1):
        k = pieces.get(word[:j], 0 if j == 1 else None)
        if k is not None:
            total += p[k] * segmentations(word[j:], pieces, p)
    return total


def test_forward_sums_all_segmentations():
    pieces = {"a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5, "▁": 6, "▁a": 7}
    p = np.random.default_rng(1).dirichlet(np.ones(8), 2).T
    words = ["▁", "▁a", "▁abab", "▁bcab", "▁ababababab"]
    got = L.forward(words, pieces, p)
    for k, w in enumerate(words):
        for lang in range(2):
            assert got[k, lang] == pytest.approx(log(segmentations(w, pieces, p[:, lang])))
        size = {0: 1} | {k: len(x) for x, k in pieces.items()}
        assert sum(size[k] * x for k, x in L.expected_counts(w, pieces, p[:, 0])) == pytest.approx(len(w))


def test_long_words_are_scored_whole():
    """Beyond SHORT characters: the same sums, one word at a time; no segmentation is cut."""
    pieces = {"a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5, "▁": 6, "▁a": 7, "b" * 9: 8}
    p = np.random.default_rng(1).dirichlet(np.ones(9), 2).T
    short = "▁" + "abbcabab" * 5
    assert L.forward_long(short, pieces, p) == pytest.approx(L.forward([short], pieces, p)[0])
    assert dict(L._expected_long(L.arcs(short, pieces), len(short), p[:, 0])) == pytest.approx(dict(L.expected_counts(short, pieces, p[:, 0])))
    word = "▁" + "abbcabab" * 3000
    plain = [-np.inf] * (len(word) + 1)
    plain[0] = 0.0
    for i, j, k in L.arcs(word, pieces):
        plain[j] = np.logaddexp(plain[j], plain[i] + log(p[k, 1]))
    assert L.forward([word, short], pieces, p)[0, 1] == pytest.approx(plain[-1])
    assert sum({0: 1, **{k: len(x) for x, k in pieces.items()}}[k] * x for k, x in L.expected_counts(word, pieces, p[:, 0])) == pytest.approx(len(word))


def language_brute(rows):
    """Training and scoring over all substrings and all segmentations, without the operator's code."""
    known = L.load_pieces()

    def marked(t):
        return ["▁" + w for w in re.findall(r"[^\W\d_]+", t.lower())]

    def splits(w):
        if not w:
            return [[]]
        return [[w[:j], *rest] for j in range(1, len(w) + 1) if j == 1 or w[:j] in known for rest in splits(w[j:])]

    number = lambda x: known.get(x, 0)
    train = {}
    for i, t, lang in rows:
        if lang is not None and t is not None and not (i is not None and zlib.crc32(str(i).encode()) % 3 == 1):
            train.setdefault(lang, []).extend(marked(t))
    size, model = len(known) + 1, {}
    for lang, words in train.items():
        first = np.full(size, 0.1)
        for w in words:
            for a in range(len(w)):
                for b in range(a + 1, len(w) + 1):
                    if b == a + 1 or w[a:b] in known:
                        first[number(w[a:b])] += 1
        first /= first.sum()
        second = np.full(size, 0.1)
        for w in words:
            ways = [(s, np.prod([first[number(x)] for x in s])) for s in splits(w)]
            for s, weight in ways:
                for x in s:
                    second[number(x)] += weight / sum(v for _, v in ways)
        model[lang] = second / second.sum()
    out = {}
    for i, t, _ in rows:
        words = marked(t or "")
        if words and model:
            ll = {lang: sum(log(sum(np.prod([p[number(x)] for x in s]) for s in splits(w))) for w in words) for lang, p in sorted(model.items())}
            best = max(ll, key=ll.get)
            out[i] = (best, 1 / sum(np.exp(v - ll[best]) for v in ll.values()))
        else:
            out[i] = ("und", 0.0)
    return out


def test_language_against_brute_force(spark):
    talk = {"aa": "the cat sat on a mat", "bb": "le chat est sur un lit", "cc": "das ist ein hund"}
    rows = []
    for k in range(24):
        lang = sorted(talk)[k % 3]
        words = talk[lang].split()
        rows.append((k, " ".join(words[k % 4 :] + words[: k % 2]) + ("?!" if k % 5 else " 12_ §"), None if k == 7 else lang))
    rows += [(50, None, "aa"), (51, "12 --", "bb"), (None, "sat on", "cc"), (52, "zzq", None)]
    df = spark.createDataFrame([(i, t, x, "s") for i, t, x in rows], "doc_id long, text string, lang string, lang_pred string")
    got, want = L.identify(df).collect(), language_brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-9), r


def test_language_ties_go_to_the_first(spark):
    rows = [(k, "same words here", lang) for k in range(30) for lang in ("xx", "aa", "mm")]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"aa"} and {round(r["score"], 9) for r in got} == {round(1 / 3, 9)}


def test_pieces_of_any_length_count():
    found = L.load_pieces()
    assert sum(len(x) >= 8 for x in found) > 4000
    pieces = {"a": 1, "▁": 2, "a" * 12: 3, "▁" + "a" * 15: 4}
    p = np.random.default_rng(1).dirichlet(np.ones(5), 2).T

    def total(word, lang):
        return sum(p[k, lang] * total(word[len(x) :], lang) for x, k in pieces.items() if word.startswith(x)) if word else 1.0

    for w in ("▁" + "a" * 11, "▁" + "a" * 12, "▁" + "a" * 30):
        assert L.forward([w], pieces, p)[0] == pytest.approx([log(total(w, lang)) for lang in range(2)])
        assert sum(len(x) * n for k, n in L.expected_counts(w, pieces, p[:, 0]) for x, j in pieces.items() if j == k) == pytest.approx(len(w))
    assert 3 in {k for _, _, k in L.arcs("▁" + "a" * 12, pieces)}


def test_language_on_edges(spark, docs_of):
    rows = L.identify(docs_of([*EDGES, (30, "123 456"), (31, "abc " * 50)])).collect()
    assert len(rows) == len(EDGES) + 2
    found = {(r["doc_id"], r["lang_pred"]) for r in rows}
    assert {(1, "und"), (2, "und"), (3, "und"), (30, "und"), (31, "en")} <= found
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["lang_pred"] == "und" for r in L.identify(docs_of(EDGES).drop("lang").selectExpr("*", "cast(null as string) lang")).collect())


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not there")
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = L.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
