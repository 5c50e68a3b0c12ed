"""Quality classifier: regularised quadratic discriminant analysis over statistics of whole texts.

Each text becomes a row of transformed statistics.  Class means and covariances come from sums over all labelled
training rows (a distributed aggregate: counts, sums and products); covariances are shrunk towards the pooled one and
towards a multiple of the identity, and factored once (Cholesky).  A score is the logistic of the prior log odds plus the
difference of the two Gaussian log densities, each from a triangular solve with the cached factor.

Defined results: null text counts as empty and gets a score like any other.  Labels whose id is null or unknown, or
whose quality is not 0 or 1, are not used; of several labels for an id each counts.  With fewer than two rows of either
class the score is the share of label 1 (0.5 without labels).  Repeated rows get equal results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.text import doc_texts, slices
from pointweave.plans.lineage import cut

#: Share of the pooled covariance in a class's covariance, and of the scaled identity in the result.
TO_POOLED, TO_IDENTITY = 0.5, 0.01
CUT = 0.3
#: Labelled ids that a broadcast may hold; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
FEATURES = (
    "log_words", "log_chars", "word_length", "word_length_spread", "long_words", "short_words", "distinct_words", "repeated_pairs",
    "upper", "digits", "symbols", "stops", "exclaims", "other_ascii", "non_ascii", "line_words", "repeated_lines", "top_word",
)
_FOLDS = 5


def _masks() -> np.ndarray:
    """Byte classes as columns: upper case, lower case, digits, symbols, sentence marks, exclamation marks, white space, other ASCII, non-ASCII."""
    m = np.zeros((256, 9))
    for b in range(256):
        c = chr(b)
        k = 8 if b > 127 else 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if "0" <= c <= "9" else 3 if c in "#*$%&|<>@=+_{}[]\\/~^" else 4 if c in ".,;:?" else 5 if c == "!" else 6 if c in " \t\n\r\x0b\x0c" else 7
        m[b, k] = 1
    return m


_MASKS = _masks()


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of FEATURES; finite for every text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    upper, lower, digits, symbols, stops, exclaims, _, other, wide = (np.bincount(raw, minlength=256) @ _MASKS).tolist()
    ws = text.split()
    n, size = len(ws), max(1, len(raw))
    letters = max(1.0, upper + lower + wide)
    share = lambda x: math.sqrt(x)  # noqa: E731  spreads small shares
    if n:
        lengths = np.fromiter(map(len, ws), np.int64, n)
        mean, spread = float(lengths.mean()), float(lengths.std())
        long, short = float((lengths > 14).mean()), float((lengths < 4).mean())
        counts: dict[str, int] = {}
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
        distinct, top = len(counts) / n, max(counts.values()) / n
        pairs = 1 - len(set(zip(ws, ws[1:], strict=False))) / max(1, n - 1) if n > 1 else 0.0
    else:
        mean = spread = long = short = top = pairs = 0.0
        distinct = 1.0
    lines = [x for x in text.split("\n") if x.strip()]
    m = len(lines)
    return [
        math.log1p(n), math.log1p(len(raw)), math.log1p(mean), math.log1p(spread), share(long), share(short), distinct * math.log1p(n) / 8, share(max(0.0, pairs)),
        share(upper / letters), share(digits / size), share(symbols / size), share(stops / size), share(exclaims / size), share(other / size), share(wide / size),
        math.log1p(n / m if m else 0.0), share(1 - len(set(lines)) / m if m else 0.0), share(top),
    ]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, x array<double>``."""

    def run(batches):
        for b in slices(batches):
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return doc_texts(docs, text=text).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: str = "doc_id", folds: int = _FOLDS, fold: int = 0):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, y`` of the labels that may be learned from."""
    return labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))


def fit(table: DataFrame, labels: DataFrame) -> dict:
    """Class moments of the training rows, as a model on the driver (its size depends on the features only)."""
    d = len(FEATURES)
    rows = table.join(training_labels(labels), "doc_id").select("y", *[F.col("x")[i].alias(f"x{i}") for i in range(d)])
    sums = [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(d)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]]
    got = {r["y"]: r for r in rows.groupBy("y").agg(*sums).collect()}
    n = {y: got[y]["n"] if y in got else 0 for y in (0, 1)}
    total = n[0] + n[1]
    if min(n.values()) < 2:
        return {"share": n[1] / total if total else 0.5}
    mean, cov = {}, {}
    for y, r in got.items():
        mean[y] = np.array([r[f"s{i}"] for i in range(d)]) / n[y]
        second = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / n[y]
        cov[y] = second - np.outer(mean[y], mean[y])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))  # shrink in units of each statistic's spread
    model = {"scale": scale, "odds": math.log(n[1] / n[0])}
    for y in (0, 1):
        c = ((1 - TO_POOLED) * cov[y] + TO_POOLED * pooled) / np.outer(scale, scale)
        c = (1 - TO_IDENTITY) * c + TO_IDENTITY * np.trace(c) / d * np.eye(d)
        factor = np.linalg.cholesky(c)
        model[y] = (mean[y] / scale, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))
    return model


def score(x: np.ndarray, model: dict) -> np.ndarray:
    """Probabilities of label 1 for rows of statistics."""
    if "share" in model:
        return np.full(len(x), float(model["share"]))
    z = x / model["scale"]
    log_density = {}
    for y in (0, 1):
        mean, inverse, half_log_det = model[y]
        u = (z - mean) @ inverse.T
        log_density[y] = -0.5 * np.einsum("ij,ij->i", u, u) - half_log_det
    odds = np.clip(model["odds"] + log_density[1] - log_density[0], -500, 500)
    return 1 / (1 + np.exp(-odds))


def classify(docs: DataFrame, labels: DataFrame, cut_at: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    table = cut(features(docs), "statistics")
    model = fit(table, labels)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            p = score(x, model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= cut_at).astype("i4"), pa.int32())], names=["doc_id", "score", "predicted"])

    return table.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, cut_at: float = CUT) -> DataFrame:
    """Rows of ``docs`` (all columns, whatever their names) that score at least ``cut_at``; scored in place, so texts are not shuffled.

    Statistics for the fit are taken of labelled rows only; their ids are broadcast if few, else joined by a shuffle.
    """
    ids = training_labels(labels).select(F.col("doc_id").alias("_d")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    labelled = plain.join(F.broadcast(ids) if few else ids, plain.doc_id == ids._d, "left_semi")
    model = fit(cut(features(labelled), "statistics"), labels)
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            texts = b.column(0).field(at).to_pylist()
            x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), len(FEATURES))
            yield b.filter(pa.array(score(x, model) >= cut_at))

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return row.mapInArrow(run, row.schema).select("_doc.*")
