"""Quality rules from DataFrame functions only: plain counts and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word unigrams and bigrams: one of trusted texts and one of the whole
corpus.  Both are counted in a single pass over all texts, as partial aggregates over a fixed number of buckets; every
bucket's log ratio becomes a fixed-point integer, so a document's sum does not depend on the order of addition and the
verdict is the same on every run and at every partitioning.  The sum is divided by the number of n-grams.

Defined results: null or blank text has no words, fails the base rules and is not kept.  Rows are judged one by one, so
repeated rows get equal results and null ids stay; further columns are ignored.  Without trusted texts (or on an empty
table) every ratio is 0 and the base rules decide.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.text import SPACE

BUCKETS = 1 << 14
#: Trusted ids that a broadcast may hold; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Fixed-point steps in one nat.
STEPS = 1 << 20
#: Mean log ratio (nats for each n-gram) under which a text is not kept.
THRESHOLD = -0.10
#: Counts added to both sides of a bucket's ratio.
PRIOR = 20
_WS = " \t\n\x0b\f\r"


def _word_hashes(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_t`` (text), ``_w`` (words) and ``_h`` (a 64-bit hash for each word)."""
    df = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("_b", F.btrim("_t", F.lit(_WS)))
    df = df.withColumn("_w", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", SPACE))).drop("_b")
    return df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))


def _window(i: Column, size: int) -> Column:
    """A hash of the ``size`` words from place ``i`` on."""
    return F.xxhash64(*[F.get("_h", i + k) for k in range(size)])


def _buckets(buckets: int) -> tuple[Column, Column]:
    one = F.transform("_h", lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 1, F.lit(0)))  # a pair begins at each word but the last
    two = F.transform(pairs, lambda h, i: F.pmod(_window(i, 2), F.lit(buckets)).cast("int"))
    return one, two


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all rows labelled as good (one row for each id)."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id")).distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, text: str = "text") -> list[int]:
    """Fixed-point log(p_trusted / p_corpus) for each bucket.

    Both counts are taken on the trusted scale and get PRIOR added: the trusted multinomial is smoothed towards the
    corpus's, so that a bucket with little evidence, as a few unlabelled copies of a text would make in a small corpus,
    says little.
    """
    few = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col(text).alias("text")).join(F.broadcast(trusted) if few else trusted, F.col("_d") == F.col("_id"), "left")
    one, two = _buckets(buckets)
    grams = _word_hashes(marked, "text").select(F.col("_id").isNotNull().alias("good"), F.explode(F.concat(one, two)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("good").alias("g"))
    rows = counts.collect()  # `buckets` rows at most
    n, g = sum(r["n"] for r in rows), sum(r["g"] for r in rows)
    out = [0] * buckets
    if g:
        for r in rows:
            out[r["bucket"]] = round(STEPS * log((r["g"] + PRIOR) / (r["n"] * g / n + PRIOR)))
    return out


def base_counts(df: DataFrame) -> DataFrame:
    """Adds the plain counts to a table made by ``_word_hashes``."""
    text = F.col("_t")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_WS)) != "")
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "_lines": lines,
    })
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = df.withColumn("_five", F.when(F.size("_h") >= 5, F.slice(F.transform("_h", lambda h, i: _window(i, 5)), F.lit(1), F.size("_h") - 4)).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_five")) < F.size("_five")
    # places of windows that occur twice or more: neighbours in the order of (hash, place)
    df = df.withColumn("_sorted", F.when(some, F.sort_array(F.transform("_five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
    twice = F.transform(F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
    df = df.withColumn("_at", F.sort_array(twice)).drop("_sorted", "_five")
    covered = F.aggregate(F.transform("_at", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_at", k + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_at")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _grams() -> Column:
    """The number of single words and pairs of a text with words."""
    return 2 * F.col("n_words") - 1


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """All columns of ``docs`` under ``_doc`` with the counts, ``score_steps`` (fixed point), ``base_failed`` and ``kept``."""
    ratios = log_ratios(docs, trusted, buckets, text)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    judged = base_counts(_word_hashes(row, f"_doc.{text}"))
    total = F.lit(0).cast("long")
    for part in _buckets(buckets):
        total = total + F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    judged = judged.withColumn("score_steps", total).drop("_t", "_w", "_h")
    # integers on both sides: mean >= threshold
    enough = F.col("score_steps") >= F.lit(round(threshold * STEPS)) * _grams()
    return judged.withColumn("kept", ~F.col("base_failed") & enough)


def keep_passing(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` (all columns) that are kept.

    The row id keeps the optimiser from pushing the verdict below the projections that compute it step by step, which
    would inline every step into one expression many times over.
    """
    judged = judge(docs, trusted, threshold).select("_doc", "kept", F.monotonically_increasing_id().alias("_gate"))
    return judged.where(F.col("kept") & (F.col("_gate") >= 0)).select("_doc.*")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    found = judge(docs, trusted_ids(labels), threshold)
    mean = F.when(F.col("n_words") > 0, F.col("score_steps") / (F.lit(float(STEPS)) * _grams())).otherwise(F.lit(0.0))
    return found.select(F.col("_doc.doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", mean.alias("mean_log_ratio"))
