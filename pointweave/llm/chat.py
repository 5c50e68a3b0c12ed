"""Chat formatting from DataFrame functions only, after collapsing cumulative snapshots.

Logs often hold a conversation several times, each time with a few more turns.  A rolling 128-bit hash over the turns
gives each conversation a fingerprint for every prefix; a conversation whose own fingerprint is a proper prefix of a
longer one is dropped by an anti-join, equal conversations collapse to the smallest id, and what is left is rendered.
Fingerprints are aggregated before any join, so a first turn that a third of all conversations share is one row there.
Texts are shuffled once, for rendering; fingerprints come from hashes of the turns.

Defined results: a row without ``conv_id`` belongs to no conversation and is left out.  Turns are ordered by
(turn, role, MD5 of the text), nulls first; fully repeated rows count once.  A null role renders as ``unknown``, null
text as empty.  A text's own markers are broken up, so that it can't open or close a turn.  An empty table gives an
empty result; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The order of turns; nulls come first.
ORDER = ("turn", "role", "digest")
OPEN, CLOSE, BROKEN = "<|", "<|end|>", "< |"


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return df.withColumn("digest", F.md5(F.col("text").cast("binary")))


def fingerprints(conversations: DataFrame) -> DataFrame:
    """``conv_id, k, n_turns, a, b``: the 128-bit fingerprint of every prefix of k turns, from digests of the turns only.

    A prefix's fingerprint is the exclusive or of its turns' hashes, each salted with the turn's place: one running window
    over a conversation's turns, so a long conversation costs what its turns do.
    """
    rows = _turns(conversations).select("conv_id", "turn", "role", "digest").distinct()
    order = Window.partitionBy("conv_id").orderBy(*ORDER)
    rows = rows.withColumns({"k": F.row_number().over(order).cast("long"), "n_turns": F.count("*").over(Window.partitionBy("conv_id"))})
    salted = {c: F.xxhash64(F.lit(salt), "k", "role", "digest") for c, salt in (("a", 1), ("b", 2))}
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns(salted).select("conv_id", "k", "n_turns", *[F.bit_xor(c).over(so_far).alias(c) for c in "ab"])


def maximal(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the conversations that are a prefix of no longer one, one for each content."""
    found = fingerprints(conversations)
    whole = found.where("k = n_turns").groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = found.where("k < n_turns").select(F.col("k").alias("n_turns"), "a", "b").distinct()
    return whole.join(inner, ["n_turns", "a", "b"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(conversations: DataFrame, kept: DataFrame) -> DataFrame:
    """Adds ``rendered`` to the kept conversations."""
    chosen = _turns(conversations).join(kept.select("conv_id"), "conv_id", "left_semi")
    ts = chosen.groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct(*ORDER, "text"))).alias("ts"))
    safe = lambda c: F.replace(c, F.lit(OPEN), F.lit(BROKEN))
    turn = lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("|>\n"), safe(t["text"]), F.lit("\n"), F.lit(CLOSE))
    return ts.select("conv_id", F.array_join(F.transform("ts", turn), "\n").alias("rendered")).join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


def format_chats(conversations: DataFrame) -> DataFrame:
    return render(conversations, maximal(conversations))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, md5(text)) AS ts FROM t GROUP BY conv_id),
w AS (SELECT ts, min(conv_id) AS conv_id, count(*) AS n_copies FROM l GROUP BY ts),
p AS (SELECT DISTINCT ts[1:k.k] AS ts FROM l, LATERAL (SELECT unnest(range(1, len(ts))) AS k) AS k)
SELECT conv_id, CAST(len(ts) AS BIGINT) AS n_turns, n_copies,
  array_to_string(list_transform(ts, lambda x: '<|' || replace(x.role, '<|', '< |') || '|>' || chr(10) || replace(x.text, '<|', '< |') || chr(10) || '<|end|>'), chr(10)) AS rendered
FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ts = w.ts)
"""
