"""Near-duplicate documents by HyperMinHash.

1. Every text's 5-word shingles become a sketch of 128 buckets.  Shingles are dealt to buckets round by round until none is
   empty (so short texts fill them too), and a bucket keeps its smallest hash as an exponent (round, or leading zeros in
   the first round) and ten mantissa bits: 16 bits.  Texts with equal shingle sets collapse to one representative.
2. Bands of four registers put representatives into buckets; two texts of similarity 0.75 miss all 32 bands with
   probability 5e-6.  A candidate pair goes on if the Jaccard estimate from the registers, corrected for chance collisions
   of compressed registers, is within six standard deviations of the threshold, and is verified on the full shingle sets.
3. First every bucket's members are paired with its smallest member only (the pivot), once for all buckets; a pivot's pairs
   are a stream of texts that follow the pivot's, so a task holds two sets.  Verified pairs give components.
4. Only buckets that still hold several components apart from their pivot are compared further, inside tasks: their members
   are dealt to blocks bounded in members and shingles, two blocks meet in one task, and only links that join components
   come out, less than there are members.  A pair is looked at in the first band that both share.  So the rows between
   steps are in proportion to the members of buckets, and no link that joins components is lost.  The work inside tasks
   is not linear: members of one bucket that lie in different components are compared with each other.

Defined results: null text, blank text and texts without words have an empty set, are linked with nothing and kept.
Equal texts are linked.  Every input row gives a row, also for repeated rows and repeated ids (all rows with the
component's smallest id count as kept); a null id is reported as null and is kept unless it belongs to a component with
an id.  An empty table gives an empty result; further columns are ignored, and ``keep_one`` returns them whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.hashing import mix, shingles
from pointweave.llm.text import doc_texts, slices
from pointweave.operators.components import connected_components
from pointweave.plans.lineage import cut, drop

BUCKETS, BITS = 128, 7
ROWS = 4
MANTISSA = 10
PERCENT = 75
#: Estimates under this are not verified: six standard deviations of the estimate at the threshold.
LEAST = 0.75 - 6 * math.sqrt(0.75 * 0.25 / BUCKETS)
#: Members and shingles (8 bytes each) of a block; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Shingles that one task compares with a pivot (expected); a pivot with more is dealt to several tasks.
CHUNK = 1_000_000
#: Ids that a broadcast may hold; more are joined by a shuffle.
BROADCAST_IDS = 400_000
_GOLDEN = 0x9E3779B97F4A7C15


def registers(h: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a non-empty set of hashes."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(BUCKETS, full)
    rest_bits = np.uint64(64 - BITS)
    mask = (np.uint64(1) << rest_bits) - np.uint64(1)
    done, n = 0, len(h)
    while done < BUCKETS and (least == full).any():
        rounds = np.arange(done, min(BUCKETS, done + max(1, 400 // n)), dtype=np.uint64)
        x = mix(h[None, :] + (rounds[:, None] + np.uint64(1)) * np.uint64(_GOLDEN)).ravel()
        # the round leads, so that an earlier one always wins
        np.minimum.at(least, (x >> rest_bits).astype(np.int64), np.repeat(rounds << rest_bits, n) | (x & mask))
        done += len(rounds)
    for b in np.flatnonzero(least == full):  # as good as never: every item for each bucket still empty
        x = mix(h + np.uint64((BUCKETS + 1 + int(b)) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
        least[b] = (np.uint64(BUCKETS - 1) << rest_bits) | (x.min() & mask)
    turn, rest = (least >> rest_bits).astype(np.int64), least & mask
    width = np.int64(64 - BITS)
    length = np.frexp(np.maximum(rest, np.uint64(1)).astype(np.float64))[1].astype(np.int64)  # bits in use
    zeros = np.minimum(width - length, 39)
    first = turn == 0
    exponent = np.where(first, zeros, np.minimum(39 + turn, 63))
    below = np.where(first, np.maximum(length - 1, 0), width)  # bits under the leading one, or all of them
    shift = np.maximum(below - MANTISSA, 0).astype(np.uint64)
    mantissa = (rest >> shift).astype(np.int64) & ((1 << MANTISSA) - 1)
    return (exponent << MANTISSA | mantissa).astype(np.uint16)


def _spread(n: np.ndarray) -> np.ndarray:
    """For each size the probabilities of a register's exponents."""
    m = np.maximum(n[:, None] / BUCKETS, 1e-9)
    at_least = 1 - np.power(1 - np.power(0.5, np.arange(0, 40))[None, :], m)  # the smallest hash has e leading zeros or more
    return at_least - np.concatenate([at_least[:, 1:], np.zeros((len(n), 1))], axis=1)


def chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The probability that registers of unrelated sets of these sizes agree."""
    return (_spread(na) * _spread(nb)).sum(1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates for rows of registers."""
    c = chance(na, nb)
    return ((a == b).mean(1) - c) / (1 - c)


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, registers`` for each row; the last two are null for empty sets."""

    def run(batches):
        for b in slices(batches):
            n, digests, regs = [], [], []
            for t in b.column(2).to_pylist():
                h = shingles(t)
                n.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                regs.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "digest", "registers"])

    return doc_texts(docs, doc_id, text).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, registers binary")


def bands(representatives: DataFrame) -> DataFrame:
    """``band, key, node``: the 64 bits of each four registers."""

    def run(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            per = BUCKETS // ROWS
            nodes = np.repeat(b.column(0).to_numpy(), per)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(per, dtype=np.int8), b.num_rows)), pa.array(keys), pa.array(nodes, pa.int64())], names=["band", "key", "node"])

    return representatives.select("node", "registers").mapInArrow(run, "band byte, key long, node long")


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, nb: shingles of b) whose sizes and estimate leave the threshold possible."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("registers").alias(f"r{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(F.lit(100) * F.least("na", "nb") >= F.lit(PERCENT) * F.greatest("na", "nb")).select("a", "b", "na", "nb", "ra", "rb")

    def run(batches):
        for b in slices(batches, 4096):
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (4, 5))
                e = estimate(ra, rb, b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3)], names=["a", "b", "nb"]).filter(pa.array(e >= LEAST))

    return rows.mapInArrow(run, "a long, b long, nb long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes (node, doc_id, text_hash; a cut table)."""
    texts = doc_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    w = (F.broadcast(wanted) if few else wanted).select("node", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    return texts.join(w, (texts.text_hash == w._h) & texts.doc_id.eqNullSafe(w._d)).select("node", "text").dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``pairs`` (a, b, nb; a cut table) whose full shingle sets reach the threshold.

    Rows are dealt by pivot and chunk and sorted, the pivot's text first, so that each text is met once for each of its pivots.
    """
    chunks = pairs.groupBy("a").agg(F.ceil(F.sum("nb") / CHUNK).cast("int").alias("chunks"))
    side = texts.select(F.col("node").alias("b"), "text")
    others = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b").join(side, "b")
    pivots = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).join(side.withColumnRenamed("b", "a"), "a")
    rows = others.select("a", "chunk", "b", "text").union(pivots.select("a", "chunk", F.lit(None).cast("long"), "text"))
    dealt = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b")  # the pivot's null comes first

    def run(batches):
        pivot = np.zeros(0, np.uint64)
        for batch in slices(batches):
            a, b = [], []
            for x, y, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = shingles(text)
                if y is None:
                    pivot = found
                    continue
                both = len(np.intersect1d(pivot, found, assume_unique=True))
                if 100 * both >= PERCENT * (len(pivot) + len(found) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def spanning_links(part: np.ndarray, n: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Verified pairs of places, one from ``left`` and one from ``right``, that join different parts; no pair is left out
    unless its parts are joined already, its estimate is too low, or an earlier band has it.
    """
    size = len(sets)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    owner = np.repeat(np.arange(size), n)
    # a set of which over a quarter occurs nowhere else reaches no other one; leaving it out can leave others alone
    able = np.ones(size, bool)
    while True:
        live = able[owner]
        common = np.bincount(code[live], minlength=code.max() + 1)[code] > 1
        still = able & (100 * np.add.reduceat(common & live, starts, dtype=np.int64) >= PERCENT * n)
        if still.sum() == able.sum():
            break
        able = still
    root = np.unique(part, return_inverse=True)[1]
    keys = np.ascontiguousarray(regs).view(np.int64).reshape(size, -1)
    spread = _spread(n.astype(float))
    own = np.zeros(code.max() + 1, bool)
    one_block = len(left) == len(right) and bool((left == right).all())
    found = []
    for place, k in enumerate(left):
        if not able[k]:
            continue
        other = right[place + 1 :] if one_block else right
        other = other[able[other] & (root[other] != root[k]) & (100 * np.minimum(n[other], n[k]) >= PERCENT * np.maximum(n[other], n[k]))]
        same = (regs[other] == regs[k]).mean(1)
        near = same >= LEAST  # the correction only lowers an estimate
        other, same = other[near], same[near]
        if not len(other):
            continue
        c = spread[other] @ spread[k] / (1 << MANTISSA)
        other = other[((same - c) / (1 - c) >= LEAST) & ((keys[other] == keys[k]).argmax(1) == band)]
        if not len(other):
            continue
        own[code[starts[k] : starts[k] + n[k]]] = True
        if len(other) < 32:
            both = np.array([own[code[starts[j] : starts[j] + n[j]]].sum() for j in other])
        else:
            both = np.add.reduceat(own[code], starts, dtype=np.int64)[other]
        own[code[starts[k] : starts[k] + n[k]]] = False
        for j in other[100 * both >= PERCENT * (n[k] + n[other] - both)]:
            if root[j] != root[k]:
                found.append((int(k), int(j)))
                root[root == root[j]] = root[k]
    return found


def _rest(members: DataFrame, nodes: DataFrame, parts: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) that join the components left in a bucket; pairs with the pivot have been tested before."""
    placed = members.where("node > pivot").join(parts, "node", "left").select("band", "key", "node", F.coalesce("component", "node").alias("part"))
    several = placed.groupBy("band", "key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("band", "key")
    mixed = cut(placed.join(several, ["band", "key"]).join(nodes.select("node", "n_shingles", "registers"), "node"), "mixed")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    rows = mixed.join(mixed.groupBy("band", "key").agg(blocks.alias("blocks")), ["band", "key"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.join(texts, "node").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"p": F.least("i", "j"), "q": F.greatest("i", "j")}).select("band", "key", "p", "q", "i", "node", "part", "n_shingles", "registers", "text")

    def run(table: pa.Table) -> pa.Table:
        node, part, n, block = (table.column(c).to_numpy() for c in ("node", "part", "n_shingles", "i"))
        p, q, band = (table.column(c)[0].as_py() for c in ("p", "q", "band"))
        found = []
        if (block == p).any() and (block == q).any():
            regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            sets = [shingles(t.as_py()) for t in table.column("text")]
            found = spanning_links(part, n, regs, sets, np.flatnonzero(block == p), np.flatnonzero(block == q), band)
        ends = [(min(node[x], node[y]), max(node[x], node[y])) for x, y in found]
        return pa.table({"a": pa.array([x for x, _ in ends], pa.int64()), "b": pa.array([y for _, y in ends], pa.int64())})

    links = cut(rows.groupBy("band", "key", "p", "q").applyInArrow(run, "a long, b long"), "links")
    drop(mixed)
    return links


def components_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches with row numbers (``row, doc_id, text_hash, n_shingles, digest``), nodes and ``(node, component)``; cut tables."""
    made = cut(sketch(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = made.where("digest is not null")
    # one node for each distinct set: its first row
    nodes = some.groupBy("digest").agg(F.min(F.struct("row", "doc_id", "text_hash", "n_shingles", "registers")).alias("r"))
    nodes = cut(nodes.select("digest", F.col("r.row").alias("node"), "r.doc_id", "r.text_hash", "r.n_shingles", "r.registers"), "nodes")
    banded = bands(nodes)
    pivots = banded.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = cut(banded.join(pivots.select("band", "key", "pivot"), ["band", "key"]), "members")
    wanted = cut(nodes.select("node", "doc_id", "text_hash").join(members.select("node").distinct(), "node", "left_semi"), "wanted")
    texts = cut(_texts(docs, wanted), "texts")
    stars = members.where("node > pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    tested = cut(_estimated(stars, nodes), "pairs")
    links = cut(_verified(tested, texts), "links")
    parts = cut(connected_components(links), "parts")
    joins = _rest(members, nodes, parts, texts)
    if not joins.isEmpty():  # what is known goes on as stars
        first = parts
        parts = cut(connected_components(first.where("node > component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(joins)), "parts")
        drop(first)
    for t in (members, wanted, texts, tested, links, joins):
        drop(t)
    return made, nodes, parts


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row."""
    made, nodes, parts = components_of(docs)
    placed = made.select("row", "doc_id", "n_shingles", "digest").join(nodes.select("digest", "node"), "digest", "left")
    placed = placed.join(parts, "node", "left").select("row", "doc_id", "n_shingles", F.coalesce("component", "node", F.col("row")).alias("part"))
    least = cut(placed.groupBy("part").agg(F.min("doc_id").alias("component_id")), "least")  # apart, so that a large component's rows may be split in the join
    out = placed.join(least, "part")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns) without all but one of each group: the one with the smallest id stays.

    Rows to drop are named by id and text hash; they are broadcast if few, else joined by a shuffle.
    """
    made, nodes, parts = components_of(docs)
    placed = made.join(nodes.select("digest", "node"), "digest", "left").join(parts, "node", "left")
    placed = placed.select("row", "doc_id", "text_hash", F.coalesce("component", "node", F.col("row")).alias("part"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "text_hash")
    chosen = placed.groupBy("part").agg(F.min(order).alias("k")).select("part", F.col("k.doc_id").alias("kd"), F.col("k.text_hash").alias("kh"))
    chosen = cut(chosen, "chosen")  # apart, so that a large component's rows may be split in the join
    groups = placed.join(chosen, "part")
    same = F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("text_hash") == F.col("kh"))
    losers = cut(groups.where(~same).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct(), "losers")
    repeated = groups.where(same).groupBy("part", "kd", "kh").agg(F.count("*").alias("n")).where("n > 1").select(F.col("kd").alias("_d"), F.col("kh").alias("_h"))
    # the row goes as one struct, so that its columns may have any name
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    keyed = keyed.withColumns({"_i": F.col("_row.doc_id").cast("long"), "_t": F.xxhash64(F.coalesce(F.col("_row.text").cast("string"), F.lit("")))})
    on = lambda k: keyed._i.eqNullSafe(k._d) & (keyed._t == k._h)
    few = losers.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    left = keyed.join(F.broadcast(losers) if few else losers, on(losers), "left_anti")
    if repeated.isEmpty():
        return left.select("_row.*")
    keyed = left
    again = left.join(repeated, on(repeated), "left_semi").dropDuplicates(["_i", "_t"])
    return left.join(repeated, on(repeated), "left_anti").union(again).select("_row.*")
