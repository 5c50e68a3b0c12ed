"""Removal of repeated passages by sorted suffixes: every byte covered by a 100-byte string that also starts earlier.

A 100-byte string is looked up by its *anchor*: the place, among its 69 32-byte substrings, of the one with the least
hash.  The anchor depends on the string alone, so equal strings have equal anchors, and neighbouring strings mostly share
one: about one place in 35 is an anchor.

1. Among the texts that a task has at hand (512), anchors whose whole surroundings (all strings that use them) are equal, by
   two 64-bit hashes, are combined before any exchange: all but the first are settled.  So a passage that a third of all
   documents share leaves each task as a few rows.  What is left is dealt by the anchor's hash; an anchor that occurs once is
   dropped, which needs only the row before.
2. The surroundings of all other anchors are fetched from the texts; each task sorts the suffixes that start at its anchors
   and sends them as front-coded runs; runs are merged with a loser tree over known common prefixes.  The common-prefix
   lengths of the sorted suffixes, and of the sorted reversed left sides, tell which strings are equal, and so which are not
   the first.  One task holds the records of an anchor that are left (some 600 bytes each).
3. Flagged strings become byte spans for each document.

Order is by (doc_id, place in the text); nulls come first.  Defined results: null text counts as empty.  Of rows that
repeat both id and text one is the first and the others are copies of it; different texts under one id are ordered by
their hashes.  Strings never reach over a document's end; spans count bytes of UTF-8 and may cut a character.  An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.hashing import prefix_sums, spans
from pointweave.llm.suffixes import front_code, merge
from pointweave.llm.text import doc_texts, partitions, slices
from pointweave.plans.lineage import cut, drop

LENGTH, K = 100, 32
PLACES = LENGTH - K + 1
#: String starts for which anchors are found at once.
STRETCH = 1 << 22
_PLACE_BITS = 24
#: Records in a run, and records after which a merged stream is cut at the next change of anchor.
RUN, PART = 50_000, 20_000
#: Rows that a broadcast may hold; more are joined by a shuffle.
BROADCAST_ROWS = 300_000
KEY = ["doc_id", "version"]


def anchors(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(place, first start, last start, hash, hash of the surroundings)`` of a text's anchors."""
    n = len(raw)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = prefix_sums(raw)
    places, firsts = [], []
    low = np.uint64((1 << _PLACE_BITS) - 1)
    for begin in range(0, n - LENGTH + 1, STRETCH):
        count = min(STRETCH, n - LENGTH + 1 - begin)
        at = np.arange(begin, begin + count + PLACES - 1)
        h = (spans(sums, at, at + K) & ~low) | (at - begin).astype(np.uint64)  # equal hashes: the leftmost
        for step in (1, 2, 4, 8, 16, 32):
            h = np.minimum(h[:-step], h[step:])
        least = np.minimum(h[:count], h[PLACES - 64 : PLACES - 64 + count])
        place = (least & low).astype(np.int64) + begin
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        places.append(place[new])
        firsts.append(new + begin)
    place, first = np.concatenate(places), np.concatenate(firsts)
    last = np.concatenate([first[1:] - 1, [n - LENGTH]])
    return place, first, last, spans(sums, place, place + K), spans(sums, first, last + LENGTH)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Texts with a ``version`` (0, unless an id has several texts), and rows for each (id, version)."""
    texts = doc_texts(docs, doc_id, text).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    rows = cut(texts.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("copies")), "rows")
    several = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_i"))
    if several.isEmpty():
        return texts.withColumn("version", F.lit(0)), rows.withColumn("version", F.lit(0))
    w = Window.partitionBy("doc_id").orderBy("h1", "h2")
    ranked = rows.join(several, rows.doc_id.eqNullSafe(several._i), "left_semi").withColumn("version", F.row_number().over(w) - 1)
    ranked = cut(ranked.select(F.col("doc_id").alias("_d"), F.col("h1").alias("_a"), F.col("h2").alias("_b"), "version"), "versions")

    def versioned(df):
        return df.join(ranked, df.doc_id.eqNullSafe(ranked._d) & (df.h1 == ranked._a) & (df.h2 == ranked._b), "left").withColumn("version", F.coalesce("version", F.lit(0))).drop("_d", "_a", "_b")

    return versioned(texts), versioned(rows)


def _once(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts with every (id, version) once; only rows that repeat are shuffled."""
    repeated = rows.where("copies > 1").select(F.col("doc_id").alias("_i"), F.col("version").alias("_w"))
    if repeated.isEmpty():
        return texts
    on = texts.doc_id.eqNullSafe(repeated._i) & (texts.version == repeated._w)
    return texts.join(repeated, on, "left_anti").union(texts.join(repeated, on, "left_semi").dropDuplicates(KEY))


ANCHOR = "hash long, around long, shape int, doc_id long, version int, place int, again boolean"


def _repeats_here(h: np.ndarray, around: np.ndarray, shape: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Flags rows whose anchor and surroundings come earlier (by ``order``) among the rows at hand."""
    by_hash = np.argsort(h, kind="stable")
    equal = h[by_hash][1:] == h[by_hash][:-1]
    some = by_hash[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])] if len(h) else by_hash
    some = some[np.lexsort((order[some], shape[some], around[some], h[some]))]
    out = np.zeros(len(h), bool)
    if len(some):
        out[some[1:]] = (h[some[1:]] == h[some[:-1]]) & (around[some[1:]] == around[some[:-1]]) & (shape[some[1:]] == shape[some[:-1]])
    return out


def _anchor_table(texts: DataFrame) -> DataFrame:
    """Anchors of all texts; shape: 256 * (place - first start) + (last - first start).

    ``again``: the same surroundings come earlier among the texts at hand, so the row is settled before any exchange.  A
    passage in a third of all texts leaves each task as a few rows that are not.
    """

    def run(batches):
        for b in slices(batches, 512):
            counts, columns = [], []
            for t in b.column(2).to_pylist():
                place, first, last, h, around = anchors(np.frombuffer(t.encode(), np.uint8))
                counts.append(len(place))
                columns.append((h.view(np.int64), around.view(np.int64), ((place - first) * 256 + last - first).astype(np.int32), place.astype(np.int32)))
            if sum(counts):
                h, around, shape, place = (np.concatenate(c) for c in zip(*columns, strict=True))
                rows = np.repeat(np.arange(b.num_rows), counts)
                doc = b.column(0)
                rank = np.empty(b.num_rows, np.int64)
                rank[np.lexsort((b.column(1).to_numpy(), doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False)))] = np.arange(b.num_rows)
                again = _repeats_here(h, around, shape, rank[rows] << 32 | place)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(around), pa.array(shape), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(place), pa.array(again)], names=["hash", "around", "shape", "doc_id", "version", "place", "again"])

    return texts.select("doc_id", "version", "text").mapInArrow(run, ANCHOR)


def _settle(table: DataFrame, equal_by_hash: bool = False) -> DataFrame:
    """Anchors that recur: ``open`` is True where texts must be compared, False where the same surroundings came earlier.

    Rows that are settled already only pass through, in any task.
    """
    deal = F.when(F.col("again"), F.xxhash64("doc_id", "place")).otherwise(F.col("hash"))
    dealt = table.withColumn("deal", deal).repartition("deal").drop("deal").sortWithinPartitions("again", "hash", "around", "shape", "doc_id", "version", "place")

    def run(batches):
        held: pa.RecordBatch | None = None  # the last first-of-its-kind row, whose fate the next row decides
        held_open = False
        before: tuple | None = None
        for b in batches:
            known = np.flatnonzero(b.column(6).to_numpy(zero_copy_only=False))
            if len(known):
                yield _with_open(b.take(pa.array(known)), np.zeros(len(known), bool))
                b = b.slice(0, b.num_rows - len(known))  # they come last
            if not b.num_rows:
                continue
            h, around, shape = (b.column(k).to_numpy() for k in range(3))
            ph, pr, ps = (np.concatenate([[before[k] if before else x[0]], x[:-1]]) for k, x in enumerate((h, around, shape)))
            same_hash = h == ph
            same = same_hash & (around == pr) & (shape == ps) & equal_by_hash
            if before is None:
                same_hash[0] = same[0] = False
            before = (h[-1], around[-1], shape[-1])
            heads = np.flatnonzero(~same)
            # a head is open if the head before or after it has its hash
            joined = same_hash[heads]  # shares its hash with the head before
            if len(heads):
                opened = joined.copy()
                opened[:-1] |= joined[1:]
                if held is not None:
                    if joined[0]:
                        held_open = True
                    if held_open:
                        yield _with_open(held, np.array([True]))
                keep = np.ones(len(heads), bool)
                keep[-1] = False
                kept = heads[keep][opened[keep]]
                if len(kept):
                    yield _with_open(b.take(pa.array(kept)), np.ones(len(kept), bool))
                held, held_open = b.slice(int(heads[-1]), 1), bool(joined[-1])
            rest = np.flatnonzero(same)
            if len(rest):
                yield _with_open(b.take(pa.array(rest)), np.zeros(len(rest), bool))
        if held is not None and held_open:
            yield _with_open(held, np.array([True]))

    return dealt.mapInArrow(run, "hash long, shape int, doc_id long, version int, place int, open boolean")


def _with_open(b: pa.RecordBatch, flag: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), b.column(5), pa.array(flag)], names=["hash", "shape", "doc_id", "version", "place", "open"])


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def _runs(texts: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """Front-coded runs of the suffixes at open anchors: ``part, run``."""
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("hash", "shape", "place")).alias("a"))
    ids = cut(wanted.select(*KEY).distinct(), "ids")
    k = ids.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"))
    chosen = texts.join(F.broadcast(k) if _small(ids) else k, texts.doc_id.eqNullSafe(k._d) & (texts.version == k._v), "left_semi")
    a = lists.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), "a")
    rows = chosen.join(a, chosen.doc_id.eqNullSafe(a._d) & (chosen.version == a._v)).select("doc_id", "version", "text", F.col("a.hash").alias("hash"), F.col("a.shape").alias("shape"), F.col("a.place").alias("place"))

    def run(batches):
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        count = 0

        def out():
            parts_of = sorted(held)
            coded = [front_code(sorted(held[p])) for p in parts_of]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(parts_of, pa.int32()), pa.array(coded, pa.binary())], names=["part", "run"])

        for b in slices(batches, 64):
            for doc, version, text, hs, shapes, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode()
                for h, shape, place in zip(hs, shapes, places, strict=True):
                    back, span = divmod(shape, 256)
                    suffix, left = raw[place : place - back + span + LENGTH], raw[place - back : place][::-1]
                    who = np.array([doc is not None, doc or 0, version, place, shape], "<i8").tobytes()
                    held.setdefault(h % parts, []).append((suffix, who + left))
                count += len(hs)
            if count > RUN:
                count = 0
                yield out()
        if held:
            yield out()

    return rows.mapInArrow(run, "part int, run binary")


def later_strings(entries: list[tuple[int, bytes, bytes]]) -> list[tuple]:
    """``(has id, id, version, first start, last start)`` of the strings that are not the first of their kind.

    ``entries`` are merged records in suffix order, all records of any anchor among them.
    """
    n = len(entries)
    who = np.frombuffer(b"".join(e[2][:40] for e in entries), "<i8").reshape(n, 5)
    shared = np.array([e[0] for e in entries])
    shared[0] = 0
    back, span = np.divmod(who[:, 4], 256)
    left = [e[2][40:] for e in entries]
    order = np.array(sorted(range(n), key=left.__getitem__))
    wide = np.full((n, PLACES), -1, np.int16)  # reversed left sides; -1 after the end
    for r, k in enumerate(order):
        wide[r, : len(left[k])] = np.frombuffer(left[k], np.uint8)
    differs = np.zeros((n, PLACES + 1), bool)
    differs[1:, :PLACES] = wide[1:] != wide[:-1]
    differs[:, PLACES] = True
    left_shared = differs.argmax(1)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((who[:, 3], who[:, 2], who[:, 1], who[:, 0]))] = np.arange(n)
    later = np.zeros((n, PLACES), bool)
    for o in range(PLACES):  # strings that begin o bytes before their anchor
        valid = np.flatnonzero((o <= back) & (o >= back - span))
        if len(valid) < 2:
            continue
        right_class = np.cumsum(shared < LENGTH - o)
        left_class = np.empty(n, np.int64)
        left_class[order] = np.cumsum(left_shared < o)
        key = right_class[valid] * (n + 1) + left_class[valid]
        by = np.lexsort((rank[valid], key))
        k = key[by]
        later[valid[by[1:][k[1:] == k[:-1]]], o] = True
    found = []
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), later.astype(np.int8), np.zeros((n, 1), np.int8)], axis=1), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True):
        has, doc, version, place, _ = who[r].tolist()
        found.append((has, doc, version, place - e + 1, place - b))
    return found


def _merged(runs: DataFrame, parts: int) -> DataFrame:
    """Merges each part's runs and gives the starts of strings that are not the first: ``doc_id, version, lo, hi``."""

    def emit(entries):
        got = later_strings(entries)
        if got:
            has, doc, version, lo, hi = zip(*got, strict=True)
            ids = pa.array([d if x else None for x, d in zip(has, doc, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in ((version, pa.int32()), (lo, pa.int64()), (hi, pa.int64())))], names=["doc_id", "version", "lo", "hi"])

    def run(batches):
        by_part: dict[int, list[bytes]] = {}
        for b in batches:
            for p, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_part.setdefault(p, []).append(r)
        for p in sorted(by_part):
            held = []
            for e in merge(by_part[p]):
                if e[0] < K and len(held) >= PART:  # another anchor begins
                    yield from emit(held)
                    held = []
                held.append(e)
            if held:
                yield from emit(held)

    return runs.repartition(parts, "part").mapInArrow(run, "doc_id long, version int, lo long, hi long")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", equal_by_hash: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed texts, their rows, and for each (id, version) with removals ``spans array<struct<b, e>>`` (bytes, end excluded).

    With ``equal_by_hash`` an anchor whose surroundings are equal, by their hash, to earlier ones anywhere in the corpus is
    settled without the sort.
    """
    texts, rows = _keyed(docs, doc_id, text)
    parts = partitions(docs.sparkSession)
    once = _once(texts, rows)
    found = cut(_settle(_anchor_table(once), equal_by_hash), "anchors")
    settled = found.where("not open").select(*KEY, (F.col("place") - F.floor(F.col("shape") / 256)).cast("long").alias("lo"), F.col("shape").alias("s"))
    settled = settled.select(*KEY, "lo", (F.col("lo") + F.col("s") % 256).alias("hi"))
    others = cut(_merged(_runs(once, found.where("open"), parts), parts), "strings")
    whole = settled.union(others).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("s"))

    def run(batches):
        for b in slices(batches, 2048):
            out = []
            for s in b.column(2).to_pylist():
                merged: list[list[int]] = []
                for x in s:
                    if merged and x["lo"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["hi"] + LENGTH)
                    else:
                        merged.append([x["lo"], x["hi"] + LENGTH])
                out.append([{"b": p, "e": q} for p, q in merged])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())])))], names=["doc_id", "version", "spans"])

    spans_of = cut(whole.mapInArrow(run, "doc_id long, version int, spans array<struct<b:bigint,e:bigint>>"), "spans")
    drop(found)
    drop(others)
    return texts, rows, spans_of


def _with_spans(texts: DataFrame, spans_of: DataFrame) -> DataFrame:
    s = spans_of.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), "spans")
    total = spans_of.agg(F.sum(F.size("spans") + 1).alias("n")).first()["n"] or 0
    return texts.join(F.broadcast(s) if total <= BROADCAST_ROWS else s, texts.doc_id.eqNullSafe(s._d) & (texts.version == s._v), "left").drop("_d", "_v")


def kept_bytes(text: str, removed: list[dict] | None) -> tuple[bytes, bytes]:
    raw = text.encode()
    if not removed:
        return raw, raw
    out, at = [], 0
    for x in removed:
        out.append(raw[at : x["b"]])
        at = x["e"]
    return raw, b"".join([*out, raw[at:]])


def dedup_repeats(docs: DataFrame, equal_by_hash: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row."""
    texts, rows, spans_of = repeated_spans(docs, equal_by_hash=equal_by_hash)
    one = _with_spans(_once(texts, rows), spans_of)
    repeated = rows.where("copies > 1").select(F.col("doc_id").alias("_i"), F.col("version").alias("_w"), "copies")
    if repeated.isEmpty():
        one = one.withColumn("copies", F.lit(1).cast("long"))
    else:  # one of the rows that repeat speaks for all
        one = one.join(repeated, one.doc_id.eqNullSafe(repeated._i) & (one.version == repeated._w), "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))

    def run(batches):
        empty = hashlib.sha256(b"").hexdigest()
        for b in slices(batches):
            out = []
            for doc, text, removed, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw, kept = kept_bytes(text, removed)
                out.append((doc, len(raw), len(raw) - len(kept), len(removed or []), hashlib.sha256(kept).hexdigest()))
                copy = (doc, len(raw), len(raw), 1, empty) if len(raw) >= LENGTH else out[-1]
                out += [copy] * (copies - 1)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return one.select("doc_id", "text", "spans", "copies").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns, whatever their names) with repeated passages cut out of ``text`` and ``n_chars`` set anew where there is one.

    A character of which only some bytes are removed goes as a whole; rows of which nothing is left are dropped, as are
    further rows with the same id and text (of 100 bytes or more).
    """
    texts, rows, spans_of = repeated_spans(docs)
    # the row goes as one struct, so that its columns may have any name
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    hashed = hashed.withColumns({"_i": F.col("_doc.doc_id").cast("long"), "_x": F.xxhash64(F.coalesce(F.col("_doc.text").cast("string"), F.lit("")))})
    total = spans_of.agg(F.sum(F.size("spans") + 1).alias("n")).first()["n"] or 0
    named = rows.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), F.col("h1").alias("_h"), "copies")
    removed = spans_of.withColumnsRenamed({"doc_id": "_sd", "version": "_sv"})
    marked = named.join(removed, named._d.eqNullSafe(removed._sd) & (named._v == removed._sv), "left").where("spans is not null or copies > 1").select("_d", "_h", "spans", "copies")
    joined = hashed.join(F.broadcast(marked) if total <= BROADCAST_ROWS else marked, hashed._i.eqNullSafe(marked._d) & (hashed._x == marked._h), "left")
    several = joined.where(F.coalesce("copies", F.lit(1)) > 1)
    if not several.isEmpty():
        long = F.octet_length(F.col("_doc.text").cast("string")) >= LENGTH
        joined = joined.where(F.coalesce("copies", F.lit(1)) == 1).union(several.where(long).dropDuplicates(["_i", "_x"])).union(several.where(~long | F.col("_doc.text").isNull()))
    at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in slices(batches):
            row = b.column(0)
            out = [row.field(k) for k in range(row.type.num_fields)]
            spans = b.column(1).to_pylist()
            texts_out, keep = [], []
            for t, s in zip(out[at].to_pylist(), spans, strict=True):
                if s:
                    t = kept_bytes(t, s)[1].decode("utf-8", "ignore")
                texts_out.append(t)
                keep.append(not s or bool(t))
            out[at] = pa.array(texts_out, out[at].type)
            if n_at is not None:
                sizes = pa.array([len(t) if s else None for t, s in zip(texts_out, spans, strict=True)], out[n_at].type)
                out[n_at] = pc.if_else(pa.array([bool(s) for s in spans], pa.bool_()), sizes, out[n_at])
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(out, fields=list(row.type))], names=["_doc"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("_doc", "spans").mapInArrow(run, hashed.select("_doc").schema).select("_doc.*")
