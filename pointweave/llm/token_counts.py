"""Token counts without ids: pieces are counted once for each distinct pre-token of the corpus.

1. Each task counts its pre-tokens; a partial aggregate and one shuffle give the corpus's distinct pre-tokens with their
   frequency, and each is encoded once, keeping only its number of pieces: the lexicon, a table in the shared folder.
2. The ``hot`` most frequent entries (a fixed number) go to the tasks as a small table; they cover most occurrences, so
   that no join key is hot.  Documents' remaining pre-tokens join the lexicon on the pre-token, and a sum over the
   document's row number adds both parts.

Null text counts as empty (0 tokens).  Rows are told apart by their place in the input, so repeated ids and repeated rows
each get their own result; null ids stay null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.bpe import chunk_counts, cut_chunk, load, vocabulary
from pointweave.llm.codec import BYTE_VOCABULARY
from pointweave.llm.text import doc_texts, slices
from pointweave.plans.lineage import cut

#: Distinct chunks, and distinct pre-tokens, that a task holds before it hands them on (some 150 bytes each).
HELD = 200_000
#: Lexicon entries that every worker gets: a dictionary of some 40 MB however large the corpus is.
HOT = 1 << 18
#: Chunks of which a worker remembers the number of pieces.
MEMO = 200_000


def lexicon(texts: DataFrame, name: str) -> DataFrame:
    """``pretoken, freq, pieces`` for every distinct pre-token."""

    def count(batches):
        bpe = load(vocabulary(name))
        chunks, held = Counter(), Counter()

        def out():
            for c, k in chunks.items():
                for p in cut_chunk(c):
                    held[p] += k
            chunks.clear()
            keys, values = list(held), list(held.values())
            held.clear()
            for start in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[start : start + 50_000], pa.string()), pa.array(values[start : start + 50_000], pa.int64())], names=["pretoken", "freq"])

        for b in slices(batches):
            for t in b.column(1).to_pylist():
                found, others, _ = chunk_counts(bpe, t)
                chunks.update(found)
                held.update(others)
            if len(chunks) > HELD or len(held) > HELD:
                yield from out()
        yield from out()

    def pieces(batches):
        bpe = load(vocabulary(name))
        for b in batches:
            n = [len(bpe.merge(p.encode())) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32())], names=["pretoken", "freq", "pieces"])

    counted = texts.mapInArrow(count, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return cut(counted.mapInArrow(pieces, "pretoken string, freq long, pieces int"), "lexicon")


def _least_frequency(known: DataFrame, hot: int) -> int:
    """The frequency from which on there are at most ``hot`` entries; found from a histogram with some 16 steps an octave."""
    step = F.floor(F.log2("freq") * 16).cast("int")
    rows = sorted(known.groupBy(step.alias("s")).agg(F.min("freq").alias("least"), F.count("*").alias("n")).collect(), key=lambda r: -r["s"])
    least, total = 1 << 62, 0
    for r in rows:  # at most 16 * 63 rows
        total += r["n"]
        if total > hot:
            break
        least = r["least"]
    return least


def count_tokens(docs: DataFrame, name: str = BYTE_VOCABULARY, limit: int = 512, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    texts = doc_texts(docs, doc_id, text)
    known = lexicon(texts, name)
    top = known.where(F.col("freq") >= _least_frequency(known, hot)).select("pretoken", "pieces").toArrow()
    shared, run = spark.sparkContext.broadcast((top.column(0).to_pylist(), top.column(1).to_pylist())), uuid.uuid4().hex

    def split(batches):
        bpe = load(vocabulary(name))
        pieces, known_chunks = _hot_table(run, shared)
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("pretoken", pa.binary()), ("tokens", pa.int64())])
        for b in slices(batches):
            rows, ids, sizes, keys, counts = [], [], [], [], []
            if len(known_chunks) > MEMO:
                known_chunks.clear()
            for row, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                chunks, others, total = chunk_counts(bpe, t)
                for c, k in chunks.items():
                    n = known_chunks.get(c)
                    if n is None:
                        cut_at = cut_chunk(c)
                        each = [pieces.get(p) for p in cut_at]
                        if None in each:  # counted pre-token by pre-token
                            for p in cut_at:
                                others[p] += k
                            continue
                        n = sum(each)
                        if len(c) < 64:
                            known_chunks[c] = n
                    total += n * k
                for p, k in others.items():
                    n = pieces.get(p)
                    if n is None:
                        rows.append(row)
                        ids.append(None)
                        sizes.append(None)
                        keys.append(p.encode())
                        counts.append(k)
                    else:
                        total += n * k
                rows.append(row)
                ids.append(i)
                sizes.append(len(t.encode()))
                keys.append(b"\xff" + row.to_bytes(8, "big"))  # no text: matches no pre-token, and spreads over tasks
                counts.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((rows, ids, sizes, keys, counts), schema, strict=True)], schema=schema)

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = numbered.mapInArrow(split, "row long, doc_id long, n_bytes long, pretoken binary, tokens long")
    joined = parts.join(known.select(F.col("pretoken").cast("binary").alias("pretoken"), "pieces"), "pretoken", "left")
    # a row that matches nothing carries what its task has already counted
    total = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("tokens") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


_TABLES: dict[str, tuple[dict[str, int], dict[str, int]]] = {}


def _hot_table(name: str, shared) -> tuple[dict[str, int], dict[str, int]]:
    """The dictionary of a broadcast, built once for each worker, and the chunks that it has settled."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = dict(zip(*shared.value, strict=True)), {}
    return _TABLES[name]
