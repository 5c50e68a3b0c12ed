"""Packing into training sequences: shortest-pack-first over the length histogram.

Every text is tokenised and closed by an end id, and cut at multiples of the sequence length.  The histogram of piece
lengths (at most ``size`` entries) is all that the driver sees: lengths are placed longest first, each into the pack with
the most room that takes it, whole counts of equal packs at a time, which leaves packing patterns with counts.  Pieces
find their place by their rank among the pieces of equal length; ranks come from counts for (length, hash slice), so that
a length that a third of all pieces share is ranked by many tasks.

Null text counts as empty and still gets its end id.  Repeated rows are packed each.  An empty table gives an empty
result; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.bpe import printable_bytes, vocabulary
from pointweave.llm.text import Memo, doc_texts, slices
from pointweave.plans.lineage import cut

WORD_VOCABULARY = "word_bpe_49k.json"
SIZE = 2048
END = 1
#: Bytes that a worker's memo may hold.
MEMO = 64 << 20
_SHOWN = {b: c for c, b in printable_bytes().items()}
_MARKS = ".,!?;:"
#: Letters before this one are composed, and each has its own lower case: Latin-1 and Latin Extended-A.
_LATIN = "\u0130"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct white-space chunk being encoded once for a worker.

    The vocabulary drops white space and no token reaches over it, so chunks encode alone as they do in the text.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.memo = Memo(MEMO)  # chunks, and the words and marks in them: most words are chunks as well

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of a Latin word in lower case, which is one pre-token: the library's model alone, without its pipeline."""
        shown = word if word.isascii() else "".join([_SHOWN[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        memo.turn()
        # these four are white space to str.split but not to the vocabulary's pattern
        odd = {k for k, t in enumerate(texts) if "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t}
        chunks = [[] if k in odd else t.split() for k, t in enumerate(texts)]
        new = [c for c in set().union(*chunks).difference(memo.young) if memo.again(c) is None]
        cuts = [self._cut(c) for c in new]
        missing = []
        for p in {p for c in cuts for p in c}.difference(memo.young):
            if memo.again(p) is None:
                if p.isalpha() and p.islower() and max(p) < _LATIN:
                    ids = self._word(p)
                    memo.put(p, ids)
                else:
                    missing.append(p)
        for start in range(0, len(missing), 2000):
            part = missing[start : start + 2000]
            for p, ids in zip(part, self._encode(part), strict=True):
                memo.put(p, ids)
        for c, cut_at in zip(new, cuts, strict=True):
            if c not in memo.young:  # else it is a word or marks alone
                memo.put(c, b"".join([memo.young[p] for p in cut_at]))
        found = memo.young
        return [self._encode([t])[0] if k in odd else b"".join([found[c] for c in chunks[k]]) for k, t in enumerate(texts)]

    @staticmethod
    def _cut(chunk: str) -> tuple[str, ...]:
        """A Latin word (in lower case) and the marks after it, which are tokens apart; any other chunk as it is."""
        word = chunk.rstrip(_MARKS)
        if word.isalpha() and max(word) < _LATIN:
            return (word.lower(), chunk[len(word) :]) if len(word) < len(chunk) else (word.lower(),)
        return (chunk,)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(name: str) -> WordEncoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(vocabulary(name))
    return _ENCODERS[name]


def pieces(docs: DataFrame, name: str = WORD_VOCABULARY, size: int = SIZE, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as pieces of at most ``size`` tokens with the CRC-32 of their ids."""

    def run(batches):
        encoder = _encoder(name)
        last = array("I", [end]).tobytes()
        for b in slices(batches):
            out = []
            for i, ids in zip(b.column(0).to_pylist(), encoder.encode_batch(b.column(1).to_pylist()), strict=True):
                ids += last
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    out.append((i, start, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return doc_texts(docs, doc_id, text).mapInArrow(run, PIECE)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns ``(count, [(length, copies), ...])`` for a histogram ``length -> pieces``.

    Longest lengths first; a piece goes into the pack with the most room, and a new pack is opened only if none takes it.
    Packs with equal contents are handled as one pattern with a count.
    """
    by_room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    done: list[tuple[int, tuple[tuple[int, int], ...]]] = []

    def put(count: int, pattern: tuple[tuple[int, int], ...], room: int) -> None:
        if count:
            (by_room.setdefault(room, []) if room else done).append((count, pattern))

    def added(pattern, length, copies=1):
        if pattern and pattern[-1][0] == length:
            return (*pattern[:-1], (length, pattern[-1][1] + copies))
        return (*pattern, (length, copies))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=0)
            if room < length:
                each = size // length
                put(left // each, ((length, each),), size - each * length)
                if left % each:
                    put(1, ((length, left % each),), size - left % each * length)
                break
            count, pattern = by_room[room].pop()
            used = min(count, left)
            put(count - used, pattern, room)
            put(used, added(pattern, length), room - length)
            left -= used
    return [(c, list(p)) for c, p in [*done, *(x for packs in by_room.values() for x in packs)]]


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (a table that can be read twice)."""
    spark = cut_pieces.sparkSession
    slices_of = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sliced = cut_pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slices_of)))
    counts = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = sliced.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    # at most `size` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows, sequence, taken = [], 0, dict.fromkeys(histogram, 0)
    for count, pattern in plan(histogram, size):
        offset = 0
        for length, copies in pattern:
            rows.append((length, taken[length], copies, sequence, offset))
            taken[length] += count * copies
            offset += length * copies
        sequence += count
    slots = np.array(sorted(rows), "i8").reshape(-1, 5)
    keys = slots[:, 0] << 48 | slots[:, 1]

    def place(batches):
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            at = slots[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            k = rank - at[:, 1]
            sequence_id, offset = at[:, 3] + k // at[:, 2], at[:, 4] + k % at[:, 2] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence_id, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    chosen = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("_rank").cast("long").alias("_rank"))
    return chosen.mapInArrow(place, f"{PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, name: str = WORD_VOCABULARY, size: int = SIZE, end: int = END) -> DataFrame:
    return pack(cut(pieces(docs, name, size, end), "pieces"), size)
