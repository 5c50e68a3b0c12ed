"""BPE encoding and decoding of documents.

Null text counts as empty; an empty text has no tokens.  Rows are independent: repeated rows give repeated results, an
empty table an empty result, and columns other than the two named ones are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from pointweave.llm.bpe import load, vocabulary
from pointweave.llm.text import doc_texts, slices

BYTE_VOCABULARY = "byte_bpe_50k.json"


def encode_documents(docs: DataFrame, name: str = BYTE_VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""

    def run(batches):
        import numpy as np

        bpe = load(vocabulary(name))
        for b in slices(batches):
            packed = [np.frombuffer(bpe.encode(t), "<u4").astype("i4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return doc_texts(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, name: str = BYTE_VOCABULARY) -> DataFrame:
    """``doc_id, text`` for rows of ``doc_id, ids``; null ids give an empty text."""

    def run(batches):
        import numpy as np

        bpe = load(vocabulary(name))
        for b in slices(batches):
            texts = [bpe.decode(np.asarray(i or [], "<u4").tobytes()) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, name: str = BYTE_VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the encoding and of what it decodes to, in one pass without moving ids between processes."""

    def run(batches):
        bpe = load(vocabulary(name))
        for b in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
