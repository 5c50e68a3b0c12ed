"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pointweave.llm import chat
from pointweave.llm.codec import round_trip
from pointweave.llm.embedding_dups import near_duplicate_vectors
from pointweave.llm.language_id import identify
from pointweave.llm.near_dups import near_duplicates
from pointweave.llm.packing import pack_documents
from pointweave.llm.quality_classifier import classify
from pointweave.llm.quality_rules import quality_rules
from pointweave.llm.repeats import dedup_repeats
from pointweave.llm.text import table
from pointweave.llm.token_counts import count_tokens

QUERIES = {
    "op1_packing": lambda spark, d: pack_documents(table(spark, d, "documents")),
    "op2_bpe": lambda spark, d: round_trip(table(spark, d, "documents")),
    "op3_quality_rules": lambda spark, d: quality_rules(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_chat": lambda spark, d: chat.format_chats(table(spark, d, "conversations")),
    "op5_minhash": lambda spark, d: near_duplicates(table(spark, d, "documents")),
    "op6_token_counts": lambda spark, d: count_tokens(table(spark, d, "documents")),
    "op7_language_id": lambda spark, d: identify(table(spark, d, "documents")),
    "op8_suffix_array": lambda spark, d: dedup_repeats(table(spark, d, "documents")),
    "op9_embedding_dups": lambda spark, d: near_duplicate_vectors(table(spark, d, "embeddings")),
    "op10_quality_classifier": lambda spark, d: classify(table(spark, d, "documents"), table(spark, d, "labels")),
}

ORACLE: dict[str, str] = {"op4_chat": chat.ORACLE}
