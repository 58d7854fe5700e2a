"""Queries on tokens: encoding (1), packing (9) and token files (12)."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .bpe import bpe_decode, bpe_encode, vocabulary
from .common import table, whole_text
from .packing import pack_documents
from .registry import query
from .token_file import read_tokens, write_tokens


@query("op1_bpe_encode_decode")
def op1(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and the text they decode to, as digests."""
    vocab = vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    ids = bpe_encode(docs, vocab, keep_text=False)
    both = bpe_decode(ids, vocab)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op9_packing")
def op9(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op12_token_files")
def op12(spark, sf_dir: str) -> DataFrame:
    """Start, length and digest of every document's ids, from the token files."""
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_tokens(spark, path, ids=False)
