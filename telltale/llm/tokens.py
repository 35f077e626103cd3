"""Byte-level BPE over tables: encode and decode whole texts.

Defined cases. A null text is encoded as an empty one: no ids. Texts of any length are encoded whole, row by row; columns
beside id and text are not read. Rows are encoded one by one, repeated rows alike; an
empty table gives an empty result. A string that looks like a special token is ordinary text. Ids unknown to the
vocabulary fail the job on decoding, as they can't come from it; a null list of ids is decoded to an empty text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from telltale.llm.bpe import Utf8Decoder, piece_encoder
from telltale.llm.common import per_batch
from telltale.sources.tables import table

ENCODE_RANKS = "byte_bpe_multi_50k.tiktoken"


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``ids``, the tokens of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        encoder = piece_encoder(ranks_path, pattern)

        def step(batch: pa.RecordBatch) -> dict:
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            return {id_col: batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}

        return step

    return per_batch(docs.select(id_col, text_col), f"`{id_col}` {kind}, ids array<int>", start, most_bytes=4 << 20)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and ``text`` of every list of ids."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def start():
        decoder = Utf8Decoder(piece_encoder(ranks_path, pattern).machine.token_of)

        def step(batch: pa.RecordBatch) -> dict:
            texts = [decoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            return {id_col: batch.column(0), "text": pa.array(texts, pa.string())}

        return step

    return per_batch(encoded.select(id_col, ids_col), f"`{id_col}` {kind}, text string", start, most_bytes=4 << 20)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: how many tokens, digests of the ids (little-endian, 32 bits each) and of the decoded bytes.

    Encoding and decoding follow each other in one pass over the rows, so no ids are shuffled or written.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start():
        encoder = piece_encoder(ranks_path, pattern)
        decoder = Utf8Decoder(encoder.machine.token_of)

        def step(batch: pa.RecordBatch) -> dict:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                packed = encoder.encode_packed(text or "")
                counts.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_text.append(hashlib.sha256(decoder.decode_packed(np.frombuffer(packed, "<u4"))).hexdigest())
            return {
                "doc_id": batch.column(0),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(of_ids, pa.string()),
                "decoded_sha256": pa.array(of_text, pa.string()),
            }

        return step

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_batch(docs.select("doc_id", "text"), schema, start, most_bytes=4 << 20)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(ENCODE_RANKS)
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
