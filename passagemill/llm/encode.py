"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.session import spread


def encode_corpus(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None
) -> DataFrame:
    """``key`` and ``ids`` of every row, by prefix dynamic programming over the bytes of each pre-token.

    Null and empty texts have an empty array. Strings of special tokens are ordinary text. Repeated rows and rows
    with a null key are kept as they are; other columns are not read. Work is one pass over the rows, without a
    shuffle where the scan is already split.
    """
    kind = docs.schema[key].dataType
    arrow = pa.schema([(key, _arrow(kind)), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from passagemill.llm.prefix_bpe import prefix_encoder

        encode = prefix_encoder(tokenizer, folder).encode
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for t in batch.column(1):
                flat.extend(encode(t.as_py()))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], schema=arrow)

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(docs.select(F.col(key), F.col(text).alias("_text")), key).mapInArrow(run, schema)


def reencode_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: str = "title", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """For each text an edit in its middle and an append, encoded from the text's own encoding.

    The column ``edit`` is put in after the middle character, with a blank, and once more at the end. Columns: key,
    n_bytes and n_ids of the edited text, encoded_bytes (what both edits encoded) and same (whether the ids are those
    of encoding the edited text from its start). Null and empty texts count as empty, a null edit changes nothing.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_ids", "encoded_bytes")], T.StructField("same", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from passagemill.llm.prefix_bpe import prefix_encoder

        encoder = prefix_encoder(tokenizer, folder)
        for batch in batches:
            rows = []
            for body, added in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                body, added = body or "", f" {added}" if added else ""
                middle = encoder.encode_edited(encoder.encode_with_places(body), body[: len(body) // 2] + added + body[len(body) // 2 :])
                last = encoder.encode_edited(middle, middle.text + added)
                rows.append((len(last.text.encode("utf-8", "replace")), len(last.ids), middle.encoded_bytes + last.encoded_bytes, last.ids == encoder.encode(last.text)))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.bool_())], names=[key, "n_bytes", "n_ids", "encoded_bytes", "same"]
            )

    return spread(docs.select(F.col(key), F.col(text).alias("_text"), F.col(edit).cast("string").alias("_edit")), key).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.string() if isinstance(kind, T.StringType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()
