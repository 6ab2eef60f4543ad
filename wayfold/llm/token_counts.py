"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, utf8_list
from .encoder import kept


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every row of docs.

    tokenizer is a .json file of the tokenizers library or a sentencepiece .model; no begin, end or added special tokens, no
    truncation or padding. Texts are encoded in Arrow batches of about `batch_bytes`; only lengths leave them. Long texts are
    cut at white space between chunks, where the tokenizer never joins anything. Null text counts as empty (0, 0); a null or
    repeated id keeps its row; other columns, whatever their names, are not read; an empty table gives an empty result.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            count = lambda x: len(model.encode(x.decode(), num_threads=1))
        else:
            count = kept(tokenizer).count
        for batch in by_bytes(batches, "text", batch_bytes):
            texts = utf8_list(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, texts), pa.int64()), pa.array(map(count, texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(counts, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
