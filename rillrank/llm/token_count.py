"""Token counts of whole texts (8): batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rillrank.llm.common import slices
from rillrank.llm.tokenizing import ByteBpeCounter, instance

def token_counts(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """Bytes and tokens of every whole text: ``id_col, n_bytes, n_tokens, over_limit``.

    Arrow batches are cut into slices balanced by bytes; texts are split at safe boundaries (see ``tokenizing``), and
    only lengths leave the workers.  There is no shuffle.  Null and empty texts have 0 bytes and 0 tokens, a null id
    stays null, repeated rows give repeated rows, an empty table gives an empty result; other columns are ignored.
    The tokenizer's file is read on the driver and sent with the function (its size doesn't depend on the data).
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        serialised = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = instance(ByteBpeCounter, serialised.value)
        for batch in slices(batches, "text", keep=True):
            texts = batch.column("text")
            n_bytes = pc.binary_length(texts).fill_null(0).cast(pa.int64())
            n_tokens = counter.counts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, pa.array(n_tokens, pa.int64())], names)

    names = [id_col, "n_bytes", "n_tokens"]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long"
    counted = rows.mapInArrow(count, schema)
    return counted.withColumn("over_limit", counted["n_tokens"] > limit)
