"""Token counts by the whole-token shortcut.

The vocabulary's strings that encode alone as one token are proven once, before the job; a pre-token of the text that
is such a string counts one. Every other pre-token is merged by the library once and remembered.

Nulls count as empty texts (0 bytes, 0 tokens); a null id stays null; repeated rows are counted each on
their own; other columns of the input are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Memo, count_of, memo_of, of_column, proof


def count_text(text: bytes, path: str) -> int:
    return sum(next(memo_of(path, count_of).of_texts([text])))


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and whether n_tokens exceeds `limit`, one row per input row."""
    proven = proof(docs.sparkSession, tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(tokenizer, count_of, proven.value)
        for batch in batches:
            rows = [(size, sum(values)) for size, values in of_column(batch.column(1), memo)]
            sizes, n = [s for s, _ in rows], [x for _, x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
