"""Token counts by the whole-token shortcut.

``Encoder.whole`` proves which vocabulary strings are one token each, once, before the job: the driver sends the proven ones
(8 bytes each, so the vocabulary bounds them). Pre-tokens that equal one of them are counted directly, and only the rest is
merged (once for each distinct pre-token and worker).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.pretokens import Encoder, encoder
from chatloom.llm.util import documents, release, tidy, utf8

LIMIT = 2048


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def proof(path: str) -> np.ndarray:
    """Keys of the vocabulary strings that the whole library gives as one token."""
    keys = Encoder(path, True).whole()
    release()
    return keys


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated ids stay separate rows, an empty table gives no rows, and
    further columns of the input are not looked at. No shuffle: the work is dealt out as the input's files are.
    """
    if docs.schema[id_col].dataType.typeName() != "long":
        docs = docs.withColumn(id_col, F.col(id_col).cast("long"))

    proven = docs.sparkSession.sparkContext.broadcast(proof(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, True)
        e.proven = proven.value
        for batch in batches:
            data, offsets = utf8(batch, "text")
            number = e.count(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(number, pa.int64()), pa.array(number > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run, True), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
