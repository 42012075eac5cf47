"""Encoding of a corpus with a public byte-level BPE (see bpe.py for the transducer)."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import load

#: Folder of the public vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"


def rank_file(folder: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def ship(spark: SparkSession, path: str | None = None) -> None:
    """Send the vocabulary file to the executors, for those that don't hold it at its path."""
    spark.sparkContext.addFile(path or rank_file())


def _encoder(path: str):
    return load(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def ids_column(text: Column, path: str | None = None) -> Column:
    """array<int>: ids of the text without special tokens (their strings are ordinary text).

    Null and empty texts give an empty list. A text is encoded whole, whatever its length."""
    path = path or rank_file()

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        packed = _encoder(path).packed
        parts = [packed(x) for x in texts.to_pylist()]
        ends = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(x) // 4 for x in parts], out=ends[1:])
        values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
        if ends[-1] < 2**31 - 1:
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
        return pa.LargeListArray.from_arrays(pa.array(ends), values).cast(pa.list_(pa.int32()))

    return encode(text)


def count_column(text: Column, path: str | None = None) -> Column:
    """int: number of tokens; 0 for null and empty texts."""
    path = path or rank_file()

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        n = _encoder(path).count
        return pa.array([n(x) for x in texts.to_pylist()], type=pa.int32())

    return count(text)


def text_column(ids: Column, path: str | None = None) -> Column:
    """string: the text of a list of ids, by the incremental byte-to-text machine; '' for null and for []."""
    path = path or rank_file()

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        d = _encoder(path).decode
        return pa.array([d(x or []) for x in rows.to_pylist()], type=pa.string())

    return decode(ids)


def encode_corpus(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """docs with the column `out`; a column of that name is replaced. One pass, no shuffle."""
    ship(docs.sparkSession, path)
    return docs.withColumn(out, ids_column(F.col(text), path))


def decode_corpus(docs: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    ship(docs.sparkSession, path)
    return docs.withColumn(out, text_column(F.col(ids), path))


def count_corpus(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """docs with the number of tokens in place of the text."""
    ship(docs.sparkSession, path)
    return docs.withColumn(out, count_column(F.col(text), path)).drop(text)
