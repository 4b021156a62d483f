"""Token ids of texts, by a public tokenizer read once a worker, and training columns made of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH = "/opt/tokenizers/byte_bpe_50k.json"
_LOADED: dict = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].encode_special_tokens = True
    return _LOADED[path]


def encode(df: DataFrame, columns: list[str], path: str = PATH, max_length: int | None = None) -> DataFrame:
    """With each text column as an array of ids, cut to max_length; a null text has no ids."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.IntegerType())) if f.name in columns else f for f in df.schema.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for c in columns:
                texts = [t if isinstance(t, str) else "" for t in batch[c].tolist()]
                batch[c] = [x.ids[:max_length] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
            yield batch

    return df.mapInPandas(run, schema)


def training_columns(pairs: DataFrame, path: str = PATH, max_length: int = 256) -> DataFrame:
    """(input_ids, attention_mask, labels) of (source, target) pairs, cut to max_length and not padded."""
    ids = encode(pairs.select("source", "target"), ["source", "target"], path, max_length)
    return ids.select(F.col("source").alias("input_ids"), F.transform("source", lambda x: F.lit(1)).alias("attention_mask"), F.col("target").alias("labels"))
