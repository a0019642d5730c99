"""Schemas of the exchanged records and the entry check for required columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    out = T.StructType()
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}
    for part in spec.split():
        name, kind = part.split(":")
        out.add(name, kinds[kind])
    return out


METRIC_RECORDS = _struct("id:s bleu:d f_measure:d precision:d recall:d edit_dist:d text_token_len:i text_len:i")
EVAL_RECORDS = _struct("id:s label:s answer:s text_token_len:i text_len:i")
RUN_RECORDS = _struct("image_id:s finish_reason:s")
ANALYSIS_POINTS = _struct(
    "image_id:s patch_density:d font_size:i line_spacing:i letter_spacing:i token_len:i text_len:i resolution:i "
    "image_W:i image_H:i character_width:d character_height:d model_W:d model_H:d edit_distance:d"
)
LAYOUT_BLOCK = T.StructType(
    [
        T.StructField("anno_id", T.IntegerType()),
        T.StructField("category_type", T.StringType()),
        T.StructField("order", T.IntegerType()),
        T.StructField("ignore", T.BooleanType()),
        T.StructField("poly", T.ArrayType(T.DoubleType())),
        T.StructField("text", T.StringType()),
    ]
)


def assert_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
