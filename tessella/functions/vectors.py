"""Vectors of small integers: quantising, similarity, text form."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quantize(v: Column) -> Column:
    """A vector of unit length as array<tinyint>: times 127, halves to even."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.bround(x.cast("double") * 127, 0).cast("int"))).cast("tinyint"))


def normalised(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    """The integer dot product, exact in any order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two quantised vectors; -1 where sizes differ or a vector is empty."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b) / F.lit(16129.0)).otherwise(-1.0)


@F.pandas_udf(T.StringType())
def encode_base64(v: pd.Series) -> pd.Series:
    """Signed bytes as base64."""
    return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, np.int8).tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.ByteType()))
def decode_base64(v: pd.Series) -> pd.Series:
    """The signed bytes of base64."""
    return v.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), np.int8))
