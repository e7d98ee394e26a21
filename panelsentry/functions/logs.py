"""Logarithm and exponential as C, Python and SQL databases have them: by the C library, through Arrow. The JVM's differ in the last bit now and then, and a number that is
printed half way between two shows that."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_of(values: np.ndarray) -> np.ndarray:
    """The logarithms of an array of any shape."""
    return pc.ln(pa.array(np.ravel(values))).to_numpy(zero_copy_only=False).reshape(values.shape)


def _ln(x: pa.Array) -> pa.Array:
    return pc.ln(x)


def _exp(x: pa.Array) -> pa.Array:
    return pc.exp(x)


def _each(f, lists: pa.Array) -> pa.Array:
    """f over the elements of lists; null lists stay null."""
    size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), f(lists.flatten()), mask=lists.is_null())


def _ln_each(x: pa.Array) -> pa.Array:
    return _each(pc.ln, x)


def _exp_each(x: pa.Array) -> pa.Array:
    return _each(pc.exp, x)


def ln(c: Column) -> Column:
    """Null where there is none."""
    return F.when(c > 0, F.arrow_udf(_ln, "double")(c))


def exp(c: Column) -> Column:
    return F.arrow_udf(_exp, "double")(c)


def ln_each(c: Column) -> Column:
    """The logarithms of an array of positive numbers. Python functions have no place inside a transform, so arrays go as a whole."""
    return F.arrow_udf(_ln_each, "array<double>")(c)


def exp_each(c: Column) -> Column:
    return F.arrow_udf(_exp_each, "array<double>")(c)
