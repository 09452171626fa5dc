"""Results of Python functions as Arrow arrays, without a detour over pandas, which costs more than most of the functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_()}


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in t])
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.MapType):
        return pa.map_(arrow_type(t.keyType), arrow_type(t.valueType))
    return _PLAIN[t]


def rowwise(f, result: T.DataType):
    """f, a function of plain values, as an Arrow UDF. Structs are dicts, maps lists of pairs."""
    kind = arrow_type(result)

    def run(*columns):
        return pa.array([f(*x) for x in zip(*(c.to_pylist() for c in columns), strict=True)], kind)

    # The number of arguments is that of f: an Arrow UDF needs it spelled out.
    if f.__code__.co_argcount == 1:
        return F.arrow_udf(lambda a: run(a), result)
    if f.__code__.co_argcount == 2:
        return F.arrow_udf(lambda a, b: run(a, b), result)
    return F.arrow_udf(lambda a, b, c: run(a, b, c), result)
