"""Arrow functions declared at import time, before any session exists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column


def arrow(ddl: str) -> Callable:
    """Decorator: ``rows -> rows`` over Python lists (one list for each argument) as a vectorised column function.

    The function gets whole Arrow batches as lists and returns a list, or an Arrow array, of the same length.
    """

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            if len(columns) == 1:

                def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                    for batch in batches:
                        yield _array(f(batch.to_pylist()), kind)

            else:

                def each(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                    for batch in batches:
                        yield _array(f(*(a.to_pylist() for a in batch)), kind)

            from pyspark.sql.pandas.types import to_arrow_type
            from pyspark.sql.types import _parse_datatype_string

            spark_type = _parse_datatype_string(ddl)
            kind = to_arrow_type(spark_type)
            each.__annotations__ = {"batches": Iterator[pa.Array] if len(columns) == 1 else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
            return F.arrow_udf(each, spark_type)(*columns)

        call.python = f
        return call

    return wrap


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)
