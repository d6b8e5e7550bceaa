"""Grouped Python functions with little cost per group: rows are dealt by key and
sorted, and a task streams through its groups, holding one at a time."""

from collections.abc import Callable
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

EMIT = 2000


def row_lists(batch: pa.RecordBatch) -> list[dict]:
    """A batch's rows; lists of structs come as lists of tuples."""
    return [dict(zip(batch.schema.names, r, strict=True)) for r in zip(*map(values, batch.columns), strict=True)]


def values(column: pa.Array) -> list:
    if not (pa.types.is_list(column.type) and pa.types.is_struct(column.type.value_type)):
        return column.to_pylist()
    items = list(zip(*(f.to_pylist() for f in column.flatten().flatten()), strict=True))
    ends = pc.list_value_length(column).to_pylist()
    at = 0
    out: list = []
    for n in ends:
        out.append(None if n is None else items[at : at + n])
        at += n or 0
    return out


def per_group(df: DataFrame, keys: list[str], function: Callable[[tuple, list[dict]], list[dict]], schema: str) -> DataFrame:
    """function(key, rows) for each group of keys, with blocks as tuples; its rows have the
    schema's fields."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        rows = (r for b in batches for r in row_lists(b))
        out: list[dict] = []
        for key, group in groupby(rows, itemgetter(*keys)):
            out += function(key, list(group))
            if len(out) >= EMIT:
                yield from pa.Table.from_pylist(out, kind).to_batches()
                out = []
        if out:
            yield from pa.Table.from_pylist(out, kind).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
