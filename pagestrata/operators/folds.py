"""Folds over sorted partitions: the rows of a key, in order, through a small state object."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagestrata.session import cut_lineage

BIG_PAGE = 5_000
OUT_ROWS = 4_096


def values_of(column: pa.Array) -> list:
    """``to_pylist`` by whole columns: numbers are copied at once, lists of structs cost one object each instead of one per field."""
    if not len(column):
        return []
    if pa.types.is_list(column.type):
        at = column.offsets.to_pylist()
        inner = values_of(column.values.slice(at[0], at[-1] - at[0]))
        made = [inner[a - at[0]:b - at[0]] for a, b in zip(at, at[1:])]
    elif pa.types.is_struct(column.type):
        names = [f.name for f in column.type]
        made = [dict(zip(names, row)) for row in zip(*map(values_of, column.flatten()))] if names else [{} for _ in column]
    elif pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        made = (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    return [m if there else None for m, there in zip(made, column.is_valid().to_pylist())] if column.null_count else made


def fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], make: Callable[[], object], schema: StructType
) -> DataFrame:
    """Feed each key's rows in order to ``make()``'s ``add``; emit the rows of ``result``."""
    arrow_schema = to_arrow_schema(schema)
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []
        for batch in batches:
            names = batch.schema.names
            for values in zip(*map(values_of, batch.columns)):
                row = dict(zip(names, values))
                key = tuple(row[k] for k in keys)
                if key != current:
                    if state is not None:
                        out.extend(state.result())
                    current, state = key, make()
                state.add(row)
                if len(out) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)
                    out = []
        if state is not None:
            out.extend(state.result())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def split_by_size(df: DataFrame, keys: Sequence[str], limit: int, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of keys above the limit if there are any. ``counted`` has as many rows of a key and costs less."""
    big = (df if counted is None else counted).groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    if big.isEmpty():
        return df, None
    big = cut_lineage(big)
    return df.join(big, list(keys), "left_anti"), df.join(big, list(keys), "left_semi")
