"""Order-dependent logic over sorted streams.

Rows are dealt by key and sorted within their task, and a fold sees them one
after the other, so that a group costs its state and not its rows, however
many they are, and small groups cost no call of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_groups(df: DataFrame, keys: list[str], order: list, start: Callable[[], object], step: Callable[[object, tuple], Iterable[tuple]], schema: str | StructType, finish: Callable[[object], Iterable[tuple]] | None = None, rows_per_batch: int = 8192) -> DataFrame:
    """For each group of keys, in the given order, step(state, row) gives the
    rows that a row leads to, and finish(state) those of the group's end."""
    n_keys = len(keys)
    rest = [c for c in df.columns if c not in keys]
    typed = df.select(*keys, *rest)
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last: tuple | None = None
        state: object = None

        def flush() -> pa.RecordBatch:
            columns = zip(*held) if held else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = row[:n_keys]
                if key != last:
                    if finish is not None and last is not None:
                        held.extend(finish(state))
                    last, state = key, start()
                held.extend(step(state, row))
            if len(held) >= rows_per_batch:
                yield flush()
                held = []
        if finish is not None and last is not None:
            held.extend(finish(state))
        if held:
            yield flush()

    return typed.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
