"""Python functions of several columns that give several columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a function gets at a time.
BATCH = 128


def struct_of(function: Callable[..., pd.DataFrame], schema: str, *inputs: Column | str, batch: int = BATCH) -> Column:
    """A struct column that ``function`` makes of batches of the inputs: it gets a pandas series for each, of at most ``batch`` rows, and returns a frame of ``schema``.

    A result with another number of rows than the batch is an error.
    """
    if batch < 1:
        raise ValueError("batch size must be positive")

    @F.pandas_udf(f"struct<{schema}>")
    def run(arrived: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for series in arrived:
            series = series if isinstance(series, tuple) else (series,)
            parts = []
            for low in range(0, len(series[0]), batch):
                rows = [s.iloc[low : low + batch].reset_index(drop=True) for s in series]
                made = function(*rows)
                if len(made) != len(rows[0]):
                    raise ValueError(f"{len(made)} results of a batch of {len(rows[0])} rows")
                parts.append(made)
            yield pd.concat(parts, ignore_index=True) if parts else function(*series)

    return run(*[F.col(c) if isinstance(c, str) else c for c in inputs])


def with_structs(frame: DataFrame, function: Callable[..., pd.DataFrame], schema: str, inputs: Sequence[Column | str], batch: int = BATCH) -> DataFrame:
    """``frame`` with the fields of :func:`struct_of` as columns; the function runs once a row. A field replaces a column of its name."""
    name = "_struct"
    while name in frame.columns:
        name += "_"
    made = frame.withColumn(name, struct_of(function, schema, *inputs, batch=batch))
    fields = made.schema[name].dataType.names
    return made.select(*[F.col(f"`{c}`") for c in frame.columns if c not in fields], f"{name}.*")
