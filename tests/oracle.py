"""Running a query and its SQL side by side."""

import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(float(value)) if isinstance(value, decimal.Decimal) else repr(value)


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(plain, row)) for row in frame.select([f"`{n}`" for n in names]).collect())


def sql_rows(sql, folder):
    base = duckdb.connect()
    for name in TABLES:
        path = Path(folder, f"{name}.parquet")
        if path.exists():
            base.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    found = base.sql(sql)
    columns = list(found.columns)
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, sorted(tuple(plain(row[k]) for k in order) for row in found.fetchall())
