"""Documents in shards of bounded size, which stages of one plan visit again and again.

A stage sends what it found out about its shard to hash buckets, a bucket answers, and the next
stage meets the answers in the shard. All stages read the documents through the same exchange, so
Spark shuffles the texts once (ReusedExchange) however many stages there are.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text in a shard, on average.
SHARD_BYTES = 2_000_000


ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of flat columns "name type, ..."; workers can't ask Spark for it."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def shard_of(doc_id, shards: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def sharded(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES, carry: bool = True) -> tuple[DataFrame, int]:
    """``docs`` as (shard, doc, body, row), and the number of shards.

    ``row`` is a struct with every other column, so that no name can clash with those that a stage adds.
    Rows without an id are dealt out by their place in the scan, so that many of them, alike or not, are in many shards.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    doc, body = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] if carry else []
    key = F.when(doc.isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(doc))
    row = F.struct(*rest, F.lit(None).cast("int").alias("_"))
    parts = docs.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), doc.alias("doc"), body.alias("body"), row.alias("row"))
    return parts.withColumn("row", F.col("row").cast(nullable(parts.schema["row"].dataType))), shards


def nullable(kind: StructType) -> StructType:
    """The same type with nulls allowed everywhere, as Arrow tables that come back from a worker have it."""
    text = kind.json()
    for key in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{key}":false', f'"{key}":true')
    return StructType.fromJson(json.loads(text))
