"""Small tables given by value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

MAX_INLINE = 2_000


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"double('{value!r}')"
    return str(value)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Rows as a literal relation: known to the optimizer, broadcast without a job."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    plain = all(isinstance(v, (str, int, float, bool, type(None))) for row in rows for v in row)
    if not rows or len(rows) > MAX_INLINE or not plain:
        return spark.createDataFrame(list(rows), schema)
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    casts = ", ".join(f"cast(c{i} as {f.dataType.simpleString()}) as `{f.name}`" for i, f in enumerate(fields))
    return spark.sql(f"select {casts} from values {body} as t({names})")
