"""Compare a Spark result with the SQL check's result: names, row count, sorted values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


# Type names that hash alike in the two engines.
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
}


def differences(df, sql: str, con) -> str | None:
    """None if equal, otherwise a short description."""
    return compare(df.dtypes, [tuple(r) for r in df.collect()], sql, con)


def compare(dtypes, collected, sql: str, con) -> str | None:
    spark_names, spark_rows = rows_of([n for n, _ in dtypes], collected)
    rel = con.sql(sql)
    sql_names, sql_rows = rows_of(rel.columns, rel.fetchall())
    if spark_names != sql_names:
        return f"columns {spark_names} != {sql_names}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    odd = {n: (t, kinds[n]) for n, t in dtypes if KINDS.get(t, t) != kinds[n]}
    if odd:
        return f"types {odd}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    for mine, theirs in zip(spark_rows, sql_rows):
        if mine != theirs:
            return f"{spark_names}\n  spark {str(mine)[:900]}\n  sql   {str(theirs)[:900]}"
    return None
