"""Compare registered queries with their check SQL: ``python tests/oracle_check.py SF_DIR [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type -> acceptable DuckDB types.
KINDS = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"},
}


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_norm(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, job, sql: str) -> str | None:
    """None where equal, else what differs."""
    df = job(spark, sf_dir)
    spark_rows = df.collect()
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    types = {column[0]: str(column[1]).upper() for column in result.description}
    duck_rows = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    for field in df.schema.fields:
        wanted = KINDS.get(field.dataType.simpleString())
        if wanted and types[field.name] not in wanted:
            return f"type of {field.name}: {field.dataType.simpleString()} != {types[field.name]}"
    left, right = rows_of(df.columns, spark_rows), rows_of(names, duck_rows)
    if left != right:
        extra, missing = list((left - right).items())[:3], list((right - left).items())[:3]
        return f"{sum(left.values())} rows != {sum(right.values())}; only Spark {extra}; only SQL {missing}"
    return None


def main() -> int:
    from larder.plans import catalog
    from larder.session import local_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark, connection, bad = local_session(8), duck(sf_dir), 0
    for name, job in catalog.QUERIES.items():
        if only and name not in only:
            continue
        started = time.time()
        if name in catalog.ORACLES:
            problem = compare(spark, connection, sf_dir, job, catalog.ORACLES[name])
            count = len(connection.execute(catalog.ORACLES[name]).fetchall())
        else:
            problem, count = None, job(spark, sf_dir).count()
        bad += problem is not None
        print(f"{name:34s} {time.time() - started:6.1f}s {count:8d} {problem or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
