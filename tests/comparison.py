"""Order-insensitive comparison of a Spark result with its SQL counterpart."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value if value is None or isinstance(value, (int, str)) else str(value)


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=_key)


def oracle_rows(sql: str, sf_dir: str):
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    cursor = connection.execute(sql)
    return normalised([c[0] for c in cursor.description], cursor.fetchall())


def spark_rows(df):
    return normalised(df.columns, [tuple(row) for row in df.collect()])
