"""Compare a query with its SQL, run by DuckDB over the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SIMPLE = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def differences(df, con, sql: str) -> list[str]:
    """What differs in columns, types, row count or values; empty if nothing."""
    names = sorted(df.columns)
    types = dict(df.dtypes)
    relation = con.execute(f"DESCRIBE {sql}").fetchall()
    wanted = {r[0]: r[1] for r in relation}
    if sorted(wanted) != names:
        return [f"columns {names} against {sorted(wanted)}"]
    found = [
        f"type of {n}: {types[n]} against {wanted[n]}"
        for n in names
        if SIMPLE.get(types[n]) != wanted[n] and types[n] in SIMPLE
    ]
    quoted = ", ".join(f'"{n}"' for n in names)
    theirs = sorted(con.execute(f"SELECT {quoted} FROM ({sql})").fetchall(), key=_key)
    ours = sorted((tuple(r) for r in df.select(*names).collect()), key=_key)
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows against {len(theirs)}")
    for a, b in zip(ours, theirs):
        if not all(map(_same, a, b)):
            found.append(f"{a} against {b}")
            break
    if not theirs:
        found.append("the SQL gives no rows")
    return found
