"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _family(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "long", "int64"):
        return "bigint"
    if t in ("int", "integer", "int32"):
        return "int"
    if t in ("double", "float64"):
        return "double"
    if t in ("string", "varchar"):
        return "string"
    return t


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def compare(df, con, sql: str) -> list[str]:
    """Problems found; empty when names, types and all rows agree."""
    cols = sorted(df.columns)
    con.execute(f"CREATE OR REPLACE TEMP TABLE _o AS {sql}")
    described = con.execute("DESCRIBE _o").fetchall()
    theirs = {r[0]: _family(r[1]) for r in described}
    ours = {n: _family(t) for n, t in df.dtypes}
    problems = []
    if sorted(theirs) != cols:
        return [f"columns {cols} vs {sorted(theirs)}"]
    problems += [f"type of {c}: {ours[c]} vs {theirs[c]}" for c in cols if ours[c] != theirs[c]]
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = [tuple(map(_norm, r)) for r in con.execute(f"SELECT {quoted} FROM _o").fetchall()]
    got = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    if len(want) != len(got):
        problems.append(f"rows {len(got)} vs {len(want)}")
    if not got:
        problems.append("empty")
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    got.sort(key=key)
    want.sort(key=key)
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(bad)} rows differ; first {bad[:2]} cols {cols}")
    return problems
