"""Compare a registered query with its SQL on the same Parquet tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    con.execute("SET TimeZone='UTC'")
    return con


def cell(v):
    if v is None or v is pd.NaT:
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, float):
        if math.isnan(v):
            return "~"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).tz_localize(None).isoformat() if getattr(v, "tzinfo", None) is None else \
            pd.Timestamp(v).tz_convert("UTC").tz_localize(None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Problems found; empty when columns, row count and all values agree."""
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rows_of(want_cols, rel.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(want_cols) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(want_cols)}"]
    out = []
    if len(want) != len(got):
        out.append(f"rows {len(got)} != {len(want)}")
    a, b = set(got), set(want)
    if got != want:
        out.append(f"{len(a - b)} rows only here, {len(b - a)} only in SQL, columns {sorted(want_cols)}")
        out += [f"  here {r}" for r in sorted(a - b)[:4]] + [f"  sql  {r}" for r in sorted(b - a)[:4]]
    return out


def main() -> None:
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from cutline.session import build_session

    path = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = build_session()
    if os.environ.get("SPAN"):
        spark.conf.set("spark.cutline.spanRows", os.environ["SPAN"])
    con = duck(path)
    names = sys.argv[1:] or list(entry.queries())
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = entry.queries()[n](spark, path)
            if n in entry.oracle_sql():
                problems = compare(df, con, entry.oracle_sql()[n])
                state = "ok" if not problems else "DIFF"
            else:
                problems, state = [], f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            problems, state = [str(e)[:1500]], "ERROR"
        bad += bool(problems)
        print(f"{n:32s} {state:8s} {time.time() - t:6.1f}s", flush=True)
        for p in problems:
            print("    " + p)
    print("bad:", bad)


if __name__ == "__main__":
    main()
