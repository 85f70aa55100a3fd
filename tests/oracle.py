"""Runs registered queries and their oracles side by side.

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


def compare(spark, con, name, fn, sql, sf):
    """Error text, or None when both sides agree on columns, rows, values and value types."""
    out = fn(spark, sf)
    got, got_cols = _rows(out.columns, [tuple(r) for r in out.collect()])
    cur = con.execute(sql)
    want, want_cols = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, columns {got_cols}\n   spark  {bad[0][0]}\n   oracle {bad[0][1]}", len(got)
    return None, len(got)


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from eventlens.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                error, rows = compare(spark, con, name, queries[name], oracles[name], sf)
            else:
                error, rows = None, len(queries[name](spark, sf).collect())
        except Exception as exc:  # report and go on
            error, rows = f"{type(exc).__name__}: {str(exc)[:900]}", -1
        tag = "FAIL" if error else ("ok  " if name in oracles else "rows")
        print(f"{tag} {name} rows={rows} {time.time() - start:.2f}s {error or ''}", flush=True)
        if error:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} pass; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
