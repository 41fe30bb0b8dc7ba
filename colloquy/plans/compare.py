"""Developer check: run registered Spark queries and their DuckDB oracle SQL
side by side and compare row count, column names and order-insensitive values.

    python -m colloquy.plans.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(v)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return cols, out


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
                 "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT",
                 "float": "FLOAT"}


def type_mismatches(sdf, rel) -> list:
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    return [(c, s_types[c], d_types.get(c)) for c in s_types if d_types.get(c) != s_types[c]]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def run(sf_dir: str, names=None, spark=None):
    from colloquy.plans import load_all
    from colloquy.session import get_session
    reg = load_all()
    spark = spark or get_session("local[8]", 8)
    con = duck(sf_dir)
    results = {}
    for name, (fn, sql) in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            s_rows = [tuple(r) for r in sdf.collect()]
            s_cols = sdf.columns
            t1 = time.time()
            if sql is None:
                results[name] = ("rows-only", len(s_rows), round(t1 - t0, 2))
                print(name, *results[name], flush=True)
                continue
            rel = con.sql(sql)
            d_cols = list(rel.columns)
            d_rows = rel.fetchall()
            t2 = time.time()
            sc, sr = canon(s_cols, s_rows)
            dc, dr = canon(d_cols, d_rows)
            if sc != dc:
                status = f"COLS {sc} vs {dc}"
            elif len(sr) != len(dr):
                status = f"ROWS {len(sr)} vs {len(dr)}"
            elif sr != dr:
                bad = next(i for i in range(len(sr)) if sr[i] != dr[i])
                status = f"VALUES first diff spark={sr[bad]} duck={dr[bad]}"
            else:
                tm = type_mismatches(sdf, rel)
                status = "OK" if not tm else f"OK-TYPES {tm}"
            results[name] = (status, len(sr), round(t1 - t0, 2), round(t2 - t1, 2))
        except Exception as e:  # report and continue
            results[name] = ("ERROR " + str(e).split("\n")[0][:300],)
        print(name, *results[name], flush=True)
    return results


if __name__ == "__main__":
    run(sys.argv[1], sys.argv[2:] or None)
