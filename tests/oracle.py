"""Side-by-side comparison of registered queries with their SQL."""

from __future__ import annotations

import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(arrow):
    names = sorted(arrow.column_names)
    cols = [arrow.column(n).to_pylist() for n in names]
    return names, sorted((tuple(_plain(v) for v in r) for r in zip(*cols)), key=repr)


def kinds(schema):
    out = {}
    for f in schema:
        t = str(f.type).replace("large_", "").replace("string_view", "string")
        out[f.name] = t
    return out


def compare(query, sql: str, spark, con, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    got = query(spark, sf_dir).toArrow()
    t1 = time.time()
    want = con.execute(sql).to_arrow_table()
    t2 = time.time()
    note = f"{got.num_rows} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    gn, g = _rows(got)
    wn, w = _rows(want)
    if gn != wn:
        return False, f"columns {gn} != {wn}"
    if g != w:
        bad = [(a, b) for a, b in zip(g, w) if a != b][:3]
        return False, f"{note}; {len(g)} vs {len(w)} rows; first differences {bad}"
    gk, wk = kinds(got.schema), kinds(want.schema)
    diff = {c: (gk[c], wk[c]) for c in gk if gk[c] != wk[c]}
    if got.num_rows == 0:
        return False, "empty result"
    return True, note + (f"; types differ {diff}" if diff else "")


def main(argv):
    """``python tests/oracle.py SF_DIR [query or check module ...]``"""
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import tessella.checks as checks

    queries, oracle = checks.load()
    asked = {a.lstrip("@") for a in argv[1:]}
    names = [n for n, q in queries.items() if not asked or n in asked or q.__module__.rsplit(".", 1)[1] in asked]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(argv[0])
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            if n in oracle:
                ok, note = compare(queries[n], oracle[n], spark, con, argv[0])
            else:
                rows = queries[n](spark, argv[0]).toArrow().num_rows
                ok, note = rows >= 0, f"rows only: {rows}, {time.time() - t0:.1f}s"
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", n, note, flush=True)
    print("failed:", bad, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])
