"""Local stand-in for the driver's correctness gate: run each registered Spark query and its
DuckDB oracle on the same parquet tables, compare row count, column names and an
order-insensitive hash of the values (columns sorted by name).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""
import hashlib
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import __spark_entry__ as E  # noqa: E402
from tabforge.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not a.startswith("/")]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    spark = local_session()
    qs, orc = E.queries(), E.oracle_sql()
    ok = bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(ex).__name__}: {str(ex)[:300]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in orc:
            print(f"rows {name}: {len(srows)} rows ({dt:.1f}s, no oracle)")
            continue
        try:
            rel = con.sql(orc[name])
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(ex)[:300]}")
            bad += 1
            continue
        problems = []
        if sorted(scols) != sorted(dcols):
            problems.append(f"columns spark={scols} duck={dcols}")
        if len(srows) != len(drows):
            problems.append(f"rows spark={len(srows)} duck={len(drows)}")
        if not problems:
            hs, ls = digest(scols, srows)
            hd, ld = digest(dcols, drows)
            if hs != hd:
                diff = [(a, b) for a, b in zip(ls, ld) if a != b][:3]
                problems.append(f"values differ, e.g. {diff}")
        if problems:
            bad += 1
            print(f"FAIL {name} ({dt:.1f}s): " + "; ".join(problems)[:900])
        else:
            ok += 1
            print(f"ok   {name} ({dt:.1f}s, {len(srows)} rows)")
    print(f"\n{ok} ok, {bad} failing, {len(qs) - ok - bad} rows-only")


if __name__ == "__main__":
    main()
