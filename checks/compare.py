"""Run registered queries and their SQL on the same tables and compare the rows.

python -m checks.compare [--sf 0.01] [--only a,b] [--from prefix]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return repr(float(value)) if hasattr(value, "as_tuple") else value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def main() -> None:
    from listwarden.session import local_session

    from . import registered

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--folder", default="")
    ap.add_argument("--only", default="")
    ap.add_argument("--prefix", default="")
    args = ap.parse_args()
    folder = args.folder or f"/root/testdata/sf{args.sf}"
    queries, oracles = registered()
    spark = local_session()
    con = connect(folder)
    bad = []
    for name, fn in queries.items():
        if (args.only and name not in args.only.split(",")) or not name.startswith(tuple(args.prefix.split(","))):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            got = df.collect()
            took = time.time() - start
            if name not in oracles:
                print(f"{name:40s} rows {len(got):7d}  {took:6.2f}s  (rows only)", flush=True)
                continue
            start = time.time()
            cursor = con.execute(oracles[name])
            names = [d[0] for d in cursor.description]
            want = cursor.fetchall()
            sql_took = time.time() - start
            same_columns = sorted(names) == sorted(df.columns)
            a, b = rows_of(df.columns, got), rows_of(names, want)
            ok = same_columns and a == b and len(a) > 0
            print(f"{name:40s} rows {len(got):7d}  {took:6.2f}s  sql {sql_took:5.2f}s  {'ok' if ok else 'DIFFERS'}",
                  flush=True)
            if not ok:
                bad.append(name)
                print("   columns", sorted(df.columns), sorted(names), "rows", len(a), len(b))
                for x in sorted(set(a) - set(b))[:3]:
                    print("   spark", x[:400])
                for x in sorted(set(b) - set(a))[:3]:
                    print("   sql  ", x[:400])
        except Exception as error:   # keep going: the point is the full list
            bad.append(name)
            print(f"{name:40s} FAILED {str(error)[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
