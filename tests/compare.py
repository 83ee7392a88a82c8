"""Run registered queries beside their SQL in DuckDB and compare values."""

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), sorted(names)


def compare(spark, con, sf_dir, name, queries, oracles):
    """None when equal, else a short description."""
    df = queries[name](spark, sf_dir)
    got, got_names = rows_of(df.columns, df.collect())
    if name not in oracles:
        return None if got else "no rows"
    cur = con.execute(oracles[name])
    want, want_names = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        has, should = set(got), set(want)
        extra, missing = [r for r in got if r not in should][:3], [r for r in want if r not in has][:3]
        return f"{len(got)} rows vs {len(want)}; spark only {extra}; sql only {missing}"
    return None if got else "no rows on either side"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from jobtide.session import get_spark

    sf = sys.argv[1]
    only = sys.argv[2:]
    cores = os.environ.get("BENCH_CPUS", "8")
    spark, con = get_spark("compare", cores=cores, shuffle_partitions=int(cores)), connect(sf)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for name in q:
        if only and not any(name.startswith(x) for x in only):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, sf, name, q, o)
        except Exception as err:  # noqa: BLE001
            diff = f"{type(err).__name__}: {str(err)[:700]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {time.time() - t:5.1f}s {name}{'' if name in o else ' (rows)'}{'' if diff is None else ' -> ' + diff[:900]}", flush=True)
    print("bad:", bad)
