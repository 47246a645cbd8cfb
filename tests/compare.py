"""Each query against its SQL on one folder, row by row: ``python tests/compare.py [FOLDER] [NAME...]``."""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings streams pods container_statuses log_lines entries pod_events json_entries timeline_items eval_items raw_records zone_names".split()


def views(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def counted(rows, names) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(str(r[i]) for i in order) for r in rows)


def difference(spark, db, name, query, sql, folder):
    """Rows of either side alone."""
    df = query(spark, folder)
    got = counted(map(tuple, df.collect()), df.columns)
    out = db.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(df.columns), (name, names, df.columns)
    want = counted(out.fetchall(), names)
    return got - want, want - got, sum(want.values())


if __name__ == "__main__":
    import __spark_entry__ as driver
    from logloom.runtime import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, db = local_session(8), views(folder)
    queries = driver.queries()
    for name, sql in driver.oracle_sql().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            more, less, n = difference(spark, db, name, queries[name], sql, folder)
            print(name, "ok" if not more and not less else f"DIFFERS {sum(more.values())} {sum(less.values())}", n, round(time.time() - began, 1), flush=True)
            if more or less:
                print("  spark:", sorted(more)[:3], "\n  sql:  ", sorted(less)[:3], flush=True)
        except Exception as error:  # noqa: BLE001
            print(name, "ERROR", str(error)[:700], flush=True)
