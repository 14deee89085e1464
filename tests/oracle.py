"""Side-by-side check of queries() against oracle_sql() in DuckDB.

    python tests/oracle.py [name-prefix ...]      (SF_DIR picks the tables)
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


KIND = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date"}


def compare(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    if sql is None:
        return f"rows={len(rows)}", None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: {cols} / {sorted(names)}", False
    kinds = {d[0]: KIND.get(str(d[1]), str(d[1])) for d in cur.description}
    mine = dict(df.dtypes)
    wrong = {c: (mine[c], kinds[c]) for c in cols if mine[c] != kinds[c]}
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    ours = Counter(tuple(norm(v) for v in r) for r in rows)
    if ours != theirs:
        return (f"values differ: {len(rows)} / {sum(theirs.values())} rows\n  only spark: {str(list((ours - theirs).items())[:3])[:900]}"
                f"\n  only duck:  {str(list((theirs - ours).items())[:3])[:900]}"), False
    if wrong:
        return f"types differ: {wrong}", False
    return f"rows={len(rows)}", True


def main(prefixes):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf), entry.oracle_sql(), []
    con.execute("SET threads=4")
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            message, good = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as error:  # noqa: BLE001
            message, good = f"{type(error).__name__}: {str(error)[:1500]}", False
        if good is False:
            bad.append(name)
        print(f"{ {True: 'ok  ', False: 'FAIL', None: 'rows'}[good]} {name} {time.time() - began:.1f}s {message}", flush=True)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
