"""Compare registered queries with their DuckDB twins: python tools/check.py [-s SF] [name-part ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from plantlens.plans import load_all  # noqa: E402
from plantlens.session import TABLES, local_session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return (type(value).__name__, str(value))


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(spark, con, name, entry, sf_dir):
    start = time.time()
    df = entry.run(spark, sf_dir)
    got_columns, got = table_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if entry.sql is None:
        return f"ROWS  {len(got):>7} {took:6.1f}s {name}", True
    start = time.time()
    cursor = con.execute(entry.sql)
    want_columns, want = table_of([d[0] for d in cursor.description], cursor.fetchall())
    duck = time.time() - start
    if got_columns != want_columns:
        return f"COLS  {name}: {got_columns} != {want_columns}", False
    if got != want:
        a, b = set(got), set(want)
        diff = [f"   spark {x[:600]}" for x in sorted(a - b)[:3]] + [f"   duck  {x[:600]}" for x in sorted(b - a)[:3]]
        return f"DIFF  {name}: {len(got)} / {len(want)} rows, {len(a - b)} / {len(b - a)} differ\n" + "\n".join(diff), False
    note = "  EMPTY" if not got else ""
    return f"ok    {len(got):>7} {took:6.1f}s (sql {duck:.1f}s) {name}{note}", True


def main(argv):
    sf = "0.01"
    if argv[:1] == ["-s"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    bad = 0
    for name, entry in load_all().items():
        if argv and not any(part in name for part in argv):
            continue
        try:
            line, good = compare(spark, con, name, entry, sf_dir)
        except Exception as error:  # report every query in one run
            line, good = f"FAIL  {name}: {type(error).__name__}: {str(error)[:700]}", False
        bad += not good
        print(line, flush=True)
    print(f"{bad} not matching")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
