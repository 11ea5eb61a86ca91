"""Run registered queries next to their SQL: ``python -m tracemesh.plans.check SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _normal(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def compare(spark, con, sf: str, name: str, query, sql: str) -> tuple[bool, str]:
    """Whether both sides give the same columns and rows, with a note."""
    df = query(spark, sf)
    columns = sorted(df.columns)
    ours = sorted((tuple(_normal(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    found = con.execute(sql)
    theirs_columns = [d[0] for d in found.description]
    if sorted(theirs_columns) != columns:
        return False, f"columns {columns} / {sorted(theirs_columns)}"
    order = [theirs_columns.index(c) for c in columns]
    theirs = sorted((tuple(_normal(r[i]) for i in order) for r in found.fetchall()), key=repr)
    if ours == theirs:
        return True, f"{len(ours)} rows"
    only_ours = [r for r in ours if r not in set(theirs)][:3]
    only_theirs = [r for r in theirs if r not in set(ours)][:3]
    return False, f"{len(ours)} / {len(theirs)} rows; only ours {only_ours}; only SQL {only_theirs}"


def main(argv: list[str]) -> int:
    from tracemesh.plans.oracle import ORACLE
    from tracemesh.plans.queries import QUERIES
    from tracemesh.session import build_session

    sf, names = argv[0], argv[1:] or list(QUERIES)
    options = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    spark = build_session("check", "local[8]", **options)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        began = time.time()
        try:
            if name in ORACLE:
                good, note = compare(spark, con, sf, name, QUERIES[name], ORACLE[name])
            else:
                good, note = True, f"{QUERIES[name](spark, sf).count()} rows, no SQL"
        except Exception as error:  # the report goes on with the next query
            good, note = False, str(error)[:600].replace("\n", " ")
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {name:28s} {time.time() - began:6.1f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree, {sum(n in ORACLE for n in names)} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
