"""Copy a sample folder with a third of all rows on one key: order, customer, product, seller, ZIP, day.

usage: python tools/make_skew.py SOURCE TARGET
"""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb

CHANGES = {
    "lineitem": "SELECT * REPLACE (CASE WHEN hash(l_orderkey, l_linenumber, l_partkey) % 3 = 0 THEN 1 ELSE l_orderkey END "
    "AS l_orderkey, CASE WHEN hash(l_partkey, l_shipdate) % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey, "
    "CASE WHEN hash(l_suppkey, l_shipdate) % 3 = 0 THEN 5 ELSE l_suppkey END AS l_suppkey, "
    "CASE WHEN hash(l_extendedprice) % 3 = 0 THEN 99.99 ELSE l_extendedprice END AS l_extendedprice) FROM t",
    "orders": "SELECT * REPLACE (CASE WHEN hash(o_orderkey) % 3 = 0 THEN 11 ELSE o_custkey END AS o_custkey, "
    "CASE WHEN hash(o_orderkey, 1) % 3 = 0 THEN TIMESTAMP '1998-05-05' ELSE o_orderdate END AS o_orderdate, "
    "CASE WHEN o_orderkey = 1 THEN 'F' ELSE o_orderstatus END AS o_orderstatus) FROM t",
    "customer": "SELECT * REPLACE (CASE WHEN hash(c_custkey) % 3 = 0 THEN 3 ELSE c_nationkey END AS c_nationkey) FROM t",
    "events": "SELECT * REPLACE (ts AS ts) FROM t",
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def main() -> None:
    source, target = sys.argv[1:]
    Path(target).mkdir(parents=True, exist_ok=True)
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '{source}/{table}.parquet'")
        connection.execute(f"COPY ({CHANGES.get(table, 'SELECT * FROM t')}) TO '{target}/{table}.parquet' (FORMAT parquet)")


if __name__ == "__main__":
    main()
