"""Copy the test tables so that one account holds a third of all events and orders.

Usage: python tools/skewed_copy.py SF_DIR NEW_DIR, then check_oracle.py NEW_DIR.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from campanula.sources.tables import TABLES  # noqa: E402

HOT = {
    "events": "* REPLACE (CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS BIGINT) AS user_id)",
    "orders": "* REPLACE (CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS BIGINT) AS o_custkey)",
}


def main(source: str, target: str) -> None:
    os.makedirs(target, exist_ok=True)
    con = duckdb.connect()
    for name in TABLES:
        columns = HOT.get(name, "*")
        con.execute(f"COPY (SELECT {columns} FROM '{source}/{name}.parquet') TO '{target}/{name}.parquet' (FORMAT parquet)")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
