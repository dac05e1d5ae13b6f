"""DuckDB texts for the correctness oracle.

Every text sees only the raw driver tables, so it starts from the contact
table derived in SQL (the DuckDB form of ``campaign_from_tables``).
"""

from __future__ import annotations

CAMPAIGN_SQL = """
li AS (
  SELECT l_orderkey, COUNT(*) AS n_lines FROM lineitem GROUP BY l_orderkey
), o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
         CAST(o_orderdate AS DATE) AS od,
         ROW_NUMBER() OVER w - 1 AS seq,
         LAG(CAST(o_orderdate AS DATE)) OVER w AS prev_od,
         LAG(o_orderstatus) OVER w AS prev_status
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), b AS (
  SELECT o.o_orderkey AS row_id,
    CAST(18 + c.c_custkey % 78 AS INT) AS age,
    LOWER(c.c_mktsegment) AS job,
    CASE c.c_custkey % 3 WHEN 0 THEN 'married' WHEN 1 THEN 'single' ELSE 'divorced' END AS marital,
    CASE c.c_nationkey % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'primary' WHEN 2 THEN 'primary'
      WHEN 3 THEN 'tertiary' WHEN 4 THEN 'tertiary' ELSE 'secondary' END AS education,
    CASE WHEN c.c_acctbal < -800 THEN 'yes' ELSE 'no' END AS "default",
    CAST(FLOOR(c.c_acctbal) AS INT) AS balance,
    CASE WHEN c.c_nationkey % 2 = 0 THEN 'yes' ELSE 'no' END AS housing,
    CASE WHEN o.o_orderpriority = '5-LOW' THEN 'yes' ELSE 'no' END AS loan,
    CASE o.o_orderstatus WHEN 'F' THEN 'cellular' WHEN 'O' THEN 'telephone' ELSE 'unknown' END AS contact,
    CAST(EXTRACT(DAY FROM o.od) AS INT) AS day,
    SUBSTR('janfebmaraprmayjunjulaugsepoctnovdec', CAST(EXTRACT(MONTH FROM o.od) AS INT) * 3 - 2, 3) AS month,
    CAST(FLOOR(o.o_totalprice / 130) AS INT) AS duration,
    CAST(COALESCE(li.n_lines, 1) AS INT) AS campaign,
    CAST(COALESCE(DATE_DIFF('day', o.prev_od, o.od), -1) AS INT) AS pdays,
    CAST(o.seq AS INT) AS previous,
    CASE o.prev_status WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' WHEN 'P' THEN 'other'
      ELSE 'unknown' END AS poutcome
  FROM o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN li ON li.l_orderkey = o.o_orderkey
), campaign AS (
  SELECT b.*, CASE WHEN (CASE WHEN duration > 1900 THEN 2 ELSE 0 END)
      + (CASE WHEN poutcome = 'success' THEN 1 ELSE 0 END)
      + (CASE WHEN housing = 'no' THEN 1 ELSE 0 END) - (CASE WHEN loan = 'yes' THEN 1 ELSE 0 END)
      + row_id % 3 - 1 >= 2 THEN 'yes' ELSE 'no' END AS deposit
  FROM b
)"""


def with_campaign(body: str, *more_ctes: str) -> str:
    """``WITH <campaign>[, more] <body>``."""
    extra = "".join(f",\n{c}" for c in more_ctes)
    return f"WITH {CAMPAIGN_SQL.strip()}{extra}\n{body}"
