"""The analytics tables, bound to the given tables by one SQL text for Spark and the oracle.

``{name}`` stands for a source table or an earlier view; ``@days(d, n)@`` adds n days to a date.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import AMOUNT_RANGES

SOURCES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_RANGE = "CASE " + " ".join(f"WHEN amount <= {hi} THEN '{label}'" for label, _, hi in AMOUNT_RANGES[:-1]) + f" ELSE '{AMOUNT_RANGES[-1][0]}' END"

VIEWS = {
    "group_dim": "SELECT n_nationkey AS group_id, n_name AS name FROM {nation}",
    "entity": """SELECT entity_id, full_name, party, group_id, in_office, entity_id % 7 AS district,
        CASE WHEN in_office AND row_number() OVER (PARTITION BY group_id, in_office ORDER BY entity_id) <= 2 THEN 'senate' ELSE 'house' END AS chamber
        FROM (SELECT c_custkey AS entity_id, c_name AS full_name, c_nationkey AS group_id, c_acctbal > 0 AS in_office,
              CASE c_mktsegment WHEN 'BUILDING' THEN 'Democrat' WHEN 'MACHINERY' THEN 'Republican' ELSE c_mktsegment END AS party FROM {customer}) c""",
    "position": """SELECT ballot_id, entity_id, position FROM (
        SELECT date_trunc('hour', ts) AS ballot_id, user_id AS entity_id,
          CASE event_type WHEN 'click' THEN 'yea' WHEN 'view' THEN 'nay' WHEN 'purchase' THEN 'present' ELSE 'not_voting' END AS position,
          row_number() OVER (PARTITION BY date_trunc('hour', ts), user_id ORDER BY event_id) AS rn FROM {events}) e WHERE rn = 1""",
    "ballot": """SELECT ballot_id, CAST(ballot_id AS DATE) AS ballot_date,
        sum(CASE WHEN position = 'yea' THEN 1 ELSE 0 END) AS yeas, sum(CASE WHEN position = 'nay' THEN 1 ELSE 0 END) AS nays FROM {position} GROUP BY ballot_id""",
    "item": """SELECT p_partkey AS item_id, p_type AS item_type, p_name AS title, CASE WHEN p_size % 10 = 0 THEN NULL ELSE d END AS introduced_date
        FROM {part} LEFT JOIN (SELECT l_partkey, CAST(min(l_shipdate) AS DATE) AS d FROM {lineitem} GROUP BY l_partkey) s ON l_partkey = p_partkey""",
    "item_link": "SELECT DISTINCT l_partkey AS item_id, l_suppkey AS entity_id, CASE WHEN l_linenumber = 1 THEN 'sponsor' ELSE 'cosponsor' END AS role FROM {lineitem}",
    "brand": "SELECT p_partkey, 'B' || lpad(regexp_replace(p_brand, '[^0-9]', ''), 2, '0') AS b, p_type FROM {part}",
    "committee": "SELECT DISTINCT b AS committee_id, 'Committee ' || b AS name, CAST(NULL AS STRING) AS parent_id FROM {brand} UNION ALL SELECT DISTINCT b || p_type, b || ' ' || p_type, b FROM {brand}",
    "seat": "SELECT o_custkey AS entity_id, o_orderpriority AS pri, b, p_type FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {brand} ON p_partkey = l_partkey",
    "assignment": """SELECT entity_id, committee_id, CASE min(pri) WHEN '1-URGENT' THEN 'chair' WHEN '2-HIGH' THEN 'ranking_member' WHEN '3-MEDIUM' THEN 'vice_chair' ELSE 'member' END AS role
        FROM (SELECT entity_id, b AS committee_id, pri FROM {seat} UNION ALL SELECT entity_id, b || p_type, pri FROM {seat}) s GROUP BY entity_id, committee_id""",
    "finance_cycle": """SELECT r.entity_id, r.cycle, CASE WHEN r.entity_id % 4 = 0 THEN 0 ELSE receipts END AS total_receipts, coalesce(individual, 0) AS total_individual, coalesce(pac, 0) AS total_pac, coalesce(small, 0) AS small_individual
        FROM (SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INT) AS cycle, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS receipts FROM {orders} GROUP BY 1, 2) r
        LEFT JOIN (SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INT) AS cycle,
          CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS individual,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS pac,
          CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(round(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS small
          FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1, 2) l ON l.entity_id = r.entity_id AND l.cycle = r.cycle""",
    # filings of ids below 0 have no lines
    "filing": """SELECT o_orderkey AS filing_id, o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS filed_date, CASE o_orderstatus WHEN 'P' THEN 'review' WHEN 'F' THEN 'parsed' ELSE 'pending' END AS parse_status FROM {orders}
        UNION ALL SELECT -1 - c_custkey, c_custkey, @days(DATE '1995-01-01', c_custkey % 1000)@, 'pending' FROM {customer} WHERE c_custkey % 7 = 0""",
    "trade": """SELECT filing_id, entity_id, row_index, ticker, asset_description, tx_type, tx_date, amount, confidence, filed_date,
        CASE WHEN tx_date IS NULL THEN FALSE ELSE filed_date > @days(tx_date, 45)@ END AS filed_late FROM (
        SELECT f.filing_id, f.entity_id, f.filed_date, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS row_index,
          CASE WHEN p_size % 10 = 0 THEN NULL ELSE 'T' || regexp_replace(p_brand, '[^0-9]', '') END AS ticker, p_name AS asset_description,
          CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'S (partial)' END AS tx_type,
          CASE WHEN l_suppkey % 50 = 0 THEN NULL WHEN l_partkey % 97 = 0 THEN @days(f.filed_date, 5)@ ELSE @days(f.filed_date, 0 - ((l_partkey * 7 + l_linenumber) % 90))@ END AS tx_date,
          CAST(round(l_extendedprice) AS BIGINT) AS amount, CAST(60 + floor(l_quantity * 0.8) AS INT) AS confidence,
          row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_extendedprice, l_quantity, l_returnflag, l_shipdate) AS rn
        FROM {lineitem} JOIN {filing} f ON f.filing_id = l_orderkey JOIN {part} ON p_partkey = l_partkey) x WHERE rn = 1""",
    "line": """SELECT filing_id, entity_id, row_index, filed_date, CAST(tx_date AS STRING) AS tx_date, CAST(confidence AS DOUBLE) / 100 AS confidence,
        asset_description || CASE amount % 7 WHEN 0 THEN ' [CT]' WHEN 1 THEN ' [PS]' WHEN 2 THEN ' [OI]' WHEN 3 THEN ' [RE]' WHEN 4 THEN ' (BA)' ELSE '' END || CASE WHEN amount % 13 = 0 THEN ' Example Mega Corp' ELSE '' END AS asset_description,
        CASE amount % 5 WHEN 0 THEN 'GS' WHEN 1 THEN 'BA' WHEN 2 THEN NULL WHEN 3 THEN 'CT' ELSE ticker END AS ticker, CASE amount % 3 WHEN 0 THEN 'Stock' WHEN 1 THEN 'Bond' ELSE NULL END AS asset_type,
        CASE WHEN amount % 11 = 0 THEN 'X' ELSE tx_type END AS tx_type, CASE WHEN amount % 17 = 0 THEN '?' ELSE """
    + _RANGE
    + " END AS amount_range FROM {trade}",
    "person": "SELECT entity_id, CAST(group_id AS STRING) AS state, 'Name' || CAST(entity_id % 40 AS STRING) AS last_name, 'Given' AS first_name, district, chamber FROM {entity} WHERE in_office",
    "signer": "SELECT o_orderkey AS filing_id, CAST(o_custkey % 25 AS STRING) AS state, 'Name' || CAST(o_orderkey % 45 AS STRING) AS last, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 7 END AS district FROM {orders}",
    "release": """SELECT doc_id AS release_id, doc_id % 150 AS entity_id, substring(split(text, chr(10))[@first@], 1, 200) AS title, source || '/' || CAST(doc_id AS STRING) AS url, source,
        CASE WHEN doc_id % 17 = 0 THEN NULL ELSE @days(DATE '2024-01-01', doc_id % 400)@ END AS published FROM {documents}""",
    "run_log": "SELECT event_id AS run_id, event_type AS source, user_id % 3 AS entity_type, ts AS completed_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, CAST(round(value) AS BIGINT) AS records_count FROM {events}",
}


def _dialect(sql: str, spark: bool) -> str:
    sql = re.sub(r"@days\((.+?), (.+?)\)@", r"date_add(\1, CAST(\2 AS INT))" if spark else r"(\1 + CAST(\2 AS INTEGER))", sql)
    return sql.replace("@first@", "0" if spark else "1")


class Tables:
    """The fixture tables of one folder, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                sql = _dialect(VIEWS[name], True)
                self._made[name] = self._spark.sql(sql, **{x: getattr(self, x) for x in set(re.findall(r"\{(\w+)\}", sql))})
            else:
                self._made[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._made[name]


def oracle(sql: str) -> str:
    """DuckDB text: the views that ``sql`` names as ``{view}``, then itself."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in VIEWS and name not in needed:
                add(VIEWS[name])
                needed.append(name)

    add(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", _dialect(text, False).replace("regexp_replace(p_brand, '[^0-9]', '')", "regexp_replace(p_brand, '[^0-9]', '', 'g')"))
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in needed)
    return (f"WITH {ctes} " if ctes else "") + plain(sql)
