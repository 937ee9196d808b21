"""Market views of the driver's TPC-H-like tables.

The same SQL text runs in Spark and in DuckDB: integer arithmetic, CASE and
casts. Prices carry integer ticks of 0.01, so bucketing is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents".split()
START_MS = 1704067200000

VIEWS: dict[str, str] = {
    "trades": """
        SELECT concat('S', CAST(l_suppkey % 5 AS STRING)) AS symbol,
               CASE WHEN l_linestatus = 'O' THEN 'spot' ELSE 'futures' END AS venue,
               l_orderkey * 10 + l_linenumber AS trade_id,
               1704067200000 + (l_orderkey * 86399 + l_linenumber * 104729 + l_partkey * 613) % 86400000 AS ts_ms,
               9800 + (l_partkey * 17 + l_orderkey * 31) % 400 AS price_ticks,
               CAST(9800 + (l_partkey * 17 + l_orderkey * 31) % 400 AS DOUBLE) / 100E0 AS price,
               l_quantity AS qty,
               (l_orderkey + l_partkey) % 2 = 0 AS is_buyer_maker
        FROM {lineitem}""",
    "book_levels": """
        SELECT symbol, snapshot_id, side, price_ticks, CAST(price_ticks AS DOUBLE) / 100E0 AS price, sum(qty) AS qty
        FROM (SELECT concat('S', CAST(l_suppkey % 5 AS STRING)) AS symbol, l_orderkey % 20 AS snapshot_id,
                     CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
                     CASE WHEN l_linestatus = 'O' THEN 10000 - 5 * (1 + l_partkey % 40) ELSE 10000 + 5 * (1 + l_partkey % 40) END AS price_ticks,
                     l_quantity AS qty
              FROM {lineitem}) t
        GROUP BY symbol, snapshot_id, side, price_ticks""",
    "klines_5m": """
        SELECT symbol, venue, ts_ms - ts_ms % 300000 AS bucket_ms,
               min_by(price, (ts_ms - 1704067200000) * 10000000 + trade_id) AS open, max(price) AS high, min(price) AS low,
               max_by(price, (ts_ms - 1704067200000) * 10000000 + trade_id) AS close, sum(qty) AS volume
        FROM {trades} GROUP BY symbol, venue, ts_ms - ts_ms % 300000""",
    "taker_bars_5m": """
        SELECT symbol, ts_ms - ts_ms % 300000 AS bucket_ms,
               sum(CASE WHEN is_buyer_maker THEN 0E0 ELSE qty END) AS buy_vol,
               sum(CASE WHEN is_buyer_maker THEN qty ELSE 0E0 END) AS sell_vol
        FROM {trades} WHERE venue = 'futures' GROUP BY symbol, ts_ms - ts_ms % 300000""",
    "oi_history_5m": """
        SELECT concat('S', CAST(o_custkey % 5 AS STRING)) AS symbol, 1704067200000 + (o_orderkey % 288) * 300000 AS bucket_ms,
               CAST(sum(1000 + (o_orderkey * 7) % 500) AS DOUBLE) AS sum_open_interest,
               CAST(sum((1000 + (o_orderkey * 7) % 500) * (99 + o_orderkey % 3)) AS DOUBLE) AS sum_open_interest_value
        FROM {orders} GROUP BY concat('S', CAST(o_custkey % 5 AS STRING)), 1704067200000 + (o_orderkey % 288) * 300000""",
    "quotes": """
        SELECT concat('S', CAST(user_id % 5 AS STRING)) AS symbol,
               CASE WHEN user_id % 2 = 0 THEN 'spot' ELSE 'futures' END AS venue,
               event_id AS update_id, 1704067200000 + event_id * 250 AS ts_ms,
               10000 + (event_id * 13 + user_id) % 7 AS bid_ticks, 10001 + (event_id * 13 + user_id) % 7 + event_id % 3 AS ask_ticks,
               CAST(1 + (event_id * 7) % 50 AS DOUBLE) AS bid_qty, CAST(1 + (event_id * 11) % 50 AS DOUBLE) AS ask_qty
        FROM {events}""",
    "capture_status": """
        SELECT concat('S', CAST(user_id % 5 AS STRING)) AS symbol, 1704067200000 + event_id * 250 AS updated_at_ms,
               CASE event_type WHEN 'error' THEN 'gap' WHEN 'signup' THEN 'reconnecting' ELSE 'running' END AS state
        FROM {events}""",
    "depth_deltas": """
        SELECT symbol, venue, ts_ms, seq * 3 - 2 + CASE WHEN seq % 37 = 0 THEN 1 ELSE 0 END AS first_update_id,
               seq * 3 AS final_update_id, side, price_ticks, qty
        FROM (SELECT concat('S', CAST(user_id % 5 AS STRING)) AS symbol, 'spot' AS venue, 1704067200000 + event_id * 250 AS ts_ms,
                     row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS seq,
                     CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
                     CASE WHEN event_id % 2 = 0 THEN 9999 - (event_id * 13) % 11 ELSE 10001 + (event_id * 13) % 11 END AS price_ticks,
                     CAST((event_id * 7) % 6 AS DOUBLE) AS qty
              FROM {events}) t""",
    "notes": """
        SELECT doc_id AS note_id, source AS session_id, lang AS kind, text AS content, CAST(n_chars % 11 AS DOUBLE) AS importance,
               doc_id % 13 = 0 AS forgotten, doc_id AS created_seq
        FROM {documents}""",
    # The newest trade of a symbol closes its trailing windows.
    "book_prices": """
        SELECT symbol, snapshot_id,
               (max(CASE WHEN side = 'bid' THEN price_ticks END) + min(CASE WHEN side = 'ask' THEN price_ticks END)) / 200E0 AS price
        FROM {book_levels} GROUP BY symbol, snapshot_id
        HAVING count(CASE WHEN side = 'bid' THEN 1 END) > 0 AND count(CASE WHEN side = 'ask' THEN 1 END) > 0""",
}


#: SQL twin of ``Market.newest``.
NEWEST_SNAPSHOT = "(symbol, snapshot_id) IN (SELECT symbol, max(snapshot_id) FROM {book_levels} GROUP BY symbol)"


def parents(view: str) -> list[str]:
    return [name for name in (*TABLES, *VIEWS) if f"{{{name}}}" in VIEWS[view]]


class Market:
    """The views over one folder of tables, made on first use: ``market.trades``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def newest(self, rows: DataFrame, older: bool = False) -> DataFrame:
        """The rows of each symbol's newest book snapshot, or those of all before it."""
        last = self.book_levels.groupBy("symbol").agg(F.max("snapshot_id").alias("snapshot_id"))
        return rows.join(last, ["symbol", "snapshot_id"], "left_anti" if older else "left_semi")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.spark.sql(VIEWS[name], **{p: getattr(self, p) for p in parents(name)})
        return self._made[name]


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, after the definitions of the views it names in braces."""
    needed: list[str] = []

    def add(view: str) -> None:
        for p in parents(view):
            if p in VIEWS:
                add(p)
        if view not in needed:
            needed.append(view)

    for name in VIEWS:
        if f"{{{name}}}" in sql:
            add(name)
    names = {n: n for n in (*TABLES, *VIEWS)}

    def plain(text: str) -> str:
        for n in names:
            text = text.replace(f"{{{n}}}", n)
        return text

    made = ", ".join(f"{v} AS ({plain(VIEWS[v])})" for v in needed)
    body = plain(sql).strip()
    if not made:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {made}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {made}, {body[5:]}"
    return f"WITH {made} {body}"
