"""Queries over conversations, events and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming import sessions as ss
from .base import query, table


@query("""WITH t AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context FROM t GROUP BY conv_id""")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four messages of each conversation as context (WN9, SF48)."""
    return ss.history_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", 4)


@query("""WITH n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, max(ts) AS updated_at, CAST(count(*) AS BIGINT) AS messages FROM events GROUP BY user_id HAVING max(ts) >= (SELECT now FROM n) - INTERVAL 6 HOUR""")
def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen in the last six hours of the table (ST3)."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").cast("timestamp").alias("now")).first()[0]
    return ss.live_sessions(e, "user_id", "ts", F.lit(now), 6 * 3600)


@query("SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM events")
def sliding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of the last hour, at each event (WN8)."""
    return ss.trailing_count(table(spark, sf_dir, "events"), "user_id", F.col("ts").cast("timestamp"), 3600).select("event_id", "user_id", "in_window")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, []::DOUBLE[] AS log, NULL::BIGINT AS event_id, true AS allowed, 0 AS retry_after FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, n, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END, event_id, len(live) < 2, CASE WHEN len(live) < 2 THEN 0 ELSE greatest(1, CAST(floor(live[1] + 3600.0 - t) AS INTEGER)) END
  FROM (SELECT e.user_id, e.n, e.event_id, e.t, list_filter(log, lambda x: x > e.t - 3600.0) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT CAST(user_id AS VARCHAR) AS key, event_id, allowed, CAST(retry_after AS INTEGER) AS retry_after FROM r WHERE event_id IS NOT NULL""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a limit of two an hour and user lets through (ST2)."""
    return ss.rate_limit(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", 2, 3600.0)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type (extension)."""
    return ss.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", None, ["event_type"]).withColumn("total", F.round("total", 4))


@query("""SELECT w AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour, every half hour (extension)."""
    return ss.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", ["event_type"]).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users by gaps of two hours (extension)."""
    return ss.sessions(table(spark, sf_dir, "events"), "ts", "2 hours", "user_id")


@query("""SELECT e.event_id, e.user_id, max_by(p.value, p.ts) AS last_value FROM events e ASOF JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type <> 'purchase' GROUP BY e.event_id, e.user_id""")
def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last purchase until then (extension): one sort a user, no range join."""
    e = table(spark, sf_dir, "events")
    buy = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("bought")).withColumns({"event_id": F.lit(None).cast("long"), "o": F.lit(0)})
    both = e.where("event_type <> 'purchase'").select("user_id", "ts", F.lit(None).cast("double").alias("bought"), "event_id", F.lit(1).alias("o")).unionByName(buy)
    w = Window.partitionBy("user_id").orderBy("ts", "o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last_value", F.last("bought", ignorenulls=True).over(w)).where("o = 1 AND last_value IS NOT NULL").select("event_id", "user_id", "last_value")


@query("""SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by the customers' nations (extension): lines are summed by order before they meet
    customers, so the wide shuffle carries a row an order."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    o = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    by = o.groupBy("c_nationkey").agg(F.sum("k").alias("lines"), F.sum("v").alias("v"))
    named = by.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.sum("lines").alias("lines"), F.round(F.sum("v"), 2).alias("revenue"))


@query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by return flag and status, and their totals (extension)."""
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
