"""State machines over the events of each user (ST), and relational extensions that the blueprint lists as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.operators import state as S
from scriptoria import streaming
from scriptoria.plans import as_sql, query, rows, shared, table


@query("""SELECT event_id, coalesce(last_value(CASE WHEN value < 20 THEN true WHEN value >= 60 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS on FROM events""".replace(" AS on ", ' AS "on" '))
def schmitt_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1."""
    return S.schmitt(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 20, 60).select("event_id", "on")


@query("""WITH e AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events)
SELECT event_id, (sum((event_type <> 'purchase')::INT) OVER w)::BIGINT AS failures, (sum((event_type <> 'purchase')::INT) OVER w) >= 5 AS fallback FROM e WINDOW w AS (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def failures_since_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-7: a purchase counts as a success."""
    e = S.failures_since_success(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")
    return e.select("event_id", "failures", "fallback")


@query("""WITH g AS (SELECT *, coalesce((ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 300 MINUTE)::INT, 0) AS x FROM events), r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 300 MINUTE AS locks, count(*) AS n FROM r GROUP BY user_id, k""")
def inactivity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-8, with pauses of 300 minutes."""
    s = S.inactivity_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 300)
    return s.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("locks").cast("timestamp_ntz").alias("locks"), "n")


@query("""WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, event_type FROM events), m AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY s, event_type))::INT AS x FROM e),
r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY s, event_type ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, event_type, min(s) AS first, max(s) AS last, count(*) AS n FROM r GROUP BY user_id, k, event_type HAVING max(s) - min(s) >= 3600""")
def stable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3 and 6: what stays the same for an hour."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), "event_type")
    return S.stable_runs(e, "user_id", "s", "event_type", 3600).select("user_id", "event_type", "first", "last", "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, true AS armed, 0 AS calm, false AS fire FROM e
  UNION ALL SELECT user_id, k, event_id, armed AND NOT (armed AND calm >= 2), calm, armed AND calm >= 2 FROM (SELECT e.user_id, e.k, e.event_id, r.armed OR v >= 60 AS armed, CASE WHEN v < 20 THEN r.calm + 1 ELSE 0 END AS calm FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, event_id FROM r WHERE fire""")
def arm_and_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-4: an event's value is movement: from 60 on it arms, two below 20 in a row take the picture."""
    return S.shots(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 60, 20, 2).select("user_id", "event_id")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN false WHEN value < 10 THEN true ELSE event_id % 120 >= 60 END AS allowed FROM events")
def capture_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-5: whether a frame may be taken; an event is a frame, its value the contrast, its number the sharpness."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", S.capture_allowed(F.col("event_type") != "error", F.col("value"), F.col("event_id") % 120).alias("allowed"))


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS moment, coalesce(last_value(CASE WHEN value < 20 THEN true WHEN value >= 60 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS state FROM events),
c AS (SELECT user_id, moment, state FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY moment, state) AS was FROM o) WHERE was IS NULL OR was <> state),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, state) AS k FROM c),
r AS (SELECT user_id, k, moment, state, true AS taken FROM s WHERE k = 1
  UNION ALL SELECT s.user_id, s.k, CASE WHEN s.moment - r.moment >= 86400 AND s.state <> r.state THEN s.moment ELSE r.moment END, CASE WHEN s.moment - r.moment >= 86400 AND s.state <> r.state THEN s.state ELSE r.state END, s.moment - r.moment >= 86400 AND s.state <> r.state FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1)
SELECT user_id, moment AS "at", state AS "on" FROM r WHERE taken""")
def debounced_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2: switches at least a day apart; each depends on the last accepted one."""
    on = S.schmitt(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 20, 60)
    return S.debounced(on.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "on"), "user_id", "at", "on", 86400.0)


@query("""WITH RECURSIVE s AS (SELECT user_id, ts, event_id, event_type = 'error' AS undo, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, CASE WHEN undo THEN []::BIGINT[] ELSE [event_id] END AS stack FROM s WHERE k = 1
  UNION ALL SELECT s.user_id, s.k, CASE WHEN NOT undo THEN list_append(stack, event_id) WHEN len(stack) > 1 THEN stack[1:len(stack) - 1] ELSE []::BIGINT[] END FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1),
l AS (SELECT user_id, unnest(max_by(stack, k)) AS event_id FROM r GROUP BY user_id)
SELECT user_id, ts, event_id FROM l JOIN events USING (user_id, event_id)""")
def queue_after_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-9: jobs left after undoing; an undo takes back the last job left."""
    return S.queue_after_undo(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def newest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-11: only the newest result of each user counts."""
    e = table(spark, sf_dir, "events").withColumn("version", F.struct("ts", "event_id"))
    return S.newest_version(e, "user_id", "version").select("user_id", "event_id", "event_type")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 40""")
def undo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-12: the last forty steps of each user."""
    return S.history(table(spark, sf_dir, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ROLLUP (r_name, n_name)""")
def star_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a star join rolled up by region and nation."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ'1996-01-01' AND o_orderdate < TIMESTAMP_NTZ'1997-01-01'")
    j = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS quarter FROM orders""")
def ranking_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: ranks and quartiles."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc())
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("place"), F.ntile(4).over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long").alias("quarter"))


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: intersect and except."""
    o = table(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return of("F").intersect(of("O")).subtract(of("P"))


@query("""SELECT p.event_id, p.user_id, v.event_id AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: each purchase with the last view before it, by a union and a window instead of a join."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("seen", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "user_id", "seen")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: counts by six hours and kind; the streaming form is in scriptoria.streaming."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def _streamed(spark: SparkSession, sf_dir: str, value: str | None, hours: float) -> DataFrame:
    """What a stream of the events fires, up to where it knows that nothing older can come."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: a stream's own path must be a folder
    path = shared(spark, "fires")
    streaming.run_to_files(streaming.fires(stream, "user_id", "ts", value, hours * 3600), path, shared(spark, "ledger"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c)
    return spark.read.schema("user_id long, first timestamp, fired timestamp").parquet(path).select("user_id", shown("first"), shown("fired"))


def fires_sql(changed: str, hours: int) -> str:
    return f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type AS v FROM events), m AS (SELECT max(ms) - 600000 AS mark FROM e),
r AS (SELECT *, {changed} AS new, max(ms) OVER (PARTITION BY user_id) AS last FROM e), n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, v) AS next FROM r WHERE new)
SELECT user_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS first, strftime(make_timestamp((ms + {hours} * 3600000) * 1000), '%Y-%m-%d %H:%M:%S.%g') AS fired FROM n, m
WHERE CASE WHEN next IS NOT NULL THEN next >= ms + {hours} * 3600000 ELSE last >= ms + {hours} * 3600000 OR ms + {hours} * 3600000 < mark END"""


@query(fires_sql("true", 6))
def silence_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-8 as a stream: a lock falls six hours after a user's last event, by a timer where no event comes any more."""
    return _streamed(spark, sf_dir, None, 6)


@query(fires_sql("v IS DISTINCT FROM lag(v) OVER (PARTITION BY user_id ORDER BY ms, v) OR lag(ms) OVER (PARTITION BY user_id ORDER BY ms, v) IS NULL", 8))
def stable_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3 and 6 as a stream: an event type that has stayed the same for eight hours fires once, and is armed again by a change."""
    return _streamed(spark, sf_dir, "event_type", 8)


@query(fires_sql("true", 6))
def silence_locks_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-8: the same as silence_locks, by windows over the events."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c)
    return S.fires(table(spark, sf_dir, "events"), "user_id", "ts", None, 6 * 3600, 600).select("user_id", shown("first"), shown("fired"))


@query("SELECT 'document' AS kind, doc_id AS id, sha256(text) AS mark FROM documents UNION ALL SELECT 'benchmark', item_id, sha256(text) FROM benchmark")
def imported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: rows dropped as files are taken in once each, by a stream that is started again when more files have come."""
    drop, target, ledger = (shared(spark, x) for x in ("drop", "import", "ledger"))
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), "text")
    for part in (d, b):
        part.write.mode("append").json(drop)
        streaming.import_files(streaming.shared_files(spark, drop, "kind string, id long, text string", 2), target, ledger)
    return spark.read.schema("kind string, id long, text string, batch long").parquet(target).select("kind", "id", F.sha2("text", 256).alias("mark"))
