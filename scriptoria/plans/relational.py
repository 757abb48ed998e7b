"""Filters, sorts, updates and access rules on the star schema, which stands in for user and invitation tables (REL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.operators import relational as R
from scriptoria.plans import query, table


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND contains(lower(coalesce(c_name, '') || ' ' || coalesce(c_mktsegment, '')), lower('00')) """)
def admin_filter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-1 to 3: filter by kind, search in two columns, sort first kind first."""
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return R.search(c, "00", "c_name", "c_mktsegment").select("c_custkey", "c_name", "c_mktsegment").orderBy(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey").desc())


@query("SELECT count(*) AS total, count_if(o_orderstatus = 'O')::BIGINT AS open, count_if(o_orderstatus = 'F')::BIGINT AS done, count_if(o_orderstatus = 'P')::BIGINT AS pending, count_if(o_orderpriority = '1-URGENT')::BIGINT AS urgent FROM orders")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-4: several conditional counts in one pass."""
    s = F.col("o_orderstatus")
    return R.counts_if(table(spark, sf_dir, "orders"), open=s == "O", done=s == "F", pending=s == "P", urgent=F.col("o_orderpriority") == "1-URGENT")


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'blocked' ELSE c_mktsegment END AS c_mktsegment, nullif(trim(c_name), 'Customer#000000001') AS c_name FROM customer""")
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-6, 7 and 13: update by a set of ids, null for a value."""
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    c = R.update_where_in(table(spark, sf_dir, "customer"), ids, "c_custkey", c_mktsegment=F.lit("blocked"))
    return c.select("c_custkey", "c_mktsegment", F.nullif(F.trim("c_name"), F.lit("Customer#000000001")).alias("c_name"))


@query("""SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey = 7 OR EXISTS (SELECT 1 FROM customer a WHERE a.c_custkey = 7 AND a.c_mktsegment = 'BUILDING')
  UNION ALL SELECT c.c_custkey, c.c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1)""")
def visible_rows_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-8, 14 and 17, JOIN-10: own rows or all for admins; and rows outside locked folders."""
    c = table(spark, sf_dir, "customer")
    admin = c.where("c_custkey = 7 AND c_mktsegment = 'BUILDING'").agg((F.count("*") > 0).alias("_admin"))
    own = R.visible(c.crossJoin(F.broadcast(admin)), F.lit(7), "c_custkey", F.col("_admin"))  # one row
    locked = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return own.select("c_custkey", "c_nationkey").union(R.outside_locked(c, locked, "c_nationkey").select("c_custkey", "c_nationkey"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, o_totalprice FROM orders o WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey AND p.o_orderstatus <> 'O')""")
def upsert_no_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-10 and JOIN-9: restoring a second, overlapping set adds only what is missing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return R.insert_new(o.where("o_orderstatus <> 'O'"), o.where("o_orderstatus <> 'F'"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("""SELECT event_id, CASE WHEN try_cast(json_extract_string(props, '$.k') AS INT) IS NULL THEN 'missing' WHEN event_type = 'purchase' THEN 'used' WHEN ts + INTERVAL 7 DAY < TIMESTAMP '2024-01-15' THEN 'expired' WHEN user_id % 3 = 0 AND lower(event_type) <> 'view' THEN 'other person' ELSE 'ok' END AS outcome, ts + INTERVAL 7 DAY AS expires FROM events""")
def redeem_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-11 and 12: outcomes of redeeming an invitation, and expiry by an interval."""
    e = table(spark, sf_dir, "events")
    expires = F.col("ts") + F.expr("INTERVAL 7 DAYS")
    outcome = R.redeem_outcome(
        F.get_json_object("props", "$.k").cast("int"), F.when(F.col("event_type") == "purchase", 1), expires,
        F.when(F.col("user_id") % 3 == 0, F.lit("VIEW")), F.col("event_type"), F.lit("2024-01-15").cast("timestamp_ntz"),
    )
    return e.select("event_id", outcome.alias("outcome"), expires.alias("expires"))


@query("""SELECT user_id, CASE WHEN (first, user_id) = (SELECT min((first, user_id)) FROM (SELECT user_id, min(ts) AS first FROM events GROUP BY user_id)) THEN 'admin' ELSE 'user' END AS role FROM (SELECT user_id, min(ts) AS first FROM events GROUP BY user_id)""")
def first_arrival_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-9: the first to arrive becomes admin."""
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    return R.first_arrival(seen, [F.col("first"), F.col("user_id")]).select("user_id", "role")


@query("""SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o_custkey AND c_mktsegment <> 'BUILDING') THEN o_custkey END AS o_custkey FROM orders""")
def foreign_key_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-15: references to deleted rows become null."""
    left = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    return R.set_null_where_gone(table(spark, sf_dir, "orders"), left, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT '"' || c_custkey || '";"' || replace(c_name, '"', '""') || '";"' || c_mktsegment || '"' AS line FROM customer""")
def csv_row_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2: rows as quoted fields between semicolons."""
    from scriptoria.sources.sinks import csv_line

    return table(spark, sf_dir, "customer").select(csv_line("c_custkey", "c_name", "c_mktsegment").alias("line"))


@query("""SELECT lang, sum(n_chars)::BIGINT AS amount, round(sum(n_chars) / sum(sum(n_chars)) OVER (), 6) AS share FROM documents GROUP BY lang""")
def storage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-25: size by kind and share of the whole."""
    return R.shares(table(spark, sf_dir, "documents"), "lang", "n_chars").select("lang", "amount", F.round("share", 6).alias("share"))


@query("""SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 6""")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-21 and 26: the six largest of each kind, first ones winning ties."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return d.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id"))).where("r <= 6").drop("r")


@query("""SELECT o_custkey, o_orderkey, o_orderdate::DATE::VARCHAR AS due FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1998-06-01' + INTERVAL 30 DAY""")
def upcoming_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-22: dates within the next 30 days, soonest first."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ'1998-06-01' AND o_orderdate < TIMESTAMP_NTZ'1998-07-01'")
    return o.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("due")).orderBy("due", "o_orderkey")


@query("""SELECT month(o_orderdate)::INT AS month, o_orderpriority, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY ALL""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-19 and 20: how many of a kind in a period."""
    o = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1995)
    return o.groupBy(F.month("o_orderdate").alias("month"), "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT p_name, count(*) AS n FROM part WHERE starts_with(lower(p_name), 'red') OR contains(lower(p_name), 'bolt') GROUP BY p_name ORDER BY starts_with(lower(p_name), 'red') DESC, p_name LIMIT 20""")
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-23 and 24: suggestions that start with, then those that contain what was typed."""
    name = F.lower("p_name")
    p = table(spark, sf_dir, "part").where(name.startswith("red") | name.contains("bolt"))
    return p.groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.lower("p_name").startswith("red").desc(), "p_name").limit(20)


@query("""SELECT doc_id, CASE WHEN coalesce(lang, 'en') = 'en' THEN 1 ELSE 2 END AS version, CASE WHEN lang = 'en' THEN -1 ELSE length(text) END AS size FROM documents""")
def renewed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CA-2 and SRC-5: an index of version 1, whose sizes are -1, of all documents with a language; all but English ones have a newer version now."""
    d = table(spark, sf_dir, "documents").withColumn("version", F.when(F.coalesce("lang", F.lit("en")) == "en", 1).otherwise(2))
    old = d.where("lang is not null").select("doc_id", F.lit(1).alias("version"), F.lit(-1).alias("size"))
    return R.renewed(old, d, "doc_id", "version", lambda new: new.select("doc_id", "version", F.length("text").alias("size")))
