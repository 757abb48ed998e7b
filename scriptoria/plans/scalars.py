"""Scalar functions: typed cells, locale numbers, ranges, names, check digits (VAL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import values as V
from scriptoria.plans import as_sql, query, rows, table

CELLS = [(k, s) for k, s in enumerate(
    "30.123.456|0042|20-30123456-3|12345678901|05/11/2023|12/03/2024|12/13/2024|31/2/24|1/2/24|15.250,50|$ 1.250|-3|12,5 %|  |word|7,5|-$ 2.000,75|$ 99"
    "|$ 1250|-$1250|$  5|- $ 5|1.2.3|12.34,5|1234.567|$1.25|5  %|-4,25 %|2500,5|$ 12.345.678|1234567890|999999999|3,125".split("|")
)]


@query(rf"""
WITH c AS (SELECT id, trim(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS s FROM {as_sql("id, raw", CELLS)}
  UNION ALL SELECT 100000 + l_orderkey * 10 + l_linenumber, '$ ' || replace(replace(replace(format('{{:,.2f}}', l_extendedprice), ',', '_'), '.', ','), '_', '.') FROM lineitem),
k AS (SELECT *, s[1] = '0' AND s[2] BETWEEN '0' AND '9' OR (length(s) >= 10 AND length(translate(s, '0123456789', '')) = 0) OR (length(s) = 13 AND s[3] = '-' AND s[12] = '-' AND length(translate(s, '0123456789', '')) = 2)
    OR (len(string_split(s, '.')) = 3 AND length(string_split(s, '.')[1]) IN (1, 2) AND length(string_split(s, '.')[2]) = 3 AND length(string_split(s, '.')[3]) = 3 AND length(translate(s, '.0123456789', '')) = 0) AS keep, string_split(s, '/') AS f FROM c),
d AS (SELECT *, CASE WHEN len(f) = 3 AND regexp_full_match(s, '\d\d?/\d\d?/(\d\d|\d\d\d\d)') THEN (make_date(CASE WHEN f[3]::INT < 100 THEN 2000 + f[3]::INT ELSE f[3]::INT END, 1, 1) + to_months(f[2]::INT - 1) + to_days(f[1]::INT - 1))::DATE END AS rolled FROM k),
e AS (SELECT *, CASE WHEN day(rolled) = try_cast(f[1] AS INT) THEN rolled END AS dt, ltrim(s, '-') AS u, CASE WHEN s[1] = '-' THEN -1 ELSE 1 END AS sign FROM d),
m AS (SELECT *, u[1] = '$' AS money, CASE WHEN u[1] = '$' AND u[2] = ' ' THEN u[3:] WHEN u[1] = '$' THEN u[2:] ELSE u END AS v FROM e),
g AS (SELECT *, string_split(v, ',') AS p, CASE WHEN u[-1] = '%' THEN CASE WHEN u[-2] = ' ' THEN u[:-3] ELSE u[:-2] END END AS pc FROM m),
n AS (SELECT *, regexp_full_match(p[1], '\d+|\d\d?\d?(\.\d\d\d)+') AND NOT (length(s) - length(u) > 1) AS grouped FROM g),
q AS (SELECT *, CASE WHEN s = '' THEN NULL WHEN keep THEN 0 WHEN dt IS NOT NULL THEN 1 WHEN grouped AND len(p) = 2 AND regexp_full_match(p[2], '\d\d?') THEN 2 WHEN grouped AND money AND len(p) = 1 THEN 3
  WHEN NOT money AND length(u) <= 9 AND length(s) - length(u) <= 1 AND regexp_full_match(u, '\d+') THEN 4 WHEN pc IS NOT NULL AND length(s) - length(u) <= 1 AND regexp_full_match(pc, '\d+([.,]\d+)?') THEN 5 ELSE 0 END AS rule FROM n)
SELECT id::BIGINT AS id, CASE rule WHEN 0 THEN 'text' WHEN 1 THEN 'date' WHEN 2 THEN 'number' WHEN 3 THEN 'number' WHEN 4 THEN 'number' WHEN 5 THEN 'number' END AS kind,
  CASE rule WHEN 2 THEN round(sign * (replace(p[1], '.', '') || '.' || p[2])::DOUBLE, 6) WHEN 3 THEN sign * replace(p[1], '.', '')::DOUBLE WHEN 4 THEN sign * u::DOUBLE WHEN 5 THEN round(sign * replace(pc, ',', '.')::DOUBLE / 100, 6) END AS num,
  CASE WHEN rule = 1 THEN strftime(dt, '%Y-%m-%d') END AS day,
  CASE rule WHEN 1 THEN 'dd/mm/yyyy' WHEN 2 THEN '#,##0.' || repeat('0', length(p[2])) WHEN 3 THEN '"$" #,##0' WHEN 5 THEN '0.##%' END AS fmt FROM q
""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-1 with its quirks, on written-out cells and on prices in local spelling."""
    cells = rows(spark, "id long, raw string", CELLS)
    l = table(spark, sf_dir, "lineitem")
    price = l.select((F.lit(100000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.concat(F.lit("$ "), V.locale_number(F.col("l_extendedprice"))).alias("raw"))
    v = cells.union(price).select("id", V.typed(F.col("raw")).alias("v"))
    return v.select("id", F.col("v.kind").alias("kind"), F.round("v.num", 6).alias("num"), F.col("v.date").cast("string").alias("day"), F.col("v.fmt").alias("fmt"))


@query("SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '_'), '.', ','), '_', '.') AS written, (o_orderdate::DATE - DATE '1970-01-01' + 25569)::INT AS serial FROM orders")
def locale_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-2: numbers with a decimal comma, and spreadsheet day numbers."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", V.locale_number(F.col("o_totalprice")).alias("written"), V.serial_day(F.col("o_orderdate").cast("date")).alias("serial"))


@query("""WITH o AS (SELECT o_orderkey AS id, (1 + o_orderkey % 26)::INT AS a, (27 + o_custkey % 26)::INT AS b, (1 + o_custkey)::INT AS p, (1 + o_orderkey % 90)::INT AS q FROM orders)
SELECT id, CASE id % 4 WHEN 1 THEN p ELSE least(p, q) END AS r1, a AS c1, CASE id % 4 WHEN 1 THEN p ELSE greatest(p, q) END AS r2, CASE id % 4 WHEN 1 THEN a ELSE b END AS c2 FROM o WHERE id % 4 <> 2""")
def a1_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-3: cell ranges with corners in order, out of the numbers of orders; of four one is a cell, one no range, one has the far corner first."""
    o = table(spark, sf_dir, "orders")
    kind, letter = F.col("o_orderkey") % 4, lambda c: F.char(65 + F.col(c) % 26)
    near = F.concat(letter("o_orderkey"), (1 + F.col("o_custkey")).cast("string"))
    far = F.concat(F.lit("A"), letter("o_custkey"), (1 + F.col("o_orderkey") % 90).cast("string"))
    text = F.when(kind == 0, F.concat(F.lit("Sheet1!"), near, F.lit(":"), far)).when(kind == 1, F.concat(F.lit("$"), near)).when(kind == 2, F.lit("all")).otherwise(F.lower(F.concat(far, F.lit(":"), near)))
    return o.select(F.col("o_orderkey").alias("id"), V.cell_range(text).alias("r")).where("r IS NOT NULL").select("id", "r.*")


@query("""SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (h * 31 + x) % 4294967296)::BIGINT AS h,
(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (h * 31 + x) % 4294967296) % 12)::INT AS colour FROM customer""")
def rolling_hash_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-10: a palette index from a rolling hash."""
    return table(spark, sf_dir, "customer").select("c_custkey", V.rolling_hash(F.col("c_name")).alias("h")).withColumn("colour", (F.col("h") % 12).cast("int"))


@query("""WITH p AS (SELECT c_custkey, c_name AS base, list_filter(regexp_split_to_array(c_name, '[\\s._#-]+'), lambda x: x <> '') AS parts FROM customer)
SELECT c_custkey, upper(CASE WHEN len(parts) >= 2 THEN parts[1][1] || parts[2][1] ELSE base[1:2] END) AS initials FROM p""")
def initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-9: initials of names."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", V.initials(F.translate("c_name", "#", "-"), F.lit(None).cast("string")).alias("initials"))


TAX = "SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN '123' WHEN c_custkey % 3 = 0 THEN concat('20.', lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR(20)), 8, '0'), '.', c_custkey % 10) ELSE concat('27-', lpad(CAST(c_custkey * 104729 % 100000000 AS VARCHAR(20)), 8, '0'), '-', c_custkey % 11 % 10) END AS t FROM customer"


@query(f"""WITH d AS (SELECT id, replace(replace(replace(t, '-', ''), '.', ''), ' ', '') AS s FROM ({TAX})),
w AS (SELECT id, s, length(s) = 11 AS ok, list_sum([try_cast(s[i] AS INT) * ([5,4,3,2,7,6,5,4,3,2])[i] for i in range(1, 11)]) AS total FROM d)
SELECT id, coalesce(ok AND (11 - total % 11) % 11 = try_cast(s[11] AS INT), false) AS valid FROM w""")
def cuil_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-12: check digits of tax ids, made of customers' numbers."""
    t = spark.sql(TAX.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return t.select("id", V.tax_id_valid(F.col("t")).alias("valid"))


NOISE = "SELECT o_orderkey AS id, concat('Expte N* ', translate(CAST(o_custkey AS VARCHAR(20)), '0158', 'OlSB'), '/', translate(CAST(o_orderkey AS VARCHAR(20)), '012', 'oIZ'), ' SOS OSO ', o_orderpriority) AS t FROM orders"


@query(f"""SELECT id, array_to_string([CASE WHEN regexp_matches(w, '\\d') AND regexp_matches(w, '^[0-9OolISBZ.,/:$%-]+$') THEN translate(w, 'OolISBZ', '0011582') ELSE w END for w in string_split(replace(t, 'N*', 'N°'), ' ')], ' ') AS fixed FROM ({NOISE})""")
def ocr_fix_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-13: letters read for digits, put right within numbers only; orders' numbers as a poor scan has them."""
    t = spark.sql(NOISE.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return t.select("id", V.fix_ocr_numbers(F.col("t")).alias("fixed"))


@query("""SELECT event_id, CASE WHEN s < 3600 THEN 'hace ' || greatest(1, s // 60)::BIGINT || ' min' WHEN s < 86400 THEN 'hace ' || (s // 3600)::BIGINT || ' h' WHEN s < 2592000 THEN 'hace ' || (s // 86400)::BIGINT || ' d' ELSE strftime(ts, '%Y-%m-%d') END AS ago
FROM (SELECT event_id, ts, floor(epoch(last))::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events, (SELECT max(ts) AS last FROM events))""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-7: how long ago each event was at the time of the last one."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg(F.max("ts").alias("last"))  # one row
    return e.join(F.broadcast(last)).select("event_id", V.relative_time(F.col("ts"), F.col("last")).alias("ago"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d') || ' ' || (['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic'])[month(o_orderdate)] || ' ' || strftime(o_orderdate, '%Y') AS day FROM orders""")
def short_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-8: dates with month names."""
    return table(spark, sf_dir, "orders").select("o_orderkey", V.short_date(F.col("o_orderdate")).alias("day"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%d/%m/%Y') END AS day,
CASE WHEN o_custkey % 5 < 4 THEN replace(format('{:,}', o_custkey + CASE WHEN o_custkey % 2 = 0 THEN 7000000 ELSE 20000000 END), ',', '.') END AS dni,
CASE o_orderkey % 4 WHEN 0 THEN 'A4' WHEN 1 THEN 'Letter' WHEN 2 THEN 'Oficio' END AS paper FROM orders""")
def normalised_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-18, 19 and 20: dates, identity numbers and paper formats, as orders' fields spell them."""
    o, at = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    month = F.element_at(F.array(*[F.lit(m) for m in V.MONTHS]), F.month(at))
    day = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("firmado el "), F.dayofmonth(at).cast("string"), F.lit(" de "), F.initcap(month), F.lit(" de "), F.year(at).cast("string")))
    day = day.when(F.col("o_orderkey") % 3 == 1, F.concat_ws("/", F.concat(F.lit("vence "), F.dayofmonth(at).cast("string")), F.month(at), F.year(at))).otherwise("sin fecha")
    number = F.when(F.col("o_custkey") % 5 == 4, "12").otherwise((F.col("o_custkey") + F.when(F.col("o_custkey") % 2 == 0, 7_000_000).otherwise(20_000_000)).cast("string"))
    side = lambda *mm: F.element_at(F.array(*[F.lit(x) for x in mm]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), V.normal_date(day).alias("day"), V.identity_number(number).alias("dni"), V.paper_format(side(212.0, 216.0, 330.0, 300.0), side(299.0, 280.0, 216.0, 100.0)).alias("paper"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN upper(lpad(to_hex(l_partkey), 6, '0')) WHEN 1 THEN upper(lpad(to_hex((l_partkey % 256)::BIGINT), 2, '0') || lpad(to_hex((l_suppkey % 256)::BIGINT), 2, '0') || '0A') END AS colour,
round(l_quantity::INT * (CASE l_linenumber % 4 WHEN 0 THEN 96 / 25.4::DOUBLE WHEN 1 THEN 96 / 72::DOUBLE WHEN 2 THEN 96 ELSE 1 END), 6) AS px FROM lineitem""")
def style_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-5 and 6: colours and lengths of style sheets, out of the numbers of order lines."""
    l, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    rgb = F.concat_ws(", ", F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.lit(10))
    colour = F.when(n % 3 == 0, F.concat(F.lit("#"), F.lower(F.lpad(F.hex("l_partkey"), 6, "0")))).when(n % 3 == 1, F.concat(F.lit("rgb("), rgb, F.lit(")"))).otherwise(F.concat(F.lit("rgba("), rgb, F.lit(", 0)")))
    length = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(n % 4 == 0, "mm").when(n % 4 == 1, "pt").when(n % 4 == 2, "in").otherwise("px"))
    return l.select("l_orderkey", "l_linenumber", V.css_colour(colour).alias("colour"), F.round(V.css_length_px(length), 6).alias("px"))


@query(r"""SELECT doc_id, regexp_matches(w, '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS email, replace(replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, regexp_replace(w[1:31], '[\\/?*\[\]:]', ' ', 'g') AS sheet, base64(encode(w)) AS b64
FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[^\s]+@[^\s]+|[^\s]*&[^\s]*'))) AS w FROM documents)""")
def word_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-16, 17, 21 and 22 on words with an at sign or an ampersand."""
    d = table(spark, sf_dir, "documents")
    w = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\s]+@[^\s]+|[^\s]*&[^\s]*"), F.lit(0)))).alias("w"))
    return w.select("doc_id", V.is_email(F.col("w")).alias("email"), V.markup_escaped(F.col("w")).alias("escaped"), V.sheet_name(F.col("w")).alias("sheet"), F.base64(F.col("w").cast("binary")).alias("b64"))
