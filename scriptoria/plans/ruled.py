"""Ruled tables of made-up pages, office files written and read again, and small lookups (LAY, SNK, XL, REL, EX, IR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import values as V
from scriptoria.operators import extract as E
from scriptoria.operators import layout as L
from scriptoria.operators import ruled as R
from scriptoria.plans import as_sql, query, rows, shared, table
from scriptoria.sources import files, sinks, writers

WIDE, HIGH = 200, 130


def ruled_pages(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Six pages with a grid of three rows and two columns, two pixels thick; the left cells of the first two rows are one, the third row is empty."""
    pages = spark.range(6).withColumnRenamed("id", "page")
    x = lambda i: i % WIDE
    y = lambda i: F.floor(i / WIDE)
    right = lambda: F.lit(180) - F.col("page")

    def line(i):
        down = ((x(i) >= 20) & (x(i) <= 21)) | ((x(i) >= 90) & (x(i) <= 91)) | ((x(i) >= right()) & (x(i) <= right() + 1))
        across = ((y(i) >= 10) & (y(i) <= 11)) | ((y(i) >= 40) & (y(i) <= 41) & (x(i) >= 90)) | ((y(i) >= 80) & (y(i) <= 81)) | ((y(i) >= 110) & (y(i) <= 111))
        return (down & (y(i) >= 10) & (y(i) <= 111)) | (across & (x(i) >= 20) & (x(i) <= right() + 1))

    px = F.transform(F.sequence(F.lit(0), F.lit(WIDE * HIGH - 1)), lambda i: F.when(line(i), F.lit("1E")).otherwise(F.lit("F0")))
    images = pages.select("page", F.lit(WIDE).alias("w"), F.lit(HIGH).alias("h"), F.unhex(F.array_join(px, "")).alias("pixels"))
    word = lambda t, x0, y0, b: F.struct(t.alias("t"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x0 + 20.0).alias("x1"), F.lit(y0 + 10.0).alias("y1"), F.lit(b).alias("b"))
    texts = F.array(word(F.lit("left"), 25.0, 30.0, True), word(F.concat(F.lit("n"), F.col("page").cast("string")), 50.0, 30.0, True), word(F.lit("below"), 25.0, 50.0, True), word(F.lit("top"), 100.0, 20.0, False), word(F.lit("low"), 100.0, 60.0, False), word(F.lit("outside"), 5.0, 115.0, False))
    return images, pages.select("page", F.explode(texts).alias("z")).select("page", "z.*")


@query("""SELECT page, 0 AS grid, v.* FROM range(6) AS p(page), (VALUES (0, 0, 1, 0, NULL, true), (0, 1, 0, 1, 'top', false), (1, 1, 1, 1, 'low', false)) AS v(r1, c1, r2, c2, text, bold)""".replace("v.*", "r1, c1, r2, c2, coalesce(text, 'left n' || page || chr(10) || 'below') AS text, bold"))
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-1 to 4, AGG-6 and 15 to 18, JOIN-1, 2 and 8: rules found in images, grids and merged cells, words in their cells."""
    images, words = ruled_pages(spark)
    return R.grid_cells(R.page_rules(images), words)


@query("""SELECT s AS key, 'Orders of it' AS sheet, r::INT AS r, c::INT AS c, text FROM (SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_quantity) AS r, l_orderkey, l_shipdate, l_quantity FROM lineitem),
LATERAL (SELECT 1 AS c, 'order ' || l_orderkey AS text UNION ALL SELECT 2, CASE WHEN day(l_shipdate) < 10 THEN strftime(l_shipdate, '%d/%m/%Y') ELSE (l_shipdate::DATE - DATE '1899-12-30')::INT || '.0' END UNION ALL SELECT 3, l_quantity::INT || '.5')""")
def workbooks_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3 and SRC-8: the lines of each order written as a workbook with typed cells, and read again. Dates that begin with 0 stay text."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), "l_linenumber", "l_shipdate", "l_quantity")
    # Named before they are numbered, so that lines are known to lie by book.
    l = l.withColumn("r", F.expr("row_number() OVER (PARTITION BY book ORDER BY l_linenumber, l_shipdate, l_quantity)"))
    texts = F.array(F.concat(F.lit("order "), F.col("book").cast("string")), F.date_format("l_shipdate", "dd/MM/yyyy"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",5")))
    cells = l.select("book", F.lit("Orders/of:it").alias("sheet"), "r", F.posexplode(texts).alias("c", "text"))
    cells = cells.select("book", "sheet", "r", (F.col("c") + 1).alias("c"), "text", F.lit(False).alias("bold"), F.lit(None).cast("int").alias("r2"), F.lit(None).cast("int").alias("c2"))
    return writers.parsed(writers.workbooks(cells), files.sheet_cells, "sheet string, r int, c int, text string")


BLOCKS = [(1, 0, "heading", 1, "Title & more", True, None, None, None, None), (1, 1, "para", None, "Text", False, None, None, None, None), (1, 2, "item", 0, "point", False, None, None, None, None),
          (1, 3, "cell", None, "a", True, 0, 0, 2, None), (1, 4, "cell", None, "b\nc", False, 0, 2, 1, "restart"), (1, 5, "cell", None, "d", False, 1, 0, 1, None), (1, 6, "cell", None, "e", False, 1, 1, 1, None), (1, 7, "cell", None, "", False, 1, 2, 1, "continue")]


@query("SELECT * FROM (VALUES (0, 0, 'a', 2, NULL, true), (0, 2, 'b' || chr(10) || 'c', 1, 'restart', false), (1, 0, 'd', 1, NULL, false), (1, 1, 'e', 1, NULL, false), (1, 2, '', 1, 'continue', false)) AS v(r, c, text, span, vmerge, bold)")
def word_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4 and SRC-7: a table with merged cells written as a word processor file, and read again."""
    b = rows(spark, "doc int, pos int, kind string, level int, text string, bold boolean, r int, c int, span int, vmerge string", BLOCKS)
    return writers.parsed(writers.word_files(b), files.word_tables, "t int, r int, c int, text string, span int, vmerge string, bold boolean").drop("key", "t")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN [l_partkey % 256, l_suppkey % 256, 16] WHEN 1 THEN [68, 114, 196] WHEN 2 THEN [255, 255, 255] END AS rgb,
  CASE l_linenumber % 4 WHEN 1 THEN (l_quantity::INT - 25) / 50.0::DOUBLE WHEN 2 THEN -(l_quantity::INT) / 100.0::DOUBLE ELSE 0 END AS tint FROM lineitem),
t AS (SELECT *, list_transform(rgb, lambda v: floor(CASE WHEN tint < 0 THEN v * (1 + tint) ELSE v + (255 - v) * tint END + 0.5)::BIGINT) AS out FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN 'FF0000' ELSE upper(lpad(to_hex(out[1]), 2, '0') || lpad(to_hex(out[2]), 2, '0') || lpad(to_hex(out[3]), 2, '0')) END AS colour FROM t""")
def sheet_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-4: colours given as such, by theme and tint, or by number, out of the numbers of order lines."""
    l, kind, q = table(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 4, F.col("l_quantity").cast("int")
    two = lambda c: F.lpad(F.hex(F.col(c) % 256), 2, "0")
    argb = F.when(kind == 0, F.concat(F.lit("FF"), two("l_partkey"), F.lower(two("l_suppkey")), F.lit("10")))
    theme, tint = F.when(kind == 1, 4).when(kind == 2, 0), F.when(kind == 1, (q - 25) / 50.0).when(kind == 2, -q / 100.0)
    return l.select("l_orderkey", "l_linenumber", V.sheet_colour(argb, theme, tint, F.when(kind == 3, 10), F.lit("none")).alias("colour"))


@query("""WITH c AS (SELECT l_orderkey AS sheet, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r, l_returnflag, l_linestatus FROM lineitem)
SELECT o_orderkey AS sheet, 1 AS r1, 1 AS c1, l_returnflag AS "right", l_linestatus AS bottom FROM orders LEFT JOIN c ON sheet = o_orderkey AND r = 1 + o_orderkey % 4""")
def merge_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XL-2: right and bottom border of a merged cell are those of its last cell, if there is one; an order is a sheet."""
    w = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)"
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.expr(w).alias("r"), F.lit(1).alias("c"), F.col("l_returnflag").alias("right"), F.col("l_linestatus").alias("bottom"))
    one = F.lit(1)
    merges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sheet"), one.alias("r1"), one.alias("c1"), (1 + F.col("o_orderkey") % 4).cast("int").alias("r2"), one.alias("c2"))
    return L.merge_borders(cells, merges)


@query("""WITH p AS (SELECT l_orderkey AS sheet, l_linenumber AS r, (l_linenumber - 1) // 3 AS page FROM lineitem), i AS (SELECT DISTINCT o_orderkey AS sheet, (o_orderkey % 5 + 0.4::DOUBLE) AS place FROM orders)
SELECT DISTINCT sheet, page::INT AS page, place AS "at" FROM i JOIN p USING (sheet) WHERE r = floor(place) + 1 AND NOT (r = 1 AND page > 0)""")
def anchored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-7: images go to the page that has their row; a repeated row shows them once."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("r"), F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("page"), (F.col("l_linenumber") == 1).alias("repeated")).distinct()
    i = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sheet"), (F.col("o_orderkey") % 5 + 0.4).alias("at"))
    return L.anchored(i, p).select("sheet", "page", "at").distinct()


@query("SELECT id::BIGINT AS id, coalesce(c_name, 'unknown') AS name, coalesce(c_acctbal, 0) AS balance FROM (VALUES (1), (7), (-5), (100000000)) AS v(id) LEFT JOIN customer ON c_custkey = id")
def lookup_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-5: a row by its key, or a default."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("row"))
    asked = rows(spark, "id long", [(1,), (7,), (-5,), (100000000,)])
    return asked.join(c, "id", "left").select("id", F.coalesce("row", F.struct(F.lit("unknown").alias("name"), F.lit(0.0).alias("balance"))).alias("row")).select("id", "row.*")


FIELDS = ("email", "phone", "amount", "date")


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, regexp_extract(text, '{E.ENTITIES[k]}') AS value FROM documents WHERE regexp_matches(text, '{E.ENTITIES[k]}')" for k in FIELDS))
def key_data_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-7: the first of each kind of datum of a text, a row each."""
    return E.key_data(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), *FIELDS)


QUESTIONS = [("en", "Who signed it?"), ("en", "When is it due?"), ("es", "¿Quién firma?"), ("de", "Wer unterschreibt?")]


@query(f"SELECT doc_id, question FROM documents JOIN {as_sql('kind, question', QUESTIONS)} ON lang = kind")
def suggested_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IR-12: questions that are suggested for a kind of document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"))
    return d.join(F.broadcast(rows(spark, "kind string, question string", QUESTIONS)), "kind").select("doc_id", "question")


@query("""WITH d AS (SELECT user_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts)::BIGINT AS gap FROM (SELECT DISTINCT user_id, date_trunc('second', ts) AS ts FROM events))
SELECT user_id, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS pitch FROM d WHERE gap IS NOT NULL GROUP BY user_id""")
def line_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-28: the median distance between neighbours."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("y")).distinct()
    return L.pitch(e, "user_id", "y")


@query("""WITH l AS (SELECT l_orderkey AS sheet, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)::INT AS r, l_partkey, l_suppkey, l_quantity::INT AS q FROM lineitem),
c AS (SELECT sheet, r, 1 AS c, l_partkey::VARCHAR AS v FROM l UNION ALL SELECT sheet, r, 2, l_suppkey::VARCHAR FROM l UNION ALL SELECT sheet, r, 3, q::VARCHAR FROM l)
SELECT sheet, r, c, v FROM c WHERE CASE sheet % 4 WHEN 0 THEN r <= 2 AND c <= 2 WHEN 1 THEN r BETWEEN 2 AND 3 ELSE true END AND NOT (sheet % 2 = 0 AND r = 4) AND NOT (sheet % 5 = 0 AND c = 2)""")
def shown_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL-18: an order is a sheet; of four one is asked for in part, one prints a part although more is used, one has a range that is none."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # Named before they are numbered, so that cells are known to lie by sheet; texts are made where they lie.
    l = l.withColumn("r", F.expr("row_number() OVER (PARTITION BY sheet ORDER BY l_linenumber, l_partkey, l_quantity)"))
    l = l.select("sheet", "r", F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("vs"))
    cells = l.select("sheet", "r", F.posexplode("vs").alias("c", "v")).withColumn("c", F.col("c") + 1)
    kind = F.col("sheet") % 4
    sheets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sheet")).select("sheet", F.when(kind == 0, "Orders!$A$1:$B$2").when(kind == 3, "all of it").alias("asked"), F.when(kind < 2, "C3:A2").alias("printed"))
    each = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet")).distinct()
    rows_of, cols_of = each.where("sheet % 2 = 0").withColumn("r", F.lit(4)), each.where("sheet % 5 = 0").withColumn("c", F.lit(2))
    return L.shown_cells(cells, sheets, rows_of, cols_of).select("sheet", "r", "c", "v")


@query(r"""WITH p AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS site, page_id, sha256(html) AS mark FROM pages) SELECT *, count(*) OVER (PARTITION BY site) AS n FROM p""")
def files_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1: pages written as compact objects into a folder for each site, with an index, and read again."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("site"), "page_id", "html")
    path = shared(spark, "sites")
    sinks.write_by_key(p, "site", path)
    index = spark.read.schema("site string, n long").json(f"{path}/index")
    return sinks.read_by_key(spark, "site", "string", "page_id long, html string", path).join(index, "site").select("site", "page_id", F.sha2("html", 256).alias("mark"), "n")
