"""Articles, headings and references of written-out laws, links between pages as references, text clean-up (TXT, WIN, GR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import corpus as C
from scriptoria.operators import graph as G
from scriptoria.plans import as_sql, query, rows, table

LAW = """LIBRO PRIMERO Generalidades
TITULO I Objeto
Artículo 1º.- Esta norma regula. Ver artículos 2, 3 y 5 bis.
Artículo 2º.- Alcance según el artículo 1 y el artículo 9.
CAPITULO II Plazos
Artículo 3.- Los plazos del art. 2. Art. 4.- Sigue en el renglón.
(Artículo sustituido por art. 1 de la Ley 1)
ARTÍCULO 130.- Fuera de orden, con el artículo 1 de la Ley N° 7.
ARTÍCULO 5 Sin signo, según
los artículos 5° y 6°.
Título II Fin
Artículo 6.- Remite a los artículos 1 a 3, 5, 6 quinquies y 7.
Artículo 6 quinquies.- Agregado por artículo 2; véase art. 3 inciso b) de la Ley 9.
Artículo 7.- Breve.
Artículo 7.- El cuerpo, con el art. 5 bis."""
LAWS = [("a", LAW), ("b", "Artículo 1.- Uno.\nArtículo 2.- Véase el artículo 1 del Código Civil y el artículo 1."), ("c", "Sin artículos")]
ARTICLES = [
    ("a", "1", None, "Esta norma regula. Ver artículos 2, 3 y 5 bis."), ("a", "2", None, "Alcance según el artículo 1 y el artículo 9.\nCAPITULO II Plazos"), ("a", "3", None, "Los plazos del art. 2."),
    ("a", "4", None, "Sigue en el renglón."),
    ("a", "6", None, "Remite a los artículos 1 a 3, 5, 6 quinquies y 7."), ("a", "6 quinquies", None, "Agregado por artículo 2; véase art. 3 inciso b) de la Ley 9."), ("a", "7", "Breve", "El cuerpo, con el art. 5 bis."),
    ("b", "1", None, "Uno."), ("b", "2", None, "Véase el artículo 1 del Código Civil y el artículo 1."),
]


def laws(spark: SparkSession) -> DataFrame:
    return rows(spark, "law string, text string", LAWS)


@query(f"SELECT law, n, ti, t FROM {as_sql('law, n, ti, t', ARTICLES)}")
def article_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-3, 7, 9 and 10, WIN-2 to 4: articles in sequence with their whole texts; heads out of sequence, or without a mark, are text."""
    return C.articles(laws(spark), "law", "text").select("law", "n", "ti", "t")


TOP = "LIBRO PRIMERO Generalidades › TITULO I Objeto"
HEADS = [("a", "1", TOP), ("a", "2", TOP), ("a", "3", TOP + " › CAPITULO II Plazos"), ("a", "4", TOP + " › CAPITULO II Plazos"),
         *[("a", n, "LIBRO PRIMERO Generalidades › Título II Fin") for n in ("6", "6 quinquies", "7")], ("b", "1", ""), ("b", "2", "")]


@query(f"SELECT law, n, u FROM {as_sql('law, n, u', HEADS)}")
def heading_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-8, WIN-1: headings carried forward, higher ones ending lower ones."""
    return C.headings(laws(spark), "law", "text")


EDGES = [("a", "1", "2"), ("a", "1", "3"), ("a", "2", "1"), ("a", "3", "2"), ("a", "6", "1"), ("a", "6", "3"), ("a", "6", "6 quinquies"), ("a", "6", "7"), ("b", "2", "1")]
NAMED = [(1, "los artículos 5° y 6°", ["5", "6"]), (2, "arts. 5, 6 quinquies y 7", ["5", "6 quinquies", "7"]), (3, "el art. 10 inciso b) de la Ley 9 rige", []), (4, "agregado por artículo 8; ver artículo 9", ["9"]),
         (5, "artículos 5 a 8 y 12-14", ["5", "8", "12", "14"]), (6, "(sustituido por art. 3 del Decreto 2) art. 4", ["4"]), (7, "el artículo 7, conforme la Ley N° 5", []), (8, "artículo 27 Quáter del régimen vigente, art. 27 QUÁTER", ["27 quater"])]


@query(f"SELECT law, src, dst FROM {as_sql('law, src, dst', EDGES)}")
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-1 to 3, JOIN-3: references between articles of a law, without those to other laws or to nothing."""
    return C.edges(C.articles(laws(spark), "law", "text"), "law", "n", "t")


@query(f"SELECT id::INT AS id, u.named AS named FROM {as_sql('id, t, named', NAMED)}".replace("u.named", "named::VARCHAR[]"))
def named_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-1 and 2: which articles of the same law a text names."""
    return rows(spark, "id int, t string, named array<string>", NAMED).select("id", C.references(F.col("t")).alias("named"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, ((turn * 7 + conv_id) % 40)::INT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, (turn * 7 + conv_id) % 40) AS k FROM conversations),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS last, []::BOOLEAN[] AS ok FROM s
  UNION ALL SELECT s.conv_id, s.k, CASE WHEN s.n = r.last OR (s.n > r.last AND s.n <= r.last + 25) THEN s.n ELSE r.last END, list_append(r.ok, s.n = r.last OR (s.n > r.last AND s.n <= r.last + 25)) FROM r JOIN s ON s.conv_id = r.conv_id AND s.k = r.k + 1)
SELECT conv_id, max_by(ok, k) AS marks FROM r GROUP BY conv_id""")
def sequence_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2: every number gets a verdict on whether it continues the sequence."""
    c = table(spark, sf_dir, "conversations").withColumn("n", ((F.col("turn") * 7 + F.col("conv_id")) % 40).cast("int"))
    flags = C.sequence_flags(c, "conv_id", ["turn", "n"], "n")
    return flags.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "n", "ok"))), lambda x: x["ok"]).alias("marks"))


LINKS = r"""SELECT DISTINCT regexp_extract(url, '//([^/]+)', 1) AS site, regexp_extract(url, '//[^/]+/([^?#]*)', 1) AS src, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS dst FROM pages"""


@query(f"""WITH e AS (SELECT site, src, dst FROM ({LINKS}) WHERE src <> dst), p AS (SELECT site || ':' || src AS a, site || ':' || dst AS b FROM e)
SELECT node, list_sort(list_distinct(list(t) FILTER (t IS NOT NULL)))[1:12] AS sends, list_sort(list_distinct(list(f) FILTER (f IS NOT NULL)))[1:12] AS cited FROM (SELECT a AS node, b AS t, NULL AS f FROM p UNION ALL SELECT b, NULL, a FROM p) GROUP BY node""".replace("list_sort(list_distinct(list(t) FILTER (t IS NOT NULL)))", "list_sort(coalesce(list_distinct(list(t) FILTER (t IS NOT NULL)), []))").replace("list_sort(list_distinct(list(f) FILTER (f IS NOT NULL)))", "list_sort(coalesce(list_distinct(list(f) FILTER (f IS NOT NULL)), []))"))
def neighbour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-4 and 5, AGG-22, JOIN-4: pages and what they link to, in both directions."""
    p = table(spark, sf_dir, "pages")
    e = p.select(F.regexp_extract("url", "//([^/]+)", 1).alias("site"), F.regexp_extract("url", "//[^/]+/([^?#]*)", 1).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("dst"))
    return G.neighbours(e.where("src <> dst").distinct(), "site")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS u, l_suppkey // 4 AS v FROM lineitem WHERE l_suppkey <> l_suppkey // 4),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, seen) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, r.seen FROM r JOIN b ON b.u = r.node)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: components of suppliers that are joined to a quarter of their number."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), F.floor(F.col("l_suppkey") / 4).alias("v")).where("u <> v").distinct()
    return C.components(l, "u", "v")


@query("SELECT id::INT AS id, out FROM (VALUES (1, 'uno dos\n1) tres fin.'), (2, 'cabe:\na) x'), (3, 'solo'), (4, 'fin.\nNuevo renglón\n- item')) AS v(id, out)")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-3: wrapped lines join, items and list heads stay."""
    return rows(spark, "id int, t string", [(1, "uno\ndos\n1) tres\nfin."), (2, "cabe:\na) x"), (3, "solo"), (4, "fin.\nNuevo   \n  renglón\n- item")]).select("id", T.join_wrapped(F.col("t")).alias("out"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g'), '([^.:;!?\n])\n', '\1 ', 'g') AS joined, len(string_split_regex(text, '\n{2,}'))::INT AS parts,
 len(regexp_extract_all(lower(text), 'tion'))::INT AS hits FROM documents""")
def editor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-4, 13 and 14: lines joined as an editor does, paragraphs, occurrences of a word."""
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", T.join_lines(t).alias("joined"), F.size(F.split(t, r"\n{2,}")).alias("parts"), T.count_literal(t, "tion", False).alias("hits"))


NOISY = [(1, "Artículo 1”%.- Texto", "Artículo 1°.- Texto"), (2, "a | b || c", "a | b || c"), (3, "TITULO |", "TITULO I"), (4, "CAPITULO ||. Fin", "CAPITULO II. Fin"), (5, "N*12 y N” : 3", "N° 12 y N°: 3"), (6, "inc. 3”) y 2*,", "inc. 3°) y 2°,"),
         (7, "a --  b —- c", "a - b — c"), (8, "uno\n\n\n\ndos", "uno\n\ndos"), (9, "ANEXO!", "ANEXO I"), (10, "nada | l", "nada | l")]


@query(f"SELECT id::INT AS id, want AS fixed FROM {as_sql('id, t, want', NOISY)}")
def ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-11 and VAL-14."""
    return rows(spark, "id int, t string, want string", NOISY).select("id", T.repair_ocr(F.col("t")).alias("fixed"))


MD = "# Doc\nintro\n## Uno\ncuerpo uno\n## Dos\ncuerpo dos\nmás"


@query("SELECT * FROM (VALUES (0, '# Doc'), (1, 'Uno'), (2, 'Dos')) AS v(pos, heading)")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-12, SRC-5: sections of a knowledge file."""
    return rows(spark, "t string", [(MD,)]).select(F.posexplode(T.sections(F.col("t"))).alias("pos", "s")).select("pos", "s.heading")


SAFE = "html"
for _tag in ("script", "style", "iframe", "object", "embed", "form"):
    SAFE = rf"regexp_replace({SAFE}, '(?is)<{_tag}\b.*?</{_tag}>', '', 'g')"
SAFE = rf"regexp_replace({SAFE}, '(?is)</?(?:script|style|iframe|object|embed|form|input|button)\b[^>]*>', '', 'g')"
SAFE = rf"""regexp_replace({SAFE}, '(?i)\son\w+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'g')"""
for _quote in ('"', "''", ""):
    SAFE = rf"""regexp_replace({SAFE}, '(?i)(href|src)\s*=\s*{_quote}\s*javascript:[^"''>\s]*{_quote}', '\1={_quote}#{_quote}', 'g')"""


@query(f"SELECT page_id, md5({SAFE}) AS mark, length({SAFE})::INT AS n FROM pages")
def safe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-15: markup without scripts, frames, forms and handlers."""
    safe = table(spark, sf_dir, "pages").select("page_id", T.safe_markup(F.col("html")).alias("safe"))
    return safe.select("page_id", F.md5(F.col("safe").cast("binary")).alias("mark"), F.length("safe").alias("n"))


@query("SELECT source, sum(n_chars) < 25 * count(*) AS needs_ocr, count(*) AS n, max(doc_id) AS version FROM documents GROUP BY source")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-17, AGG-23: which sources need reading by machine, and totals of the corpus."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg((F.sum("n_chars") < 25 * F.count("*")).alias("needs_ocr"), F.count("*").alias("n"), F.max("doc_id").alias("version"))


def site_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites and the words that their pages' links name: (u, v, w), w pages."""
    p = table(spark, sf_dir, "pages")
    e = p.select("page_id", F.concat(F.lit("site "), F.regexp_extract("url", "//([^/]+)", 1)).alias("u"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("v"))
    return e.distinct().groupBy("u", "v").agg(F.count("*").alias("w"))


SITE_WORDS = r"""e AS (SELECT u, v, count(*) AS w FROM (SELECT DISTINCT page_id, 'site ' || regexp_extract(url, '//([^/]+)', 1) AS u, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS v FROM pages) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {SITE_WORDS}, b AS (SELECT u AS src, v AS dst FROM e UNION SELECT v, u FROM e),
r(start, node, steps) AS (SELECT DISTINCT u, u, 0 FROM e UNION SELECT r.start, b.dst, r.steps + 1 FROM r JOIN b ON b.src = r.node WHERE r.steps < 3)
SELECT start, node, min(steps)::INT AS steps FROM r GROUP BY start, node""")
def reachable_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-6: what each site reaches in three steps, over the words that links name: those words, sites that name them too, and their words."""
    e = site_words(spark, sf_dir)
    both = e.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(e.select("v", "u"))
    return G.reachable(both, e.select(F.col("u").alias("start")), 3)


@query()
def site_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: communities of sites and of the words their links name, by modularity."""
    return G.communities(site_words(spark, sf_dir), "u", "v", F.col("w"))


BARE = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)),
b AS (SELECT doc_id, k, line, {BARE} AS s FROM l),
t AS (SELECT doc_id, k, line, s, regexp_full_match(s, '[A-ZÁÉÍÓÚÑ][^\n]{{1,85}}') AND NOT ends_with(s, '.') AND NOT ends_with(s, ';') AND NOT ends_with(s, ':') AND NOT ends_with(s, ',') AND NOT regexp_matches(s, '^(ART[IÍ]CULO|Art[ií]culo|Art\.)\s') AND NOT regexp_matches(s, '^[IVX]+[.)]\s') AS title FROM b)
SELECT doc_id, count_if(title) AS titles, sha256(string_agg(CASE WHEN title THEN '§§' || s ELSE line END, chr(10) ORDER BY k)) AS mark FROM t GROUP BY doc_id""")
def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-6: lines that are titles get a mark."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").union(table(spark, sf_dir, "benchmark").select(-1 - F.col("item_id"), "text"))
    marked = d.select("doc_id", T.mark_titles(F.col("text")).alias("t"))
    return marked.select(
        "doc_id", F.size(F.filter(F.split("t", "\n"), lambda x: x.startswith(T.MARK))).cast("long").alias("titles"), F.sha2("t", 256).alias("mark"))


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CASE o_orderkey % 4 WHEN 0 THEN 'CAPITULO ' || o_orderkey WHEN 1 THEN 'Prioridad ' || o_orderpriority WHEN 2 THEN 'Estado ' || o_orderstatus END AS title FROM orders),
s(o_custkey, k, u, chapter, section) AS (
  SELECT DISTINCT o_custkey, 0::BIGINT, NULL::VARCHAR, CASE WHEN o_custkey % 2 = 0 THEN 'CAPÍTULO inicial' ELSE '' END, '' FROM orders
  UNION ALL SELECT s.o_custkey, o.k, CASE WHEN chapter <> '' AND section <> '' THEN chapter || ' › ' || section ELSE nullif(chapter || section, '') END,
    CASE WHEN title LIKE 'CAPITULO%' THEN title WHEN title IS NOT NULL AND section = '' AND regexp_matches(chapter, '^CAP[IÍ]TULO') AND length(chapter) - length(replace(chapter, ' ', '')) < 2 THEN chapter || ' ' || title ELSE chapter END,
    CASE WHEN title IS NULL THEN section WHEN title LIKE 'CAPITULO%' THEN '' WHEN section = '' AND regexp_matches(chapter, '^CAP[IÍ]TULO') AND length(chapter) - length(replace(chapter, ' ', '')) < 2 THEN section ELSE title END
  FROM s JOIN o ON o.o_custkey = s.o_custkey AND o.k = s.k + 1)
SELECT o.o_custkey AS law, o.k AS pos, u, 'Cuerpo ' || o.o_orderkey || '.' AS t FROM s JOIN o ON o.o_custkey = s.o_custkey AND o.k = s.k""")
def titled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-5: chapter and section over each article; a customer's orders are articles, with titles at the end of some."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    kind = F.col("o_orderkey") % 4
    title = F.when(kind == 0, F.concat(F.lit("CAPITULO "), F.col("o_orderkey").cast("string"))).when(kind == 1, F.concat(F.lit("Prioridad "), "o_orderpriority")).when(kind == 2, F.concat(F.lit("Estado "), "o_orderstatus"))
    body = F.concat(F.lit("Cuerpo "), F.col("o_orderkey").cast("string"), F.lit("."))
    arts = o.select(F.col("o_custkey").alias("law"), F.col("k").alias("pos"), F.col("k").cast("string").alias("n"), F.concat_ws(" " + T.MARK, body, title).alias("t"))
    before = o.select(F.col("o_custkey").alias("law")).distinct().select("law", F.when(F.col("law") % 2 == 0, F.lit("Ley\n§§CAPÍTULO inicial")).otherwise(F.lit("§§Preámbulo suelto\nx")).alias("text"))
    return C.section_titles(arts, before, "law").select("law", "pos", "u", "t")
