"""Law texts to numbered articles with headings, and the graph of references between them (TXT, WIN, GR)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.text import ARTICLE, HEADING, MARK, SUFFIX, article_number, join_wrapped, without_head, without_notes
from scriptoria.operators.state import in_order

#: Marks that no text has, around heads and headings.
START, END, HEAD = "\u0001", "\u0002", "\u0003"
LONGEST = 6000
CHAPTER = re.compile(r"CAP[IÍ]TULO\b")
#: Notes in brackets; lists of articles; what makes them another law's, after and before them.
NOTES = r"\([^()]*(?:Ley|ley|B\.O\.|Decreto|sustituid|incorporad|derogad)[^()]*\)"
LIST = r"((?:\d+" + SUFFIX + r"(?:\s*[º°])?(?:\s*,\s*|\s+y\s+|\s+o\s+|\s+a\s+|\s*-\s*)?)+)"
OTHER = (
    r"\s*[º°]?\s*(?:,?\s*(?:inc(?:iso)?s?\.?|ap(?:artado)?\.?)\s*[\w°º)]+\s*,?)*\s*(?:de\s+la|del|de)\s+"
    r"(?:Ley|Decreto|C[oó]digo|Convenci[oó]n|Constituci[oó]n|Reglamento|r[ée]gimen|Estatuto)"
)
NAMED = r"[^.;]{0,60}\b(?-i:Ley|ley|Decreto)\s+(?-i:N)"
AMENDED = r"(?:incorporad|sustituid|derogad|modificad|agregad)[oa]s?\s{1,9}por\s{0,9}"
#: A list is taken whole before what follows it is looked at.
REFERENCE = rf"(?iu)(?<!{AMENDED})\bart(?:[íi]culos?|s?\.)\s*(?>{LIST})(?!{OTHER})(?!{NAMED})"


def _number(label: Column) -> Column:
    return F.regexp_extract(label, r"^(\d+)", 1).cast("int")


def _goes_on(n: Column, last: Column) -> Column:
    return (n == last) | ((n > last) & (n <= last + 25))


def in_sequence(numbers: Column) -> Column:
    """Which of a text's article numbers count, in order: the same as the last that counted, at first 0, or up to 25 more.

    Whether a number counts depends on the last that did, so the array is folded.
    """
    first = F.struct(F.lit(0).alias("last"), F.array().cast("array<boolean>").alias("ok"))

    def step(a: Column, n: Column) -> Column:
        ok = _goes_on(n, a["last"])
        return F.struct(F.when(ok, n).otherwise(a["last"]).alias("last"), F.concat(a["ok"], F.array(ok)).alias("ok"))

    return F.aggregate(numbers, first, step, lambda a: a["ok"])


def sequence_flags(df: DataFrame, key: str, order: list[str], number: str) -> DataFrame:
    """(key, *order, ok): the same verdicts on numbers that are rows; a key's rows pass by in order, none is held. A null number never counts."""

    def fold(rows):
        last = 0
        for r in rows:
            n = r[number]
            ok = n is not None and (n == last or last < n <= last + 25)
            last = n if ok else last
            yield {**{c: r[c] for c in (key, *order)}, "ok": ok}

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, *order))
    return in_order(df.select(*dict.fromkeys((key, *order, number))), key, order, fold, f"{schema}, ok boolean")


def marks(text: Column) -> Column:
    """array<struct(label, n, head, body)> of a text's article heads, in order, with what follows each."""
    cut = F.split(F.regexp_replace(text, ARTICLE, START + "$1" + END + "$0" + END), START)
    parts = F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda p: F.split(p, END, 3))
    return F.transform(parts, lambda p: F.struct(article_number(p[0]).alias("label"), _number(p[0]).alias("n"), p[1].alias("head"), p[2].alias("body")))


def articles(laws: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, n, ti, t): each article once, its body cut to LONGEST characters, wrapped lines joined.

    A head out of sequence is text of the article before it. Of an article that comes twice the first counts; if that
    one is shorter than 140 characters it becomes the title of the second.
    """
    m = laws.select(key, marks(F.col(text)).alias("m")).withColumn("ok", in_sequence(F.transform("m", lambda x: x["n"])))

    def step(a: Column, z: Column) -> Column:
        last = F.element_at(a, -1)
        glued = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["label"].alias("label"), last["n"].alias("n"), F.concat(last["body"], z["m"]["head"], z["m"]["body"]).alias("body"))))
        own = F.array(F.struct(z["m"]["label"].alias("label"), z["m"]["n"].alias("n"), z["m"]["body"].alias("body")))
        return F.when(z["ok"], F.concat(a, own)).when(F.size(a) > 0, glued).otherwise(a)

    none = F.array().cast("array<struct<label:string,n:int,body:string>>")
    kept = m.select(key, F.aggregate(F.arrays_zip("m", "ok"), none, step).alias("a"))
    each = kept.select(key, F.posexplode("a").alias("pos", "x")).select(key, "pos", F.col("x.label").alias("label"), F.substring(without_notes(F.col("x.body")), 1, LONGEST).alias("body"))
    copies = each.groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("c"))
    first, second = F.element_at("c", 1), F.try_element_at("c", F.lit(2))
    titled = second.isNotNull() & (F.length(first["body"]) < 140)
    body = F.when(titled, second["body"]).otherwise(first["body"])
    title = F.regexp_replace(F.regexp_replace(first["body"], r"^[ .:-]+|[ .:-]+$", ""), r"^[\s\-–—.:]+", "")
    return copies.select(key, first["pos"].alias("pos"), F.col("label").alias("n"), F.when(titled, title).alias("ti"), join_wrapped(without_head(body, F.col("label"))).alias("t"))


def headings(laws: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, u): the path of headings over each article in sequence, where its number stands first.

    A book ends title and chapter, a title ends the chapter; sections and parts are seen but not shown.
    """
    both = F.regexp_replace(F.regexp_replace(F.col(text), HEADING, START + HEAD + "$0" + END), ARTICLE, START + "$1" + END)
    cut = F.split(both, START)
    parts = F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))
    none = F.struct(*[F.lit("").alias(k) for k in "btc"], F.lit(0).alias("last"), F.array().cast("array<struct<n:string,u:string>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        label = F.trim(F.substring_index(p, END, 1))
        is_head, h = label.startswith(HEAD), F.regexp_replace(F.substring(label, 2, 200), r"^\s+|\s+$", "")
        word = F.translate(F.upper(F.substring_index(h, " ", 1)), "ÍÓ", "IO")
        book, title, chapter = word == "LIBRO", word == "TITULO", word == "CAPITULO"
        b = F.when(is_head & book, h).otherwise(a["b"])
        t = F.when(is_head & book, "").when(is_head & title, h).otherwise(a["t"])
        c = F.when(is_head & (book | title), "").when(is_head & chapter, h).otherwise(a["c"])
        path = F.array_join(F.filter(F.array(a["b"], a["t"], a["c"]), lambda x: x != ""), " › ")
        counts = ~is_head & _goes_on(_number(label), a["last"])
        own = F.struct(article_number(label).alias("n"), path.alias("u"))
        return F.struct(b.alias("b"), t.alias("t"), c.alias("c"), F.when(counts, _number(label)).otherwise(a["last"]).alias("last"), F.when(counts, F.concat(a["out"], F.array(own))).otherwise(a["out"]).alias("out"))

    each = laws.select(key, F.posexplode(F.aggregate(parts, none, step, lambda a: a["out"])).alias("pos", "x"))
    return each.groupBy(key, F.col("x.n").alias("n")).agg(F.min_by("x.u", "pos").alias("u"))


def references(text: Column) -> Column:
    """Labels of articles of the same law that a text names. Lists give each item, ranges their ends.

    Notes in brackets, articles of other laws, and articles that an amendment names do not count.
    """
    lists = F.regexp_extract_all(F.regexp_replace(text, NOTES, " "), F.lit(REFERENCE), F.lit(1))
    items = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit("(?iu)(\\d+" + SUFFIX + ")"), F.lit(1))))
    return F.array_distinct(F.transform(items, article_number))


def edges(arts: DataFrame, key: str, n: str, text: str) -> DataFrame:
    """(key, src, dst): references to other articles of the law that exist, once each."""
    named = arts.select(key, F.col(n).alias("src"), F.explode(references(F.col(text))).alias("dst")).where("src <> dst").distinct()
    return named.join(arts.select(key, F.col(n).alias("dst")).distinct(), [key, "dst"], "left_semi").select(key, "src", "dst")


def after_title(chapter: str, section: str, title: str, opening: bool) -> tuple[str, str]:
    """Chapter and section after a title: a chapter ends the section; a bare one takes the title after it into its name.

    Before the first article a title without a chapter says nothing.
    """
    if CHAPTER.match(title):
        return title, ""
    if title and not section and CHAPTER.match(chapter) and chapter.count(" ") < 2:
        return f"{chapter} {title}", section
    return (chapter, section) if opening and not chapter else (chapter, title)


def section_titles(arts: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, pos, n, u, t) of articles (key, pos, n, t) whose texts have marked titles: u is the chapter and section over each (WIN-5).

    Titles at an article's end are those of the articles after it, and leave its text. before: (key, text), what stands
    before a law's first article. Articles pass by in order; nothing but the titles in force is held.
    """
    head = before.select(key, F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("n"), F.col("text").alias("t"))
    rows = head.unionByName(arts.select(key, F.col("pos").cast("long").alias("pos"), "n", "t"))

    def fold(held):
        chapter = section = ""
        for r in held:
            opening, text = r["pos"] < 0, r["t"] or ""
            own, *titles = ["", *re.findall(MARK + "([^\n]+)", text)] if opening else re.split(r"\s*" + MARK, text)
            if not opening:
                yield {key: r[key], "pos": r["pos"], "n": r["n"], "u": " › ".join(x for x in (chapter, section) if x) or None, "t": own.strip()}
            for title in titles:
                chapter, section = after_title(chapter, section, title.strip(), opening)

    kinds = dict(arts.dtypes)
    return in_order(rows, key, ["pos"], fold, f"{key} {kinds[key]}, pos long, n string, u string, t string", mixed=True)


def kept(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder where the session has one, else persisted."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def components(pairs: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """(node, component) of each node of a pair; component is the least node reachable (AGG-18).

    Larger neighbours move to a node's least neighbour, then smaller ones do, in turn: rounds grow with the log of the
    longest chain.
    """
    loops = pairs.select(F.explode(F.array(a, b)).alias("node")).distinct()
    edges_ = kept(pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct())
    before = None
    for _ in range(most):
        both = edges_.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges_.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = star.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = star.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("p")).select("p.*")
        edges_ = kept(moved.where("hi > lo").distinct())
        now = tuple(edges_.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            return loops.join(edges_, F.col("node") == F.col("hi"), "left").select("node", F.coalesce("lo", "node").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")
