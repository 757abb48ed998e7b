"""Document fingerprints: invertible Bloom lookup sketches of passages, in DataFrame and SQL functions only.

A text's lines are its paragraphs; a longer one is cut at the first sentence end after 120 characters, or after 240. Each
different passage is a 64-bit digest, which each of three tables of a sketch holds in one cell: a cell has the number of its
digests, their exclusive or, and that of their marks. The sketch of one version minus that of another holds only the digests
in which they differ. A cell of one digest gives it away; taken out of the two other tables, it lays bare further cells. The
fingerprint is such a sketch of fixed size. Where its difference doesn't come apart, both sides are sketched anew in larger
tables, sized by their digests and larger each time, until it does. Likeness is what both have over what either has.

All cells of a pair lie in one partition, which a pair's rows never leave while they are peeled; a table at a time is looked
through, so that no digest is taken out twice.

A null text is empty and has no passages; two texts without passages are alike (1), one with and one without are not (0).
A passage that a text repeats counts once. Ids may be null or repeated: the next document is the next row in the order of ids
(nulls last), then of a hash of the text, so rows that repeat are next to each other. An empty table gives no rows, a single
document is its own next one. Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import record, table, written

#: A passage: up to the first sentence end after 120 characters, else up to 240 characters or the end of the line.
PASSAGE = r"[^\n]{120,240}?[.!?]+|[^\n]{1,240}"
TABLES = 3
CELL = "struct<n:int,digest:long,mark:long>"


@dataclass(frozen=True)
class Sizes:
    """cells: of a fingerprint, a third in each table. share: cells per digest of both sides at the first retry; grow: factor of
    each retry. rounds: looks through one table each before an attempt has failed. attempts: retries, then an error. task:
    digests whose cells lie in one partition, about; a digest makes three rows, however wide tables are. Ids are dealt in
    ranges of about rows documents, at most so many ranges, whose bounds come from a sample of about so many rows."""

    cells: int = 24
    share: float = 6.0
    grow: int = 2
    rounds: int = 6
    attempts: int = 8
    task: int = 200_000
    rows: int = 100
    ranges: int = 4_096
    sample: int = 20_000


def passages(text: Column) -> Column:
    """The digests of the text's different passages."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PASSAGE), F.lit(0)), lambda p: F.xxhash64(F.trim(p)))
    return F.array_distinct(found)


def _mark(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("mark"))


def _cell(digest: Column, k: int, width: Column, attempt: int) -> Column:
    """The digest's cell in table k; tables are width cells wide and follow one another."""
    return (F.pmod(F.xxhash64(digest, F.lit(k + TABLES * attempt)), width.cast("long")) + k * width).cast("int")


def sketch(digests: Column, cells: int) -> Column:
    """The digests in so many cells: an array of n, digest and mark (CELL), table after table."""
    width = cells // TABLES
    none = F.expr(f"cast(named_struct('n', 0, 'digest', 0L, 'mark', 0L) as {CELL})")
    placed = F.transform(digests, lambda d: record(d=d, m=_mark(d), **{f"c{k}": _cell(d, k, F.lit(width), 0) for k in range(TABLES)}))
    add = lambda a, p: record(n=a["n"] + 1, digest=a["digest"].bitwiseXOR(p["d"]), mark=a["mark"].bitwiseXOR(p["m"]))

    def filled(places: Column, k: int) -> Column:
        cells_of = F.sequence(F.lit(k * width), F.lit((k + 1) * width - 1))
        return F.transform(cells_of, lambda at: F.aggregate(F.filter(places, lambda p: p[f"c{k}"] == at), none, add))

    # An array of one binds the places, so that they are worked out once for all cells.
    return F.element_at(F.transform(F.array(placed), lambda p: F.concat(*[filled(p, k) for k in range(TABLES)])), 1)


def fingerprint(cells: Column) -> Column:
    """A sketch as text: each cell's number, digest and mark in hexadecimal digits, a dot for an empty one."""
    spell = lambda c: F.when((c["n"] == 0), F.lit(".")).otherwise(F.concat_ws("-", c["n"].cast("string"), F.lower(F.hex(c["digest"])), F.lower(F.hex(c["mark"]))))
    return F.array_join(F.transform(cells, spell), ",")


#: What tells a pair of versions: its two keys and its kind.
PAIR = ("k1", "k2", "kind")
#: slot: a cell from 0, or what has been found: FOUND_LEFT, FOUND_RIGHT; PRESENT marks the pair itself.
PRESENT, FOUND_LEFT, FOUND_RIGHT = -1, -2, -3


def peeled(cells: DataFrame, rules: Sizes, attempt: int) -> DataFrame:
    """Pairs with the digests that only one side has. cells: PAIR, width, slot, n, digest, mark; equal slots are summed.

    Returns PAIR, left, right (arrays of digests) and whole: whether nothing is left in any cell.
    """
    add = [F.sum("n").cast("int").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("mark").alias("mark")]
    entry = lambda slot, own, n, digest, mark: record(slot=slot.cast("int"), own=own.cast("long"), n=n, digest=digest, mark=mark)
    zero = F.lit(0).cast("long")
    # own: the digest that has been found, so that each is a group of its own; 0 for cells.
    rows = cells.withColumn("own", zero).groupBy(*PAIR, "width", "slot", "own").agg(*add)
    for turn in range(rules.rounds):
        k = turn % TABLES
        n, digest, mark = F.col("n"), F.col("digest"), F.col("mark")
        alone = (F.col("slot").between(k * F.col("width"), (k + 1) * F.col("width") - 1)) & (F.abs("n") == 1) & (mark == _mark(digest)) & (F.col("slot") == _cell(digest, k, F.col("width"), attempt))
        found = entry(F.when(n > 0, FOUND_LEFT).otherwise(FOUND_RIGHT), digest, n, digest, mark)
        others = [entry(_cell(digest, j, F.col("width"), attempt), zero, -n, digest, mark) for j in range(TABLES) if j != k]
        same = F.array(entry(F.col("slot"), F.col("own"), n, digest, mark))
        rows = rows.where((F.col("slot") < 0) | (n != 0) | (digest != 0) | (mark != 0))
        rows = rows.select(*PAIR, "width", F.explode(F.when(alone, F.array(found, *others)).otherwise(same)).alias("x")).select(*PAIR, "width", "x.*")
        rows = rows.groupBy(*PAIR, "width", "slot", "own").agg(*add)
    left = (F.col("slot") >= 0) & ((F.col("n") != 0) | (F.col("digest") != 0) | (F.col("mark") != 0))
    side = lambda slot: F.collect_list(F.when(F.col("slot") == slot, F.col("own")))
    return rows.groupBy(*PAIR).agg(side(FOUND_LEFT).alias("left"), side(FOUND_RIGHT).alias("right"), (~F.bool_or(left)).alias("whole"))


def _present() -> Column:
    return record(slot=F.lit(PRESENT), n=F.lit(0), digest=F.lit(0).cast("long"), mark=F.lit(0).cast("long"))


def _first_cells(pairs: DataFrame, rules: Sizes) -> DataFrame:
    """The fingerprints' difference, cell by cell."""
    minus = F.zip_with("a", "b", lambda a, b: record(n=a["n"] - b["n"], digest=a["digest"].bitwiseXOR(b["digest"]), mark=a["mark"].bitwiseXOR(b["mark"])))
    # Fingerprints are columns of a step of their own, so that each is worked out once.
    made = pairs.select(*PAIR, sketch(F.col("one"), rules.cells).alias("a"), sketch(F.col("two"), rules.cells).alias("b"))
    slots = F.transform(minus, lambda c, at: record(slot=at, n=c["n"], digest=c["digest"], mark=c["mark"]))
    used = F.filter(slots, lambda c: (c["n"] != 0) | (c["digest"] != 0) | (c["mark"] != 0))
    return made.select(*PAIR, F.lit(rules.cells // TABLES).alias("width"), F.explode(F.concat(F.array(_present()), used)).alias("x")).select(*PAIR, "width", "x.*")


def _larger_cells(pairs: DataFrame, rules: Sizes, attempt: int) -> DataFrame:
    """Both sides' digests in larger tables, digest by digest."""
    size = F.size("one") + F.size("two")
    width = F.ceil((rules.cells + rules.share * size) * rules.grow ** (attempt - 1) / TABLES).cast("int")
    signed = lambda c, sign: F.transform(c, lambda d: record(n=F.lit(sign), digest=d))
    each = pairs.select(*PAIR, width.alias("width"), F.explode(F.concat(signed("one", 1), signed("two", -1), F.array(record(n=F.lit(0), digest=F.lit(0).cast("long"))))).alias("x"))
    d, n = F.col("x.digest"), F.col("x.n")
    cells = [record(slot=_cell(d, k, F.col("width"), attempt), n=n, digest=d, mark=_mark(d)) for k in range(TABLES)]
    spread = F.when(n == 0, F.array(_present())).otherwise(F.array(*cells))
    return each.select(*PAIR, "width", F.explode(spread).alias("y")).select(*PAIR, "width", "y.*")


def differences(pairs: DataFrame, rules: Sizes = Sizes()) -> DataFrame:
    """Pairs (PAIR, one, two: arrays of different digests) with left and right, the digests that only one or only two has.

    The first attempt is the difference of the fingerprints; pairs that don't come apart are tried again in larger tables.
    Every attempt's answers, and the pairs it leaves, are tables in the shared folder.
    """
    done, todo, attempt = [], pairs, 0
    total = pairs.agg(F.sum((F.size("one") + F.size("two")).cast("long"))).first()[0] or 0
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-total // rules.task))
    while True:
        here = todo.repartition(parts, "k1", "k2")
        cells = _first_cells(here, rules) if attempt == 0 else _larger_cells(here, rules, attempt)
        out = written(peeled(cells, rules, attempt))
        done.append(out.where("whole").select(*PAIR, "left", "right"))
        failed = out.where("not whole").select(*[F.col(c).alias(f"f_{c}") for c in PAIR])
        if not failed.take(1):
            return reduce(DataFrame.union, done)
        attempt += 1
        if attempt > rules.attempts:
            raise RuntimeError(f"sketches of {rules.attempts} sizes did not come apart")
        todo = pairs.join(failed, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"f_{c}") for c in PAIR]), "left_semi")


def _ranges(keyed: DataFrame, rules: Sizes) -> DataFrame:
    """One row: bounds of ranges of (nameless, id, t1), in order, as lists of lists, so that a row finds its range in two steps.

    They are taken from about rules.sample rows, by a hash, and twice as many at most; every row is in some range.
    """
    n = keyed.count()
    count = max(1, min(rules.ranges, n // rules.rows))
    share = F.pmod(F.xxhash64("id", "t1", F.lit("sample")), F.lit(10**12)) < 10**12 * rules.sample // max(n, 1)
    known = keyed.select("nameless", "id", "t1").where(share).limit(2 * rules.sample).collect() if count > 1 else []
    known = sorted(known, key=lambda r: (r["nameless"], (r["id"],) if r["id"] is not None else (), r["t1"]))
    bounds = [known[len(known) * k // count] for k in range(1, count)] if known else []
    each = max(1, math.isqrt(len(bounds)))
    kind = dict(keyed.dtypes)["id"]
    lists = [[tuple(r) for r in bounds[k : k + each]] for k in range(0, len(bounds), each)]
    return keyed.sparkSession.createDataFrame([(lists, each)], f"bounds array<array<struct<nameless:boolean,id:{kind},t1:bigint>>>, each int")


def _in_ranges(keyed: DataFrame, ranges: DataFrame) -> DataFrame:
    """keyed with range: how many bounds are no greater than the row."""
    me = F.struct("nameless", "id", "t1")
    under = lambda c: F.size(F.filter(c, lambda b: b <= me))
    rows = keyed.crossJoin(F.broadcast(ranges))  # one row
    lists = under(F.transform("bounds", lambda b: b[0]))
    rows = rows.withColumn("full", lists - 1)
    inner = F.when(F.col("full") >= 0, under(F.element_at("bounds", F.greatest(F.col("full") + 1, F.lit(1)))) + F.col("full") * F.col("each")).otherwise(F.lit(0))
    return rows.withColumn("range", inner.cast("long")).drop("bounds", "each", "full")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sizes = Sizes()) -> DataFrame:
    """Documents with their edited texts: k1, k2 (range of ids, place in it), id, n_chars, edited, and digests of the text (one), of edited (two) and of the next text (three)."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = own.select("id", F.col("id").isNull().alias("nameless"), *[F.xxhash64(F.lit(k), "text").alias(f"t{k}") for k in (1, 2)], "text")
    thin = keyed.select("id", "nameless", "t1", "t2")
    ranges = _ranges(thin, rules)
    # The first row of each range is also sent to the range before it, as the next document of its last one: a row a range.
    order = F.struct("nameless", "id", "t1", "t2")
    heads = _in_ranges(thin, ranges).groupBy("range").agg(F.min(order).alias("head"))
    every = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.coalesce(F.lag("range").over(every), F.last("range").over(whole)).alias("before"))
    heads = heads.select(F.col("head.id").alias("h"), F.col("head.t1").alias("h1"), F.col("head.t2").alias("h2"), "before")
    known = _in_ranges(keyed, ranges).join(F.broadcast(heads), (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")) & F.col("id").eqNullSafe(F.col("h")), "left")
    at = F.array(record(range=F.col("range"), guest=F.lit(False)), record(range=F.col("before"), guest=F.lit(True)))
    dealt = known.select("id", "nameless", "t1", "t2", "text", F.explode(F.filter(at, lambda x: x["range"].isNotNull())).alias("x")).select("id", "nameless", "t1", "t2", "text", "x.*")
    # Texts are shuffled once, by range; what follows needs no more than the order in it.
    dealt = dealt.repartition("range").withColumn("one", passages(F.col("text")))
    w = Window.partitionBy("range").orderBy("guest", "nameless", "id", "t1", "t2")
    seen = dealt.select("range", "guest", "id", "text", "one", F.row_number().over(w).cast("long").alias("k2"), F.lead("text").over(w).alias("next"), F.lead("one").over(w).alias("three")).where(~F.col("guest"))
    n = F.length("text")
    quarter = F.shiftright(n, 2)
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter))
    both = seen.select(F.col("range").alias("k1"), "k2", "id", n.cast("long").alias("n_chars"), edited.alias("edited"), "one", "three")
    return both.select("*", passages(F.col("edited")).alias("two"))


def likeness(one: Column, two: Column, left: Column, right: Column) -> Column:
    """What both have in common over what either has: sizes of the sides and of what only one of them has."""
    either = (one + two + left + right) / 2
    return F.when(one + two == 0, F.lit(1.0)).otherwise((either - left - right) / either)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sizes = Sizes()) -> DataFrame:
    """A row per row of docs: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    known = written(with_edits(docs, id_col, text_col, rules).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("two")), F.struct(F.lit(1).alias("kind"), F.col("three").alias("two")))
    pairs = known.select("k1", "k2", "one", F.explode(kinds).alias("x")).select("k1", "k2", "x.kind", "one", "x.two")
    found = differences(pairs, rules).select("k1", "k2", "kind", F.size("left").alias("left"), F.size("right").alias("right"))
    side = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{c}{kind}")
    found = found.groupBy(F.col("k1").alias("f1"), F.col("k2").alias("f2")).agg(*[side(k, c) for k in (0, 1) for c in ("left", "right")])
    near = lambda other, kind: likeness(F.size("one"), F.size(other), F.col(f"left{kind}"), F.col(f"right{kind}"))
    return known.join(found, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(sketch(F.col("one"), rules.cells)).alias("fingerprint"), fingerprint(sketch(F.col("two"), rules.cells)).alias("edited_fingerprint"),
        near("two", 0).alias("near_edited"), near("three", 1).alias("near_next"),
    )


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
