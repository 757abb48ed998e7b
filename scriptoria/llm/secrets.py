"""Secret scans in SQL expressions: fixed patterns, and character Markov models that tell random strings from identifiers.

Two bigram models are trained from labelled samples, one of random strings and one of ordinary identifiers. Of each run of
token characters the stretch with the highest log-likelihood ratio is judged, so that ordinary characters joined to it do
not hide it: it is a secret of kind ``markov`` if its ratio is high enough in total and per character. The span reaches to
the next separator (one of / _ = -) on both sides.

Null and empty texts have no spans. Positions are code points, ends exclusive. Equal rows get equal spans, each on its
own row. Other columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm.common import record, table

#: Fixed by the contract. The second group of ASSIGN counts ASSIGN_MIN characters or more. A run that is too short for
#: ACCESS or HEX has no longer run within it, so their lengths can stand in the pattern; ASSIGN's cannot, since a match
#: that is too short still uses up its text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_MIN = 8
KINDS = ("assign", "access", "hex", "markov")
#: A text without any of these has no ASSIGN match.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Characters that the models tell apart; all others are one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Numbers above this are separators: / _ = -
SEPARATED = ALPHABET.index("+") + 1

#: Items of a list that grows by one, and characters of the pieces that a text is cut out of.
BLOCK, PIECE = 512, 1024

#: Words of ordinary identifiers, for the samples below.
ORDINARY = (
    "user name count index value table field file path line page text word list item node edge graph query result "
    "total amount price order customer account number date time start end first last next previous current default "
    "config option setting service client server request response session message error warning status state type "
    "class method function module package library version build test data base store cache memory buffer stream "
    "reader writer parser encoder decoder image color width height margin border button window screen menu "
    "international responsibility understanding administration organization communication development government "
    "gesellschaft verantwortung entwicklung wissenschaft regierung geschwindigkeit aufmerksamkeit freundlichkeit "
    "développement gouvernement responsabilité connaissance établissement naturellement heureusement changement "
    "desarrollo gobierno responsabilidad conocimiento establecimiento naturalmente afortunadamente importante"
).split()


@dataclass(frozen=True)
class SecretRules:
    """min_chars: shorter runs are not judged. total, each: least log-likelihood ratio of the stretch and per character."""

    min_chars: int = 16
    total: float = 16.0
    each: float = 0.6


def default_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled samples (value, is_random): digests in four spellings; words joined as code, paths and prose join them."""
    i = F.col("id")
    digest = F.sha2(i.cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    made = F.element_at(
        F.array(
            F.substring(digest, 1, 40),
            F.regexp_replace(coded, "=", ""),
            F.translate(coded, "+/=", "-_"),
            F.upper(F.regexp_replace(coded, "[^A-Za-z0-9]", "")),
            F.upper(F.substring(digest, 1, 40)),
        ),
        (i % 5 + 1).cast("int"),
    )
    words = F.array(*[F.lit(w) for w in ORDINARY])
    pick = [F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(ORDINARY))) + 1).cast("int")) for k in range(4)]
    number = F.pmod(F.xxhash64(i), F.lit(2030)).cast("string")
    joined = F.element_at(
        F.array(
            F.concat_ws("_", *pick),
            F.concat_ws("-", *pick, number),
            F.concat(pick[0], *[F.initcap(w) for w in pick[1:]]),
            F.concat(*pick),
            F.concat_ws("/", *pick),
            F.upper(F.concat_ws("_", *pick)),
            F.concat(*[F.initcap(w) for w in pick]),
            F.concat_ws("=", pick[0], pick[1]),
            F.repeat(F.element_at(F.array(*[F.lit(c) for c in "-=_+/"]), (i.bitwiseAND(3) + 1).cast("int")), 24),
        ),
        (i % 9 + 1).cast("int"),
    )
    ids = spark.range(n)
    return ids.select(made.alias("value"), F.lit(True).alias("is_random")).union(ids.select(joined, F.lit(False)))


def _codes(value: Column) -> Column:
    """The value's characters as numbers from 0 (any other character) up to SIZE - 1."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, row by row: SIZE * SIZE values, however many samples there are."""
    codes = samples.select("is_random", _codes(F.coalesce("value", F.lit(""))).alias("c")).where(F.size("c") > 1)
    pairs = codes.select("is_random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda a, b: a * SIZE + b)).alias("p"))
    counts = {(r["is_random"], r["p"]): r["n"] for r in pairs.groupBy("is_random", "p").agg(F.count("*").alias("n")).collect()}

    def log_p(random: bool) -> list[float]:
        rows = [[counts.get((random, a * SIZE + b), 0) + 0.5 for b in range(SIZE)] for a in range(SIZE)]
        return [math.log(x / sum(row)) for row in rows for x in row]

    return [round(r - o, 6) for r, o in zip(log_p(True), log_p(False), strict=True)]


def stretch(value: Column, ratio: Column, rules: SecretRules) -> Column:
    """The span (start, end) of the stretch with the highest ratio, widened to separators, or null if it is no secret."""
    # sum: of the best stretch that ends here, which begins at start; cut: where the part between separators begins.
    first = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("last"), F.lit(0).alias("cut"), F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0).alias("wide"), F.lit(0.0).alias("best"), F.lit(0).alias("low"), F.lit(0).alias("from"), F.lit(0).alias("end"))

    def step(acc, x):
        gain = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.element_at(ratio, acc["last"] * SIZE + x + 1))
        go_on = acc["sum"] > 0
        total = F.when(go_on, acc["sum"]).otherwise(F.lit(0.0)) + gain
        # A pair of characters begins at the first of them.
        before = F.greatest(acc["at"] - 1, F.lit(0))
        start, wide = F.when(go_on, acc["start"]).otherwise(before), F.when(go_on, acc["wide"]).otherwise(F.least(acc["cut"], before))
        better = total > acc["best"]
        return F.struct(
            (acc["at"] + 1).alias("at"), x.alias("last"), F.when(x > SEPARATED, acc["at"] + 1).otherwise(acc["cut"]).alias("cut"), total.alias("sum"), start.alias("start"), wide.alias("wide"),
            F.when(better, total).otherwise(acc["best"]).alias("best"), F.when(better, start).otherwise(acc["low"]).alias("low"), F.when(better, wide).otherwise(acc["from"]).alias("from"), F.when(better, acc["at"] + 1).otherwise(acc["end"]).alias("end"),
        )

    def judged(acc):
        rest = F.length(F.regexp_extract(F.substring(value, acc["end"] + 1, F.length(value)), "^[A-Za-z0-9+]*", 0))
        secret = (acc["best"] >= rules.total) & (acc["best"] >= rules.each * (acc["end"] - acc["low"])) & (acc["end"] - acc["low"] >= rules.min_chars)
        return F.when(secret, F.struct(acc["from"].alias("start"), (acc["end"] + rest).alias("end")))

    return F.aggregate(_codes(value), first, step, judged)


def bound(value: Column, then) -> Column:
    """then(value), with the value worked out once however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _folds(items: Column, kind: str, measure, plus) -> Column:
    """Each item with the fold of measure over those before it, from 0: structs (x, at). kind: the items' type.

    A list that grows by one is copied each time, so items go through lists of BLOCK, and their totals through a list of
    blocks: the work is that of BLOCK copies an item, not that of a list's length.
    """
    row = f"array<struct<x:{kind},at:int>>"
    blocks = lambda it: F.transform(F.sequence(F.lit(0), F.greatest(F.size(it) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(it, i + 1, BLOCK))
    total = lambda b: F.aggregate(b, F.lit(0), lambda a, x: plus(a, measure(x)))
    none = lambda t: F.array().cast(t)
    start = lambda at, t: record(at=at, out=none(t))
    firsts = lambda bs: F.aggregate(F.transform(bs, total), start(F.lit(0), "array<int>"), lambda a, t: record(at=plus(a["at"], t), out=F.concat(a["out"], F.array(a["at"]))), lambda a: a["out"])
    step = lambda a, x: record(at=plus(a["at"], measure(x)), out=F.concat(a["out"], F.array(record(x=x, at=a["at"]))))
    inner = lambda b, f: F.aggregate(b, start(f, row), step, lambda a: a["out"])
    return bound(items, lambda it: bound(blocks(it), lambda bs: F.flatten(F.zip_with(bs, firsts(bs), inner))))


def _walk(text: Column, pattern: str, group: int = 0) -> Column:
    """The pattern's matches, left to right, as structs (start, hit, value): hit is the match's length, value its group."""
    gaps = F.split(text, F.lit(pattern), -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if group:
        found = F.zip_with(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda h, g: record(hit=F.length(h), value=g))
    else:
        found = F.transform(hits, lambda h: record(hit=F.length(h), value=h))
    # The last gap has no match after it.
    parts = F.zip_with(gaps, found, lambda g, h: record(gap=F.length(g), hit=F.coalesce(h["hit"], F.lit(0)), value=h["value"]))
    placed = _folds(parts, "struct<gap:int,hit:int,value:string>", lambda x: x["gap"] + x["hit"], lambda a, b: a + b)
    return F.transform(F.filter(placed, lambda p: p["x"]["hit"] > 0), lambda p: record(start=p["at"] + p["x"]["gap"], hit=p["x"]["hit"], value=p["x"]["value"]))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: record(start=x["start"], kind=F.lit(KINDS.index(kind)), end=x["start"] + x["hit"]))


def find_spans(text: Column, weights: list[float], rules: SecretRules = SecretRules()) -> tuple[Column, Column]:
    """Spans (start, kind, end) of the fixed patterns and those that the models add; kind is a number into KINDS."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    low = F.lower(text)
    hinted = low.contains(ASSIGN_HINTS[0])
    for hint in ASSIGN_HINTS[1:]:
        hinted = hinted | low.contains(hint)
    base = F.concat(
        F.when(hinted, _spans(F.filter(_walk(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGN_MIN), "assign")).otherwise(none),
        F.when(text.contains("AKIA"), _spans(_walk(text, ACCESS), "access")).otherwise(none),
        F.when(text.rlike(HEX), _spans(_walk(text, HEX), "hex")).otherwise(none),
    )
    ratio = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")

    # Runs are judged as they were found, not cut out of the text again.
    runs = r"[A-Za-z0-9+/_=-]{%d,}" % rules.min_chars
    judged = F.transform(_walk(text, runs), lambda x: F.struct(x["start"].alias("at"), stretch(x["value"], ratio, rules).alias("own")))
    made = F.transform(F.filter(judged, lambda x: x["own"].isNotNull()), lambda x: F.struct((x["at"] + x["own"]["start"]).alias("start"), F.lit(KINDS.index("markov")).alias("kind"), (x["at"] + x["own"]["end"]).alias("end")))
    return F.array_sort(base), F.when(text.rlike(runs), made).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, rules: SecretRules = SecretRules()) -> DataFrame:
    """The id, base (spans of the fixed patterns) and all (with those the models add), both by start, then kind."""
    weights = train(default_samples(docs.sparkSession) if samples is None else samples)
    base, added = find_spans(F.coalesce(F.col(text_col), F.lit("")), weights, rules)
    out = docs.select(F.col(id_col), base.alias("base"), added.alias("added"))
    return out.select(id_col, "base", F.array_sort(F.concat("base", "added")).alias("all"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by a mark. spans: sorted by start.

    What lies between spans is cut out of pieces of the text, so that no cut counts characters from the text's beginning.
    """
    reached = _folds(spans, "struct<start:int,kind:int,end:int>", lambda x: x["end"], lambda a, b: F.greatest(a, b))
    # A gap lies between the furthest end so far and a span that begins at or after it; the last one has no end.
    gaps = lambda r: F.transform(F.filter(r, lambda p: p["x"]["start"] >= p["at"]), lambda p: record(since=p["at"], to=p["x"]["start"]))
    last = lambda r: record(since=F.array_max(F.transform(r, lambda p: F.greatest(p["at"], p["x"]["end"]))), to=F.length(text))
    piece = lambda ps, i, g: F.substring(F.element_at(ps, i + 1), F.greatest(g["since"] - i * PIECE, F.lit(0)) + 1, g["to"] - F.greatest(g["since"], i * PIECE))
    cut = lambda ps, g: F.when(g["to"] > g["since"], F.array_join(F.transform(F.sequence(F.floor(g["since"] / PIECE).cast("int"), F.floor((g["to"] - 1) / PIECE).cast("int")), lambda i: piece(ps, i, g)), "")).otherwise(F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    whole = bound(pieces, lambda ps: bound(reached, lambda r: F.array_join(F.transform(F.concat(gaps(r), F.array(last(r))), lambda g: cut(ps, g)), mark)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact_all(docs: DataFrame, text_col: str = "text", samples: DataFrame | None = None, rules: SecretRules = SecretRules()) -> DataFrame:
    """docs with all spans in the text redacted; n_chars, where there is such a column, follows the text. Null texts stay."""
    weights = train(default_samples(docs.sparkSession) if samples is None else samples)
    names = [f"c{k}" for k in range(len(docs.columns))]
    given = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)])
    text = F.col(names[docs.columns.index(text_col)])
    base, added = find_spans(F.coalesce(text, F.lit("")), weights, rules)
    found = given.select(*names, F.array_sort(F.concat(base, added)).alias("spans"))
    clean = found.select(*names, redact(text, F.col("spans")).alias("clean"))
    made = {text_col: F.col("clean"), "n_chars": F.length("clean").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return clean.select(*[made.get(c, F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def _joined(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"], x["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
    )
