"""Entities, names, titles, summaries, cards and deadlines out of texts (EX). Weights and word lists are our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import values as V
from scriptoria.functions.text import folded

#: Patterns by kind of entity.
ENTITIES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+\d{1,3} \(\d{2,4}\) \d{3}-\d{4}",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "amount": r"\$ ?\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?",
    "date": r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    "identity": r"\b\d{1,2}\.\d{3}\.\d{3}\b",
    "tax_id": r"\b\d{2}-\d{8}-\d\b",
    "file": r"\b(?:Expte|Exp|EX)\.? ?N?°? ?\d[\d/-]*\d",
}
#: What a text must have for a kind to be looked for: a cheap test before the pattern.
SIGNS = {"email": "@", "phone": "+", "ip": ".", "amount": "$", "date": "/", "identity": ".", "tax_id": "-"}
PERSON = r"\b(\p{Lu}{2,}(?: \p{Lu}{2,})*), (\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"
ORDERS = r"(?i)\b(solicit|requier|dispon|orden|intim|resuelv|notifi|request|order)"
GREETINGS = r"(?i)^(estimad|de mi mayor|saludo|atentamente|dear|sincerely)"
KINDS = ("oficio", "resolución", "nota", "informe", "acta", "dictamen")


def entities(text: Column, *kinds: str) -> Column:
    """Map from kind to distinct matches, in order of appearance."""
    chosen = kinds or tuple(ENTITIES)
    none = F.array().cast("array<string>")

    def found(k: str) -> Column:
        all_ = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITIES[k]), F.lit(0)))
        return F.when(F.contains(text, F.lit(SIGNS[k])), all_).otherwise(none) if k in SIGNS else all_

    return F.create_map(*[x for k in chosen for x in (F.lit(k), found(k))])


def key_data(docs: DataFrame, key: str, text: Column, *kinds: str) -> DataFrame:
    """(key, field, value): the first match of each kind that the text has."""
    first = F.array(*[F.struct(F.lit(k).alias("field"), F.regexp_extract(text, ENTITIES[k], 0).alias("value")) for k in kinds])
    return docs.select(key, F.explode(first).alias("x")).select(key, "x.*").where("value <> ''")


def persons(text: Column) -> Column:
    """Names written FAMILY, Given."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)))


def document_name(text: Column) -> Column:
    """Kind, number, issuing office, file and date as far as they are found, with dots between."""
    kind = F.initcap(F.regexp_extract(folded(text), "(" + "|".join(folded_word(k) for k in KINDS) + ")", 1))
    number = F.regexp_extract(text, r"(?i)(?:oficio|resoluci[oó]n|nota|informe|acta|dictamen)\s+N[°º]\s*(\d+(?:/\d+)?)", 1)
    office = F.regexp_extract(text, r"((?:Juzgado|Fiscal[ií]a|Ministerio|Direcci[oó]n|Tribunal|C[aá]mara)(?: (?:de|del|la|el|en|lo|los|N°|\p{Lu}[\p{L}.]*|\d+))*(?: (?:\p{Lu}[\p{L}.]*|\d+)))", 1)
    file = F.regexp_extract(text, ENTITIES["file"], 0)
    day = V.normal_date(text)
    some = lambda c: F.when(c != "", c)
    return F.nullif(F.concat_ws(" · ", some(F.trim(F.concat_ws(" ", some(kind), F.when(number != "", F.concat(F.lit("N° "), number))))), some(office), some(file), day), F.lit(""))


def folded_word(word: str) -> str:
    from scriptoria.functions.text import ACCENTS

    return word.translate(str.maketrans(*ACCENTS))


def is_automatic_name(name: Column) -> Column:
    return name.isNull() | name.rlike(r"^(Documento|Escaneo|Document|Scan)[ _-]?[\d ./:_-]*$")


def title_of(text: Column) -> Column:
    """The first line that is no person, identity number or date alone and has at least two words; null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), V.trimmed), lambda x: x.rlike(r"\p{L}{2,}.*\s.*\p{L}{2,}") & ~x.rlike("^" + PERSON) & ~x.rlike(r"(?i)^(dni|cuil|cuit|fecha)\b"))
    return F.substring(F.try_element_at(lines, F.lit(1)), 1, 80)


def organised(docs: DataFrame) -> DataFrame:
    """docs (id, name, text, folder) with name and folder set where the name is still automatic."""
    auto = is_automatic_name(F.col("name"))
    found = F.coalesce(document_name(F.col("text")), title_of(F.col("text")))
    folder = F.initcap(F.regexp_extract(folded(F.col("text")), "(" + "|".join(folded_word(k) for k in KINDS) + ")", 1))
    return docs.withColumn("_auto", auto).withColumn("name", F.when(F.col("_auto"), F.coalesce(found, "name")).otherwise(F.col("name"))).withColumn("folder", F.when(F.col("_auto") & (folder != ""), folder).otherwise(F.col("folder"))).drop("_auto")


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, sentence), from position 0, without blanks at the ends."""
    parts = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), lambda x: F.trim(x))
    each = docs.select(key, F.posexplode(F.filter(parts, lambda x: F.length(x) > 0)).alias("pos", "sentence"))
    return each


def summary(docs: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """(key, summary): the n sentences of most weight, in their order; nothing is made up.

    Weight: mean frequency in the text of a sentence's words of four letters or more, half as much again for requests and
    orders, one more for the first two sentences, less two for greetings.
    """
    import re
    from collections import Counter

    import pyarrow as pa
    import regex

    from scriptoria.functions.text import ACCENTS

    parts, term = re.compile(r"[^.!?\n]+[.!?]?"), regex.compile(r"[\p{L}\p{N}]{4,}")
    orders, greetings = (re.compile(p, re.ASCII) for p in (ORDERS, GREETINGS))
    accents = str.maketrans(*ACCENTS)

    def one(t: str | None) -> str | None:
        found = [x for x in (y.strip(" ") for y in parts.findall(t or "")) if x]
        if not found:
            return None
        terms = [term.findall(x.lower().translate(accents)) for x in found]
        n = Counter(w for x in terms for w in x)
        weight = lambda k: round((sum(n[w] for w in terms[k]) / len(terms[k]) if terms[k] else 0.0) * (1.5 if orders.search(found[k]) else 1) + (k < 2) - 2 * bool(greetings.search(found[k])), 9)
        best = sorted(range(len(found)), key=lambda k: (-weight(k), k))[:n_sentences]
        return " ".join(found[k] for k in sorted(best))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x) for x in batch.column(1).to_pylist()], pa.string())], names=[key, "summary"])

    n_sentences = n
    made = docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, summary string")
    return made.where("summary IS NOT NULL")  # all of it is local to a document: no shuffle


def business_card(text: Column) -> Column:
    """struct(name, title, org, phones, email, url, address) of a card's lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), V.trimmed), lambda x: x != "")
    first = lambda pattern: F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(1))
    phones = F.transform(F.filter(lines, lambda x: x.rlike(r"\d{3,}[ -]?\d{3,}") & ~x.rlike("@")), lambda x: F.trim(F.regexp_replace(x, r"[^\d+() -]", "")))
    return F.struct(
        first(r"^\p{Lu}[\p{L}.]+(?: \p{Lu}[\p{L}.]+){1,3}$").alias("name"),
        first(r"(?i)\b(director|gerente|abogad|ingenier|manager|engineer|contador|jef[ea])").alias("title"),
        first(r"(?i)\b(s\.?a\.?|s\.?r\.?l\.?|inc|ltd|estudio|empresa|ministerio|universidad)\b\.?").alias("org"),
        phones.alias("phones"),
        F.nullif(F.regexp_extract(text, ENTITIES["email"], 0), F.lit("")).alias("email"),
        F.nullif(F.regexp_extract(text, r"(?i)\b(?:https?://|www\.)\S+", 0), F.lit("")).alias("url"),
        first(r"(?i)^(av\.?|avenida|calle|ruta|street|road)\b.*\d").alias("address"),
    )


def command(text: Column) -> Column:
    """struct(kind, a, b) of teaching, naming and reminding; kind is null for anything else."""
    teach, call, remind = r"(?i)^si (?:te )?preguntan (.+?),? respond[eé] (.+)$", r"(?i)^llamame (\p{L}+)(?: y no (\p{L}+))?$", r"(?i)^record[aá]me (.+?) el (\d{1,2}/\d{1,2})$"
    kind = F.when(text.rlike(teach), "teach").when(text.rlike(call), "name").when(text.rlike(remind), "remind")
    group = lambda k: F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, k)) for p in (teach, call, remind)])
    return F.struct(kind.alias("kind"), group(1).alias("a"), group(2).alias("b"))


def deadlines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, day): dates that follow a word for a hearing or due date within 60 characters."""
    pattern = r"(?i)(audiencia|vencimiento|plazo|vence|hearing)[^\n.]{0,60}?(\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2} de [a-zñ]+ de \d{4})"
    hits = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("hit"))
    return hits.select(key, F.lower(F.regexp_extract("hit", pattern, 1)).alias("label"), V.normal_date(F.regexp_extract("hit", pattern, 2)).alias("day"))


def filled_template(template: Column, found: Column) -> Column:
    """The template with {kind} replaced by the first match of each kind; kinds without one stay."""
    out = template
    for k in ENTITIES:
        first = F.try_element_at(F.try_element_at(found, F.lit(k)), F.lit(1))
        out = F.coalesce(F.replace(out, F.lit("{" + k + "}"), first), out)
    return out


def graded(value: Column, good: float, fair: float) -> Column:
    return F.when(value >= good, "good").when(value >= fair, "fair").otherwise("poor")
