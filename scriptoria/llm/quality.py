"""Line-first cleaning: rules judge each line, failed lines go, documents that lose too much text are rejected.

Null and empty texts have no lines and are rejected. Equal rows get equal verdicts, each on its own row.
Other columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm.common import map_rows, table, words_of

#: Characters that count as symbols, fixed by the contract.
SYMBOLS = "#*$%&|<>"
#: Separators of menus and breadcrumbs.
NAVIGATION = ("|", "»", "›", "·", "•", " > ")
#: What a sentence ends in, with closing quotes and brackets after it.
SENTENCE_END = r"[.!?…:;][\"')\]»”’]*(?:\s|$)"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved|copyright|©|cookie policy|privacy policy|terms of use|terms of service|click here|read more"
    "|sign up|log in|subscribe to our|enable javascript|powered by|skip to content"
    "|tous droits réservés|politique de confidentialité|mentions légales|lire la suite|cliquez ici"
    "|alle rechte vorbehalten|datenschutzerklärung|impressum|mehr lesen|hier klicken"
    "|todos los derechos reservados|política de privacidad|aviso legal|leer más|haga clic aquí"
)
SCHEMA = (
    "id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines_cut long, chars_cut long, cleaned string"
)


@dataclass(frozen=True)
class LineRules:
    """max_symbols: symbols per word character of a line. max_lost: share of a document's word characters in failed lines.

    furniture_words: longer lines are prose even if they mention a phrase of page furniture.
    """

    max_symbols: float = 0.1
    menu_separators: int = 2
    furniture_words: int = 12
    words_per_sentence: int = 60
    max_lost: float = 0.5


_END, _BOILER = re.compile(SENTENCE_END), re.compile(BOILERPLATE)


def line_fails(line: str, n_words: int, n_chars: int, rules: LineRules) -> bool:
    """Punctuation: too many symbols, or more words than words_per_sentence for each sentence end. Navigation and boilerplate as above."""
    if sum(map(line.count, SYMBOLS)) > rules.max_symbols * n_chars:
        return True
    if sum(map(line.count, NAVIGATION)) >= rules.menu_separators:
        return True
    if n_words <= rules.furniture_words and _BOILER.search(line.lower()):
        return True
    return n_words > rules.words_per_sentence and n_words > rules.words_per_sentence * (1 + len(_END.findall(line)))


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v < 2_000_000:
        windows = (codes[:-2] * v + codes[1:-1]) * v + codes[2:]
    else:  # three numbers no longer fit in 63 bits: number the pairs first
        _, pairs = np.unique(codes[:-1] * v + codes[1:], return_inverse=True)
        windows = pairs[:-1].astype(np.int64) * v + codes[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def judge(text: str | None, rules: LineRules) -> tuple:
    text = text or ""
    words: list[bytes] = []
    word_chars = 0
    seen: set[str] = set()
    kept, n_dup, cut, chars_cut = [], 0, 0, 0
    for line in text.split("\n"):
        own = words_of(line)
        if own:
            chars = len(line) - sum(map(line.count, " \t\x0b\x0c\r"))
            words += own
            word_chars += chars
            again = line in seen
            n_dup += again
            seen.add(line)
            if line_fails(line, len(own), chars, rules):
                cut, chars_cut = cut + 1, chars_cut + chars
                continue
        kept.append(line)
    n_words, n_repeat = len(words), repeated_words(words)
    failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    return n_words, word_chars, sum(text.count(c) for c in SYMBOLS), n_dup, n_repeat, failed, not failed and chars_cut <= rules.max_lost * word_chars, cut, chars_cut, "\n".join(kept)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per input row: the id, the counts, the verdict and the text without its failed lines."""
    kind = dict(docs.dtypes)[id_col]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def per_batch(ids, texts):
        rows = [judge(t, rules) for t in texts]
        return {"id": ids} | {n: [r[k] for r in rows] for k, n in enumerate(names[1:])}

    return map_rows(docs, [id_col, text_col], SCHEMA.replace("id string", f"id {kind}", 1), per_batch).withColumnRenamed("id", id_col)


def op8_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(list_zip(ws, generate_series(1, len(ws)))) AS u FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
x AS (SELECT r, u[2] AS i, u[1] AS w1, lead(u[1], 1) OVER o AS w2, lead(u[1], 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY u[2])),
y AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w1, w2, w3) AS n FROM x WHERE w3 IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM y, (VALUES (0), (1), (2)) AS s(k) GROUP BY r),
l AS (SELECT r, u[2] AS i, u[1] AS line FROM (SELECT r, unnest(list_zip(ls, generate_series(1, len(ls)))) AS u FROM (SELECT r, string_split(t, chr(10)) AS ls FROM d))),
m AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again,
  length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
  len(regexp_extract_all(line, '[{re.escape(SYMBOLS)}]')) AS sym,
  len(regexp_extract_all(line, '{"|".join(map(re.escape, NAVIGATION))}')) AS nav,
  regexp_matches(lower(line), '{BOILERPLATE}') AS boiler,
  len(regexp_extract_all(line, '{SENTENCE_END.replace("'", "''")}')) AS ends
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT *, sym > 0.1 * chars OR nav >= 2 OR (nw <= 12 AND boiler) OR nw > 60 * (1 + ends) AS bad FROM m),
g AS (SELECT r, sum(again::INT)::BIGINT AS n_dup, sum(bad::INT)::BIGINT AS cut, sum(CASE WHEN bad THEN chars ELSE 0 END)::BIGINT AS chars_cut FROM f GROUP BY r),
b AS (SELECT d.doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[{re.escape(SYMBOLS)}]'))::BIGINT AS n_symbols,
  coalesce(g.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  coalesce(g.cut, 0)::BIGINT AS n_lines_cut, coalesce(g.chars_cut, 0)::BIGINT AS chars_cut
  FROM d LEFT JOIN rep USING (r) LEFT JOIN g USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND chars_cut <= 0.5 * word_chars AS kept,
  n_lines_cut, chars_cut FROM b
"""
