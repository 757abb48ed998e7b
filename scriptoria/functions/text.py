"""Text clean-up as Column expressions: markup, wrapped lines, headings, notes, OCR noise, folding, find and replace."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Scripts and styles, what ends a line in a page, and tags.
HIDDEN, LINE_TAGS, TAGS = r"(?is)<(script|style)[^>]*>.*?</\1>", r"(?i)<br\s*/?>|</p>|</div>|</h\d>|</li>|</tr>", r"<[^>]+>"
#: White space of any kind, as Python's texts have it.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ACCENTS = ("áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
#: Suffixes of article numbers, heads of articles, headings above them, and where editors' notes begin.
SUFFIX = r"(?:\s*(?:bis|ter|qu[aá]ter|quinquies|sexies|septies|octies|nonies|decies))?"
NAME = r"(?:ART[IÍ]CULO|Art[ií]culo|Art\.)"
ARTICLE = r"(?:\A|\n|(?<=[.;:]) )\s*" + NAME + r"\s+(\d+" + SUFFIX + r")\s*[º°o]?\s*[.:\-–—]+\s*"
HEADING = (
    r"(?m)^\s*(LIBRO|Libro|T[IÍ]TULO|T[ií]tulo|CAP[IÍ]TULO|Cap[ií]tulo|SECCI[OÓ]N|Secci[oó]n|PARTE)\s+(?:[IVXLC]+\b|\d+"
    r"|PRIMER[OA]?|SEGUND[OA]|TERCER[OA]?|CUART[OA]|QUINT[OA]|SEXT[OA]|S[ÉE]PTIM[OA]|OCTAV[OA]|NOVEN[OA]|D[ÉE]CIM[OA]|[ÚU]NIC[OA]"
    r"|Primer[oa]?|Segund[oa]|Tercer[oa]?|Cuart[oa]|Quint[oa]|[ÚU]nic[oa])(?![^\n]*,)[^\n]{0,60}$"
)
NOTE = r"\n\s*\(?\s*(?:Art[íi]culo sustituido|Art[íi]culo incorporado|Nota Infoleg|Expresi[óo]n sustituida)"
#: A title is a line like this, and what marks it.
TITLE = r"^(?!" + NAME + r"\s)(?![IVX]+[.)]\s)[A-ZÁÉÍÓÚÑ][^\n]{1,85}(?<![.;:,])$"
MARK = "§§"
ITEM = r"(?:\d+\s*[º°)\-.]|[a-zñ]\s*[).]\s|[IVX]+\s*[.)\-]|[-–—•])"


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """All character references decoded, as HTML 5 names them."""
    return texts.map(lambda t: html.unescape(t) if "&" in t else t, na_action="ignore")


def html_to_text(c: Column) -> Column:
    """Scripts and styles go with their content, ends of blocks become lines, other tags blanks; references, then white space."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, HIDDEN, " "), LINE_TAGS, "\n"), TAGS, " ")
    s = F.regexp_replace(F.replace(unescaped(s), F.lit("\xa0"), F.lit(" ")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(s, r"\n" + BLANK + r"*\n+", "\n"), rf"^{BLANK}+|{BLANK}+$", "")


def article_number(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), F.lit("quáter"), F.lit("quater"))


def join_wrapped(c: Column) -> Column:
    """Lines join unless the first ends a sentence or list head, or the next starts an item."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?<![.:;])[ \t]*\n[ \t]*(?!" + ITEM + ")", " "), r"[ \t]{2,}", " "))


def join_lines(c: Column) -> Column:
    """A hyphen at a line's end goes; lines that end no sentence join. Word characters are ASCII, as editors have them."""
    return F.regexp_replace(F.regexp_replace(c, r"(\w)-\n(\w)", "$1$2"), r"([^.:;!?\n])\n(?!\n)", "$1 ")


def is_title(line: Column) -> Column:
    return line.rlike(TITLE)


def mark_titles(c: Column, mark: str = MARK) -> Column:
    """Lines that are titles, without white space around them, get a mark: a capital first, no sentence end, no item, no article head."""
    bare = lambda x: F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(is_title(bare(x)), F.concat(F.lit(mark), bare(x))).otherwise(x)), "\n")


def without_notes(c: Column) -> Column:
    """What stands before the first editors' note."""
    return F.regexp_replace(F.element_at(F.split(c, NOTE, 2), 1), r"^\s+|\s+$", "")


def without_head(body: Column, label: Column) -> Column:
    """The body without marks at its start and without its own head, where it repeats it."""
    head = F.concat(F.lit(r"(?iu)^" + NAME + r"\s+\Q"), label, F.lit(r"\E\s*[º°]?\s*[.:\-–—]+\s*"))
    return F.regexp_replace(F.regexp_replace(body, r"^[\s\-–—.:]+", ""), head, F.lit(""))


def repair_ocr(c: Column) -> Column:
    """Degree signs after article numbers, number signs, ordinals, Roman numerals read as strokes after title words, dashes, blanks, in this order."""
    s = F.regexp_replace(c, r"\b(" + NAME + r"\s*,?\s*\d+)\s*[”\"'*%º°]+(?=\s*[.\-–—:])", "$1°")
    s = F.regexp_replace(F.regexp_replace(s, r"\bN\s*[*”\"º°%]+\s*(?=[:\d])", "N° "), r"\bN° +:", "N°:")
    s = F.regexp_replace(s, r"(?<=\d)[”*%](?=[\s).,;-])", "°")
    titles = r"(?m)\b(T[IÍ]TULO|CAP[IÍ]TULO|ANEXO|SECCI[OÓ]N|LIBRO)\s*([|!lIVX]{1,6})(?=\s*$|\s*[\n.-])"
    parts = F.split(F.regexp_replace(s, titles, "$1 \u0001$2\u0002"), "\u0001")
    numeral = lambda x: F.concat(F.translate(F.substring_index(x, "\u0002", 1), "|!l", "III"), F.substring_index(x, "\u0002", -1))
    s = F.array_join(F.transform(parts, lambda x: F.when(F.contains(x, F.lit("\u0002")), numeral(x)).otherwise(x)), "")
    s = F.replace(F.replace(s, F.lit("—-"), F.lit("—")), F.lit("--"), F.lit("-"))
    return F.regexp_replace(F.regexp_replace(s, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def folded(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), *ACCENTS)


def sections(c: Column) -> Column:
    """array<struct(heading, body)> of a text's parts under second-level headings."""
    parts = F.filter(F.split(c, r"(?m)^## +"), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.struct(F.element_at(F.split(x, "\n", 2), 1).alias("heading"), F.coalesce(F.try_element_at(F.split(x, "\n", 2), F.lit(2)), F.lit("")).alias("body")))


def count_literal(c: Column, needle: str, match_case: bool = True) -> Column:
    return F.regexp_count(c, F.lit(("" if match_case else "(?i)") + r"\Q" + needle + r"\E"))


def replace_literal(c: Column, needle: str, by: str, match_case: bool = True) -> Column:
    return F.regexp_replace(c, ("" if match_case else "(?i)") + r"\Q" + needle + r"\E", by.replace("\\", "\\\\").replace("$", "\\$"))


def paragraphs(c: Column) -> Column:
    return F.filter(F.split(c, r"\n{2,}"), lambda x: F.trim(x) != "")


def safe_markup(c: Column) -> Column:
    """Without scripts, frames, forms, handlers and script links."""
    s = F.regexp_replace(c, r"(?is)<(script|style|iframe|object|embed|form)\b.*?</\1>", "")
    s = F.regexp_replace(s, r"(?is)</?(?:script|style|iframe|object|embed|form|input|button)\b[^>]*>", "")
    s = F.regexp_replace(s, r"""(?i)\son\w+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "")
    return F.regexp_replace(s, r"""(?i)(href|src)\s*=\s*(["']?)\s*javascript:[^"'>\s]*\2""", "$1=$2#$2")


def words(c: Column) -> Column:
    """Letters and digits, folded."""
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Our choice of endings, Spanish, English, French and German, that a word of this many letters before them loses.
ENDINGS = (
    "amientos|amiento|imientos|imiento|aciones|acion|uciones|ucion|ciones|cion|siones|sion|idades|idad|mente|ables|able|ibles|ible|istas|ista|ismos|ismo|osos|osas|oso|osa"
    "|ations|ation|ments|ment|ings|ing|ness|tions|tion|edly|ed|ly|ungen|ung|heit|keit|lich|isch|eaux|eau|es|en|er|s|a|o|e"
)
STEM = r"^(.{3,}?)(?:" + ENDINGS + ")$"


def stem(word: Column) -> Column:
    """A folded word without the longest ending that leaves three letters."""
    return F.regexp_replace(word, STEM, "$1")


def stems(c: Column) -> Column:
    return F.transform(words(c), stem)


def lower_words(c: Column) -> Column:
    """Letters and digits in lower case, with accents: what words has, before it is folded. Accents are letters, so the same runs."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


UNACCENTED, LOST = str.maketrans(*ACCENTS), frozenset(ENDINGS.split("|"))
LONGEST_ENDING = max(map(len, LOST))


def stem_of(word: str) -> str:
    """The stem of one of lower_words: what stem says of it, folded."""
    if not word.isascii():
        word = word.translate(UNACCENTED)
    for at in range(max(3, len(word) - LONGEST_ENDING), len(word)):
        if word[at:] in LOST:
            return word[:at]
    return word
