"""Typed values out of cell texts, and back: locale numbers, dates, ranges, colours, check digits, names.

All are Column expressions. Numbers are written with a decimal comma and points between thousands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stay text although they look like numbers, in this order.
KEEP_TEXT = (r"^\d{1,2}\.\d{3}\.\d{3}$", r"^0\d+", r"^\d{2}-\d{8}-\d$", r"^\d{10,}$")
#: White space of any kind, as sheets have it: number formats write no-break blanks.
BLANK = r"[\s\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: What a date, a number with decimals, an amount, a whole number and a percentage look like.
DATE = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
DECIMAL = r"^(-?)\$?" + BLANK + r"?(\d{1,3}(?:\.\d{3})+|\d+),(\d{1,2})$"
CURRENCY = r"^(-?)\$" + BLANK + r"?(\d{1,3}(?:\.\d{3})+|\d+)$"
INTEGER = r"^-?\d{1,9}$"
PERCENT = r"^(-?\d+(?:[.,]\d+)?)" + BLANK + r"?%$"
#: Weights of the tax id's check digit.
TAX_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
#: Colours of the usual theme, and numbered colours.
THEME = ("FFFFFF", "000000", "E7E6E6", "44546A", "4472C4", "ED7D31", "A5A5A5", "FFC000", "5B9BD5", "70AD47")
INDEXED = (
    *("000000", "FFFFFF", "FF0000", "00FF00", "0000FF", "FFFF00", "FF00FF", "00FFFF"), *("000000", "FFFFFF", "FF0000", "00FF00", "0000FF", "FFFF00", "FF00FF", "00FFFF"),
    "800000", "008000", "000080", "808000", "800080", "008080", "C0C0C0", "808080", "9999FF", "993366", "FFFFCC", "CCFFFF", "660066", "FF8080", "0066CC", "CCCCFF",
    "000080", "FF00FF", "FFFF00", "00FFFF", "800080", "800000", "008080", "0000FF", "00CCFF", "CCFFFF", "CCFFCC", "FFFF99", "99CCFF", "FF99CC", "CC99FF", "FFCC99",
    "3366FF", "33CCCC", "99CC00", "FFCC00", "FF9900", "FF6600", "666699", "969696", "003366", "339966", "003300", "333300", "993300", "993366", "333399", "333333",
)
#: Page formats by name, short and long side in millimetres.
PAPERS = (("A4", 210.0, 297.0), ("Letter", 215.9, 279.4), ("Oficio", 215.9, 330.2))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def rolled_date(day: Column, month: Column, year: Column) -> Column:
    """A month beyond 12 rolls over into later years; a day that its month lacks gives null."""
    at = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)
    return F.when(F.dayofmonth(at) == day, at)


def typed(c: Column) -> Column:
    """struct(kind, str, num, date, fmt): the first rule that fits decides; blanks give kind null."""
    # The text without blanks, its date and its rule are found once each and bound; what follows looks at one pattern only.
    return _once(trimmed(c), lambda s: _once(F.when(s.rlike(DATE), _date(s)), lambda date: _once(F.named_struct(F.lit("s"), s, F.lit("rule"), _rule(s, date), F.lit("date"), date), _typed_by_rule)))


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it: an array of one binds it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _date(s: Column) -> Column:
    part = lambda k: F.regexp_extract(s, DATE, k).cast("int")
    return _once(part(3), lambda y: rolled_date(part(1), part(2), F.when(y < 100, y + 2000).otherwise(y)))


def _rule(s: Column, date: Column) -> Column:
    text = F.lit(False)
    for p in KEEP_TEXT:
        text = text | s.rlike(p)
    return F.when(s.isNull() | (s == ""), None).when(text, 0).when(date.isNotNull(), 1).when(s.rlike(DECIMAL), 2).when(s.rlike(CURRENCY), 3).when(s.rlike(INTEGER), 4).when(s.rlike(PERCENT), 5).otherwise(0)


def _typed_by_rule(x: Column) -> Column:
    s, rule, date = x["s"], x["rule"], x["date"]
    whole = lambda p: F.concat(F.regexp_extract(s, p, 1), F.replace(F.regexp_extract(s, p, 2), F.lit("."), F.lit("")))
    decimals = F.regexp_extract(s, DECIMAL, 3)
    number = (
        F.when(rule == 2, F.concat(whole(DECIMAL), F.lit("."), decimals).cast("double")).when(rule == 3, whole(CURRENCY).cast("double"))
        .when(rule == 4, s.cast("double")).when(rule == 5, F.replace(F.regexp_extract(s, PERCENT, 1), F.lit(","), F.lit(".")).cast("double") / 100)
    )
    fmt = F.when(rule == 1, F.lit("dd/mm/yyyy")).when(rule == 2, F.concat(F.lit("#,##0."), F.repeat(F.lit("0"), F.length(decimals)))).when(rule == 3, F.lit('"$" #,##0')).when(rule == 5, F.lit("0.##%"))
    kind = F.when(rule == 0, F.lit("text")).when(rule == 1, F.lit("date")).otherwise(F.lit("number"))
    fields = {"kind": kind, "str": F.when(rule == 0, s), "num": number, "date": F.when(rule == 1, date), "fmt": fmt}
    return F.when(rule.isNotNull(), F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)]))


def locale_number(c: Column, decimals: int = 2) -> Column:
    return F.translate(F.format_number(c, decimals), ".,", ",.")


def serial_day(c: Column) -> Column:
    """Days as spreadsheets count them."""
    return F.datediff(c, F.lit("1970-01-01").cast("date")) + 25569


def column_number(letters: Column) -> Column:
    """A is 1, Z 26, AA 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def cell_range(c: Column) -> Column:
    """struct(r1, c1, r2, c2) of an A1 range, corners in order; a single cell is a range of one. Null if it is none."""
    s = F.upper(F.regexp_replace(F.regexp_replace(c, r"^.*!", ""), r"\$", ""))
    shape = r"^([A-Z]{1,3})(\d+)(?::([A-Z]{1,3})(\d+))?$"
    one = lambda k: F.regexp_extract(s, shape, k)
    second = one(3) != ""
    a, b = column_number(one(1)), F.when(second, column_number(one(3))).otherwise(column_number(one(1)))
    p, q = one(2).cast("int"), F.when(second, one(4).cast("int")).otherwise(one(2).cast("int"))
    return F.when(s.rlike(shape), F.struct(F.least(p, q).alias("r1"), F.least(a, b).alias("c1"), F.greatest(p, q).alias("r2"), F.greatest(a, b).alias("c2")))


def css_colour(c: Column) -> Column:
    """RRGGBB of #rgb, #rrggbb, rgb() or rgba(); null for others and for no opacity."""
    s = F.lower(trimmed(c))
    three = F.regexp_extract(s, r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", 0)
    twice = F.regexp_replace(s, r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", "$1$1$2$2$3$3")
    shape = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,\s*([0-9.]+)\s*)?\)$"
    channel = lambda k: F.lpad(F.hex(F.least(F.regexp_extract(s, shape, k).cast("long"), F.lit(255))), 2, "0")
    clear = F.when(F.regexp_extract(s, shape, 4) != "", F.regexp_extract(s, shape, 4).cast("double")) == 0
    return F.when(three != "", F.upper(twice)).when(s.rlike(r"^#[0-9a-f]{6}$"), F.upper(F.substring(s, 2, 6))).when(s.rlike(shape) & ~F.coalesce(clear, F.lit(False)), F.concat(channel(1), channel(2), channel(3)))


def css_length_px(c: Column) -> Column:
    """Pixels at 96 to the inch."""
    value = F.regexp_extract(c, r"^(-?[0-9.]+)(px|mm|pt|in|cm)?$", 1).cast("double")
    unit = F.regexp_extract(c, r"^(-?[0-9.]+)(px|mm|pt|in|cm)?$", 2)
    return F.when(unit == "mm", value * 96 / 25.4).when(unit == "cm", value * 96 / 2.54).when(unit == "pt", value * 96 / 72).when(unit == "in", value * 96).otherwise(value)


def tinted(colour: Column, tint: Column) -> Column:
    """Channels of RRGGBB towards white by a positive part, towards black by a negative one."""
    t = F.coalesce(tint, F.lit(0.0))
    value = lambda k: F.conv(F.substring(colour, k, 2), 16, 10).cast("double")
    moved = lambda v: F.floor(F.when(t < 0, v * (1 + t)).otherwise(v + (255 - v) * t) + 0.5)
    channel = lambda k: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), moved(value(k)))).cast("long")), 2, "0")
    return F.when(colour.isNotNull(), F.concat(channel(1), channel(3), channel(5)))


def sheet_colour(argb: Column, theme: Column, tint: Column, indexed: Column, default: Column) -> Column:
    """RRGGBB of a cell's colour: as given, else by theme and tint, else by number, else the default."""
    pick = lambda names, k: F.get(F.array(*[F.lit(x) for x in names]), k)
    return F.coalesce(F.upper(F.when(F.length(argb) == 8, F.substring(argb, 3, 6)).otherwise(F.nullif(argb, F.lit("")))), tinted(pick(THEME, theme), tint), pick(INDEXED, indexed), default)


def relative_time(at: Column, now: Column) -> Column:
    """Minutes below an hour, at least 1; hours below a day; days below 30; else the date. Null gives a dash."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(at)
    return (
        F.when(at.isNull(), F.lit("—"))
        .when(seconds < 3600, F.concat(F.lit("hace "), F.greatest(F.lit(1), F.floor(seconds / 60)).cast("string"), F.lit(" min")))
        .when(seconds < 86400, F.concat(F.lit("hace "), F.floor(seconds / 3600).cast("string"), F.lit(" h")))
        .when(seconds < 30 * 86400, F.concat(F.lit("hace "), F.floor(seconds / 86400).cast("string"), F.lit(" d")))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


def month_name(at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(at))


def short_date(at: Column) -> Column:
    """05 mar 2024; a dash for null."""
    return F.when(at.isNull(), F.lit("—")).otherwise(F.concat_ws(" ", F.date_format(at, "dd"), F.substring(month_name(at), 1, 3), F.date_format(at, "yyyy")))


def initials(name: Column, mail: Column) -> Column:
    """Of two parts or more the first two initials, else the first two characters, in capitals."""
    base = F.when(F.coalesce(trimmed(name), F.lit("")) != "", trimmed(name)).otherwise(F.substring_index(F.coalesce(mail, F.lit("")), "@", 1))
    parts = F.filter(F.split(base, r"[\s._-]+"), lambda x: x != "")
    two = F.concat(F.substring(F.element_at(parts, 1), 1, 1), F.substring(F.try_element_at(parts, F.lit(2)), 1, 1))
    return F.upper(F.when(F.size(parts) >= 2, two).otherwise(F.substring(base, 1, 2)))


def rolling_hash(c: Column) -> Column:
    """h * 31 + code, modulo 2**32."""
    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda h, x: (h * 31 + F.ascii(x)).bitwiseAND(F.lit(4294967295)))


def tax_id_valid(c: Column) -> Column:
    """Eleven digits, the last of which checks the first ten, modulo 11."""
    digits = F.regexp_replace(c, r"[-.\s]", "")
    weights = F.array(*[F.lit(w) for w in TAX_WEIGHTS])
    total = F.aggregate(F.zip_with(F.slice(F.split(digits, ""), 1, 10), weights, lambda d, w: d.cast("int") * w), F.lit(0), lambda a, x: a + x)
    rest = (F.lit(11) - total % 11) % 11
    return F.coalesce(digits.rlike(r"^\d{11}$") & (rest == F.substring(digits, 11, 1).cast("int")), F.lit(False))


def fix_ocr_numbers(c: Column) -> Column:
    """Letters read for digits are put right in words that have a digit and nothing but digits, marks and such letters."""
    words = F.split(F.regexp_replace(c, r"\bN\*", "N°"), " ")
    looks = lambda w: w.rlike(r"\d") & w.rlike(r"^[0-9OolISBZ.,/:$%-]+$")
    return F.array_join(F.transform(words, lambda w: F.when(looks(w), F.translate(w, "OolISBZ", "0011582")).otherwise(w)), " ")


def looks_numeric(c: Column) -> Column:
    """Digits and marks only, after letters that are read for digits."""
    return F.translate(c, "oOQDlI|sS", "000011155").rlike(r"^[0-9][0-9.,/:$% -]*$")


def fix_sheet_text(c: Column) -> Column:
    """Number signs, quotes, blanks, and rules read as pipes at the edges."""
    s = F.regexp_replace(c, r"\bN[*º°o]\s?(?=\d)", "N° ")
    s = F.regexp_replace(F.regexp_replace(s, "[“”„]", '"'), "[‘’´`]", "'")
    return trimmed(F.regexp_replace(F.regexp_replace(s, r"^[|\s]+|[|\s]+$", ""), r"[ \t]{2,}", " "))


def is_email(c: Column) -> Column:
    return c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def sheet_name(c: Column) -> Column:
    """At most 31 characters, cut before characters that names may not have become blanks."""
    return F.regexp_replace(F.substring(c, 1, 31), r"[\\/?*\[\]:]", " ")


def normal_date(c: Column) -> Column:
    """dd/mm/yyyy of d/m/y and of a day, month name and year; null if there is none."""
    long = r"(?i)(\d{1,2}) de ([a-zñ]+) de (\d{4})"
    short = r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(c, long, 2)))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    year = F.when(F.length(F.regexp_extract(c, short, 3)) == 2, F.concat(F.lit("20"), F.regexp_extract(c, short, 3))).otherwise(F.regexp_extract(c, short, 3))
    return F.when(c.rlike(long) & (month > 0), F.concat_ws("/", two(F.regexp_extract(c, long, 1)), two(month), F.regexp_extract(c, long, 3))).when(
        c.rlike(short), F.concat_ws("/", two(F.regexp_extract(c, short, 1)), two(F.regexp_extract(c, short, 2)), year)
    )


def identity_number(c: Column) -> Column:
    """30.123.456 of seven or eight digits however they are set; null for others."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(digits.rlike(r"^\d{7,8}$"), F.translate(F.format_number(digits.cast("long"), 0), ",", "."))


def paper_format(width: Column, height: Column, tolerance: float = 0.03) -> Column:
    """Name of the nearest format by ratio of long to short side, if it is near enough."""
    ratio = F.greatest(width, height) / F.least(width, height)
    choices = F.array(*[F.struct((F.abs(ratio / F.lit(h / w) - 1)).alias("off"), F.lit(n).alias("name")) for n, w, h in PAPERS])
    best = F.array_min(choices)
    return F.when(best["off"] <= tolerance, best["name"])


def markup_escaped(c: Column) -> Column:
    s = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s
