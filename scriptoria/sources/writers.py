"""Office files from tables of cells and blocks: workbooks and word processor files, one binary per row (SNK-3, SNK-4).

Each file is put together from its own rows only, which come to one task in order; those of a workbook as one row.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Collection, Iterator
from functools import lru_cache
from itertools import groupby, islice
from operator import itemgetter
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.values import serial_day, sheet_name, typed
from scriptoria.operators.state import in_order

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Control characters that XML cannot hold.
DROPPED = {c: None for c in [*range(9), 11, 12, *range(14, 32)]}


def _text(s: str | None) -> str:
    # Most texts have nothing to drop or escape.
    if s and s.isprintable() and "&" not in s and "<" not in s and ">" not in s:
        return s
    return escape((s or "").translate(DROPPED))


HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Fields of a zip file's entries, all of 2000-01-01, deflated: version, flags (names are UTF-8), method, time, date.
ENTRY = struct.pack("<5H", 20, 0x800, zipfile.ZIP_DEFLATED, 0, (20 << 9) | (1 << 5) | 1)


def _deflated(body: str) -> tuple[bytes, bytes]:
    """A part's data, and its checksum and sizes."""
    raw = (HEAD + body).encode()
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = z.compress(raw) + z.flush()
    return data, struct.pack("<3I", zlib.crc32(raw), len(data), len(raw))


#: Parts that many files share are deflated once a process.
_shared_part = lru_cache(256)(_deflated)


def _packed(parts: dict[str, str], own: Collection[str]) -> bytes:
    """A zip file of parts; own: the names of those that differ between files. Larger files than zip's 32 bits can tell fail."""
    out, entries, at = [], [], 0
    for name, body in parts.items():
        data, sizes = _deflated(body) if name in own else _shared_part(body)
        n = name.encode()
        out += [b"PK\3\4", ENTRY, sizes, struct.pack("<2H", len(n), 0), n, data]
        entries += [b"PK\1\2\x14\0", ENTRY, sizes, struct.pack("<5H2I", len(n), 0, 0, 0, 0, 0, at), n]
        at += 30 + len(n) + len(data)
    listed = b"".join(entries)
    return b"".join([*out, listed, struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(parts), len(parts), len(listed), at, 0)])


@lru_cache(256)
def _types(*overrides: tuple[str, str]) -> str:
    kinds = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for n, t in overrides)
    return f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>'


@lru_cache(256)
def _links(*targets: tuple[str, str]) -> str:
    return f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{k + 1}" Type="{LINKS}/{kind}" Target="{to}"/>' for k, (kind, to) in enumerate(targets)) + "</Relationships>"


@lru_cache(2048)
def letters(c: int) -> str:
    """1 is A, 27 AA."""
    out = ""
    while c:
        c, rest = divmod(c - 1, 26)
        out = chr(65 + rest) + out
    return out


def _styles(formats: tuple[str, ...]) -> list[tuple[str | None, bool]]:
    return [(f, b) for f in (None, *formats) for b in (False, True)]


@lru_cache(256)
def _styled(formats: tuple[str, ...]) -> str:
    """The part that lists styles in that order."""
    styles, number = _styles(formats), {f: 164 + k for k, f in enumerate(formats)}
    fonts = '<fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    coded = "".join(f'<numFmt numFmtId="{number[f]}" formatCode={quoteattr(f)}/>' for f in formats)
    used = "".join(f'<xf numFmtId="{number.get(f, 0)}" fontId="{int(b)}" applyNumberFormat="1" applyFont="1"/>' for f, b in styles)
    return f'<styleSheet xmlns="{MAIN}">' + (f'<numFmts count="{len(formats)}">{coded}</numFmts>' if formats else "") + f'{fonts}<cellXfs count="{len(styles)}">{used}</cellXfs></styleSheet>'


CELL = ("sheet", "r", "c", "text", "kind", "num", "fmt", "bold", "r2", "c2")


def workbook(cells: list[tuple]) -> bytes:
    """A workbook of cells (sheet, r, c, text, kind, num, fmt, bold, r2, c2), from row and column 1, in order."""
    formats = tuple(sorted({x[6] for x in cells if x[6]}))
    styles = {x: k for k, x in enumerate(_styles(formats))}
    parts, sheets = {}, []
    for k, (name, own) in enumerate(groupby(cells, key=itemgetter(0))):
        made, merges, width, row = [], [], {}, None
        for _, r, c, text, kind, num, fmt, bold, r2, c2 in own:
            if r != row:
                made.append(f'<row r="{r}">' if row is None else f'</row><row r="{r}">')
                row = r
            at = f"{letters(c)}{r}"
            if kind == "number" or kind == "date":
                made.append(f'<c r="{at}" s="{styles[fmt, bool(bold)]}"><v>{num!r}</v></c>')
            elif text:
                made.append(f'<c r="{at}" s="{styles[fmt, bool(bold)]}" t="inlineStr"><is><t xml:space="preserve">{_text(text)}</t></is></c>')
            if (r2 or r) > r or (c2 or c) > c:
                merges.append(f'<mergeCell ref="{at}:{letters(c2 or c)}{r2 or r}"/>')
            wide = len(text or "") if "\n" not in (text or "") else max(map(len, text.split("\n")))
            width[c] = max(width.get(c, 4), wide)
        rows = [*made, "</row>"]
        columns = "".join(f'<col min="{c}" max="{c}" width="{max(6, min(60, n + 2))}" customWidth="1"/>' for c, n in sorted(width.items()))
        merged = f'<mergeCells count="{len(merges)}">{"".join(merges)}</mergeCells>' if merges else ""
        parts[f"xl/worksheets/s{k + 1}.xml"] = f'<worksheet xmlns="{MAIN}"><cols>{columns}</cols><sheetData>{"".join(rows)}</sheetData>{merged}</worksheet>'
        sheets.append(f'<sheet name={quoteattr(name or " ")} sheetId="{k + 1}" r:id="r{k + 1}"/>')
    names = [(f"xl/worksheets/s{k + 1}.xml", "spreadsheetml.worksheet") for k in range(len(sheets))]
    return _packed({
        "[Content_Types].xml": _types(("xl/workbook.xml", "spreadsheetml.sheet.main"), ("xl/styles.xml", "spreadsheetml.styles"), *names),
        "_rels/.rels": _links(("officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{"".join(sheets)}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _links(*(("worksheet", f"worksheets/s{k + 1}.xml") for k in range(len(sheets))), ("styles", "styles.xml")),
        "xl/styles.xml": _styled(formats), **parts,
    }, parts)


def workbooks(cells: DataFrame) -> DataFrame:
    """(book, content) of cells (book, sheet, r, c, text, bold, r2, c2): typed values, merges, widths from 6 to 60, safe sheet names."""
    v = cells.withColumn("v", typed(F.col("text"))).withColumn("sheet", sheet_name(F.col("sheet")))
    number = F.when(F.col("v.kind") == "date", serial_day(F.col("v.date")).cast("double")).otherwise(F.col("v.num"))
    cell = F.struct("sheet", "r", "c", "text", F.col("v.kind").alias("kind"), number.alias("num"), F.col("v.fmt").alias("fmt"), "bold", "r2", "c2")
    # A workbook is held whole when it is written; as one row it goes to Python at once, since Spark measures the batch after every row.
    whole = v.select("book", cell.alias("cell")).groupBy("book").agg(F.sort_array(F.collect_list("cell")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                books, lists = batch.slice(at, 500).columns
                flat = lists.flatten()
                # Column by column, which is many times as fast as a list of structs at a time.
                held = zip(*(c.to_pylist() for c in flat.flatten()), strict=True)
                made = [workbook(list(islice(held, n))) for n in lists.value_lengths().to_pylist()]
                yield pa.RecordBatch.from_arrays([books, pa.array(made, pa.binary())], names=["book", "content"])

    return whole.mapInArrow(run, f"book {dict(cells.dtypes)['book']}, content binary")


def word_file(blocks: list[dict]) -> bytes:
    """A word processor file of blocks (pos, kind, level, text, bold, r, c, span, vmerge): paragraphs, headings, list items, table cells.

    Cells that follow each other are one table; vmerge is restart or continue.
    """
    run = lambda x: f'<w:r>{"<w:rPr><w:b/></w:rPr>" if x["bold"] else ""}<w:t xml:space="preserve">{_text(x["text"])}</w:t></w:r>'
    body = []
    for kind, own in groupby(blocks, key=lambda x: x["kind"] == "cell"):
        if not kind:
            for x in own:
                style = {"heading": f'<w:pPr><w:pStyle w:val="Heading{x["level"] or 1}"/></w:pPr>', "item": f'<w:pPr><w:numPr><w:ilvl w:val="{x["level"] or 0}"/><w:numId w:val="1"/></w:numPr></w:pPr>'}.get(x["kind"], "")
                body.append(f"<w:p>{style}{run(x)}</w:p>")
            continue
        rows = []
        for _, row in groupby(own, key=lambda x: x["r"]):
            made = ""
            for x in row:
                merge = {"restart": '<w:vMerge w:val="restart"/>', "continue": "<w:vMerge/>"}.get(x["vmerge"], "")
                span = f'<w:gridSpan w:val="{x["span"]}"/>' if (x["span"] or 1) > 1 else ""
                lines = "".join(f"<w:p>{run({**x, 'text': t})}</w:p>" for t in (x["text"] or "").split("\n"))
                made += f"<w:tc><w:tcPr>{span}{merge}</w:tcPr>{lines}</w:tc>"
            rows.append(f"<w:tr>{made}</w:tr>")
        body.append(f"<w:tbl>{''.join(rows)}</w:tbl><w:p/>")
    level = '<w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/></w:lvl>'
    return _packed({
        "[Content_Types].xml": _types(("word/document.xml", "wordprocessingml.document.main"), ("word/numbering.xml", "wordprocessingml.numbering")),
        "_rels/.rels": _links(("officeDocument", "word/document.xml")),
        "word/_rels/document.xml.rels": _links(("numbering", "numbering.xml")),
        "word/numbering.xml": f'<w:numbering xmlns:w="{WORDS}"><w:abstractNum w:abstractNumId="0">{level}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        "word/document.xml": f'<w:document xmlns:w="{WORDS}"><w:body>{"".join(body)}</w:body></w:document>',
    }, ("word/document.xml",))


def word_files(blocks: DataFrame) -> DataFrame:
    """(doc, content) of blocks (doc, pos, kind, level, text, bold, r, c, span, vmerge)."""
    fold = lambda rows: iter([{"doc": (held := list(rows))[0]["doc"], "content": word_file(held)}])
    given = blocks.select("doc", "pos", "kind", "level", "text", "bold", "r", "c", "span", "vmerge")
    return in_order(given, "doc", ["pos", "r", "c"], fold, f"doc {dict(blocks.dtypes)['doc']}, content binary")


def written(files: DataFrame, folder: str, key: str, suffix: str) -> None:
    """Files as rows (name, content) of a folder of Parquet, to be taken out by name: Spark has no sink for single binaries."""
    files.select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("name"), "content").write.mode("overwrite").parquet(folder)


def parsed(files: DataFrame, parse, schema: str) -> DataFrame:
    """Rows that a reader of scriptoria.sources.files finds in each content."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"key {files.dtypes[0][1]}, {schema}"
    made = to_arrow_schema(_parse_datatype_string(schema))
    key = files.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [(k, *x) for k, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in parse(content)]
                columns = zip(*found, strict=True) if found else [[] for _ in made]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    return files.select(key, "content").mapInArrow(run, schema)
