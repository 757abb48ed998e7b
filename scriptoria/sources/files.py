"""Sources: decoded downloads, manifests, office documents by their XML, document stores (SRC). All files come through Spark's readers."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decoded(spark: SparkSession, path: str, charset: str = "windows-1252") -> DataFrame:
    """(path, text, bytes) of files in an old character set, which SQL's decode() does not know; bad bytes are replaced."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "text": [bytes(x).decode(charset, "replace") for x in frame["content"]], "bytes": frame["length"]})

    return spark.read.format("binaryFile").load(path).select("path", "content", "length").mapInPandas(run, "path string, text string, bytes long")


def manifest(spark: SparkSession, path: str, field: str) -> DataFrame:
    """One row per entry of a list in a JSON file."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("x")).select("x.*")


def with_missing(entries: DataFrame, files: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Entries whose file is there, and those that are skipped."""
    return entries.join(files, key), entries.join(files.select(key), key, "left_anti")


def from_first(text: F.Column, pattern: str) -> F.Column:
    """The text from the first match on; whole if there is none."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """(path, heading, body) of markdown files' sections."""
    from scriptoria.functions.text import sections

    f = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.explode(sections(F.col("value"))).alias("s"))
    return f.select("path", "s.heading", "s.body")


def word_tables(content: bytes) -> list[tuple]:
    """(table, row, col, text, span, vmerge, bold) of a word processor file."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for t, table in enumerate(root.iter(f"{W}tbl")):
        for r, row in enumerate(table.findall(f"{W}tr")):
            c = 0
            for cell in row.findall(f"{W}tc"):
                props = cell.find(f"{W}tcPr")
                span = props.find(f"{W}gridSpan") if props is not None else None
                merge = props.find(f"{W}vMerge") if props is not None else None
                width = int(span.get(f"{W}val")) if span is not None else 1
                text = "\n".join("".join(x.text or "" for x in p.iter(f"{W}t")) for p in cell.findall(f"{W}p"))
                runs = list(cell.iter(f"{W}r"))
                bold = bool(runs) and all(x.find(f"{W}rPr/{W}b") is not None for x in runs)
                out.append((t, r, c, text, width, None if merge is None else merge.get(f"{W}val") or "continue", bold))
                c += width
    return out


def _entries(content: bytes) -> dict[str, tuple[int, bytes]] | None:
    """(method, checksum and data) by name of a plain zip file's entries, still compressed; None for any other file, which zipfile is to read."""
    end = len(content) - 22
    if end < 0 or content[end : end + 4] != b"PK\5\6":
        return None
    disk, start, here, count, size, at, more = struct.unpack_from("<4H2IH", content, end + 4)
    if disk or start or here != count or more or at + size != end:
        return None
    out = {}
    for _ in range(count):
        if content[at : at + 4] != b"PK\1\2" or at + 46 > end:
            return None
        flags, method, crc, packed, full, n, extra, note, where = struct.unpack_from("<2H4x3I3H8xI", content, at + 8)
        name = content[at + 46 : at + 46 + n]
        # Encrypted, of other methods, with names in an old character set, or of sizes in zip64 fields.
        if flags & 0x2041 or method not in (0, 8) or not (flags & 0x800 or name.isascii()) or 0xFFFFFFFF in (packed, full, where) or content[where : where + 4] != b"PK\3\4" or where + 30 > end:
            return None
        own, own_extra = struct.unpack_from("<2H", content, where + 26)
        data = where + 30 + own + own_extra
        if content[where + 30 : where + 30 + own] != name or b"\0" in name or data + packed > end:
            return None
        out[name.decode()] = method, struct.pack("<2I", crc, full) + content[data : data + packed]
        at += 46 + n + extra + note
    return out if at == end else None


def _part(method: int, packed: bytes) -> bytes:
    crc, full = struct.unpack_from("<2I", packed)
    try:
        data = zlib.decompress(packed[8:], -15, min(full, 1 << 20) + 1) if method else packed[8:]
    except zlib.error as e:
        raise zipfile.BadZipFile(str(e)) from e
    if len(data) != full or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("Bad CRC-32")
    return data


def _parts(content: bytes) -> tuple[Callable[[str], tuple], Collection[str]]:
    """What gives an entry for _part() by its name, and the names."""
    if (entries := _entries(content)) is not None:
        return entries.__getitem__, entries
    z = zipfile.ZipFile(io.BytesIO(content))

    def stored(name: str) -> tuple[int, bytes]:
        data = z.read(name)
        return 0, struct.pack("<2I", zlib.crc32(data), len(data)) + data

    return stored, z.NameToInfo


@lru_cache(64)
def _visible(workbook: tuple[int, bytes], links: tuple[int, bytes]) -> list[tuple[str, str]]:
    """Names of visible sheets and where they are; files of one origin have the same, whose parts are not unpacked again."""
    targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(_part(*links))}
    found = [(s.get("name"), targets[s.get(f"{R}id")]) for s in ElementTree.fromstring(_part(*workbook)).iter(f"{S}sheet") if s.get("state", "visible") == "visible"]
    return [(name, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for name, t in found]


@lru_cache(4096)
def _column(letters: str) -> int:
    col = 0
    for letter in letters:
        col = col * 26 + ord(letter) - 64
    return col


@lru_cache(4096)
def _place(at: str) -> tuple[int, int] | None:
    """Row and column of a cell's name."""
    m = re.match(r"([A-Z]+)(\d+)$", at)
    return (int(m[2]), _column(m[1])) if m else None


def sheet_cells(content: bytes) -> list[tuple]:
    """(sheet, r, c, text) of a workbook's visible sheets."""
    out = []
    sv, si, st, sc = f"{S}v", f"{S}is", f"{S}t", f"{S}c"
    part, names = _parts(content)
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in x.iter(st)) for x in ElementTree.fromstring(_part(*part("xl/sharedStrings.xml"))).findall(f"{S}si")]
    for name, target in _visible(part("xl/workbook.xml"), part("xl/_rels/workbook.xml.rels")):
        for cell in ElementTree.fromstring(_part(*part(target))).iter(sc):
            place = _place(cell.get("r", ""))
            inline = cell.find(si)
            text = "".join([t.text or "" for t in inline.iter(st)]) if inline is not None else None if (value := cell.find(sv)) is None else value.text
            if place and text is not None:
                out.append((name, *place, shared[int(text)] if cell.get("t") == "s" else text))
    return out


def slide_runs(content: bytes) -> list[tuple]:
    """(slide, para, text) in the order of the presentation."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        ids = [x.get(f"{R}id") for x in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if x.tag.endswith("}sldId")]
        for k, i in enumerate(ids):
            for p, para in enumerate(ElementTree.fromstring(z.read("ppt/" + targets[i])).iter(f"{A}p")):
                text = "".join(t.text or "" for t in para.iter(f"{A}t"))
                if text:
                    out.append((k + 1, p, text))
    return out


def office(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """(path, …) of each file's rows; parse is one of the above, schema names its columns. Files that cannot be read give none."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    found = parse(bytes(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    found = []
                yield pd.DataFrame([(where, *x) for x in found], columns=["path", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


class DocumentStore:
    """Documents in one Parquet folder: put replaces by id, metas leaves texts and pages unread.

    Each change writes a new version beside the old one, so that readers of the old one are not disturbed.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.version, self.schema = spark, folder, 0, schema

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{self.version}") if self.version else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v{self.version + 1}")
        self.version += 1

    def put(self, docs: DataFrame) -> None:
        self._write(self.all().join(docs.select("id"), "id", "left_anti").unionByName(docs))

    def delete(self, ids: DataFrame) -> None:
        self._write(self.all().join(ids.select("id"), "id", "left_anti"))

    def metas(self, *columns: str) -> DataFrame:
        return self.all().select(*columns)
