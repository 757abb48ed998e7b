"""Sinks: quoted CSV with a byte order mark, JSON, vCards, HTML previews, encrypted backups (SNK)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions.values import markup_escaped


def csv_line(*columns: str) -> Column:
    """Every field quoted, quotes doubled, semicolons between."""
    return F.concat_ws(";", *[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Files of quoted lines; each starts with a byte order mark in its header."""
    named = df.toDF(*["﻿" + c if k == 0 else c for k, c in enumerate(df.columns)])
    named.write.csv(path, sep=";", quoteAll=True, escape='"', header=True, mode="overwrite", emptyValue="")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One compact object per row; nulls are left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """A folder for each key with its rows as compact objects, one a line, and in path/index a line for each key: n, its rows.

    Tasks write aside and their files are moved in when all are done, so a failed task leaves nothing. Keys with many rows have
    several files. A null key is the folder that Spark names for it; fields that are null are left out.
    """
    rest = [c for c in df.columns if c != key]
    rows = df.select(key, F.to_json(F.struct(*rest)).alias("value")).hint("rebalance", F.col(key))
    rows.write.partitionBy(key).text(f"{path}/rows")
    df.groupBy(key).agg(F.count("*").alias("n")).select(F.to_json(F.struct(key, "n")).alias("value")).write.text(f"{path}/index")


def read_by_key(spark: SparkSession, key: str, kind: str, schema: str, path: str) -> DataFrame:
    """Rows of write_by_key again, with their key; asking for some keys reads their folders only."""
    rows = spark.read.schema(f"value string, {key} {kind}").text(f"{path}/rows")
    return rows.select(key, F.from_json("value", schema).alias("x")).select(key, "x.*")


def vcard(name: Column, org: Column, phones: Column, mail: Column) -> Column:
    """vCard 3.0 with CRLF; the last word of the name is the family name."""
    parts = F.split(F.trim(name), r"\s+")
    family, given = F.element_at(parts, -1), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))
    tels = F.when(F.size(phones) > 0, F.array_join(F.transform(phones, lambda p: F.concat(F.lit("TEL;TYPE=CELL:"), p)), "\r\n"))
    return F.concat(F.concat_ws("\r\n", F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.concat(F.lit("N:"), family, F.lit(";"), given, F.lit(";;;")), line("FN:", name), line("ORG:", org), tels, line("EMAIL:", mail), F.lit("END:VCARD")), F.lit("\r\n"))


def html_preview(df: DataFrame, rows: int = 60) -> str:
    """A table of the first rows, and how many more there are."""
    shown = df.limit(rows).select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), markup_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns], F.lit("</tr>")).alias("row")).collect()
    more = df.count() - len(shown)
    return "<table>" + "".join(r["row"] for r in shown) + "</table>" + (f"<p>… and {more} more</p>" if more > 0 else "")


def backup_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 16)


def encrypted(df: DataFrame, key: bytes) -> DataFrame:
    """Each row as JSON, encrypted (AES-GCM)."""
    return df.select(F.aes_encrypt(F.to_json(F.struct("*")), F.lit(key), F.lit("GCM")).alias("sealed"))


def decrypted(df: DataFrame, key: bytes, schema: str) -> DataFrame:
    """The rows again; a wrong key fails."""
    opened = F.aes_decrypt("sealed", F.lit(key), F.lit("GCM")).cast("string")
    return df.select(F.from_json(opened, schema).alias("row")).select("row.*")
