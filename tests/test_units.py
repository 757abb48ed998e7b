"""Unit vectors of operators that no table query covers: sinks, file sources, streams, kernels."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptoria import streaming
from scriptoria.functions import text as T
from scriptoria.functions import values as V
from scriptoria.operators import aggregates, algebra, corpus, geometry, layout, raster, relational, retrieval, ruled, state
from scriptoria.sources import files, sinks


def test_typed_quirks(spark):
    cells = {"05/11/2023": "text", "12/03/2024": "date", "12/13/2024": "date", "31/02/2024": "text", "0042": "text", "1.250,5": "number", "$ 7": "number", "$ 1250": "number", "$  7": "text", "1.2,5": "text", "x": "text", " ": None}
    df = spark.createDataFrame([(k,) for k in cells], "s string").select("s", V.typed(F.col("s")).alias("v"))
    got = {r["s"]: r["v"] for r in df.collect()}
    assert {k: v["kind"] if v else None for k, v in got.items()} == cells
    assert str(got["12/13/2024"]["date"]) == "2025-01-12" and got["1.250,5"]["num"] == 1250.5 and got["1.250,5"]["fmt"] == "#,##0.0" and got["$ 1250"]["num"] == 1250


def test_backup_round_trip(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    key = sinks.backup_key("secret", b"salt", 1000)
    sealed = sinks.encrypted(df, key)
    assert sorted(map(tuple, sinks.decrypted(sealed, key, "id int, t string").collect())) == [(1, "a"), (2, None)]
    with pytest.raises(Exception):
        sinks.decrypted(sealed, sinks.backup_key("wrong", b"salt", 1000), "id int, t string").collect()


def test_csv_and_json_files(spark, tmp_path):
    df = spark.createDataFrame([('a"b', 1)], "x string, n int").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part*")).read_text(encoding="utf-8")
    assert text == '"﻿x";"n"\n"a""b";"1"\n'
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert next((tmp_path / "j").glob("part*")).read_text() == '{"x":"a\\"b","n":1}\n'
    assert "… and 2 more" in sinks.html_preview(spark.range(5), 3)


def test_old_character_sets_and_manifests(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("pre\nArtículo 1 ñ".encode("windows-1252"))
    got = files.decoded(spark, str(tmp_path / "a.txt")).select(files.from_first(F.col("text"), "Art").alias("t")).first()["t"]
    assert got == "Artículo 1 ñ"
    (tmp_path / "m.json").write_text('{"leyes": [{"id": "a"}, {"id": "b"}]}')
    entries = files.manifest(spark, str(tmp_path / "m.json"), "leyes")
    there, missing = files.with_missing(entries, spark.createDataFrame([("a",)], "id string"), "id")
    assert there.count() == 1 and missing.first()["id"] == "b"
    (tmp_path / "k.md").write_text("# K\n## One\nbody\n## Two\nmore")
    assert {r["heading"] for r in files.knowledge(spark, str(tmp_path / "k.md")).collect()} == {"# K", "One", "Two"}


def test_office_files(spark, tmp_path):
    def pack(name, parts):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for path, body in parts.items():
                z.writestr(path, body)

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    pack("d.docx", {"word/document.xml": f'<w:document {w}><w:body><w:tbl><w:tr>{cell("a", "<w:gridSpan w:val=\"2\"/>")}{cell("b", "<w:vMerge w:val=\"restart\"/>")}</w:tr><w:tr>{cell("c")}{cell("d")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl></w:body></w:document>'})
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    rows = files.office(spark, str(tmp_path / "*.docx"), files.word_tables, "t int, r int, c int, text string, span int, vmerge string, bold boolean")
    assert [(r["r"], r["c"], r["text"], r["span"], r["vmerge"]) for r in rows.orderBy("r", "c").collect()] == [(0, 0, "a", 2, None), (0, 2, "b", 1, "restart"), (1, 0, "c", 1, None), (1, 1, "d", 1, None), (1, 2, "", 1, "continue")]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    pack("b.xlsx", {
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>hello</t></si></sst>",
        "xl/worksheets/s.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB2"><v>7</v></c></row></sheetData></worksheet>',
    })
    cells = files.office(spark, str(tmp_path / "*.xlsx"), files.sheet_cells, "sheet string, r int, c int, text string")
    assert sorted(tuple(r)[1:] for r in cells.collect()) == [("S", 1, 1, "hello"), ("S", 2, 28, "7")]


def test_document_store(spark, tmp_path):
    store = files.DocumentStore(spark, str(tmp_path / "store"), "id int, name string, text string")
    make = lambda *rows: spark.createDataFrame(list(rows), "id int, name string, text string")
    store.put(make((1, "a", "x"), (2, "b", "y")))
    store.put(make((2, "c", "z")))
    store.delete(make((1, "", "")))
    assert [tuple(r) for r in store.metas("id", "name").collect()] == [(2, "c")]


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(k % 2, float(k), float((k * 37) % 120)) for k in range(60)]
    df = spark.createDataFrame(rows, "device int, at double, v double")
    for k in range(3):
        df.where(F.floor(F.col("at") / 20) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {(r["device"], r["at"]): r["on"] for r in state.schmitt(df, "device", ["at"], "v").collect()}
    query = streaming.schmitt(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "device", "at", "v").writeStream.format("memory").queryName("switches").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["device"], r["at"]): r["on"] for r in spark.table("switches").collect()} == batch


def test_kernels():
    g = np.full((60, 90), 40, np.uint8)
    g[10:50, 15:75] = 230
    q, score = raster.document_quad(g)
    corners = np.array(sorted(map(tuple, np.array(q))))
    assert score > 0.2 and np.abs(corners - np.array(sorted([(15, 10), (15, 49), (74, 10), (74, 49)]))).max() <= 4
    assert raster.document_quad(np.full((40, 40), 9, np.uint8)) == (None, 0.0)
    b = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool)
    assert len(np.unique(raster.labelled(b))) == 3 and len(np.unique(raster.labelled(b, False))) == 4
    square = np.array([[0, 0], [1, 0], [2, 0], [2, 2], [0, 2], [1, 1]])
    assert len(geometry.hull(square)) == 4 and len(geometry.simplified(np.array([[0, 0], [1, 0.01], [2, 0], [2, 2], [0, 2]]), 0.1)) == 4


def test_rules_and_gaps(spark):
    g = np.full((120, 200), 240, np.uint8)
    g[20:22, 10:180] = 30
    g[20:22, 80:82] = 240  # a hole of two pixels
    g[60:70, 10:180] = 30  # too thick for a rule
    g[100, 10:60], g[100, 66:180] = 30, 30  # two pieces of one line
    images = spark.createDataFrame([(1, 200, 120, bytearray(g.tobytes()))], "page long, w int, h int, pixels binary")
    rules = ruled.page_rules(images)
    assert sorted(tuple(r) for r in rules.collect()) == [(1, False, 20.5, 10, 179, 2), (1, False, 100.0, 10, 179, 1)]
    assert ruled.paper_level(g) == 240 and ruled.grids_of(rules)[0].count() == 0
    t = np.full((20, 100), 255, np.uint8)
    for a, b in ((10, 20), (22, 30), (50, 58), (80, 90)):
        t[5:15, a:b] = 0
    assert ruled.recut(t, 3, 8, 2, 92, 17) == [(10, 30), (50, 58), (80, 90)]
    assert ruled.recut(t, 5, 8, 2, 92, 17) is None
    t[5:15, 60:70] = 0
    assert ruled.recut(t, 3, 8, 2, 92, 17) is not None and ruled.recut(np.full((20, 50), 255, np.uint8), 2, 0, 0, 49, 19) is None


def test_long_chains_and_any_number_of_aliases(spark):
    chain = spark.range(300).selectExpr("id a", "id + 1 b")
    assert {tuple(r) for r in corpus.components(chain, "a", "b").collect()} == {(k, 0) for k in range(301)}
    aliases = spark.range(15_000).selectExpr("concat('l', id) law", "concat('ley ', id) alias")
    asked = spark.createDataFrame([("qué dice la ley 14999 hoy",), ("nada",)], "q string")
    assert {r["q"]: r["law"] for r in retrieval.resolve_alias(asked, aliases).collect()} == {"qué dice la ley 14999 hoy": "l14999", "nada": None}


def test_small_relational(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert sorted(map(tuple, relational.upsert(a, b, "id").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    parent, child = relational.delete_cascade(a, spark.createDataFrame([(10, 1), (11, 2)], "k int, ref int"), a.where("id = 1").select("id"), "id", "ref")
    assert parent.count() == 1 and [r["k"] for r in child.collect()] == [11]
    assert relational.with_column_if_absent(a, "v", F.lit("q")).collect() == a.collect()
    assert algebra.page_list("5-2, 9") == [(2, 5), (9, 9)]
    lines = spark.createDataFrame([(1, 0, "una pa-", 0.0, 100.0, 0.0, False, 100.0), (1, 1, "labra larga", 0.0, 60.0, 12.0, False, 100.0), (1, 2, "Otra", 0.0, 30.0, 24.0, False, 100.0)], "page int, line int, text string, x0 double, x1 double, y0 double, b boolean, right double")
    assert [r["text"] for r in layout.paragraphs(lines).orderBy("para").collect()] == ["una palabra larga", "Otra"]


def test_text_rules(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    lines = ["Título grande", "fin de frase.", "  Régimen de Licencias ", "IV) Los bienes", "Artículo 5 bis sin signo", "- Guion", "1) Ítem", "Termina con coma,", "De la\u00a0prueba"]
    want = ["§§Título grande", "fin de frase.", "§§Régimen de Licencias", "IV) Los bienes", "Artículo 5 bis sin signo", "- Guion", "1) Ítem", "Termina con coma,", "§§De la\u00a0prueba"]
    assert one(T.mark_titles(F.lit("\n".join(lines)))).split("\n") == want
    assert one(T.html_to_text(F.lit("a\u2003\n\u3000\nb"))) == "a\u2003\nb"
    cells = ["$\u00a01.250", "\u00a07,5\u00a0", "12,5\u00a0%", "\ufeff12"]
    assert [one(V.typed(F.lit(c)))["num"] for c in cells] == [1250.0, 7.5, 0.125, 12.0]
    assert one(T.without_head(F.lit(". - Artículo 16: El texto"), F.lit("16"))) == "El texto"
    assert one(T.html_to_text(F.lit("<p>Ni&ntilde;o &amp;lt; &#x41;&hearts;</p>\n \n<script>x</script>y"))) == "Niño &lt; A♥\n y"
    assert one(T.replace_literal(F.lit("a.b A.B"), "a.b", "$1", False)) == "$1 $1"
    assert one(V.is_email(F.lit("a@b.c"))) and not one(V.is_email(F.lit("a@b")))
    assert one(T.article_number(F.lit(" 27  Quáter"))) == "27 quater"
    assert one(V.column_number(F.lit("AB"))) == 28


def test_spine_and_renewed_index(spark):
    from scriptoria.operators import aggregates, relational

    # The darkest column of all is at the edge; of two equal ones near the centre the more central counts.
    dark = {0: 1, 4: 30, 6: 30}
    pixels = spark.createDataFrame([("a", x, y, dark.get(x, 200)) for x in range(10) for y in range(3)], "img string, x int, y int, v int")
    assert [tuple(r) for r in aggregates.darkest_column(pixels, "img").collect()] == [("a", 4, 30.0)]
    assert aggregates.darkest_column(pixels.limit(0), "img").count() == 0
    index = spark.createDataFrame([("same", 1, "old"), ("same", 1, "old too"), ("newer", 1, "old"), ("gone", 1, "old"), ("none", None, "old")], "f string, ver int, entry string")
    sources = spark.createDataFrame([("same", 1), ("newer", 2), ("added", 1), ("none", None)], "f string, ver int")
    got = relational.renewed(index, sources, "f", "ver", lambda x: x.selectExpr("'new' as entry", "ver", "f")).collect()
    assert sorted((r["f"], r["entry"]) for r in got) == [("added", "new"), ("newer", "new"), ("none", "new"), ("same", "old"), ("same", "old too")]


def test_stored_index_equals_a_scan_and_reads_asked_folders(spark, tmp_path):
    from scriptoria.operators import index as I

    docs = [(k, 1, t) for k, t in enumerate(["cats and dogs", "a cat", "", None, "the dogs of the dog owner", "felines sleeping", "birds", "bird song"])]
    df = spark.createDataFrame(docs, "id long, ver int, text string")
    index = I.store(I.entries(df, "id", "ver", F.col("text")), I.Index(str(tmp_path / "i1"), "id", 16))
    assert index.part(spark, "whole").first()["docs"] == 8
    same = spark.createDataFrame([("cat", "feline")], "word string, also string")
    asked = spark.createDataFrame([("cats",), ("dog bird",), ("xyzzy",)], "q string")
    found = I.answers(index, asked, same, 5, 0.0).collect()
    by = {q: [r.id for r in sorted(found, key=lambda r: r["rank"]) if r.q == q] for q in ("cats", "dog bird", "xyzzy")}
    assert set(by["cats"]) == {0, 1, 5} and set(by["dog bird"]) == {0, 4, 6, 7} and by["xyzzy"] == [None]
    assert [r.id for r in I.top(index, "dog bird", same, 2).collect()] == by["dog bird"][:2]
    plan = I.scores(index, asked.limit(1), same)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    new = df.where("id <> 6").withColumn("ver", F.when(F.col("id") == 7, 2).otherwise(1)).withColumn("text", F.when(F.col("id") == 7, "cat song").otherwise(F.col("text")))
    again = I.renew(index, new, "ver", F.col("text"), str(tmp_path / "i2"))
    fresh = I.store(I.entries(new, "id", "ver", F.col("text")), I.Index(str(tmp_path / "i3"), "id", 16))
    rows = lambda i: sorted(map(tuple, i.part(spark, "entries").select("id", "ver", "dl", "term", "tf").collect()))
    assert rows(again) == rows(fresh)


def test_entries_are_counted_where_the_text_lies(spark):
    import re
    from collections import Counter

    from scriptoria.functions import text as T
    from scriptoria.operators import index as I

    kind = "id long, ver int, text string"
    plain = [(1, 1, "Cats, cats & a CAT's Ñandú_ñandues"), (2, 1, None), (3, 1, "..."), (4, 1, "İstanbul ΣΑΣ ½x² Überfälle" * 3), (1, 2, "other version"), (None, 1, "no key")]
    few = spark.createDataFrame(plain, kind)
    made = I.entries(few, "id", "ver", F.col("text"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()

    def want(rows):
        count = Counter()
        for r in rows:
            terms = [w for (w,) in spark.createDataFrame([(r[2],)], "t string").select(F.explode(T.stems(F.col("t")))).collect()]
            count.update((r[0], r[1], len(terms), t) for t in ["", *terms])
        return count

    got = lambda df: {(r.id, r.ver, r.dl, r.term): r.tf for r in df.collect()}
    assert got(made) == want(plain) and made.count() == len(want(plain))
    # Rows of one key and version are added up, whatever batches they are in; null keys are one.
    more = plain + [(1, 1, "Cats, cats & a CAT's Ñandú_ñandues"), (None, 1, "no key"), (3, 1, "longer than before")]
    both = I.entries(spark.createDataFrame(more, kind).repartition(5), "id", "ver", F.col("text"))
    assert got(both) == want(more) and both.count() == len(want(more))
    words = sorted({w for r in more for w in re.findall(r"\w+", (r[2] or "").lower())} | {"operationes", "ed", "abcs", "amientos", "xamientos", "xyzamientos", "ción", "aciones"})
    by_spark = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(T.folded(F.col("w"))).alias("s")).collect()
    assert [(r.w, r.s) for r in by_spark if T.stem_of(r.w) != r.s] == []


def test_renewal_takes_entries_over_in_any_number(spark, tmp_path, monkeypatch):
    from scriptoria.operators import index as I

    old = spark.createDataFrame([(k, 1, f"word{k % 7} and more {k}") for k in range(40)] + [(5, 1, "twice here")], "id long, ver int, text string")
    new = old.where("id % 5 <> 1").withColumn("ver", F.when(F.col("id") % 3 == 0, 2).otherwise(1)).withColumn("text", F.when(F.col("ver") == 2, F.concat("text", F.lit(" renewed"))).otherwise(F.col("text")))
    rows = lambda i: sorted(map(tuple, i.part(spark, "entries").select("id", "ver", "dl", "term", "tf").collect()))
    fresh = rows(I.store(I.entries(new, "id", "ver", F.col("text")), I.Index(str(tmp_path / "fresh"), "id", 4)))
    for sent in (I.SENT, 0):  # keys sent to all, keys joined by shuffling
        monkeypatch.setattr(I, "SENT", sent)
        index = I.store(I.entries(old, "id", "ver", F.col("text")), I.Index(str(tmp_path / f"old{sent}"), "id", 4))
        assert rows(I.renew(index, new, "ver", F.col("text"), str(tmp_path / f"new{sent}"))) == fresh


def test_reach_and_communities(spark):
    from itertools import product

    from scriptoria.operators import graph

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), (None, "a"), ("a", "b")], "src string, dst string")
    got = {(r.start, r.node): r.steps for r in graph.reachable(e, spark.createDataFrame([("a",), ("d",)], "start string"), 3).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("d", "d"): 0, ("d", "e"): 1}
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (5, 6)]

    def quality(label):
        m, inside = 2 * len(edges), sum(2 for a, b in edges if label[a] == label[b])
        degree = [sum(x in p for p in edges) for x in range(7)]
        return inside / m - sum(sum(d for d, c in zip(degree, label, strict=True) if c == k) ** 2 for k in set(label)) / m**2

    found = {r.node: r.community for r in graph.communities(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    best = max(quality(x) for x in product(range(3), repeat=7))
    assert quality([found[k] for k in range(7)]) >= 0.95 * best and all(found[c] == c for c in found.values())
    assert graph.communities(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_edits_rebuild_the_other_text(spark):
    import random

    from scriptoria.operators import compare

    r = random.Random(3)
    lines = lambda n: [r.choice("abcdefgh") * r.randint(1, 2) for _ in range(n)]
    pairs = [(k, "\n".join(lines(r.randint(0, 30))), "\n".join(lines(r.randint(0, 30)))) for k in range(60)]
    pairs += [(100, "a\nb\nc", "a\nb\nc"), (101, None, "x\ny"), (102, "x", None), (103, "", "")]
    df = compare.text_edits(spark.createDataFrame(pairs, "k int, a string, b string").withColumn("old", F.col("a")), ["k", "a"], "old", "b")
    got = {x.k: x for x in df.select("k", "edits", compare.applied(F.col("a"), F.col("edits")).alias("made")).collect()}
    assert all(got[k].made == (b or "") for k, _, b in pairs) and got[100].edits == []

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    kept = sum(len(a.split("\n")) - sum(e["gone"] for e in got[k].edits) for k, a, _ in pairs[:60])
    assert kept == sum(common(a.split("\n"), b.split("\n")) for _, a, b in pairs[:60])
    a = [f"line {k}" for k in range(900)]
    b = [x for k, x in enumerate(a) if k % 7] + ["end"] * 3
    assert compare.edits(a, b) == compare.edits(a, b) and sum(e["gone"] for e in compare.edits(a, b)) == 129 and compare.matched(["x"] * 3, ["y"] * 3, 0) == []


def test_timers_fire_after_silence(spark, tmp_path):
    rows = [("a", 0, "x"), ("a", 10, "x"), ("a", 400, "y"), ("a", 450, "x"), ("b", 20, "x"), ("b", 5000, "z"), ("c", 30, None), ("a", 6000, "x")]
    df = spark.createDataFrame([(k, t, v) for k, t, v in rows], "k string, s long, v string").select("k", F.timestamp_seconds(F.col("s") + 100_000).alias("at"), "v")
    df.write.parquet(str(tmp_path / "in"))
    for value in (None, "v"):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        out = str(tmp_path / f"out-{value}")
        streaming.run_to_files(streaming.fires(stream, "k", "at", value, 300, "100 seconds"), out, str(tmp_path / f"ledger-{value}"))
        got = sorted(map(tuple, spark.read.schema("k string, first timestamp, fired timestamp").parquet(out).collect()))
        assert got == sorted(map(tuple, state.fires(df, "k", "at", value, 300, 100).collect())) and len(got) >= 4
        assert any(k == "c" for k, *_ in got)


def test_titles_stand_before_articles_however_parts_are_joined(spark):
    """Articles and what stands before them are dealt by law already, and large parts are joined apart from small ones."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "40kb", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        laws = spark.range(4000).select((F.col("id") % 500).alias("law"), F.sha2(F.col("id").cast("string"), 256).alias("t"), "id")
        arts = laws.withColumn("pos", F.row_number().over(Window.partitionBy("law").orderBy("id"))).select("law", "pos", F.col("pos").cast("string").alias("n"), "t")
        before = laws.select("law").distinct().select("law", F.lit("§§CAPITULO I\nx").alias("text"))
        got = corpus.section_titles(arts, before, "law").collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert len(got) == 4000 and {r["u"] for r in got} == {"CAPITULO I"}


def test_sharpness_agrees_with_pixels_and_shuffles_none(spark):
    texts = ["", "a", "ñ€😀" * 70, "x" * 48 * 3, "abcdefg" * 21, "line\n" * 60, None, "z" * 97]
    docs = spark.createDataFrame(list(enumerate(texts)), "img long, text string")
    each = docs.select("img", F.posexplode(F.split("text", "")).alias("k", "c"))
    want = aggregates.laplacian_variance(each.select("img", F.floor(F.col("k") / 48).alias("y"), (F.col("k") % 48).alias("x"), (F.ascii("c") % 256).alias("v")), "img")
    codes = F.encode(F.when(F.col("text") == "", "\x00").otherwise(F.col("text")), "UTF-32")
    got = raster.sharpness(docs.select("img", codes.alias("codes")), "img", 48)
    plain = lambda df: sorted((r["img"], None if r["blur"] is None else round(r["blur"], 4), round(r["std"], 6)) for r in df.collect())
    assert plain(got) == plain(want)
    assert "Exchange" not in got._jdf.queryExecution().toString()


def test_repeated_pages_by_first_shingles(spark, monkeypatch):
    """Against all pairs, with frequent lines, copies of copies, short pages and copies of a page; sets of pages that meet nothing are not shuffled."""
    monkeypatch.setattr(algebra, "SAMPLE", 2)
    r = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in r.integers(0, 500, n)]
    line = words(12)
    texts = [words(40) + line + words(r.integers(0, 20)) for _ in range(60)]
    for k in range(40):
        t = list(texts[k])
        t[int(r.integers(0, len(t)))] = "x"
        texts.append(t)
    texts = [" ".join(t) for t in texts] + ["", " ", "a b", "a  B", "c"] + [" ".join(texts[0])] * 2
    pages = [("d", k, t) for k, t in enumerate(texts)] + [("e", 0, texts[0]), (None, 7, "a b"), ("d", 900, None)]
    got = {(x["k"], x["p"], x["earlier"]) for x in algebra.repeated_pages(spark.createDataFrame(pages, "k string, p long, t string"), "k", "p", "t").collect()}

    def grams(t):
        w = " ".join(t.lower().split()).split(" ")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [grams(t) for t in texts]
    want = {("d", i, min(js)) for i, a in enumerate(sets) if (js := [j for j in range(i) if len(a & sets[j]) >= 0.8 * len(a | sets[j])])}
    assert len(want) > 25 and got == want


def shuffled_bytes(spark):
    """Bytes that the session has shuffled so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("pairs", [20_000, 5])
def test_repeated_pages_send_a_set_to_few_tasks(spark, monkeypatch, pairs):
    """Near copies of one page are many pairs; their sets are not sent once a pair, nor are texts, and parted or joined by shuffling they give the same rows."""
    monkeypatch.setattr(algebra, "PAIRS", pairs)
    monkeypatch.setattr(algebra, "ASKED", 1_000_000 if pairs > 5 else 0)
    r = np.random.default_rng(7)
    page = [f"w{x}" for x in r.integers(0, 10**6, 600)]
    texts = []
    for k in range(60):
        t = list(page)
        for j in r.integers(0, 600, 1 + k % 12):
            t[j] = f"x{k}"
        texts.append(" ".join(t))
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = {(k, min(js)) for k, a in enumerate(grams) if (js := [j for j in range(k) if len(a & grams[j]) >= 0.8 * len(a | grams[j])])}
    pages = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "k string, p long, t string")
    before = shuffled_bytes(spark)
    assert {(x["p"], x["earlier"]) for x in algebra.repeated_pages(pages, "k", "p", "t").collect()} == want and len(want) > 50
    sets = sum(8 * len(g) for g in grams)
    assert pairs == 5 or shuffled_bytes(spark) - before < 6 * sets


def test_meetings_are_all_pairs_of_different_labels():
    import pyarrow as pa

    r = np.random.default_rng(8)
    n = r.integers(5, 9, 40)
    label = np.where(np.arange(40) < 20, 0, np.arange(40) // 2)
    rows = sorted({(int(s), int(x)) for s, x in zip(r.integers(0, 25, 400), r.integers(0, 40, 400), strict=True)} | {(99, x) for x in range(40)} | {(100, x) for x in range(20)})
    rows += [rows[-1]] * 2
    want = {}
    for s, a in set(rows):
        for t, b in set(rows):
            if s == t and a < b and label[a] != label[b] and min(n[a], n[b]) >= 0.8 * max(n[a], n[b]):
                want[a, b] = want.get((a, b), 0) + 1
    flat = [np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([n[x[1]] for x in rows]), np.array([label[x[1]] for x in rows])]
    for step in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + step]) for c in flat], names=["s", "ref", "n", "label"]) for k in range(0, len(rows), step)]
        got = {}
        for batch in algebra.meetings(0.8)(iter(batches)):
            for a, b, least, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                assert least == min(n[a], n[b])
                got[a, b] = got.get((a, b), 0) + times
        assert got == want
    assert [b.num_rows for b in algebra.meetings(0.8)(iter([]))] == [0]


def test_corners_are_sorted_once_a_quad(spark):
    df = spark.createDataFrame([(1, [5.0, 5.0, 0.0, 0.0, 0.0, 4.0, 6.0, 1.0])], "id int, v array<double>")
    q = geometry.polygon(*[F.col("v")[k] for k in range(8)])
    got = df.select(geometry.ordered_corners(q).alias("o"), geometry.ordered_corners(F.slice(q, 1, 3)).alias("none"))
    row = got.first()
    assert [tuple(p) for p in row["o"]] == [(0.0, 0.0), (6.0, 1.0), (5.0, 5.0), (0.0, 4.0)] and row["none"] is None
    plan = df.select(geometry.ordered_corners(q).alias("o"))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("atan2(") == 1


def test_styled_pages_are_not_shuffled_and_equal_their_lines(spark):
    lines = [(p, k, f"text {k}-" if k % 3 else "  head:  ", 50.0 + 100 * (k % 4 == 3), 550.0 - 200 * (k % 5 == 4), k * (12.0 + p % 2), 10.0 + 8 * (k == 0), p == 3, 600.0) for p in range(6) for k in range(p * 2)]
    lines += [(6, 0, None, 1.0, 2.0, 3.0, 4.0, None, 5.0), (7, 0, "alone", 1.0, 2.0, 3.0, None, None, None)]
    df = spark.createDataFrame(lines, "page long, line int, text string, x0 double, x1 double, y0 double, h double, b boolean, width double").repartition(3)
    whole = spark.createDataFrame([(p, [x[1:] for x in lines if x[0] == p][::-1]) for p in range(9)], "page long, lines array<struct<line int, text string, x0 double, x1 double, y0 double, h double, b boolean, width double>>")
    got = layout.styled_pages(whole)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, layout.styled_paragraphs(df).collect()))
    assert {r.page for r in got.collect()} == {1, 2, 3, 4, 5, 7}
    from scriptoria.plans import catalogue

    plan = catalogue.QUERIES["paged_paragraphs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "Sort" not in plan and "Window" not in plan


def test_shown_cells_stay_with_their_sheet(spark):
    """The cells are dealt once, by sheet: no row or column of one deals them anew."""
    cells = spark.createDataFrame([(s, r, c, f"{s}{r}{c}") for s in (1, 2, 3) for r in range(1, 5) for c in range(1, 4)] + [(None, 1, 1, "none"), (4, None, 1, "no row")], "sheet long, r int, c int, v string")
    sheets = spark.createDataFrame([(1, "S!$A$1:$B$2", "C3"), (2, "none", "B4:A2")], "sheet long, asked string, printed string")
    rows, cols = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "sheet long, r int"), spark.createDataFrame([(3, 2), (3, 2), (2, None)], "sheet long, c int")
    got = layout.shown_cells(cells, sheets, rows, cols)
    assert sorted(r.v for r in got.collect()) == ["111", "112", "221", "222", "241", "242", "321", "323", "331", "333"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = layout.shown_cells(cells, sheets, rows, cols)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    from scriptoria.plans import catalogue

    assert "hashpartitioning(sheet#" in plan and not any(", r#" in x or ", c#" in x for x in plan.split("\n") if "hashpartitioning" in x)
    plan = catalogue.QUERIES["shown_areas"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sheet#" in plan and not any("hashpartitioning(sheet" in x for x in plan.split("Generate")[0].split("SortMergeJoin")[0].split("\n"))
    assert plan.count("Exchange hashpartitioning") <= 4


def test_crossings_are_dealt_by_cells(spark):
    """One hot page is many cells, which no task holds together; rows are those of all pairs."""
    from scriptoria.plans import catalogue

    plan = catalogue.QUERIES["segment_crossings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    r = np.random.default_rng(4)
    h = [(1, k, *map(int, r.integers(-90, 90, 3))) for k in range(60)]
    v = [(1, k, *map(int, r.integers(-90, 90, 3))) for k in range(60)]
    want = [(a[1], b[1]) for a in h for b in v if min(a[3:]) == a[3] and min(b[3:]) == b[3] and a[3] - 6 <= b[2] <= a[4] + 6 and b[3] - 6 <= a[2] <= b[4] + 6]
    hs, vs = spark.createDataFrame(h, "page int, h int, y int, x0 int, x1 int").where("x0 <= x1"), spark.createDataFrame(v, "page int, v int, x int, y0 int, y1 int").where("y0 <= y1")
    for cell in (4, 8, 64):
        assert sorted(map(tuple, algebra.crossings(hs, vs, "page", cell=cell).select("h", "v").collect())) == sorted(want)


def test_workbooks_of_one_book_a_row(spark):
    """Cells in any order, two sheets, a merge, other formats and no book: files as zip has them, one row a book for Python."""
    import io

    from scriptoria.sources import writers

    cells = [(2, "b", 1, 1, "x", False, None, None), (1, "b/c", 2, 28, "$ 7", True, None, None), (1, "a", 3, 1, "12/03/2024", False, 4, 2), (1, "a", 1, 2, "1,5", False, None, None), (1, "a", 1, 1, "é & <", False, None, None), (None, "n", 1, 1, "05/11/2023", False, None, None)]
    df = spark.createDataFrame(cells, "book long, sheet string, r int, c int, text string, bold boolean, r2 int, c2 int").repartition(4)
    made = writers.workbooks(df)
    books = {r.book: bytes(r.content) for r in made.collect()}
    assert sorted(map(str, books)) == ["1", "2", "None"]
    for content in books.values():
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            assert z.testzip() is None and z.namelist()[0] == "[Content_Types].xml" and z.infolist()[0].date_time == (2000, 1, 1, 0, 0, 0)
    assert files.sheet_cells(books[1]) == [("a", 1, 1, "é & <"), ("a", 1, 2, "1.5"), ("a", 3, 1, "45363.0"), ("b c", 2, 28, "7.0")]
    assert files.sheet_cells(books[None]) == [("n", 1, 1, "05/11/2023")]
    with zipfile.ZipFile(io.BytesIO(books[1])) as z:
        assert b'<mergeCell ref="A3:B4"/>' in z.read("xl/worksheets/s1.xml")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" in plan.split("MapInArrow")[1].split("\n")[1]


def test_plain_workbooks_are_read_without_zipfile(monkeypatch):
    """Those of our own and of zipfile, packed or not; any other file is left to zipfile, and broken ones fail as there."""
    import io

    from scriptoria.sources import writers

    cells = [("a", 1, 1, "é & <", "text", None, None, False, None, None), ("a", 1, 2, "x", "text", None, None, True, None, None), ("a", 2, 28, "7", "number", 7.0, None, False, None, None), ("b", 1, 1, "y\nlonger", "text", None, None, False, None, None)]
    want = [("a", 1, 1, "é & <"), ("a", 1, 2, "x"), ("a", 2, 28, "7.0"), ("b", 1, 1, "y\nlonger")]
    own = writers.workbook(cells)
    with zipfile.ZipFile(io.BytesIO(own)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    assert b'<col min="1" max="1" width="7" customWidth="1"/><col min="2" max="2" width="6" customWidth="1"/>' in parts["xl/worksheets/s1.xml"]

    def zipped(method, comment=b"", before=b"", target=None):
        out = target or io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            z.comment = comment
            for n, data in parts.items():
                z.writestr(n, data)
        return before + out.getvalue()

    plain = [own, zipped(zipfile.ZIP_DEFLATED), zipped(zipfile.ZIP_STORED)]
    others = [zipped(zipfile.ZIP_DEFLATED, b"note"), zipped(zipfile.ZIP_DEFLATED, before=b"#!x"), zipped(zipfile.ZIP_BZIP2)]
    assert all(files._entries(x) is None for x in others)
    assert all(files.sheet_cells(x) == want for x in others)
    broken = bytearray(zipped(zipfile.ZIP_STORED))
    broken[broken.index(b"longer")] ^= 1
    for bad in (b"", b"PK", own[:-1], bytes(broken)):
        with pytest.raises(zipfile.BadZipFile):
            files.sheet_cells(bytes(bad))
    monkeypatch.setattr(files.zipfile, "ZipFile", None)
    assert all(files.sheet_cells(x) == want for x in plain)
