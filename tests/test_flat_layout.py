"""Pages laid out many at a time are as those laid out one by one."""

import random
import re

import pyarrow as pa
import pytest

from scriptoria.operators import layout as L


def page(r):
    words, y, straight = [], 0.0, r.random() < 0.5
    for _ in range(r.randint(1, 14)):
        y += r.choice([12, 14, 20, 20, 28, 60, 7, 3])
        for c in sorted(r.sample([10, 60, 120, 140, 200, 260.5, 333.3, 400], r.randint(1, 5))):
            x = c + r.choice([0, 0, 0, r.random() * 8, -3])
            for _ in range(r.randint(1, 4)):
                t = "".join(r.choice("abcd12") for _ in range(r.randint(1, 8))) if r.random() > 0.03 else r.choice(["|", "--", "  ", "=\n"])
                width, top = len(t) * 6 * r.choice([1, 1, 1, 1.5, 0.3]), y if straight else y + r.choice([0, 0, 1.3, -2, 4.5])
                words.append({"t": t, "x0": x, "y0": top, "x1": x + width, "y1": top + 10 * r.choice([1, 1, 1, 0.5, 2.2]), "b": r.random() < 0.3, "conf": r.choice([95.0, 95.0, None, 15.0, 14.0])})
                x += width + r.choice([6, 6, 6, 9, 20, 2.5, 0, -4])
    if r.random() < 0.02:
        words[0]["x1"] = words[0]["x0"] - 5  # ends before it begins: such a page is laid out alone
    return words, [{"y": r.random() * y, "x0": r.choice([0.0, 30.0]), "x1": r.choice([500.0, 300.0])} for _ in range(r.choice([0, 0, 3, 8]))]


def usable(w):
    return (w["conf"] is None or w["conf"] >= 15) and not re.search(r"^[|_\-–—=~]+$", w["t"]) and w["t"].strip(" ")


@pytest.mark.parametrize("rows", [7, 50, 1000])
def test_many_pages_as_one(rows):
    r = random.Random(rows)
    pages = [page(r) for _ in range(400)]
    want = []
    for k, (words, rules) in enumerate(pages):
        want += [(k, *x) for x in L.blocks(sorted(filter(usable, words), key=lambda w: (w["y0"], w["x0"])), rules)]
    numbers = lambda xs, names: [x[c] if x[c] is None else float(x[c]) for x in xs for c in names]
    # Every page in two pieces.
    parts = [(k, w, s) for k, (words, rules) in enumerate(pages) for w, s in ((words[:5], rules), (words[5:], []))]
    many = pa.list_(pa.float64())
    table = pa.table({"page": pa.array([k for k, *_ in parts], pa.int64()), "ts": pa.array([[x["t"] for x in w] for _, w, _ in parts], pa.list_(pa.string())), "places": pa.array([numbers(w, L.PLACE) for _, w, _ in parts], many), "rules": pa.array([numbers(s, L.RULE) for *_, s in parts], many)})
    got = []
    for whole in L._by_whole_pages(iter(table.to_batches(max_chunksize=rows))):
        for columns in L._rows_of_pages(whole):
            for *head, cells, bold in zip(*(c.to_pylist() for c in columns), strict=True):
                got += [(*head, c, t, b) for c, (t, b) in enumerate(zip(cells, bold, strict=True)) if t is not None]
    assert sorted(got) == sorted(want) and {"rows", "text"} == {x[2] for x in got}


def test_pages_at_once_from_words_and_rules(spark):
    made = [(x, 20.0 * k, t) for k, (a, b) in enumerate((("a", "1"), ("b", "2"), ("c", "3"))) for x, t in ((10.0, a), (22.0, "is"), (200.0, b), (212.0, "m"))]
    words = spark.createDataFrame([(p, t, x, y, x + 6.0 * len(t), y + 10.0, False, 95.0) for p in range(3) for x, y, t in made], L.WORD)
    rules = spark.createDataFrame([(1, float(y), 0.0, 300.0) for y in (-5, 35, 55)], "page long, y double, x0 double, x1 double")
    got = sorted((r.page, r.row, tuple(r.cells)) for r in L.page_rows(words, rules).collect())
    plain = [(0, ("a is", "1 m")), (1, ("b is", "2 m")), (2, ("c is", "3 m"))]
    assert got == [*((0, *x) for x in plain), (1, 0, ("a is b is", "1 m 2 m")), (1, 1, ("c is", "3 m")), *((2, *x) for x in plain)]
