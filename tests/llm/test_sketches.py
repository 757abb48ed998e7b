"""Document fingerprints against sets of passages, with retries, nulls, repeated rows, very long texts and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptoria.llm import sketches


def parts(text):
    return {m[0].strip(" ") for m in re.finditer(sketches.PASSAGE, text)}


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def edits(texts):
    """Each text with its last quarter replaced by the start of the next."""
    out = []
    for k, t in enumerate(texts):
        q = len(t) // 4
        out.append(t[: len(t) - q] + texts[(k + 1) % len(texts)][:q])
    return out


def made(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéfghiñjkl") for _ in range(r.randint(2, 9)))
    line = lambda: " ".join(word() + r.choice(["", "", "", ".", "!"]) for _ in range(r.randint(1, 60)))
    return ["\n".join(line() for _ in range(r.randint(1, 12))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, k1 string, n long, id long")


def check(got, ids, texts):
    edited = edits(texts)
    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(parts(t), parts(e)), 9), round(alike(parts(t), parts(texts[(k + 1) % len(texts)])), 9)) for k, (i, t, e) in enumerate(zip(ids, texts, edited, strict=True))]
    rows = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(rows) == sorted(want)


def test_fingerprints(spark):
    texts = made(40, 1)
    texts += [texts[0], "", "", "\n\n\n", "a", "x" * 700, "one. " * 4000, texts[3] + "\n" + texts[4], texts[3]]
    ids = [7 * k - 30 for k in range(len(texts))]
    rows = list(zip(ids, texts, strict=True))
    random.Random(2).shuffle(rows)
    got = sketches.fingerprints(frame(spark, [(i, t or None) for i, t in rows]).repartition(5), rules=sketches.Sizes(rows=4)).collect()
    check(got, ids, texts)
    by = {}
    for r, t in zip(sorted(got, key=lambda r: r.doc_id), texts, strict=True):
        by.setdefault(t, set()).add(r.fingerprint)
        assert (r.near_edited == 1.0) or r.fingerprint != r.edited_fingerprint
    assert all(len(x) == 1 for x in by.values())


@pytest.mark.parametrize("rules", [sketches.Sizes(cells=3, share=0.1, grow=4), sketches.Sizes(cells=6, share=1.2, grow=2, rounds=3, attempts=12)])
def test_retries(spark, rules):
    texts = made(12, 5)
    check(sketches.fingerprints(frame(spark, enumerate(texts)), rules=rules).collect(), range(12), texts)


def test_differences_are_digests(spark):
    """The digests that only one side has, not only their number."""
    sides = [(list(range(1, 40)), list(range(30, 90))), ([1, 2, 3], [1, 2, 3]), ([], []), ([], [5]), ([2**62, -7], [-7])]
    pairs = spark.createDataFrame([(k, -k, 0, a, b) for k, (a, b) in enumerate(sides)], "k1 long, k2 long, kind int, one array<long>, two array<long>")
    for r in sketches.differences(pairs).collect():
        a, b = map(set, sides[r.k1])
        assert (sorted(r.left), sorted(r.right)) == (sorted(a - b), sorted(b - a))
    with pytest.raises(RuntimeError):
        sketches.differences(pairs, sketches.Sizes(cells=3, share=0.0, grow=1, attempts=1))


def test_rows_without_an_order(spark):
    one = sketches.fingerprints(frame(spark, [(4, "Only. text")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(4, 1.0)]
    rows = [(None, "a b"), (None, "c d"), (3, "same"), (3, "same"), (3, "other"), (None, None)]
    got = sketches.fingerprints(frame(spark, rows), rules=sketches.Sizes(rows=1)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 3), (0, 3), (3, 4), (3, 4), (3, 5)]
    assert sketches.fingerprints(frame(spark, rows[:3]).where(F.lit(False))).count() == 0
