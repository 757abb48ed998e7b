"""The filter audit and the whitening against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import math
from itertools import permutations

import numpy as np
import pytest

from scriptoria.llm import audit, whitening

TEXT = "Alpha beta, gamma delta one two three four five six seven eight nine ten eleven twelve"


def fails(text):
    words = [w for w in text.encode().split()]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum(c.isascii() and c.isupper() for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        failed = fails(text or "")
        failed["E"] = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        rows.append((source or "", failed, i in good, i in toxic))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            total = left
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = sum(r[1][f] for r in total)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in total)
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted(r + (shapley[r[0], r[1][r[2] - 1]],) for r in out)


DOCS = [
    (1, " ".join(f"word{k}" for k in range(60)), "a"), (2, " ".join(f"word{k}" for k in range(60)), "b"), (2, " ".join(f"word{k}" for k in range(60)), "a"),
    (3, TEXT, "a"), (4, TEXT * 9, "a"), (5, "", "a"), (6, None, None), (6, None, None), (7, "# " + "ABC " * 70, ""), (None, TEXT, "a"), (None, "", "b"), (0, "\n\t ", "b"), (8, "É" * 300, "b"),
    (9, "x y " * 60_000 + "$", "c"), (10, TEXT, "c"),
]
LABELS = [(3, 1, 0), (3, 0, 1), (4, 0, 1), (5, None, None), (99, 1, 1), (None, 1, 1), (7, 1, 1), (6, 1, 0)]


def test_audit(spark):
    docs = spark.createDataFrame([(*r, 1, "n", True) for r in DOCS], "doc_id long, text string, source string, n long, mask string, good boolean")
    labels = spark.createDataFrame([(*r, "z") for r in LABELS], "doc_id long, quality int, toxic int, text string")
    got = audit.audit(docs, labels)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(DOCS, LABELS)
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).count() == 600 * 4


def brute_whitening(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors])
    n, s = len(x), x.sum(axis=0)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, dev, c, e[::-1], u[:, ::-1]


def rows(spark, vectors, ids=None):
    made = [(k if ids is None else ids[k], v, 1, 0.5) for k, v in enumerate(vectors)]
    return spark.createDataFrame(made, "vec_id long, embedding array<float>, component int, n double")


@pytest.mark.parametrize("rules", [whitening.Finder(), whitening.Finder(passes=0, over=0), whitening.Finder(passes=40, tolerance=1e-3)])
def test_whitening(spark, rules):
    r = np.random.default_rng(3)
    good = (r.standard_normal((300, 20)) * np.linspace(3, 0.1, 20) + 5).astype(np.float32).tolist()
    bad = [None, [1.0] * 19 + [None], [1.0] * 19 + [math.nan], [1.0] * 19 + [-math.inf], [1.0] * 19, [], [3e38] * 20]
    vectors = good[:150] + bad + good[150:] + [good[0]]
    got = whitening.whiten(rows(spark, vectors).repartition(5), rules=rules).collect()
    kept = [k for k, v in enumerate(vectors) if v in good]
    n, dev, c, e, u = brute_whitening([vectors[k] for k in kept])
    assert len(got) == 8 * n and {x.n for x in got} == {n}
    by = {(x.vec_id, x.component): x for x in got}
    for j in range(8):
        white = np.array([by[k, j + 1].whitened for k in kept])
        want = c @ u[:, j] / np.sqrt(e[j])
        assert min(abs(white - want).max(), abs(white + want).max()) < (1e-9 if rules.tolerance < 1e-9 else 1e-5)
        assert abs(by[0, j + 1].explained - e[j] / e.sum()) < 1e-9
    assert [by[k, 1].deviation for k in kept] == dev == [int(by[k, 1].deviation_exact) for k in kept]
    assert max(x.identity_error for x in got) < 1e-9


def test_whitening_edges(spark):
    flat = whitening.whiten(rows(spark, [[1.0, 2.0], [1.0, 3.0], [1.0, 2.5]], [None, 4, 4])).collect()
    assert len(flat) == 6 and all((x.whitened is None) == (x.component == 2) for x in flat) and sum(x.vec_id is None for x in flat) == 2
    one = whitening.whiten(rows(spark, [[0.5] * 3])).collect()
    assert [(x.deviation, x.whitened, x.explained, x.identity_error) for x in one] == [(0, None, 0.0, 0.0)] * 3
    far = whitening.whiten(rows(spark, [[1e12, 0.0], [-1e12, 1.0]])).collect()
    assert all(x.deviation is None and x.deviation_exact > 2**63 for x in far)
    assert whitening.whiten(rows(spark, [None])).count() == 0 and whitening.whiten(rows(spark, [[1.0]]).limit(0)).count() == 0
