"""Whitening against the linear-algebra library on exact covariances, and vector codes against plain Lloyd rounds."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from touchline.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component int, code string, error long, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, "c", 2, 3) for i, v, lab in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8)) * np.array([1, 2, 0.5, 3, 1, 1, 0.1, 0.02])[None, :]
    out = [(i, [float(np.float32(c)) for c in base[i % 6] + rng.normal(size=8) * 0.3], [None, 0, 1][i % 3]) for i in range(400)]
    out += [(1000 + i, out[3][1], 2) for i in range(300)]  # a hot vector
    return out + [(7, out[7][1], 0), (None, out[9][1], None), (2000, None, 1), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] + [0.0] * 7, 0)]


def kept(rows, scale):
    return [(i, [math.floor(scale * c) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


# -- whitening ---------------------------------------------------------------------------------------------------------


def exact_fit(rows):
    fit = sorted({tuple(x) for _, x, _ in kept(rows, 256)})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) / Fraction(n**3)) for j in range(len(s))] for i in range(len(s))])
    return fit, n, s, cov


def test_whitened_rows(spark, rows):
    fit, n, s, cov = exact_fit(rows)
    got = whitening.whiten(frame(spark, rows)).collect()
    have = kept(rows, 256)
    assert len(got) == 4 * len(have)
    values, vectors = np.linalg.eigh(cov)
    for k in range(4):
        mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == k + 1)
        u, e = vectors[:, -1 - k], values[-1 - k]
        want = sorted((str(i), sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), float((np.array(x) - np.array(s) / n) @ u / math.sqrt(e))) for i, x, _ in have)
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        sign = np.sign(np.dot([m[2] for m in mine], [w[2] for w in want]))
        assert np.allclose([m[2] for m in mine], [sign * w[2] for w in want], atol=1e-9)
        row = next(r for r in got if r.component == k + 1)
        assert row.n == n and row.explained == pytest.approx(e / np.trace(cov), rel=1e-9) and 0 <= row.identity_error <= 1e-9
    assert sorted(map(repr, got)) == sorted(map(repr, whitening.whiten(frame(spark, rows).repartition(7)).collect()))


@pytest.mark.parametrize("size", [1, 2, 3, 17, 40])
def test_jacobi_keeps_small_eigenvalues(size):
    rng = np.random.default_rng(size)
    scale = 10.0 ** -np.arange(size).clip(0, 12)
    g = rng.normal(size=(size, size)) + 3 * np.eye(size)
    a = (g.T @ g) * scale[:, None] * scale[None, :]
    values, vectors = whitening.cyclic_jacobi(a)
    assert (np.diff(values) <= 0).all() and np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-13)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-13 * np.abs(a).max())
    want = np.prod(np.abs(np.diag(np.linalg.qr(g)[1])) ** 2 * scale**2)
    assert np.prod(values) == pytest.approx(want, rel=1e-9)  # the smallest ones too, with relative accuracy
    assert np.allclose(whitening.cyclic_jacobi(np.zeros((size, size)))[0], 0)


def test_exact_sums_of_large_entries(spark):
    big = 2**62
    df = spark.createDataFrame([([big, -big],), ([big, 5],), ([big - 1, 7],)], "x array<long>").repartition(2)
    assert whitening.exact_sums(df, 2, lambda x: x.sum(axis=0), big, 2) == [3 * big - 1, 12 - big]
    cov = whitening.covariance(df, 2, 3, [3 * big - 1, 12 - big], big)
    assert cov[0, 0] == pytest.approx(2 / 9) and cov[1, 1] == pytest.approx(float(Fraction(2 * (big + 6) ** 2, 9)), rel=1e-6)


def test_odd_vectors(spark):
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, None)}
    ragged = whitening.whiten(frame(spark, [(1, [1.0], 0), (2, [1.0, 2.0, 3.0], 0), (3, [], 0), (4, [-1.0, 0.5, 0.25], 0)])).collect()
    assert len(ragged) == 12 and {r.n for r in ragged} == {4} and any(r.whitened is None for r in ragged) is False
    huge = whitening.whiten(frame(spark, [(1, [3e38, 1.0], 0), (2, [0.0, 2.0], 0), (3, [1.0, -3e38], 0)])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id != 9)
    assert whitening.whiten(frame(spark, [(1, None, 0)])).collect() == [] and whitening.whiten(frame(spark, [(1, [], 0)])).collect() == []


# -- vector codes ------------------------------------------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4):
    have = kept(rows, 1024)
    width = -(-max(len(x) for _, x, _ in have) // 4) * 4
    have = [(i, x + [0] * (width - len(x)), lab) for i, x, lab in have]
    m = width // 4
    first = sorted(have, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[x[p * m : p * m + m] for _, x, _ in first] for p in range(4)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, x, _ in have:
                part = x[p * m : p * m + m]
                groups.setdefault(near(part, books[p])[1], []).append(part)
            for k, parts in groups.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    out, by_label = [], {}
    for i, x, lab in have:
        found = [near(x[p * m : p * m + m], books[p]) for p in range(4)]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    digest = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    return sorted(repr((i, code, error, by_label[lab], digest)) for i, code, error, lab in out)


def found_codes(df, **options):
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in vector_codes.vector_codes(df, **options).collect())


@pytest.mark.parametrize("entries", [256, 5])
def test_codes_as_plain_rounds(spark, rows, entries):
    assert found_codes(frame(spark, rows), entries=entries) == plain_codes(rows, entries)


def test_only_changed_parts_are_sent(spark, rows):
    sent = []
    vector_codes.vector_codes(frame(spark, rows), entries=8, rounds=6, watch=lambda changed, parts: sent.append((changed, parts)))
    assert sent[0][0] == sent[0][1] == 4 * len(kept(rows, 1024)) and all(b[0] < sent[0][0] / 2 for b in sent[1:])


def test_codes_by_salted_join(spark, rows, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABELS", 1)
    assert found_codes(frame(spark, rows), entries=5) == plain_codes(rows, 5)


def test_odd_vectors_have_codes(spark):
    few = [(3, [1.0], None), (1, [0.5, 2.0, -3.0, 4.0, 5.0], 1), (1, [0.5, 2.0, -3.0, 4.0, 5.0], 1), (None, [], 2)]
    assert found_codes(frame(spark, few)) == plain_codes(few)
    huge = [(1, [1e12, 0.0, 3.0, 4.0], 0), (2, [-1e12, 5.0, 6.0, 7.0], 0), (3, [5e11, 1.0, 1.0, 1.0], 1)]
    got = vector_codes.vector_codes(frame(spark, huge), entries=2).collect()
    assert len(got) == 3 and {r.error for r in got if r.vec_id == 2} != {None}
    assert vector_codes.vector_codes(frame(spark, [(1, None, 0)])).collect() == []
