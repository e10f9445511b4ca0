"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of digits, letters and non-ASCII characters, lower-cased (A-Z). Their features are the token and
its first 4, 5 and 6 bytes. Labels come per document, so tokens are labelled from them: in a toxic document a
token is toxic if it has a feature that toxic documents hold significantly more often than others (likelihood
ratio). A two-label CRF with feature weights and transitions is fitted to these labelled tokens by gradient
ascent; forward-backward gives each token's marginal. A document's score is a logistic function of its largest
marginal and of the expected number of toxic tokens, fitted to the document labels; tokens whose marginal is at
least 1/2 are the offending ones and returned as code-point offsets.

Bounds (documented parameters): features are counted over at most SAMPLE labelled documents of each label,
picked by a seeded hash and one of each group of near copies (equal smallest shingle hash), so that the odd words of a
toxic document with many copies don't count many times; the CRF and the logistic function are fitted on at most FIT of each; scoring covers every
whole text.

Defined results: a null or empty text has no tokens and the score of a document without toxic tokens; documents
without labels are only scored; without any toxic label all have the score of a document without toxic tokens; repeated rows are scored alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import ALNUM, LOWER, Words, doc_crc, shingles, slices, text_bytes

SAMPLE, FIT = 6000, 1200
PREFIXES = (4, 5, 6)
#: The likelihood ratio (chi-square, 1 degree of freedom) that a feature needs; all that reach it are kept.
LEAST_RATIO = 18.0
#: A token's log-odds are held within +-CLIP, so that products of SEGMENT steps stay within doubles.
CLIP, SEGMENT = 12.0, 32
THRESHOLD = 0.3

SCHEMA = "doc_id long, score double, predicted int, n_tokens long, expected double, spans string"


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """Runs of rows (from, to) with their bytes, offsets and tokens."""
    data, offsets = text_bytes(texts)
    for i, j in slices(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, j, part, own, Words(LOWER[part], own, ALNUM, PREFIXES)


def features(words: Words) -> list[np.ndarray]:
    """A column of hashes per kind of feature; 0 where a token is too short for a prefix."""
    return [words.hashes, *[words.prefixes[n] ^ np.uint64(0) for n in PREFIXES]]


class Chain:
    """Two-label chains, many at once. Labels: 0 other, 1 toxic. odds: exp of a token's log-odds for label 1."""

    def __init__(self, trans: np.ndarray, begin: np.ndarray):
        self.trans, self.begin = trans, begin  # exp of transition scores [from, to], exp of the scores of the first label

    def marginals(self, odds: np.ndarray, first: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """P(label 1) of all tokens, expected transition counts, sum of log partition functions. first: each text's first token.

        Tokens are cut into segments of SEGMENT; segments of all texts advance in step. A first sweep multiplies each
        segment's 2x2 matrices, a second carries forward and backward vectors from segment to segment within a text,
        and a third runs through the segments again from their true boundary vectors.
        """
        n = np.diff(first)
        if not len(odds):
            return np.zeros(0), np.zeros((2, 2)), 0.0
        seg_n = -(-n // SEGMENT)
        seg_first = np.concatenate([[0], np.cumsum(seg_n)])
        s = int(seg_first[-1])
        doc = np.repeat(np.arange(len(n)), seg_n)
        start = first[:-1][doc] + (np.arange(s) - seg_first[:-1][doc]) * SEGMENT
        length = np.minimum(SEGMENT, first[1:][doc] - start)
        grid = start[None, :] + np.arange(SEGMENT)[:, None]
        real = np.arange(SEGMENT)[:, None] < length[None, :]
        x = np.where(real, odds[np.minimum(grid, len(odds) - 1)], 1.0)
        t = self.trans
        # products of T diag(1, x) over a segment; beyond its end the identity
        m = [np.ones(s), np.zeros(s), np.zeros(s), np.ones(s)]
        scale = np.zeros(s)
        for k in range(SEGMENT):
            on = real[k]
            a = [m[0] * t[0, 0] + m[1] * t[1, 0], (m[0] * t[0, 1] + m[1] * t[1, 1]) * x[k], m[2] * t[0, 0] + m[3] * t[1, 0], (m[2] * t[0, 1] + m[3] * t[1, 1]) * x[k]]
            m = [np.where(on, p, q) for p, q in zip(a, m, strict=True)]
            if k % 8 == 7 or k == SEGMENT - 1:
                top = np.maximum(np.maximum(m[0], m[1]), np.maximum(m[2], m[3]))
                m = [p / top for p in m]
                scale += np.log(top)
        # forward vectors before each segment, backward vectors after it, text by text in step over its segments
        f0, f1 = np.empty(s), np.empty(s)
        b0, b1 = np.ones(s), np.ones(s)
        has = np.flatnonzero(seg_n > 0)
        by_len = has[np.argsort(-seg_n[has], kind="stable")]
        lens = seg_n[by_len]
        # the start vector v with v T = begin makes the first token like all others
        v = np.linalg.solve(t.T, self.begin)
        f0[seg_first[by_len]], f1[seg_first[by_len]] = v[0], v[1]
        for k in range(1, int(lens[0]) if len(lens) else 0):
            at = seg_first[by_len[: int(np.searchsorted(-lens, -k, side="left"))]] + k
            p = at - 1
            u0, u1 = f0[p] * m[0][p] + f1[p] * m[2][p], f0[p] * m[1][p] + f1[p] * m[3][p]
            top = np.maximum(u0, u1)
            f0[at], f1[at] = u0 / top, u1 / top
        for k in range(1, int(lens[0]) if len(lens) else 0):
            some = by_len[: int(np.searchsorted(-lens, -k, side="left"))]
            at = seg_first[some + 1] - 1 - k
            q = at + 1
            u0, u1 = m[0][q] * b0[q] + m[1][q] * b1[q], m[2][q] * b0[q] + m[3][q] * b1[q]
            top = np.maximum(u0, u1)
            b0[at], b1[at] = u0 / top, u1 / top
        # within segments
        w0, w1 = np.ones((SEGMENT + 1, s)), np.ones((SEGMENT + 1, s))
        w0[SEGMENT], w1[SEGMENT] = b0, b1
        for k in range(SEGMENT - 1, -1, -1):
            y1 = w1[k + 1] * x[k]
            u0, u1 = t[0, 0] * w0[k + 1] + t[0, 1] * y1, t[1, 0] * w0[k + 1] + t[1, 1] * y1
            top = np.maximum(u0, u1)
            w0[k], w1[k] = np.where(real[k], u0 / top, w0[k + 1]), np.where(real[k], u1 / top, w1[k + 1])
        out = np.empty((SEGMENT, s))
        counts = np.zeros((2, 2))
        log_z, u0, u1 = 0.0, f0, f1
        opens = start == first[:-1][doc]
        for k in range(SEGMENT):
            on = real[k]
            if pairs:
                e = [[u0 * t[0, 0] * w0[k + 1], u0 * t[0, 1] * x[k] * w1[k + 1]], [u1 * t[1, 0] * w0[k + 1], u1 * t[1, 1] * x[k] * w1[k + 1]]]
                z = e[0][0] + e[0][1] + e[1][0] + e[1][1]
                use = on & ~(opens & (k == 0))
                for i in range(2):
                    for j in range(2):
                        counts[i, j] += (e[i][j][use] / z[use]).sum()
            n0, n1 = u0 * t[0, 0] + u1 * t[1, 0], (u0 * t[0, 1] + u1 * t[1, 1]) * x[k]
            top = np.maximum(n0, n1)
            if pairs:
                log_z += np.log(top[on]).sum()
            u0, u1 = np.where(on, n0 / top, u0), np.where(on, n1 / top, u1)
            p1 = u1 * w1[k + 1]
            out[k] = p1 / (u0 * w0[k + 1] + p1)
        return out.T[real.T], counts, log_z


class Model:
    """keys: sorted feature hashes, weights by feature, bias, transitions, begin scores, and the logistic function of a document."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.weights = np.zeros(len(keys))
        self.bias, self.trans, self.begin = -4.0, np.zeros((2, 2)), np.zeros(2)
        self.doc = np.array([-4.0, 0.0, 0.0])
        self.marks = np.zeros(1 << 16, dtype=bool)
        self.marks[(keys >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature) of all known features, by token."""
        at, which = [], []
        for column in features(words):
            i = np.flatnonzero(self.marks[(column >> np.uint64(48)).astype(np.int64)])
            if len(i) and len(self.keys):
                p = np.minimum(np.searchsorted(self.keys, column[i]), len(self.keys) - 1)
                hit = self.keys[p] == column[i]
                at.append(i[hit])
                which.append(p[hit])
        if not at:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at, which = np.concatenate(at), np.concatenate(which)
        order = np.lexsort((which, at))
        return at[order], which[order]

    def odds(self, n: int, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(np.bincount(at, self.weights[which], n) + self.bias, -CLIP, CLIP))

    def chain(self) -> Chain:
        return Chain(np.exp(self.trans), np.exp(self.begin))

    def score(self, p: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and expected counts of toxic tokens of all texts."""
        expected = np.diff(np.concatenate([[0.0], np.cumsum(p)])[first])
        return 1 / (1 + np.exp(-np.clip(summary(p, first) @ self.doc, -40, 40))), np.maximum(expected, 0)


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row per text: 1, its largest marginal, log of 1 plus the expected count of tokens above 1/100."""
    n = np.diff(first)
    most, many = np.zeros(len(n)), np.zeros(len(n))
    has = np.flatnonzero(n > 0)
    if len(has):
        most[has] = np.maximum.reduceat(p, first[:-1][has])
        many[has] = np.add.reduceat(np.where(p > 0.01, p, 0), first[:-1][has])
    return np.stack([np.ones(len(n)), most, np.log1p(many)], axis=1)


def _ascend(gradient, x: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Adam on a gradient to ascend."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x


def fit_model(keys: np.ndarray, docs: list[tuple[int, int, np.ndarray, np.ndarray]], prior: float, rounds: int = 40) -> Model:
    """docs: (label, number of tokens, tokens with features, their features). prior: share of toxic documents."""
    model = Model(keys)
    first = np.concatenate([[0], np.cumsum([n for _, n, _, _ in docs])]).astype(np.int64)
    at = np.concatenate([d[2] + f for d, f in zip(docs, first, strict=False)]).astype(np.int64)
    which = np.concatenate([d[3] for d in docs]).astype(np.int64)
    label = np.array([d[0] for d in docs])
    toxic = np.repeat(label, np.diff(first))
    gold = np.zeros(first[-1])
    gold[at] = toxic[at]
    follows = np.ones(len(gold), dtype=bool)
    follows[first[:-1][np.diff(first) > 0]] = False
    prev = np.concatenate([[0], gold[:-1]]).astype(int)[follows]
    seen = np.bincount(prev * 2 + gold[follows].astype(int), minlength=4).reshape(2, 2).astype(float)
    k = len(keys)
    opens = first[:-1][np.diff(first) > 0]
    size = max(1, len(gold))

    def put(x: np.ndarray) -> None:
        model.weights, model.bias, model.trans, model.begin = x[:k], x[k], x[k + 1 : k + 5].reshape(2, 2), x[k + 5 : k + 7]

    def gradient(x: np.ndarray) -> np.ndarray:
        put(x)
        p, counts, _ = model.chain().marginals(model.odds(len(gold), at, which), first, pairs=True)
        off = gold - p
        begin = off[opens].sum()
        return np.concatenate([np.bincount(which, off[at], k), [off.sum()], (seen - counts).ravel(), [-begin, begin]]) / size - 1e-6 * x

    x0 = np.concatenate([np.full(k, 4.0), [-5.0], np.array([[0.2, -0.2], [-0.1, 0.1]]).ravel(), np.zeros(2)])
    put(_ascend(gradient, x0, rounds, 0.15))
    p, _, _ = model.chain().marginals(model.odds(len(gold), at, which), first)
    z = summary(p, first)
    share = max(1e-6, label.mean())
    weight = np.where(label == 1, prior / share, (1 - prior) / max(1e-6, 1 - share))
    model.doc = _ascend(lambda w: ((label - 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))) * weight) @ z / len(z) - 1e-4 * w, np.array([-3.0, 4.0, 1.0]), 400, 0.05)
    return model


def _sampled(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[DataFrame, float]:
    """Labelled training rows, at most about bound of each label by a seeded hash, with the share of toxic ones among all."""
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    toxic, rest = counts.get(1, 0), counts.get(0, 0)
    part = F.when(F.col("label") == 1, min(1.0, bound / max(1, toxic))).otherwise(min(1.0, bound / max(1, rest)))
    picked = labels.filter(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 20)) < part * (1 << 20))
    # at most about 2 * bound rows of two numbers
    return docs.join(F.broadcast(picked), "id"), toxic / max(1, toxic + rest)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, fit: int = FIT) -> Model:
    """Fits the model to labelled documents whose crc32(id as text) mod 4 is not 2."""
    mine = labels.filter((F.pmod(doc_crc(id_col), F.lit(4)) != 2) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, prior = _sampled(flat, mine, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, _, _, words in tokens(batch.column(0)):
                doc = np.repeat(np.arange(i, j), np.diff(words.first))
                for column in features(words):
                    order = np.lexsort((doc, column))
                    h, d = column[order], doc[order]
                    new = np.ones(len(h), dtype=bool)
                    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                    new &= h != 0
                    h, lab = h[new], label[d[new]]
                    if not len(h):
                        continue
                    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.add.reduceat(lab, at).astype(np.int64)), pa.array(np.diff(np.append(at, len(h))).astype(np.int64))], names=["f", "toxic", "docs"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, words in tokens(batch.column(1)):
                values, at = shingles(words.hashes, words.first)
                least = np.zeros(j - i, dtype=np.uint64)
                has = np.flatnonzero(np.diff(at) > 0)
                if len(has):
                    least[has] = np.minimum.reduceat(values, at[:-1][has])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(least.view(np.int64))], names=["id", "h", "k"])

    # of near copies the text with the least hash is learnt from; ids only tell exact copies apart
    one = rows.select("id", "text", F.xxhash64("text").alias("h")).mapInArrow(sketch, "id long, h long, k long").groupBy("k").agg(F.min(F.struct("h", "id"))["id"].alias("id")).select("id")
    rows = rows.join(F.broadcast(one), "id")  # at most about 2 * sample rows
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, dtype=np.uint64))
    counts = rows.select("text", "label").mapInArrow(count, "f long, toxic long, docs long").groupBy("f").agg(F.sum("toxic").alias("a"), (F.sum("docs") - F.sum("toxic")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    share = (a + b) / (n1 + n0)
    ratio = 2 * (term(a, share * n1) + term(b, share * n0) + term(n1 - a, (1 - share) * n1) + term(n0 - b, (1 - share) * n0))
    strong = counts.filter((a * n0 > 8 * b * n1) & (ratio > LEAST_RATIO))  # as many as the words of the sample, at most
    keys = np.sort(np.array([r["f"] for r in strong.select("f").collect()], dtype=np.int64).view(np.uint64))
    model = Model(keys)
    kept = pickle.dumps(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(kept)
        for batch in batches:
            label = batch.column(1).to_pylist()
            for i, j, _, _, words in tokens(batch.column(0)):
                at, which = own.lookup(words)
                cut = np.searchsorted(at, words.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[i:j], pa.int64()), pa.array(np.diff(words.first), pa.int64()), pa.array([(at[cut[k] : cut[k + 1]] - words.first[k]).astype(np.int64) for k in range(j - i)], pa.list_(pa.int64())), pa.array([which[cut[k] : cut[k + 1]].astype(np.int64) for k in range(j - i)], pa.list_(pa.int64()))],
                    names=["label", "n", "at", "which"],
                )

    rows, _ = _sampled(flat, mine, fit)
    found = rows.select("text", F.col("label").cast("long")).mapInArrow(encode, "label long, n long, at array<long>, which array<long>").toArrow().to_pylist()
    found.sort(key=lambda r: (r["label"], r["n"], r["at"], r["which"]))
    return fit_model(keys, [(r["label"], r["n"], np.array(r["at"], dtype=np.int64), np.array(r["which"], dtype=np.int64)) for r in found], prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every whole text scored: SCHEMA. spans: start:end of offending tokens in code points, comma-joined."""
    kept = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(kept)
        chain = own.chain()
        for batch in batches:
            for i, j, part, offsets, words in tokens(batch.column(1)):
                at, which = own.lookup(words)
                p, _, _ = chain.marginals(own.odds(len(words.starts), at, which), words.first)
                scores, expected = own.score(p, words.first)
                bad = np.flatnonzero(p >= 0.5)
                spans = [""] * (j - i)
                cut = np.searchsorted(bad, words.first)
                for k in np.flatnonzero(np.diff(cut)):
                    hit = bad[cut[k] : cut[k + 1]]
                    points = np.concatenate([[0], np.cumsum((part[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80)])
                    spans[k] = ",".join(f"{a}:{b}" for a, b in zip(points[words.starts[hit] - offsets[k]], points[words.ends[hit] - offsets[k]], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(np.diff(words.first), pa.int64()), pa.array(expected), pa.array(spans, pa.string())],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, all columns as they are, in one pass and without a shuffle."""
    kept = pickle.dumps(model)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(kept)
        chain = own.chain()
        for batch in batches:
            good = np.ones(batch.num_rows, dtype=bool)
            for i, j, _, _, words in tokens(batch.column(at_text)):
                at, which = own.lookup(words)
                p, _, _ = chain.marginals(own.odds(len(words.starts), at, which), words.first)
                good[i:j] = own.score(p, words.first)[0] < threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)

