"""Language-model scores by a subword lattice.

The vocabulary is an existing tokenizer's (its file is a parameter; nothing is copied and no tokenizer is trained). Its
scores order the pieces; as a unigram prior, the piece of rank r has a probability in proportion to 1 / (r + RANK_SHIFT).
The corpus re-weights the pieces: expected piece counts over all segmentations of all training words (forward-backward
on the lattice), with PRIOR_WEIGHT occurrences of the prior on top, ROUNDS times.

A text is its words, each with a leading mark, and one end. A word's probability is the sum over all its segmentations
into pieces (and single bytes) of the product of their probabilities, computed by a forward recursion (long or very unlikely words in logarithms);
pieces don't cross words, so a text's probability is the product over its words and the end. Probabilities of all texts
sum to 1 at most.

Words are counted over the whole corpus, map-side first. Each distinct word's lattice is computed once. The most common
words (at most HOT_WORDS, the bound of the broadcast) are added up where the texts are; all other words of a text are
joined to the word table by a shuffle.

Defined results: a null or empty text is its end alone; repeated rows are scored alike; without training texts all counts
are 0 and the prior stands; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import checkpoint, doc_crc, range_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
RANK_SHIFT, PRIOR_WEIGHT, ROUNDS = 50.0, 5000.0, 2
HOT_WORDS = 1 << 18
#: Distinct words that a task counts before it reports, and lattice cells handled at a time.
HELD, CELLS = 400_000, 150_000
#: Rows or bytes of words that a task sums together.
GATHERED = (16_000, 1 << 20)
#: Words of at most so many bytes are summed as plain numbers, unless their probability is below the least.
LINEAR, LEAST = 100, 1e-250
LN10 = float(np.log(10))
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_MARK = "▁"


def load_pieces(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (the word mark as a space), single bytes last, then the end; and their prior probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace(_MARK, " ").encode()
            if piece and b" " not in piece[1:]:
                ranked[piece] = max(ranked.get(piece, -np.inf), model.get_score(i))
    order = sorted(ranked, key=lambda p: (-ranked[p], p))
    p = 1 / (np.arange(len(order) + 257) + RANK_SHIFT)  # bytes and the end rank last
    return order, p / p.sum()


class Lattice:
    """All segmentations of words into pieces. scores: log probabilities of the pieces, the 256 bytes and the end."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.scores = scores
        self.n = len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        self.lengths = sorted(by)
        self.tables = {}
        for n in self.lengths:
            data = np.frombuffer(b"".join(pieces[i] for i in by[n]), dtype=np.uint8)
            at = np.arange(len(by[n])) * n
            h = _fixed(data, at, n)
            order = np.argsort(h)
            self.tables[n] = (h[order], np.array(by[n])[order])
        self.linear = np.exp(scores)
        self.single = self.linear[self.n : self.n + 256]
        self.prefixes = []  # for each length the hashes of pieces' first bytes, and the piece that ends there (or -1)
        h, rest = np.zeros(self.n, dtype=np.uint64), np.arange(self.n)
        size = np.array([len(p) for p in pieces])
        for n in range(1, max(self.lengths) + 1):
            rest = rest[size[rest] >= n]
            h[rest] = _longer(h[rest], np.array([pieces[i][n - 1] for i in rest], dtype=np.uint8))
            known, inverse = np.unique(h[rest], return_inverse=True)
            which = np.full(len(known), -1)
            ends = size[rest] == n
            which[inverse[ends]] = rest[ends]
            self.prefixes.append((known, which))

    def _grid(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Bytes [word, position] with the leading mark, lengths, and for each piece length the piece that starts there (or -1)."""
        size = np.array([len(w) + 1 for w in words])
        width = int(size.max())
        flat = np.frombuffer(b"".join(b" " + w + bytes(width - len(w) - 1) for w in words), dtype=np.uint8)
        grid = flat.reshape(len(words), width)
        found = {}
        for n in self.lengths:
            if n > width:
                break
            known, which = self.tables[n]
            fits = (np.arange(width - n + 1)[None, :] + n) <= size[:, None]
            at = np.flatnonzero(np.pad(fits, ((0, 0), (0, n - 1))).ravel())
            h = _fixed(flat, at, n)
            p = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[p] == h
            own = np.full(flat.shape, -1, dtype=np.int32)
            own[at[hit]] = which[p[hit]]
            found[n] = own.reshape(grid.shape)
        return grid, size, found

    def _arcs(self, grid: np.ndarray, found: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """For each length, the log weight of the arc that starts at [position, word]; pieces and bytes of one byte are added."""
        table = np.append(self.scores, -np.inf)
        arcs = {n: table[own].T.copy() for n, own in found.items()}
        single = self.scores[self.n + grid.astype(np.int64)].T
        arcs[1] = np.logaddexp(arcs[1], single) if 1 in arcs else single.copy()
        return dict(sorted(arcs.items()))

    def forward(self, arcs: dict[int, np.ndarray], size: np.ndarray) -> np.ndarray:
        """Log sums of all partial segmentations, [position, word]."""
        width = int(size.max())
        out = np.full((width + 1, len(size)), -np.inf)
        out[0] = 0
        for t in range(1, width + 1):
            terms = [out[t - n] + arc[t - n] for n, arc in arcs.items() if n <= t]
            top = np.maximum.reduce(terms)
            safe = np.where(np.isfinite(top), top, 0)
            total = np.zeros(len(size))
            for x in terms:
                total += np.exp(x - safe)
            with np.errstate(divide="ignore"):
                out[t] = safe + np.log(total)
        return out

    def _paths(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """For words of at most LINEAR bytes: bytes [position, word], sizes, and the arcs of the pieces, in the order of their
        starts: start and end cell (position * words + word), piece, and for each position the first of its arcs.

        Only places that are the start of some piece's first n bytes are asked for n + 1.
        """
        size = np.array([len(w) + 1 for w in words])
        count, width = len(words), int(size.max())
        grid = np.frombuffer(b"".join((b" " + w).ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(count, width).T.copy()
        flat = grid.ravel()
        left = size[None, :] - np.arange(width)[:, None]
        at = np.flatnonzero(left > 0)
        left = left.ravel()[at]
        h = np.zeros(len(at), dtype=np.uint64)
        starts, ends, pieces = [], [], []
        for n, (known, which) in enumerate(self.prefixes, 1):
            h = _longer(h, flat[at + (n - 1) * count])
            p = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[p] == h
            piece = which[p[hit]]
            at, h, left = at[hit], h[hit], left[hit]
            own = piece >= 0
            starts.append(at[own])
            ends.append(at[own] + n * count)
            pieces.append(piece[own])
            more = left > n
            at, h, left = at[more], h[more], left[more]
            if not len(at):
                break
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)
        place = (start // count).astype(np.int16)
        order = np.argsort(place, kind="stable")
        return grid, size, start[order], end[order], piece[order], np.searchsorted(place[order], np.arange(width + 1))

    def _sums(self, grid: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums of all partial segmentations, [position, word], as plain numbers: arcs of one position end in different cells."""
        width, count = grid.shape
        alpha = np.zeros((width + 1, count))
        alpha[0] = 1
        flat = alpha.ravel()
        for t in range(width):
            alpha[t + 1] += alpha[t] * self.single[grid[t]]
            own = slice(first[t], first[t + 1])
            flat[end[own]] += flat[start[own]] * p[own]
        return alpha

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural logs of the words' marginal probabilities; in logarithms throughout where plain numbers would leave their range."""
        out = np.full(len(words), -np.inf)
        size = np.array([len(w) for w in words])
        for some in _batches(words, np.flatnonzero(size <= LINEAR)):
            grid, own, start, end, piece, first = self._paths([words[i] for i in some])
            z = self._sums(grid, start, end, self.linear[piece], first)[own, np.arange(len(own))]
            out[some] = np.log(np.where(z > LEAST, z, 0), out=out[some], where=z > LEAST)
        for some in _batches(words, np.flatnonzero(np.isinf(out))):
            grid, own, found = self._grid([words[i] for i in some])
            out[some] = self.forward(self._arcs(grid, found), own)[own, np.arange(len(own))]
        return out

    def expected_counts(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected occurrences of the pieces and bytes in the words, each word as often as counts says."""
        out = np.zeros(len(self.scores))
        size = np.array([len(w) for w in words])
        small = np.zeros(len(words), dtype=bool)
        for some in _batches(words, np.flatnonzero(size <= LINEAR)):
            grid, own, start, end, piece, first = self._paths([words[i] for i in some])
            width, count = grid.shape
            p, place = self.linear[piece], np.arange(count)
            alpha = self._sums(grid, start, end, p, first)
            z = alpha[own, place]
            small[some] = z <= LEAST
            beta = np.zeros((width + 1, count))
            beta[own, place] = 1
            flat = beta.ravel()
            word = start % count
            for t in range(width - 1, -1, -1):
                beta[t] += beta[t + 1] * self.single[grid[t]]
                at = slice(first[t], first[t + 1])
                beta[t] += np.bincount(word[at], p[at] * flat[end[at]], count)
            share = np.where(z > LEAST, counts[some] / np.where(z > LEAST, z, 1), 0)
            out += np.bincount(piece, alpha.ravel()[start] * p * flat[end] * share[word], len(out))
            singles = alpha[:-1] * self.single[grid] * beta[1:] * share
            out[self.n : self.n + 256] += np.bincount(grid.ravel(), singles.ravel(), 256)
        for some in _batches(words, np.flatnonzero(small | (size > LINEAR))):
            out += self._expected_by_logs([words[i] for i in some], counts[some])
        return out

    def _expected_by_logs(self, words: list[bytes], weight: np.ndarray) -> np.ndarray:
        """expected_counts of a batch of any words."""
        out = np.zeros(len(self.scores))
        grid, size, found = self._grid(words)
        arcs = self._arcs(grid, found)
        alpha = self.forward(arcs, size)
        at = np.arange(len(size))
        z = alpha[size, at]
        width = int(size.max())
        beta = np.full((width + 1, len(size)), -np.inf)
        beta[size, at] = 0
        with np.errstate(divide="ignore"):
            for t in range(width - 1, -1, -1):
                terms = [arc[t] + beta[t + n] for n, arc in arcs.items() if t + n <= width]
                top = np.maximum.reduce(terms)
                safe = np.where(np.isfinite(top), top, 0)
                total = np.zeros(len(size))
                for x in terms:
                    total += np.exp(x - safe)
                beta[t] = np.where(t == size, 0.0, safe + np.log(total))
        for n, own in found.items():
            t, w = np.nonzero(own.T >= 0)
            which = own.T[t, w]
            out += np.bincount(which, np.exp(alpha[t, w] + self.scores[which] + beta[t + n, w] - z[w]) * weight[w], len(out))
        w, t = np.nonzero(np.arange(width)[None, :] < size[:, None])
        which = self.n + grid[w, t].astype(np.int64)
        out += np.bincount(which, np.exp(alpha[t, w] + self.scores[which] + beta[t + 1, w] - z[w]) * weight[w], len(out))
        return out


def _fixed(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes from each position on (positions may overlap)."""
    h = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ data[at + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return h


def _longer(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hashes of byte strings, each with one byte more."""
    h = (h ^ byte) * np.uint64(0x100000001B3) + np.uint64(1)
    return h ^ (h >> np.uint64(29))


def _batches(words: list[bytes], some: np.ndarray) -> Iterator[np.ndarray]:
    """Those of the indexes of words, by like length, about CELLS cells together."""
    size = np.array([len(w) + 1 for w in words], dtype=np.int64)
    order = some[np.argsort(size[some], kind="stable")]
    a = 0
    while a < len(order):
        b = a + max(1, CELLS // int(size[order[a]]))
        while b > a + 1 and (b > len(order) or size[order[min(b, len(order)) - 1]] * (min(b, len(order)) - a) > 2 * CELLS):
            b = max(a + 1, a + (min(b, len(order)) - a) // 2) if b <= len(order) else len(order)
        yield order[a:b]
        a = b


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of words put together, until they hold GATHERED rows or bytes: sums over few words cost mostly their calls."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.num_rows for b in some) >= GATHERED[0] or sum(b.nbytes for b in some) >= GATHERED[1]:
            yield pa.concat_batches(some)
            some = []
    if some:
        yield pa.concat_batches(some)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): occurrences of each word in training texts, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        held: Counter = Counter()

        def report() -> Iterator[pa.RecordBatch]:
            for counts, is_train in ((train, True), (held, False)):
                keys = list(counts)
                n = np.fromiter(counts.values(), dtype=np.int64, count=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n if is_train else n * 0), pa.array(n)], names=["word", "c", "n"])
                counts.clear()

        for batch in batches:
            for text, out in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (held if out else train).update((text or b"").translate(_LOWER).split())
                if len(train) + len(held) > HELD:
                    yield from report()
        yield from report()

    return docs.select("text", "held_out").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_scores(words: DataFrame, n_texts: int, path: str = VOCABULARY, rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray]:
    """Pieces and their log probabilities after rounds of expectation-maximisation over all training words."""
    pieces, prior = load_pieces(path)
    p = prior
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((pieces, np.log(p)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            out = np.zeros(len(lattice.scores))
            for batch in _gathered(batches):
                out += lattice.expected_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["piece", "e"])

        rows = words.filter("c > 0").select("word", "c").mapInArrow(run, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).toArrow()  # a row a piece
        expected = np.zeros(len(p))
        expected[rows["piece"].to_numpy()] = rows["e"].to_numpy()
        expected[-1] = n_texts
        p = (expected + PRIOR_WEIGHT * prior) / (expected.sum() + PRIOR_WEIGHT)
    return pieces, np.log(p)


def word_table(words: DataFrame, pieces: list[bytes], scores: np.ndarray) -> DataFrame:
    """(word, c, n, lattice): with log10 probabilities from the lattice."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in _gathered(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lattice.log_probability(batch.column(0).to_pylist()) / LN10)], names=["word", "c", "n", "lattice"])

    return words.select("word", "c", "n").mapInArrow(run, "word binary, c long, n long, lattice double")


def common_words(table: DataFrame, limit: int) -> dict[bytes, tuple[float, float, int]]:
    """At most limit of the most common words, all those with at least so many occurrences: log10(c + 1), lattice, whether c > 0."""
    levels = {r["level"]: r["count"] for r in table.groupBy(F.floor(F.log2("n") * 4).alias("level")).count().collect()}
    least, total = None, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > limit:
            break
        least = level
    if least is None:
        return {}
    rows = table.filter(F.floor(F.log2("n") * 4) >= least).select("word", "c", "lattice").toArrow()
    c = rows["c"].to_numpy()
    return dict(zip(rows["word"].to_pylist(), zip(np.log10(c + 1).tolist(), rows["lattice"].to_pylist(), (c > 0).astype(int).tolist(), strict=True), strict=True))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from crc32(id as text) mod 7 other than 2."""
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.pmod(doc_crc(id_col), F.lit(7)) == 2).alias("held_out"))
    counted = checkpoint(word_counts(flat))
    sums = counted.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train = flat.filter("not held_out").count()
    train_tokens, vocabulary = (sums["c"] or 0) + n_train, sums["v"] + (n_train > 0)
    pieces, scores = fit_scores(counted, n_train, path, rounds)
    table = checkpoint(word_table(counted, pieces, scores))
    hot = common_words(table, hot_words)
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    whole = float(np.log10(train_tokens + vocabulary + 1))
    end = (float(np.log10(n_train + 1)) - whole, float(scores[-1]) / LN10, int(n_train > 0))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text (its common words and its end added up; a word no text has as its key) and one per further word."""
        common = shared.value
        for batch in batches:
            found, times, ends, marks = [], [], [], []
            sums: list[tuple] = []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                own = (text or b"").translate(_LOWER)
                words = own.split()
                mark = int(range_hashes(np.frombuffer(own, dtype=np.uint8), np.array([0]), np.array([len(own)]))[0].view(np.int64)[0]) if own else 0
                base, like, known = end
                for word, n in Counter(words).items():
                    if (at := common.get(word)) is not None:
                        base += n * (at[0] - whole)
                        like += n * at[1]
                        known += n * at[2]
                    else:
                        found.append(word)
                        times.append(n)
                ends.append(len(found))
                found.append(b" %d" % mark)
                times.append(0)
                marks.append(mark)
                sums.append((base, like, known, len(words) + 1))
            last = np.array(ends, dtype=np.int64)
            text_of = pa.array(np.repeat(np.arange(len(last)), np.diff(last, prepend=-1)))  # each row's text
            own_row = np.zeros(len(found), dtype=bool)
            own_row[last] = True
            total = pa.array(np.where(own_row, np.cumsum(own_row) - 1, 0), mask=~own_row)  # its sums, for a text's own row
            columns = [pa.array([x[k] for x in sums], kind).take(total) for k, kind in enumerate((pa.float64(), pa.float64(), pa.int64(), pa.int64()))]
            keys = [batch.column(0).take(text_of), pa.array(marks, pa.int64()).take(text_of), batch.column(2).take(text_of)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(found, pa.binary()), pa.array(times, pa.int32()), *columns], names=["id", "mark", "held_out", "word", "k", "base", "like", "known", "tokens"])

    parts = flat.mapInArrow(split, "id long, mark long, held_out boolean, word binary, k int, base double, like double, known long, tokens long")
    met = parts.join(table.select("word", "c", "lattice"), "word", "left")
    rare = lambda x: F.when(F.col("k") > 0, F.col("k") * x)
    n = F.col("copies")
    return (
        met.groupBy("id", "mark", "held_out")
        .agg(
            F.sum(F.coalesce("base", rare(F.log10(F.coalesce("c", F.lit(0)) + 1) - whole))).alias("base"), F.sum(F.coalesce("like", rare(F.col("lattice")))).alias("like"),
            F.sum(F.coalesce("known", rare((F.col("c") > 0).cast("long")))).alias("known"), F.sum("tokens").alias("tokens"), F.count("tokens").alias("copies"),
        )
        # rows with the same id and text were added up; each is given its part
        .withColumn("copy", F.explode(F.sequence(F.lit(1), n.cast("int"))))
        .select(
            F.col("id").alias(id_col), "held_out", (F.col("tokens") / n).cast("long").alias("n_tokens"), (F.col("known") / n).cast("long").alias("n_known"),
            F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") / n).alias("base_score"), (F.col("like") / n).alias("score"),
        )
    )
