"""Exact Jaccard join of documents' word-shingle sets, with set relations used to skip work.

Two documents link when 100 * |x & y| >= 75 * |x | y| over their sets of distinct 5-word shingles, which is the same as
7 * |x ^ y| <= |x| + |y| for the symmetric difference x ^ y. The answer is the link graph's components and each document's
exact number of links; nothing is sampled or capped.

1.  Equal sets are one class, named by 64 bits of the set's digest; from here on classes are met, not documents.
2.  Shingles that many documents share are counted (per task, then in total) and put last in one global order, the
    rest in order of their hash. By the prefix filter, two sets that link share one of their first
    n - ceil(0.75 n) + 1 shingles, so only those are indexed: (shingle, class, size, position), the index lists. Entries
    travel packed by bucket, and those whose shingle no other class has end there.
3.  A list is met block by block: blocks hold sets of like size, and a set skips the blocks whose sizes can't link
    with its own. Entries too late in a set to be a linking pair's first shared one are skipped, as are pairs whose
    shared entries and their positions leave too few shingles.
4.  Each class has a parity sketch: bit i tells whether an odd number of its shingles fall into slot i. Slots that differ
    are at most |x ^ y|, so pairs whose sketches differ in too many are ruled out exactly, without their sets.
5.  Components: in each block the sets are held against pivots, first one, then several of seeded orders, then several
    that differ from list to list; then all pairs of different components that still share an entry are met.
6.  Answers are derived, not recomputed. All links lie within components. Each class of a component is compared once,
    with the component's root r, and only its difference D(x) = x ^ r goes on. As x ^ y = D(x) ^ D(y), a pair links for
    sure where 7 * (|D(x)| + |D(y)|) <= |x| + |y|, doesn't where 7 * abs(|D(x)| - |D(y)|) > |x| + |y|, and only what is
    left is counted, from the shingles that two differences share. Large components are met in pairs of bounded parts, of like
    sizes only. No pair becomes a row: parts give each class's number of linked documents.

Whole sets are recomputed from the texts for the classes in pairs and travel once per pivot. What is broadcast is counted
first; beyond PICK rows the same step runs as a shuffled join.

Defined results: texts with fewer than 5 words have one shingle, the whole sequence; null texts and texts without
words have none and link with nothing; rows with a null id link and are counted like others, but a component is named by
its smallest id that isn't null (null if it has none); repeated rows each appear; two rows with one id and different texts
are two documents; ties go to the smaller id; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import LOWER, Words, checkpoint, distinct_per_row, mix, salted_join, shingles, slices, store, text_bytes

#: Shingles put last in the global order, at most; a broadcast of 8 bytes each.
COMMON = 1 << 18
#: A task's own count from which it reports a shingle, and shingles that it holds before it reports.
LOCAL, HELD = 2, 2_000_000
#: Rows of narrow tables (at most three numbers) that may be broadcast.
PICK = 2_000_000
#: Index entries a bucket is made for (about 50 bytes each in its task), and entries that a task packs at a time.
BUCKET_ENTRIES, PACK = 1_000_000, 500_000
#: Sets that are held against one copy of a pivot, and the classes and the shingles of a part of a large component.
MEMBERS, PART, PART_ITEMS = 2_000, 1_024, 4_000_000
#: Numbers of a slice of the matrix in which a part's differences are counted.
CELLS = 4_000_000
#: Rounds of pivots, and pivots of a list in the second one; twice as many from the third on.
ROUNDS, PIVOTS = 3, 6
SHINGLE, NUM, DEN = 5, 3, 4  # similarity NUM / DEN


def need(a: Column, b: Column) -> Column:
    """Least overlap with which sets of sizes a and b link: ceil(0.75 / 1.75 * (a + b))."""
    return F.ceil((a + b) * F.lit(NUM) / F.lit(NUM + DEN))


def close(a: Column, b: Column, apart: Column) -> Column:
    """Whether sets of sizes a and b link, whose symmetric difference has so many shingles."""
    return (NUM + DEN) * apart <= (DEN - NUM) * (a + b)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-NUM * n // DEN) + 1


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their distinct shingle hashes, ascending within a row, and each row's first."""
    data, offsets = text_bytes(texts)
    for i, j in slices(offsets):
        words = Words(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
        yield i, j, *distinct_per_row(*shingles(words.hashes, words.first, size))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[at[1:]] - sums[at[:-1]]


def _digests(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; the first one names its class."""
    second = _sums(mix(values), at)
    return mix(_sums(values, at) + (second << np.uint64(1))), second


def sketch(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each set's parity sketch, of as many slots as the next power of 2 above its size, 64 at least."""
    n = np.diff(at)
    slots = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(slots)])
    place = np.repeat(first[:-1], n) + (values & np.repeat(slots - 1, n).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(place, minlength=int(first[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [bits[a // 8 : b // 8] for a, b in zip(first[:-1], first[1:], strict=True)]


def least_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference: slots in which the sketches differ, the longer one folded to the shorter."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def common_shingles(docs: DataFrame, size: int = SHINGLE, limit: int = COMMON) -> np.ndarray:
    """Hashes of the most common shingles, rarest first: those with the largest sums of their tasks' counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def report() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["s", "n"])

        for batch in batches:
            for _, _, values, _ in _sets(batch.column(0), size):
                held.append(values)
                n += len(values)
                if n >= HELD:
                    yield from report()
                    held, n = [], 0
        if held:
            yield from report()

    counts = store(docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")))
    levels = {r["level"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()}
    least, total = None, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > limit:
            break
        least = level
    rows = None if least is None else counts.filter(F.col("n") >= 2**least).toArrow()  # at most limit rows
    if rows is None or not rows.num_rows:
        return np.zeros(0, dtype=np.uint64)
    values, n = rows["s"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    return values[np.lexsort((values, n))]


def digests(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, t, n, c, d, sketch) of each document (id, t, text): set size, the class, further 64 bits of the set's digest, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, at in _sets(batch.column(2), size):
                c, d = _digests(values, at)
                own = [batch.column(k).slice(i, j - i) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at)), pa.array(c.view(np.int64)), pa.array(d.view(np.int64)), pa.array(sketch(values, at), pa.binary())], names=["id", "t", "n", "c", "d", "sketch"])

    return docs.select("id", "t", "text").mapInArrow(run, "id long, t long, n long, c long, d long, sketch binary")


def index_lists(docs: DataFrame, common: np.ndarray, buckets: int, size: int = SHINGLE) -> DataFrame:
    """(s, c, n, pos): the index entries whose shingle at least two classes have, s by 48 bits of the shingle's hash.

    A task packs its classes' entries by bucket. A common shingle's entries need no meeting to know that it is shared, so
    they are dealt by class, and a list of any length is never in one bucket for that. Positions beyond 65,535 are given
    as that, which only makes the filters on them wider.
    """
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order))
    low = np.uint64(0xFFFF)

    def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))

    def pack(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        s, c, n, known = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = ((np.where(known, c, s) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
        turn = np.argsort(bucket * 2 + known, kind="stable")
        s, c, n, chunk = s[turn], c[turn], n[turn], (bucket * 2 + known)[turn]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (chunk[1:] != chunk[:-1]) | (c[1:] != c[:-1])  # a class's entries of a bucket stand together
        runs = np.flatnonzero(new)
        per_run = np.diff(np.append(runs, len(s)))
        at = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        per_chunk, runs_per_chunk = np.diff(np.append(at, len(s))), np.diff(np.append(np.searchsorted(runs, at), len(runs)))
        columns = [
            pa.array((chunk[at] // 2).astype(np.int32)), pa.array(chunk[at] % 2 == 1), lists(c[runs].view(np.int64), runs_per_chunk, pa.int64()), lists(n[runs].astype(np.int32), runs_per_chunk, pa.int32()),
            lists(per_run.astype(np.int32), runs_per_chunk, pa.int32()), lists(s.view(np.int64), per_chunk, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "known", "c", "n", "k", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        marks = np.zeros(1 << 20, dtype=bool)
        marks[(frequent >> np.uint64(44)).astype(np.int64)] = True
        held, many, met = [], 0, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for _, _, values, at in _sets(batch.column(0), size):
                n = np.diff(at)
                c = _digests(values, at)[0]
                # a task's further copies of a class say nothing new
                _, first = np.unique(c, return_index=True)
                use = np.zeros(len(c), dtype=bool)
                use[first] = True
                use &= (n > 0) & ~np.isin(c, met)
                met = np.concatenate([met, c[use]])
                rows = np.repeat(np.arange(len(n)), n)
                last = np.zeros(len(values), dtype=np.int64)
                maybe = np.flatnonzero(marks[(values >> np.uint64(44)).astype(np.int64)])
                ordered, known = values, np.zeros(len(values), dtype=bool)
                if len(maybe):
                    p = np.minimum(np.searchsorted(frequent, values[maybe]), len(frequent) - 1)
                    hit = frequent[p] == values[maybe]
                    last[maybe[hit]] = rank[p[hit]] + 1
                    turn = np.lexsort((last, rows))  # stable: hashes ascend where last is 0
                    ordered, known = values[turn], last[turn] > 0
                inside = np.arange(len(values)) - at[rows]
                take = np.flatnonzero((inside < prefix_length(n)[rows]) & use[rows])
                if len(take):
                    place = np.minimum(inside[take], 0xFFFF).astype(np.uint64)
                    held.append(((ordered[take] & ~low) | place, c[rows[take]], n[rows[take]], known[take]))
                    many += len(take)
                if many >= PACK:
                    yield pack(held)
                    held, many = [], 0
        if held:
            yield pack(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {True: [], False: []}
        for batch in batches:
            for k in range(batch.num_rows):
                c, n, per, s = (batch.column(x)[k].values.to_numpy(zero_copy_only=False) for x in range(2, 6))
                held[batch.column(1)[k].as_py()].append((s.view(np.uint64), np.repeat(c, per), np.repeat(n, per)))
        for known, parts in held.items():
            if not parts:
                continue
            s, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            key = s >> np.uint64(16)
            turn = np.lexsort((c, key))
            key, c, n, pos = key[turn], c[turn], n[turn], (s[turn] & low).astype(np.int32)
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
            key, c, n, pos = key[new], c[new], n[new], pos[new]
            if not known:
                same = key[1:] == key[:-1]
                keep = np.append(same, False) | np.insert(same, 0, False)
                key, c, n, pos = key[keep], c[keep], n[keep], pos[keep]
            for a in range(0, len(key), 100_000):
                b = a + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(key[a:b].astype(np.int64)), pa.array(c[a:b]), pa.array(n[a:b].astype(np.int64)), pa.array(pos[a:b])], names=["s", "c", "n", "pos"])

    packed = docs.select("text").mapInArrow(run, "bucket int, known boolean, c array<long>, n array<int>, k array<int>, s array<long>")
    return packed.repartitionById(buckets, "bucket").mapInArrow(meet, "s long, c long, n long, pos int")


def small(df: DataFrame) -> DataFrame:
    """A stored narrow table for a join, broadcast only if it has few enough rows."""
    return F.broadcast(df) if df.count() <= PICK else df


def whole_sets(docs: DataFrame, ids: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(c, items): the distinct shingle hashes, ascending, of documents (id, text) whose id is in ids (id).

    Rows with a null id are taken too; what is joined with the result tells which classes count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, at in _sets(batch.column(0), size):
                items = values.view(np.int64)
                items = items[np.lexsort((items, np.repeat(np.arange(len(at) - 1), np.diff(at))))]
                yield pa.RecordBatch.from_arrays([pa.array(_digests(values, at)[0].view(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(items))], names=["c", "items"])

    key = F.xxhash64("id").alias("key")  # of a null id too
    ids = store(ids.select(key).distinct())
    return docs.select(key, "text").join(small(ids), "key").select("text").mapInArrow(run, "c long, items array<long>")


def differences(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int = SHINGLE, items: bool = False) -> DataFrame:
    """Distinct pairs (a, b, na, nb) with apart, the size of their symmetric difference, and with items its hashes.

    A set travels once for each b it is paired with, to a partition of b's group that meets its members as a stream: b's set
    first, then theirs. Groups are dealt to as many parts as they have MEMBERS members, each with its own copy of b's set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, base, before = None, None, None
        for batch in batches:
            out = []
            b, salt, a, na, nb, sets = (batch.column(k) for k in range(6))
            for k in range(batch.num_rows):
                at, who = (b[k].as_py(), salt[k].as_py()), a[k].as_py()
                if at != group:
                    group, base, before = at, None, None
                own = sets[k].values.to_numpy()
                if who is None:
                    base = own
                elif base is not None and who != before:  # rows of a document that occurs twice stand together
                    p = np.minimum(np.searchsorted(base, own), len(base) - 1)
                    hit = base[p] == own
                    apart = len(own) + len(base) - 2 * int(hit.sum())
                    gone = np.ones(len(base), dtype=bool)
                    if items:
                        gone[p[hit]] = False
                    out.append((who, at[0], na[k].as_py(), nb[k].as_py(), apart, np.concatenate([own[~hit], base[gone]]) if items else None))
                    before = who
            names = ["a", "b", "na", "nb", "apart", "items"]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
            for e in range(0, len(out), 1000):  # a batch of differences stays small
                columns = list(zip(*out[e : e + 1000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)][: 5 + items], names=names[: 5 + items])

    pairs = store(pairs.select("a", "b", "na", "nb"))
    parts = store(pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")))
    members = pairs.join(small(parts), "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("salt"), "a", "na", "nb")
    heads = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    wanted = store(members.unionByName(heads, allowMissingColumns=True).withColumn("c", F.coalesce("a", "b")))
    ids = classes.join(small(store(wanted.select("c").distinct())), "c").select("id")
    met = whole_sets(docs, ids, size).join(small(wanted), "c").select("b", "salt", "a", "na", "nb", "items")
    return met.repartition("b", "salt").sortWithinPartitions("b", "salt", "a").mapInArrow(run, "a long, b long, na long, nb long, apart long" + ", items array<long>" * items)


def not_ruled_out(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose sketches leave them a chance to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(k) for k in range(6))
            most = (DEN - NUM) * (na.to_numpy() + nb.to_numpy())
            keep = pa.array([(NUM + DEN) * least_apart(p, q) <= m for p, q, m in zip(x.to_pylist(), y.to_pylist(), most.tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a, b, na, nb], names=["a", "b", "na", "nb"]).filter(keep)

    pairs = store(pairs.select("a", "b", "na", "nb"))
    sketches = classes.select("c", "sketch")
    ends = [pairs.select(F.col(x).alias("c")).distinct() for x in ("a", "b")]
    some = store(sketches.join(small(store(ends[0].unionByName(ends[1]).distinct())), "c"))
    first = pairs.join(some.select(F.col("c").alias("a"), F.col("sketch").alias("x")), "a")
    return first.join(some.select(F.col("c").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, na long, nb long")


def links_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link."""
    pairs = not_ruled_out(pairs, classes)
    return store(differences(pairs, classes, docs, size).filter(close(F.col("na"), F.col("nb"), F.col("apart"))).select("a", "b"))


def may_link(na: Column, nb: Column, shared: Column, last_a: Column, last_b: Column) -> Column:
    """Whether sets that share so many prefix entries, the last at these positions, can still link.

    Beyond their last shared entry both have what follows it; and beyond the end of the prefix that ends first, its set
    has what follows that prefix.
    """
    rest = lambda n: F.ceil(n * F.lit(NUM) / F.lit(DEN)) - 1
    return shared + F.least(F.greatest(rest(na), rest(nb)), na - 1 - last_a, nb - 1 - last_b) >= need(na, nb)


def early(na: Column, nb: Column, pos_a: Column, pos_b: Column) -> Column:
    """Whether a shared entry at these positions can be the first one that a linking pair shares: enough entries from it on in both sets."""
    return F.least(na - pos_a, nb - pos_b) >= need(na, nb)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for all ids in edges (a, b): the smallest id reachable.

    Every id is hung under its smallest neighbour and its other neighbours are passed on to that one, until each has one
    parent; then parents are replaced by their own parents until all are roots. Parents are looked up once each, so that
    a root with very many children is one row in the exchange.
    """
    pairs = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while pairs.groupBy("a").count().filter("count > 1").limit(1).count():
        named = pairs.join(pairs.groupBy("a").agg(F.min("b").alias("m")), "a")
        named = named.select("a", F.col("m").alias("b")).unionByName(named.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        pairs = checkpoint(named.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        up = checkpoint(pairs.select("b").distinct().join(pairs.select(F.col("a").alias("b"), F.col("b").alias("up")), "b"))
        n = up.count()
        if not n:
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        moved = pairs.join(F.broadcast(up), "b", "left") if n <= PICK else salted_join(pairs, up, "b", "a", "left")
        pairs = checkpoint(moved.select("a", F.coalesce("up", "b").alias("b")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, common: int = COMMON, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_copies (documents with the same set, itself too), n_links (other rows that it links with)."""
    return _answers(docs, id_col, text_col, size, common, rounds, True).drop("t").withColumnRenamed("id", id_col)


def _answers(docs: DataFrame, id_col: str, text_col: str, size: int, common: int, rounds: int, count: bool) -> DataFrame:
    """(id, t, n_shingles, component_id, n_copies, n_links), t a hash of the text as it stands; without count n_links is null."""
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    every = store(digests(flat, size))
    classes = store(every.filter("n > 0").groupBy("n", "c", "d").agg(F.min("id").alias("id"), F.count("*").alias("n_copies"), F.first("sketch").alias("sketch")))
    entries = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1)).first()[0] or 0
    # blocks: sizes within a factor of 4/3, so sets that link are in the same block or the next
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("int")
    lists = index_lists(flat, common_shingles(flat, size, common), max(1, int(-(-entries // BUCKET_ENTRIES))), size)
    lists = store(lists.withColumn("block", block))
    comp = store(_components(flat, lists, classes, size, rounds))
    named = store(classes.join(small(comp.withColumnRenamed("id", "c")), "c", "left").withColumn("comp", F.coalesce("comp", "c")).drop("sketch"))
    smallest = named.groupBy("comp").agg(F.min("id").alias("component_id"), F.count("*").alias("members"))
    linked = salted_join(named, smallest, "comp", "c")
    if count:
        linked = store(linked)
        others = _others(linked.filter("members > 1"), classes, flat, size)
        linked = linked.join(others, "c", "left").withColumn("n_links", F.col("n_copies") - 1 + F.coalesce("others", F.lit(0)))
    else:
        linked = linked.withColumn("n_links", F.lit(None).cast("long"))
    key = F.concat_ws(":", "n", "c", "d").alias("set_key")
    some = salted_join(every.filter("n > 0").select("id", "t", key), linked.select(key, F.col("n").alias("n_shingles"), "component_id", "n_copies", "n_links"), "set_key", "t").drop("set_key")
    none = every.filter("n = 0").select("id", "t", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0 if count else None).cast("long").alias("n_links"))
    return some.unionByName(none)


def _components(docs: DataFrame, lists: DataFrame, classes: DataFrame, size: int, rounds: int) -> DataFrame:
    """(id, comp) of the classes that link with others."""
    left, links = lists.withColumn("comp", F.col("c")), None
    for k in range(rounds):
        # first the smallest class of a list; then several of seeded orders, the same for all lists; then of each list's own orders
        order = [F.col("c")] if not k else [F.xxhash64(F.lit(i + PIVOTS * k), "c", *(["s"] if k > 1 else [])) for i in range(PIVOTS * min(k, 2))]
        pivots = F.array_distinct(F.array(*[F.min(F.struct(h.alias("h"), F.struct(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb")).alias("x")))["x"] for h in order]))
        chosen = left.groupBy("s", "block").agg(pivots.alias("pivots"), F.count("*").alias("many")).filter("many > 1").drop("many")
        near = left.join(chosen, ["s", "block"]).select("c", "n", "pos", "comp", F.inline("pivots")).filter("comp <> cb")
        if k > 1:  # a set meets a pivot in one of their lists only
            near = near.filter(early(F.col("n"), F.col("nb"), F.col("pos"), F.col("pb")))
        near = near.groupBy("c", "n", "b", "nb").agg(F.count("*").alias("shared"), F.max("pos").alias("i"), F.max("pb").alias("j"))
        if k < 2:
            near = near.filter(may_link(F.col("n"), F.col("nb"), F.col("shared"), F.col("i"), F.col("j")))
        if not k:  # the one that a set shares most entries with
            near = near.groupBy("c", "n").agg(F.max(F.struct("shared", F.col("b"), F.col("nb"))).alias("x")).select("c", "n", "x.b", "x.nb")
        new = links_of(near.select(F.col("c").alias("a"), "b", F.col("n").alias("na"), "nb"), classes, docs, size)
        links = new if links is None else links.unionByName(new)
        left = _several(lists, components(links))
    return components(links.unionByName(links_of(_rest(left), classes, docs, size)))


def _several(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """Entries of the lists that hold more than one component, with their component and the one with most entries of the list."""
    named = lists.join(small(store(comp.withColumnRenamed("id", "c"))), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    by = named.groupBy("s", "comp").agg(F.count("*").alias("many")).groupBy("s").agg(F.max(F.struct("many", "comp"))["comp"].alias("most"), F.count("*").alias("comps"))
    return store(named.join(by.filter("comps > 1").drop("comps"), "s"))


def _rest(left: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of different components that share a list entry and that no filter rules out.

    One of the two isn't of the list's most common component, so only such entries probe: a list that is one large
    component and a few others costs their number times its length.
    """
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("s", "c", "n", "pos", "comp")]
    key = lambda block: F.xxhash64("s", block)
    probe = left.filter("comp <> most").withColumn("at", F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1))).select(key("at").alias("key"), *side("a"))
    na, nb, pa, pb = (F.col(c) for c in ("n_a", "n_b", "pos_a", "pos_b"))
    met = salted_join(probe, left.select(key("block").alias("key"), *side("b")), "key", "c_a").filter((F.col("s_a") == F.col("s_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.least(na, nb) * DEN >= F.greatest(na, nb) * NUM) & early(na, nb, pa, pb))
    turned = F.col("c_a") < F.col("c_b")
    return met.select(F.when(turned, F.col("c_a")).otherwise(F.col("c_b")).alias("a"), F.when(turned, F.col("c_b")).otherwise(F.col("c_a")).alias("b"), F.when(turned, na).otherwise(nb).alias("na"), F.when(turned, nb).otherwise(na).alias("nb")).distinct()


def _others(members: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(c, others): for classes (c, n, n_copies, comp) of components with several, the documents of other classes that link with it."""
    members = store(members.select("c", "n", "n_copies", "comp"))
    roots = members.groupBy("comp").agg(F.min(F.struct("c", "n")).alias("r")).select("comp", F.col("r.c").alias("b"), F.col("r.n").alias("nb"))
    pairs = salted_join(members.select(F.col("c").alias("a"), F.col("n").alias("na"), "comp"), roots, "comp", "a")
    apart = differences(pairs, classes, docs, size, items=True).select(F.col("a").alias("c"), "items")
    apart = store(salted_join(members, apart, "c", "c", hot=[]))
    # parts: a component as a whole if it is small, else by size level and hash
    size_of = apart.groupBy("comp").agg(F.count("*").alias("k"), F.sum(F.size("items")).alias("many"))
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("int")
    whole = (F.col("k") <= PART) & (F.col("many") <= PART_ITEMS)
    large = store(size_of.filter(~whole).select("comp"))
    leveled = apart.join(small(large.withColumn("large", F.lit(True))), "comp", "left").withColumn("level", F.when(F.col("large"), level).otherwise(0)).drop("large")
    by_level = leveled.groupBy("comp", "level").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum(F.size("items")) / PART_ITEMS)).cast("int").alias("parts"))
    by_level = store(by_level)
    parts = by_level.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("comp", "level", "part")
    # each part with itself and the later ones of its level and the next; a row for either side
    second = parts.select("comp", F.col("level").alias("level_2"), F.col("part").alias("part_2"))
    met = parts.join(second, "comp").filter("(level_2 = level and part_2 >= part) or level_2 = level + 1")
    sides = met.select("comp", "level", "part", "level_2", "part_2", F.lit(0).alias("side")).withColumnsRenamed({"level": "l1", "part": "p1", "level_2": "l2", "part_2": "p2"})
    first = sides.withColumns({"level": F.col("l1"), "part": F.col("p1")})
    last = sides.filter("l1 <> l2 or p1 <> p2").withColumns({"level": F.col("l2"), "part": F.col("p2"), "side": F.lit(1)})
    where = store(first.unionByName(last))
    placed = leveled.join(small(by_level), ["comp", "level"]).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")).drop("parts")
    dealt = placed.join(small(where), ["comp", "level", "part"]).select("comp", "l1", "p1", "l2", "p2", "side", "c", "n", "n_copies", "items")
    keys = ["comp", "l1", "p1", "l2", "p2"]
    counted = dealt.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(_count_links, "c long, others long")
    return counted.groupBy("c").agg(F.sum("others").alias("others"))


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (comp, l1, p1, l2, p2, side, c, n, n_copies, items), in order, to each class's (c, others) in each pair of parts."""

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        side, c, n, copies = (rows[x].to_numpy() for x in ("side", "c", "n", "n_copies"))
        items = rows["items"].combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        split = int((side == 0).sum())
        others = links_within(n, copies, np.diff(items.offsets.to_numpy()), items.flatten().to_numpy(), split)
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(others)], names=["c", "others"])

    held, group = [], None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(5)]) if batch.num_rows else np.zeros((5, 0))
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if group != (at := tuple(keys[:, a].tolist())):
                if held:
                    yield answer(held)
                held, group = [], at
            held.append(batch.slice(a, b - a))
    if held:
        yield answer(held)


def links_within(n: np.ndarray, copies: np.ndarray, d: np.ndarray, items: np.ndarray, split: int) -> np.ndarray:
    """For each set the copies of the sets that it links with: the first split sets with the rest, or all with each other if there is no rest.

    n: sizes, d: sizes of the differences from one root, items: their hashes, end to end.
    """
    total = len(n)
    one = np.arange(split)
    two = np.arange(split, total) if split < total else one
    most = (DEN - NUM) * (n[one][:, None] + n[two][None, :])
    sure = (NUM + DEN) * (d[one][:, None] + d[two][None, :]) <= most
    open_ = ~sure & ((NUM + DEN) * np.abs(d[one][:, None] - d[two][None, :]) <= most)
    links = sure
    a, b = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if len(a) and len(b):
        # shingles that two of the differences share, a slice of the matrix at a time
        rows = np.repeat(np.arange(total), d)
        _, which, many = np.unique(items, return_inverse=True, return_counts=True)
        rows, which = rows[many[which] > 1], which[many[which] > 1]
        turn = np.argsort(which, kind="stable")
        rows, which = rows[turn], which[turn]
        both = np.zeros((len(a), len(b)), dtype=np.float32)
        step = max(1, CELLS // total)
        at = 0
        used = np.unique(which)
        for e in range(0, len(used), step):
            end = int(np.searchsorted(which, used[min(e + step, len(used)) - 1], side="right"))
            cells = np.zeros((total, min(step, len(used) - e)), dtype=np.float32)
            cells[rows[at:end], np.searchsorted(used[e : e + step], which[at:end])] = 1
            both += cells[one[a]] @ cells[two[b]].T
            at = end
        apart = d[one[a]][:, None] + d[two[b]][None, :] - 2 * both
        found = open_[np.ix_(a, b)] & ((NUM + DEN) * apart <= most[np.ix_(a, b)])
        links[np.ix_(a, b)] |= found
    out = np.zeros(total, dtype=np.int64)
    if split == total:
        np.fill_diagonal(links, False)
        return links @ copies
    out[one], out[two] = links @ copies[two], links.T @ copies[one]
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are smallest of their component, all columns as they are; rows with the same id and text are one document.

    Documents without words and rows with a null id all stay. What goes is joined out by id and text hash, broadcast if
    it is few enough; only rows whose id and text occur more than once are compared as texts.
    """
    found = store(_answers(docs, id_col, text_col, SHINGLE, COMMON, ROUNDS, False).filter("id is not null").select("id", "t", "component_id"))
    id_, t = F.col(id_col).cast("long").alias("id_"), F.xxhash64(text_col).alias("t_")
    gone = store(found.filter("id <> component_id").select(F.col("id").alias("id_"), F.col("t").alias("t_")).distinct())
    twice = store(found.groupBy(F.col("id").alias("id_"), F.col("t").alias("t_")).count().filter("count > 1").select("id_", "t_"))
    named = docs.select("*", id_, t)
    kept = named.join(small(gone), ["id_", "t_"], "left_anti")
    again = kept.join(small(twice), ["id_", "t_"], "left_semi").dropDuplicates(["id_", "t_", text_col])
    return kept.join(small(twice), ["id_", "t_"], "left_anti").unionByName(again).select(*[F.col(c) for c in docs.columns])
