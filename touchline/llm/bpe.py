"""Byte-level BPE: texts to token ids by a public rank file, and ids back to bytes.

A text is cut by the tokenizer's pattern; each match (a word, here) is encoded by itself. A word that the rank file holds is
one id. Any other starts as its single bytes; the pair of neighbours whose joined bytes have the least rank (the leftmost of
equals) is merged, again and again, until no pair is in the file.

The merges are a fold of Spark's higher-order functions over a word's array of ids (`fold_merges`). Its rank map is a
constant of the plan: the file's pairs (each way to cut a piece into two pieces) as a hash table in one array, since Spark
searches a map literal from end to end. Words are counted over the whole corpus, map-side first; the WORDS most common
unknown ones are folded once, collected and sent to all tasks, a broadcast of bounded size. So texts are never shuffled and
nothing is joined back. The same merges in Python serve the rest where the texts lie: rare words, which would need a
shuffle of their texts or some 0.2 ms a fold (`list_merges`), and words of more than FOLD_BYTES bytes, whose fold would be
quadratic (`heap_merges`). The results don't depend on WORDS.

Decoding looks each id's piece up in a constant and concatenates the pieces.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded alike; an empty table
gives no rows; null ids (of a table to decode) give null and ids that the file doesn't hold no bytes; only doc_id and the
named columns are read, so others may have any names. A rank file that lacks one of the 256 bytes raises an error.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import store

#: Most unknown words that are folded once for all texts, the longest word that is folded, and distinct words that a task holds.
WORDS, FOLD_BYTES, HELD = 1 << 18, 48, 500_000
#: Primes, near the number of slots of each half of the rank table for a file of 50,000 pieces; doubled (to the next odd number) where pairs don't fit.
SLOTS = (131_071, 131_101)
#: The characters that are white space to the pattern: Unicode's property White_Space, fixed values.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=4)
def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Pieces and their ranks, which are their ids. path: a file of base64 pieces and ranks, one a line."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}
    lacking = [b for b in range(256) if bytes([b]) not in ranks]
    if lacking:
        raise ValueError(f"the rank file lacks the bytes {lacking}")
    return ranks


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


# -- merges ------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def rank_table(path: str | None = None) -> tuple[np.ndarray, int, tuple[int, int]]:
    """The pairs of pieces that join into a piece, as two halves of slots; a pair is in one of its two slots.

    Returns the slots, the base of an id in a slot, and the slots of each half. A slot holds left id, right id and the id of
    both together; an empty one is -1.
    """
    ranks = load_ranks(path)
    base = max(ranks.values()) + 1
    if base >= 1 << 21:
        raise ValueError("ids of more than 21 bits don't fit a slot")
    pairs = [(ranks[p[:i]] * base + ranks[p[i:]], rank) for p, rank in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
    sizes = SLOTS
    while True:
        slots = [[None] * n for n in sizes]
        if all(_insert(slots, sizes, pair) for pair in pairs):
            return np.array([-1 if s is None else s[0] * base + s[1] for half in slots for s in half]), base, sizes
        sizes = (2 * sizes[0] + 1, 2 * sizes[1] + 3)


def _insert(slots: list[list], sizes: tuple[int, int], pair: tuple[int, int]) -> bool:
    """Puts a pair into one of its two slots; a pair that was there moves to its other one."""
    half = 0
    for _ in range(500):
        at = pair[0] % sizes[half]
        pair, slots[half][at] = slots[half][at], pair
        if pair is None:
            return True
        half = 1 - half
    return False


def constant(spark: SparkSession, values: list | np.ndarray, kind: pa.DataType) -> Column:
    """An array as a literal of the plan: a scalar subquery of one row, since a literal of this size would fill the plan's text."""
    return spark.createDataFrame(pa.table({"value": pa.array([values], pa.list_(kind))})).scalar()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: an array of one element names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(table: Column, words: Column, path: str | None = None) -> Column:
    """For an array of words (binary, none empty) the ids of each after all merges. table: the slots of rank_table."""
    ranks, (_, base, (first, second)) = load_ranks(path), rank_table(path)
    single, none = F.array(*(F.lit(ranks[bytes([b])]) for b in range(256))), F.array().cast("array<int>")

    def fold(t: Column, word: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            pair = left.cast("long") * base + right
            hit = lambda s: F.when(s.between(pair * base, pair * base + (base - 1)), s % base)
            return F.coalesce(hit(F.get(t, pair % first)), hit(F.get(t, pair % second + first))).cast("int")

        def state(ids: Column, pairs: Column) -> Column:
            return _let(pairs, lambda p: F.struct(ids.alias("ids"), p.alias("pairs"), F.array_min(p).alias("least")))

        def merge(s: Column, at: Column) -> Column:  # the pair of places at and at + 1, from 1
            ids, pairs, new, n = s["ids"], s["pairs"], s["least"], F.size(s["ids"])
            before = F.when(at > 1, F.array(rank(F.get(ids, at - 2), new))).otherwise(none)
            after = F.when(at + 1 < n, F.array(rank(new, F.get(ids, at + 1)))).otherwise(none)
            return state(F.concat(F.slice(ids, F.lit(1), at - 1), F.array(new), F.slice(ids, at + 2, n)), F.concat(F.slice(pairs, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(pairs, at + 2, n)))

        def step(s: Column, _: Column) -> Column:
            return F.when(s["least"].isNull(), s).otherwise(_let(F.array_position(s["pairs"], s["least"]).cast("int"), lambda at: merge(s, at)))

        n = F.octet_length(word)
        ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(single, F.conv(F.hex(F.substring(word, i, F.lit(1))), 16, 10).cast("int")))
        start = _let(ids, lambda x: state(x, F.when(n < 2, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: rank(F.get(x, i), F.get(x, i + 1))))))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["ids"])

    return _let(table, lambda t: F.transform(words, lambda w: fold(t, w)))


def list_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a short word."""
    get, none = ranks.get, len(ranks) << 32
    at = list(range(len(word) + 1))
    pairs = [get(word[i : i + 2], none) for i in at[:-2]]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        del pairs[i], at[i + 1]
        if i < len(pairs):
            pairs[i] = get(word[at[i] : at[i + 2]], none)
        if i:
            pairs[i - 1] = get(word[at[i - 1] : at[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:], strict=False)]


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word, in n log n steps."""
    n = len(word)
    end, last = list(range(1, n + 1)), list(range(-1, n))  # of the piece that starts at a byte: its end; the start of the one before
    heap: list[tuple[int, int, int, int]] = []

    def push(a: int) -> None:
        b = end[a]
        if b < n and (rank := ranks.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (rank, a, b, end[b]))

    for a in range(n - 1):
        push(a)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or end[b] != c:
            continue  # one of the two has been merged since
        end[a], end[b] = c, -1
        if c < n:
            last[c] = a
        push(a)
        if a:
            push(last[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


# -- texts -------------------------------------------------------------------------------------------------------------


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column("text").fill_null("").to_pylist()


def _with_ranks(df: DataFrame, path: str | None) -> DataFrame:
    return df.withColumn("ranks_", constant(df.sparkSession, rank_table(path)[0], pa.int64()))


def _cutters(pattern: str) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    """Functions that cut a text into units and a unit into words.

    No word of the public pattern goes on behind a white-space character that follows another character, and what is before a
    unit doesn't change its words; so the units of that pattern are a run of other characters with a space before it, and
    runs of white space as the pattern takes them. Units repeat, so that the costly pattern meets each once a task. Any
    other pattern takes a whole text as one unit.
    """
    import re

    import regex

    words = regex.compile(pattern).findall
    if pattern != default_pattern():
        return (lambda text: [text] if text else []), words
    return re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall, words


def _counted(pattern: str, ranks: dict[bytes, int]):
    """Unknown words that can be folded, with their counts."""
    known = {w.decode() for w in ranks if _is_text(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (units, words), seen = _cutters(pattern), Counter()

        def report() -> pa.RecordBatch:
            counts: Counter[str] = Counter()
            for unit, n in seen.items():
                for word in words(unit):
                    if word not in known:
                        counts[word] += n
            seen.clear()
            found = [(raw, n) for w, n in counts.items() if len(raw := w.encode()) <= FOLD_BYTES]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["word", "count"])

        for batch in batches:
            for text in _texts(batch):
                seen.update(units(text))
                if len(seen) >= HELD:
                    yield report()
        yield report()

    return run


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def common_words(docs: DataFrame, pattern: str, path: str | None) -> pa.Table:
    """The most common unknown words that occur at least twice and their ids; WORDS at most, so the driver can hold and send them.

    The least count is found among classes of counts (some eight to a doubling), so no task gathers the candidates.
    """
    counted = docs.select("text").mapInArrow(_counted(pattern, load_ranks(path)), "word binary, count long").groupBy("word").agg(F.sum("count").alias("n"))
    often = store(counted.filter("n > 1").withColumn("class", F.floor(8 * F.log2("n")).cast("int")))
    least, held = 1 << 20, 0
    for r in often.groupBy("class").agg(F.count("*").alias("words")).orderBy(F.desc("class")).collect():  # some hundred rows
        held += r.words
        if held > WORDS:
            break
        least = r["class"]
    chosen = _with_ranks(often.filter(F.col("class") >= least).select("word"), path)
    return chosen.select("word", F.get(fold_merges(F.col("ranks_"), F.array("word"), path), F.lit(0)).alias("ids")).toArrow()


def _encoded(pattern: str, ranks: dict[bytes, int], known: dict[str, bytes]):
    """Ids of each text. known: packed ids by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (units, words), met = _cutters(pattern), {}

        def word_ids(word: str) -> bytes:
            raw = word.encode()
            merged = (list_merges if len(raw) <= FOLD_BYTES else heap_merges)(raw, ranks)
            return struct.pack(f"<{len(merged)}i", *merged)

        for batch in batches:
            rows = []
            for text in _texts(batch):
                parts = units(text)
                ids = list(map(met.get, parts))
                if None in ids:
                    for k in [k for k, found in enumerate(ids) if found is None]:
                        ids[k] = met.get(parts[k])
                        if ids[k] is None:
                            ids[k] = b"".join([known.get(w) or word_ids(w) for w in words(parts[k])])
                            if len(parts[k]) <= FOLD_BYTES:  # few characters, so that what is held is bounded
                                if len(met) >= HELD:
                                    met.clear()
                                met[parts[k]] = ids[k]
                rows.append(b"".join(ids))
            at = np.append(0, np.cumsum([len(r) // 4 for r in rows]))
            flat = pa.array(np.frombuffer(b"".join(rows), dtype="<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), pa.array(rows, pa.binary())], ["doc_id", "ids", "packed"])

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row (doc_id, ids array<int>, packed) for each row of docs; packed: the ids as little-endian unsigned 32-bit integers."""
    pattern, ranks = pattern or default_pattern(), load_ranks(path)
    known = {w.decode(): r.to_bytes(4, "little") for w, r in ranks.items() if _is_text(w)}
    for batch in common_words(docs, pattern, path).to_batches():
        ids, at = batch.column("ids").flatten().to_numpy().astype("<i4").tobytes(), np.append(0, np.cumsum(batch.column("ids").value_lengths().to_numpy())) * 4
        known |= {w.decode(): ids[a:b] for w, a, b in zip(batch.column("word").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)}
    sent = docs.sparkSession.sparkContext.broadcast((ranks, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(pattern, *sent.value)(batches)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, packed binary")


def decode(df: DataFrame, ids: str, to: str, path: str | None = None) -> DataFrame:
    """With column to: the bytes of the array of ids, which are its pieces, concatenated (in hexadecimal, as only strings are joined in one step)."""
    ranks = load_ranks(path)
    forms = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        forms[rank] = piece.hex()
    joined = _let(F.col("forms_"), lambda f: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(f, i)), "")))
    return df.withColumn("forms_", constant(df.sparkSession, forms, pa.string())).withColumn(to, joined).drop("forms_")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: number of ids and digests of the ids and of the decoded bytes."""
    both = decode(encode(docs, path), "ids", "decoded", path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
