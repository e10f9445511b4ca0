"""Byte-level BPE against the tokenizer library and a plain merge of pairs."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(), special_tokens={})


def plain(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks.get(a + b, len(ranks) * 9), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        if not pairs or min(pairs)[0] > len(ranks):
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


ODD = ["a", " ", "\x00", "aaaaaaa", "abababababab", "ééé日本", "The end's", "qzxjqzxjqzxj" * 4, "​\U0001f600", "0000000000", "==--==--", "thethethe"]


def test_folds_merge_as_the_heap_and_as_plain_steps(spark):
    ranks = bpe.load_ranks()
    rng = np.random.default_rng(3)
    words = [w.encode() for w in ODD] + [bytes(rng.choice(list(b"aetinos hr"), n)) for n in range(1, 49)] + [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in range(1, 49)]
    df = bpe._with_ranks(spark.createDataFrame([(w,) for w in words], "word binary"), None)
    got = {bytes(r.word): r.ids for r in df.select("word", F.get(bpe.fold_merges(F.col("ranks_"), F.array("word")), 0).alias("ids")).collect()}
    for w in words:
        assert got[w] == plain(w, ranks) == bpe.heap_merges(w, ranks) == bpe.list_merges(w, ranks)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=80) | st.text("ab cdeth", min_size=1, max_size=200).map(str.encode))
def test_heap_merges_as_plain_steps(word):
    assert bpe.heap_merges(word, bpe.load_ranks()) == plain(word, bpe.load_ranks()) == bpe.list_merges(word, bpe.load_ranks())


@settings(max_examples=500, deadline=None)
@given(st.text("ab1'.s \n\t\r\x85\xa0\u2003\u3000\x1c\x1fé日", max_size=30) | st.text(max_size=30))
def test_units_hold_the_words_of_the_pattern(text):
    import regex

    units, words = bpe._cutters(bpe.default_pattern())
    assert [w for u in units(text) for w in words(u)] == regex.findall(bpe.default_pattern(), text)


def test_long_word_takes_no_quadratic_time():
    ranks = bpe.load_ranks()
    word = bytes(np.random.default_rng(1).integers(97, 123, 400_000, dtype=np.uint8))
    ids = bpe.heap_merges(word, ranks)
    pieces = {r: p for p, r in ranks.items()}
    assert b"".join(pieces[i] for i in ids) == word


@pytest.mark.parametrize("words", [1 << 18, 5, 0])
def test_texts_are_encoded_as_by_the_library(docs, rows, library, monkeypatch, words):
    monkeypatch.setattr(bpe, "WORDS", words)  # the results don't depend on it
    monkeypatch.setattr(bpe, "HELD", 20)
    got = bpe.encode(docs).collect()
    key = lambda x: (str(x[0]), list(x[1]))
    assert sorted(map(key, got)) == sorted((str(i), library.encode_ordinary(t or "")) for i, t in rows)


def test_another_pattern(docs, rows):
    other = tiktoken.Encoding("other", pat_str=r"\w+|\W", mergeable_ranks=bpe.load_ranks(), special_tokens={})
    some = docs.filter("doc_id < 15 AND doc_id <> 8")
    got = {r.doc_id: r.ids for r in bpe.encode(some, pattern=r"\w+|\W").collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in rows if i is not None and i < 15 and i != 8}


def test_round_trip_digests(spark, docs, rows, library):
    extra = spark.createDataFrame([(900 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = bpe.round_trip(docs.select("doc_id", "text").union(extra)).collect()
    want = []
    for i, t in rows + [(900 + i, t) for i, t in enumerate(ODD)]:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_decode_of_odd_ids_and_of_nothing(spark, none):
    df = spark.createDataFrame([([0, 1],), ([],), (None,), ([10**8],)], "ids array<int>")
    pieces = {r: p for p, r in bpe.load_ranks().items()}
    assert [None if r.b is None else bytes(r.b) for r in bpe.decode(df, "ids", "b").collect()] == [pieces[0] + pieces[1], b"", None, b""]
    assert bpe.round_trip(none).count() == 0


def test_rank_file_without_a_byte(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.load_ranks(str(tmp_path / "ranks"))
