"""Operators that score or transform single documents, sharding and mixing."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import license_scan, lm_score, media, mixing, secret_scan, sharding, toxicity


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- sharding ----------------------------------------------------------------------------------------------------------


def test_shards_hold_all_rows(docs, rows):
    got = sharding.shuffle_into_shards(docs, 8, bucket_rows=10).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    again = sharding.shuffle_into_shards(docs.repartition(7), 8, bucket_rows=10).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_repeated_rows_are_dealt_to_many_buckets(spark):
    """Rows that are alike fill no bucket of their own, whatever the input's layout."""
    df = spark.createDataFrame([(7, "same text")] * 900 + [(None, None)] * 300 + [(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    numbered = sharding._numbered(df.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text"))
    assert sorted(r.copy for r in numbered.filter("text = 'same text'").collect()) == list(range(900))
    got = [sharding.shuffle_into_shards(df.repartition(n), 3, carry=("text",), bucket_rows=50).collect() for n in (2, 5)]
    assert sorted(map(repr, got[0])) == sorted(map(repr, got[1])) and len(got[0]) == 1300
    mine = sorted(r.slot * 3 + r.shard for r in got[0] if r.doc_id == 7)
    assert mine[0] < 100 and mine[-1] >= 1200  # from the first bucket to the last


def test_written_shards_are_read_back(docs, rows, spark, tmp_path):
    shards = sharding.shuffle_into_shards(docs, 4, carry=("text",), bucket_rows=10)
    sharding.write_shards(shards.drop("size", "text_crc32"), f"{tmp_path}/s")
    back = sharding.with_sizes(sharding.read_shards(spark, f"{tmp_path}/s", shards.drop("size", "text_crc32").schema)).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.size, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, back)) == sorted(map(key, shards.collect())) and len(back) == len(rows)


def test_shards_of_nothing(none):
    assert sharding.shuffle_into_shards(none, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(none, 0)


# -- mixing ------------------------------------------------------------------------------------------------------------


def test_mix_meets_targets(docs, rows):
    got = mixing.mix(docs, F.array("source"), carry=("source",)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(tokens(t))) for i, t in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([sizes[s] for s in names], [(1, 2, 3)[k % 3] for k in range(len(names))]), strict=True))
    for s in names:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and mine[0].target == pytest.approx(float(want[s]))
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
    assert sum(want.values()) == sum(sizes.values())
    again = mixing.mix(docs.repartition(7), F.array("source"), carry=("source",)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_flow_of_overlapping_sources():
    """A pattern of two sources serves both; a second epoch is used only when first ones are gone."""
    sent = mixing.route([100, 50, 40], [[0], [1], [0, 1]], [120, 90], 3)
    assert sum(x.get(0, 0) for x in sent) == 120 and sum(x.get(1, 0) for x in sent) == 90
    assert sum(max(0, sum(x.values()) - c) for x, c in zip(sent, [100, 50, 40], strict=True)) == 20
    small = mixing.route([3], [[0]], [100], 3)
    assert small == [{0: 9}]


def best_flow(sent, capacity, members, quota, epochs):
    """Whether no residual path brings more words to an open source, or moves a word from a dearer epoch to a cheaper one."""
    used, filled = [sum(x.values()) for x in sent], [0] * len(quota)
    for x in sent:
        for s, f in x.items():
            filled[s] += f
    assert all(u <= epochs * c for u, c in zip(used, capacity, strict=True)) and all(f <= q for f, q in zip(filled, quota, strict=True)) and all(set(x) <= set(m) for x, m in zip(sent, members, strict=True))
    givers = [[] for _ in quota]
    for p, x in enumerate(sent):
        for s, f in x.items():
            if f:
                givers[s].append(p)
    for epoch in range(epochs):  # patterns whose next word costs this at most
        todo = [p for p, c in enumerate(capacity) if c and used[p] < (epoch + 1) * c]
        seen_p, seen_s = set(todo), set()
        while todo:
            for s in members[todo.pop()]:
                if s not in seen_s:
                    seen_s.add(s)
                    new = [p for p in givers[s] if p not in seen_p]
                    seen_p.update(new)
                    todo += new
        if any(filled[s] < quota[s] for s in seen_s) or any(used[p] > (epoch + 1) * capacity[p] for p in seen_p):
            return False
    return True


def test_flow_is_the_cheapest_and_ends_for_many_patterns():
    rng = np.random.default_rng(6)
    for n, sources in [(1, 1), (3, 2), (9, 4), (40, 6), (200, 12)] * 6:
        members = [sorted(rng.choice(sources, rng.integers(0, min(4, sources) + 1), replace=False).tolist()) for _ in range(n)]
        capacity, quota = rng.integers(0, 30, n).tolist(), rng.integers(0, 40 * n // sources + 2, sources).tolist()
        assert best_flow(mixing.route(capacity, members, quota), capacity, members, quota, 3)
    assert not best_flow([{0: 2}, {}], [1, 1], [[0], [0]], [2], 3)  # a second epoch where a first one is left
    n, sources = 20_000, 60
    members = [sorted(rng.choice(sources, 1 + i % 4, replace=False).tolist()) for i in range(n)]
    capacity, quota = rng.integers(1, 1000, n).tolist(), rng.integers(1, 2 * 500 * n // sources, sources).tolist()
    began = time.time()
    sent = mixing.route(capacity, members, quota)
    assert time.time() - began < 60 and best_flow(sent, capacity, members, quota, 3)


def test_mix_of_many_patterns_is_joined(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), [["a"], ["a", "b"], ["b"]][i % 3]) for i in range(90)], "doc_id long, text string, of array<string>")
    want = sorted(mixing.mix(df, F.col("of")).collect())
    monkeypatch.setattr(mixing, "SENT_PATTERNS", 1)
    assert sorted(mixing.mix(df, F.col("of")).collect()) == want


def test_mix_of_overlapping_sources(spark):
    """Rows of one or several sources: words go to quotas as the flow says, and no row beyond three times its size."""
    some = [["a"], ["a", "b"], ["b"], [None, "a"], ["c"]]
    data = [(i, "w " * (1 + i % 9), some[i % 5]) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, of array<string>"), F.col("of"), carry=("of",)).collect()
    sizes = [sum(1 + i % 9 for i, _, m in data if s in m) for s in ("a", "b", "c", None)]
    want = mixing.targets(sizes, [1, 2, 3, 1])
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        k = tuple(sorted(r.of, key=str))
        by[k] = by.get(k, 0) + r.taken
    members = sorted(by, key=str)
    capacity = [sum(1 + i % 9 for i, _, m in data if tuple(sorted(m, key=str)) == k) for k in members]
    sent = mixing.route(capacity, [[["a", "b", "c", None].index(s) for s in k] for k in members], [round(t) for t in want])
    assert sum(by.values()) == sum(sum(x.values()) for x in sent)


def test_mixed_documents_keep_columns(docs, none):
    assert mixing.mixed_documents(docs, F.array("source")).columns == docs.columns
    assert mixing.mix(none, F.array("source")).count() == 0


# -- language model ----------------------------------------------------------------------------------------------------


def test_base_score_equals_count(docs, rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = Counter()
    for i, t in rows:
        if not held(i):
            train.update(tokens(lower(t)))
            train["\n"] += 1
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in rows:
        w = [*tokens(lower(t)), "\n"]
        want[i, held(i), len(w), sum(x in train for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in lm_score.score_texts(docs, hot_words=50).collect())
    assert got == want


def test_common_words_do_not_change_scores(docs):
    a = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm_score.score_texts(docs, hot_words=20).collect())
    assert a == sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm_score.score_texts(docs).collect())


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b" a", b"a", b"ab", b"b", b"ba"]
    scores = np.log(np.full(len(pieces) + 257, 0.01) + np.arange(len(pieces) + 257) * 1e-5)
    lattice = lm_score.Lattice(pieces, scores)
    for word in (b"abab", b"b", b"xa"):
        s, total = b" " + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(s) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
            p = 1.0
            for x, y in zip(at, at[1:], strict=False):
                part = s[x:y]
                p *= sum(np.exp(scores[i]) for i, q in enumerate(pieces) if q == part) + (np.exp(scores[len(pieces) + part[0]]) if len(part) == 1 else 0)
            total += p
        assert lattice.log_probability([word])[0] == pytest.approx(math.log(total))


def test_lattice_by_plain_numbers_and_by_logarithms():
    rng = np.random.default_rng(3)
    pieces = [b" ", b" a", b"a", b"ab", b"b", b"ba", b"abab", b" abba"]
    p = rng.random(len(pieces) + 257)
    p[len(pieces) + 120] = 1e-40  # x: six of them leave the range of plain numbers
    words = [b"ab" * 3, b"b", b"xa", b"ab" * 300, b"x" * 8, b"abba", b"abx" + b"x" * 30]
    counts = np.arange(1.0, len(words) + 1)
    lattice = lm_score.Lattice(pieces, np.log(p / p.sum()))
    alone = [lattice._grid([w]) for w in words]
    want = [lattice.forward(lattice._arcs(g, f), n)[n[0], 0] for g, n, f in alone]
    assert lattice.log_probability(words) == pytest.approx(want)
    by_logs = sum(lattice._expected_by_logs([w], counts[[i]]) for i, w in enumerate(words))
    assert lattice.expected_counts(words, counts) == pytest.approx(by_logs)
    assert np.isfinite(want).all() and by_logs[len(pieces) + 120] == pytest.approx(8 * 5 + 3 + 31 * 7)


def test_lattice_asks_only_for_starts_of_pieces():
    pieces, p = lm_score.load_pieces()
    lattice = lm_score.Lattice(pieces, np.log(p))
    words = [b"understanding", b"zq9", "größe".encode(), b"a"]
    grid, size, start, end, piece, first = lattice._paths(words)
    got = {(int(s % 4), int(s // 4), pieces[i]) for s, i in zip(start, piece, strict=True)}
    text = [b" " + w for w in words]
    assert got == {(w, t, q) for w, s in enumerate(text) for t in range(len(s)) for q in pieces if s.startswith(q, t)}
    assert (end - start == 4 * np.array([len(pieces[i]) for i in piece])).all() and first[-1] == len(piece)


def test_words_are_gathered():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([b"a"] * n, pa.binary())], names=["word"]) for n in (1000, 15000, 3, 0, 2)]
    assert [b.num_rows for b in lm_score._gathered(iter(batches))] == [16000, 5]
    assert [b.num_rows for b in lm_score._gathered(iter([]))] == []


def test_lm_of_nothing(none):
    assert lm_score.score_texts(none).count() == 0


# -- licences ----------------------------------------------------------------------------------------------------------


def test_licence_places(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_licenses(docs).collect())
    want = Counter()
    for i, t in rows:
        w, at, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)), [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        want[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    assert got == want


def test_licence_errors_within_bound():
    found = license_scan.scan(b"see the GNU Generel Public Licence and apach license; permit license")
    assert found[1] == 0 and found[5] == "apache,gpl" and 0 < found[6] < 1
    assert license_scan.scan(b"") == (0, 0, None, None, "", "", 0.0, "")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("text", [
    "apache licence or apache license", "mit licence or mit license or mit licens", "gnu generel public license or gnu general public license",
    "bsd license bsd licence bsd license", "x mit license mit licence y", "apache license apach license aache license and mozila public license",
])
def test_licence_places_near_each_other(text):
    """Every place within the edits: the one with fewest edits, then the first, then what overlaps none taken."""
    w = text.split()
    ends = list(itertools.accumulate(len(x) + 1 for x in w))
    want = set()
    for name, label, k in license_scan.NOTICES:
        spans = [(edits(name, " ".join(w[i:j])), ends[i] - len(w[i]) - 1, ends[j - 1] - 1) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 9) + 1)]
        taken = []
        for e, a, b in sorted(s for s in spans if s[0] <= k):
            if all(b <= c or d <= a for _, c, d in taken):
                taken.append((e, a, b))
        want |= {(a, b, label, e) for e, a, b in taken}
    assert set(license_scan.fuzzy_spans(text.encode())) == want and len(want) >= 2


def test_many_places_in_one_text():
    """Thousands of places in one text are found in one pass a level."""
    found = license_scan.scan(b"mit license mit licens " * 3000)
    assert found[1] == 3000 and found[7].count(",") == 5999


# -- secrets -----------------------------------------------------------------------------------------------------------


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_equal_rules(docs, rows):
    want = Counter()
    for i, t in rows:
        s = base_spans(t or "")
        n = [sum(x[1] == k for x in s) for k in range(3)]
        want[(i, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.scan_secrets(docs).collect()) == want


def test_ledger_scans_only_new_pairs(spark):
    first = spark.createDataFrame([("a", "token=abcdef1"), ("b", "token=abcdef1"), ("c", "x")], "p string, t string")
    ledger = secret_scan.update_ledger(first, "p", "t")
    assert ledger.count() == 2
    ledger = ledger.withColumn("spans", F.lit("from the ledger"))
    more = spark.createDataFrame([("a", "token=abcdef1"), ("d", "secret: qwerty12"), ("e", "secret: qwerty12"), ("e", None)], "p string, t string")
    got = Counter(r.spans for r in secret_scan.update_ledger(more, "p", "t", ledger).collect())
    assert got == {"from the ledger": 2, "assign:0:16": 1, "": 1}
    assert secret_scan.update_ledger(more, "p", "t", ledger, "2").count() == 3


def test_deliveries_give_one_run_s_findings(docs, none):
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob"]
    parts = [docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 > 0"), docs.filter("doc_id is null"), none]
    got = Counter(map(tuple, secret_scan.scan_deliveries(parts).select(*columns).collect()))
    assert got == Counter(map(tuple, secret_scan.scan_secrets(docs).select(*columns).collect()))
    assert secret_scan.scan_secrets(none).count() == 0


def test_further_kinds():
    text = "Bearer " + "xY" * 12 + " postgres://me:pw1@host/x ghp_" + "Z9" * 18 + " eyJabcdefgh1.abcdefgh12.abcdefgh123 -----BEGIN RSA PRIVATE KEY-----"
    kinds = [k for _, _, k in secret_scan.find(text)[1]]
    assert kinds == ["bearer", "connection", "hosting", "jwt", "private_key"] and secret_scan.find(text)[0] == []


# -- media -------------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs, rows):
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        p = media.payload(raw)
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_features(docs).collect()) == want


def test_broken_streams_are_refused():
    (stream,) = media.encode([media.payload(b"some text " * 900)])
    blocks = media.decode([stream])[0]
    assert [at for at, _ in blocks] == list(range(0, 9024, media.BLOCK))
    for at in (60, len(stream) // 2, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode([bytes(bad)])
    with pytest.raises(ValueError):
        media.decode([stream[: len(stream) // 2]])


# -- toxicity ----------------------------------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    r = np.random.default_rng(2)
    chain = toxicity.Chain(np.exp(r.normal(size=(2, 2))), np.exp(r.normal(size=2)))
    odds, first = np.exp(r.normal(size=45)), np.array([0, 3, 3, 10, 11, 45])
    p, _, _ = chain.marginals(odds, first)
    for a, b in ((0, 3), (3, 10), (10, 11)):
        total, on = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            w = chain.begin[y[0]] * odds[a] ** y[0]
            for k in range(1, b - a):
                w *= chain.trans[y[k - 1], y[k]] * odds[a + k] ** y[k]
            total += w
            on += w * np.array(y)
        assert p[a:b] == pytest.approx(on / total)


def toxic_data(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(600):
        w = [f"w{x}" for x in r.integers(0, 500, 40)]
        bad = i % 5 == 0
        if bad:
            at = r.integers(0, 38)
            w[at : at + 2] = ["vile", "scum"]
        rows.append((i, " ".join(w), int(bad)))
    return spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, docs, none):
    data, labels = toxic_data(spark)
    model = toxicity.train(data, labels)
    got = [(r.doc_id, r.score, r.predicted, r.spans) for r in toxicity.score(data, model).collect()]
    held = [x for x in got if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert all((x[2] == 1) == (x[0] % 5 == 0) for x in held)
    texts = {r.doc_id: r.text for r in data.collect()}
    assert all({texts[i][int(a) : int(b)] for a, b in (s.split(":") for s in spans.split(","))} <= {"vile", "scum"} for i, _, p, spans in held if p)
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and odd.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.keep_clean(data, model).count() == sum(x[2] == 0 for x in got)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.keep_clean(docs, toxicity.train(docs, labels.filter("toxic = 0"))).columns == docs.columns
