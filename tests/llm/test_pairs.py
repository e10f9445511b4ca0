"""Jaccard join, decontamination and repeated passages against brute force."""

import random
import re
import zlib
from collections import Counter

from touchline.llm import decontam, jaccard_join, substring_dedup


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]


def shingle_set(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def by_search(rows):
    sets, up = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets if i is not None}


def near_copies(seed, n):
    """A large group of copies with random edits, of which many don't link with each other, and unrelated texts."""
    r = random.Random(seed)
    base = [f"b{r.randrange(3000)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out + [(n + i, " ".join(f"b{r.randrange(3000)}" for _ in range(r.randrange(1, 60)))) for i in range(40)]


def test_components_equal_search(spark, docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect() if r.doc_id is not None}
    assert got == by_search(rows)


def test_group_of_near_copies_equals_search(spark):
    """With few pivots and few common shingles, so that most links are left to the last step."""
    data = near_copies(3, 90)
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = by_search(data)
    for rounds in (1, 2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, common=64, rounds=rounds).collect()}
        assert got == want


def links_by_search(rows):
    """Each row's number of other rows that it links with, all pairs tried."""
    sets = [shingle_set(t) for _, t in rows]
    return Counter((rows[k][0], sum(1 for j, b in enumerate(sets) if j != k and a and b and 100 * len(a & b) >= 75 * len(a | b))) for k, a in enumerate(sets))


def test_links_equal_search(spark, docs, rows):
    """All links, also those between sets of one component that share no verified pair."""
    data = near_copies(3, 90) + [(500, None), (501, "")] + [(502 + i, t) for i, t in near_copies(3, 4)[:4]]
    near = spark.createDataFrame(data, "doc_id long, text string")
    for rounds in (1, 2):
        got = Counter((r.doc_id, r.n_links) for r in jaccard_join.jaccard_components(near, common=64, rounds=rounds).collect())
        assert got == links_by_search(data)
    named = [r for r in rows if r[0] is not None]
    got = Counter((r.doc_id, r.n_links) for r in jaccard_join.jaccard_components(docs.filter("doc_id is not null")).collect())
    assert got == links_by_search(named)


def test_keep_one_keeps_clean_rows(docs, rows):
    want = {c for _, c in by_search(rows).values()}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert kept.filter("doc_id is null").count() == 2


def test_no_documents(none, spark):
    assert jaccard_join.jaccard_components(none).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0
    assert decontam.find_items(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def items_by_search(rows, items):
    found = set()
    for i, t in rows:
        w = words(t)
        for k, item in items:
            v = words(item)
            if not v:
                continue
            n = len(v)
            bag = lambda x: [tuple(x[a : a + 5]) for a in range(max(1, len(x) - 4))] if len(x) >= 5 else [tuple(x)]
            own = bag(v)
            for a in range(len(w) - n + 1):
                if n < 5 and len(w) != n:
                    continue
                win = bag(w[a : a + n])
                shared = sum(min(win.count(s), own.count(s)) for s in set(win))
                if shared / (len(win) + len(own) - shared) >= 0.75:
                    found.add((i, k))
                    break
    return found


def test_items_equal_search(spark, rows, docs):
    long = dict(r for r in rows if r[0] is not None)[13].split()
    edited = [*long[20:45], "zzz", *long[46:70]]
    items = [(1, " ".join(long[10:50])), (2, " ".join(edited)), (3, "one two three"), (4, None), (5, ""), (6, "not in any text at all here"), (7, " ".join(long[10:50]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    some = [r for r in rows if r[0] is not None and r[0] not in (8, 9)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_items(df, bench).collect()}
    assert got == items_by_search(some, items) and (13, 2) in got
    # in several blocks, the same
    assert {(r.doc_id, r.item_id) for r in decontam.find_items(df, bench, item_bytes=200).collect()} == got
    kept = decontam.keep_uncontaminated(docs, bench)
    bad = {i for i, _ in got}
    assert kept.columns == docs.columns
    assert kept.filter("doc_id not in (8, 9)").count() == len([r for r in some if r[0] not in bad])


def similar(x, y):
    """Weighted Jaccard similarity of two word lists' bags of 5-word shingles."""
    bag = lambda v: Counter(tuple(v[a : a + 5]) for a in range(max(1, len(v) - 4)))
    p, q = bag(x), bag(y)
    return sum((p & q).values()) / sum((p | q).values())


def test_short_documents_and_short_items(spark):
    """Documents that are less than the item, items of fewer than 5 words inside longer ones, and an item's several places."""
    r = random.Random(11)
    fresh = lambda n: [f"f{r.randrange(10**7)}" for _ in range(n)]
    long, brief = fresh(40), ["Mont", "Blanc", "massif"]
    items = {1: long, 2: brief, 3: ["alone"], 4: fresh(12), 5: brief}
    data = {k: long[:k] for k in range(28, 42)} | {100 + k: fresh(k) + ["mont", "BLANC", "massif"] + fresh(3) for k in range(4)}
    data |= {200: fresh(9) + long + fresh(60) + long + fresh(2), 201: brief + brief, 202: ["mont", "blanc"], 203: items[4][1:], 204: ["alone"] * 3 + fresh(5), 205: long + long}
    want = {}
    for d, w in data.items():
        w = [x.lower() for x in w]
        for k, item in items.items():
            v = [x.lower() for x in item]
            n = min(len(v), len(w))
            found = sorted((-similar(w[a : a + n], v), a) for a in range(len(w) - n + 1) if similar(w[a : a + n], v) >= 0.75)
            places = []
            for like, a in found:
                if all(abs(a - b) >= n for b, _, _ in places):
                    places.append((a, n, -like))
            want |= {(d, k): sorted(places)} if places else {}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in data.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {}
    for x in decontam.find_items(df, bench).collect():
        got.setdefault((x.doc_id, x.item_id), []).append((x.start_word, x.n_words, x.similarity))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert (39, 1) in want and (103, 2) in want and len(want[200, 1]) == len(want[201, 2]) == len(want[205, 1]) == 2
    bad = {d for d, _ in want}
    assert {x.doc_id for x in decontam.keep_uncontaminated(df, bench).collect()} == set(data) - bad


def test_passages_equal_search(spark):
    r = random.Random(5)
    passage = [f"p{r.randrange(900)}" for _ in range(70)]
    fresh = lambda n: [f"f{r.randrange(10**7)}" for _ in range(n)]
    data = []
    for i in range(30):
        w = fresh(r.randrange(90))
        if i % 3 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[i % 4 :]
        data.append((i, ("  " if i % 2 else "\n").join(w)))
    data += [(100, None), (101, ""), (102, " ".join(passage[:49])), (103, " ".join(passage[:50])), (103, " ".join(passage[:50])), (None, " ".join(passage))]
    holders = {}
    for i, t in data:
        if i is not None:
            w = words(t)
            for a in range(len(w) - 49):
                holders.setdefault(tuple(w[a : a + 50]), set()).add(i)
    want = set()
    for i, t in data:
        w = words(t)
        good = [a for a in range(len(w) - 49) if i is not None and len(holders[tuple(w[a : a + 50])]) > 1]
        starts = [a for a in good if a - 1 not in good]
        for a in starts:
            b = a
            while b + 1 in good:
                b += 1
            want.add((i, a, b - a + 50))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {(x.doc_id, x.start_word, x.n_words) for x in substring_dedup.repeated_passages(df).collect()} == want
    kept = {x.doc_id: x.kept for x in substring_dedup.drop_repeats(df).collect()}
    assert kept[103] == "" and kept[102] == " ".join(passage[:49]) and kept[0].count("p") >= 60


def test_chained_passages_stay_once(spark):
    """A run whose parts are shared with different documents: each part stays in the first document that holds it."""
    r = random.Random(6)
    fresh = lambda n: [f"f{r.randrange(10**7)}" for _ in range(n)]
    p, q, both = fresh(60), fresh(70), fresh(100)
    data = [(2, fresh(5) + p + fresh(3)), (5, fresh(4) + p + q + fresh(6)), (9, q + fresh(8)), (11, fresh(2) + both[:75]), (12, both + fresh(1)), (13, fresh(3) + both[30:]), (14, fresh(60)), (14, None)]
    first = {}
    for i, w in data:
        for a in range(len(w or ()) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)  # ids ascend
    want = []
    for i, w in data:
        w = w or []
        gone = {a + k for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for k in range(50)}
        want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    df = spark.createDataFrame([(i, w and " ".join(w)) for i, w in data], "doc_id long, text string")
    assert sorted((x.doc_id, x.kept) for x in substring_dedup.drop_repeats(df).collect()) == sorted(want)
    kept = dict(want)
    assert q[0] in kept[5].split() and kept[9].split() == data[2][1][70:] and p[0] not in kept[5].split()
    rows = substring_dedup.passages_and_kept(df).collect()
    assert {(x.doc_id, x.n_kept, x.kept_crc32) for x in rows} == {(i, len(kept[i].split()), zlib.crc32(kept[i].encode())) for i in (2, 5, 9, 11, 12, 13)}
    assert {(x.doc_id, x.start_word, x.n_words, x.first_doc) for x in rows} == {tuple(x) for x in substring_dedup.repeated_passages(df).collect()}


def test_cuts_resist_shifts():
    """An insertion at the front leaves the later chunks as they were."""
    import numpy as np
    import pyarrow as pa

    from touchline.llm.common import text_bytes

    r = random.Random(9)
    body = " ".join(f"w{r.randrange(10**5)}" for _ in range(400))
    a, b = (set(substring_dedup.Chunks(*substring_dedup.normalised(*text_bytes(pa.array([t])))).digests.tolist()) for t in (body, "something new " + body))
    assert len(a & b) >= 0.9 * len(a) and np.uint64
