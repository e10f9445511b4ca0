"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to (their pattern). A flow routes each pattern's
words to its sources' quotas; a pattern offers its words up to max_epochs times, each further time at a higher
cost, so that fresh words go first (a convex repetition cost). What a pattern sends is then turned into
documents: all of them so many whole times, and for the rest a seeded order of the pattern's documents up to
the last word, so that at most one document of a pattern is taken in part.

Sums along the seeded order run over hash bins; only the one bin of a pattern in which the rest ends is sorted,
so a source with a third of all rows isn't gathered anywhere. The driver sees patterns, never documents.

Defined results: a null source is a source of its own, last in order; a null or empty text has size 0 and is
taken 0 times; repeated rows count one by one; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import store

#: Patterns whose plan is broadcast; more are joined.
SENT_PATTERNS = 100_000
#: Documents that a hash bin holds on average.
BIN_ROWS = 2000
_TOP = 1 << 62


def word_count(text: str = "text") -> Column:
    """Number of runs of non-white-space characters; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], max_epochs: int = 3) -> list[Fraction]:
    """Shares of all sizes by weight, none above max_epochs times its size; the excess is shared again by weight."""
    left, open_ = Fraction(sum(sizes)), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(Fraction(weights[i]) for i in open_)
        above = {i for i in open_ if unit * Fraction(weights[i]) > max_epochs * sizes[i]}
        for i in above or open_:
            out[i] = Fraction(max_epochs * sizes[i]) if above else unit * Fraction(weights[i])
        left -= sum(out[i] for i in above)
        open_ -= above or open_
    return out


def route(capacity: list[int], members: list[list[int]], quota: list[int], max_epochs: int = 3) -> list[dict[int, int]]:
    """Min-cost max-flow: words each pattern sends to each of its sources. The k-th epoch of a word costs k.

    Costs stand only where a pattern takes words up, so a cheapest augmenting path costs what its first pattern's next epoch
    does, and paths never get cheaper again. So epoch by epoch the flow is made as large as it can be, by shortest levels and blocking
    flows (a few passes over the members each), and none of it is taken back from a pattern.
    """
    n_p, n_s = len(capacity), len(quota)
    sent: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    takers: list[list[int]] = [[] for _ in range(n_s)]
    for p, m in enumerate(members):
        for s in m:
            takers[s].append(p)
    open_ = list(quota)
    for _ in range(max_epochs):
        room = list(capacity)
        while True:
            # levels: patterns with room, their sources, patterns that could move words away from these, ...
            level_p, level_s = [-1] * n_p, [-1] * n_s
            here, depth, ends = [p for p in range(n_p) if room[p] and members[p]], 0, False
            for p in here:
                level_p[p] = 0
            while here and not ends:
                met = []
                for p in here:
                    for s in members[p]:
                        if level_s[s] < 0:
                            level_s[s] = depth + 1
                            met.append(s)
                            ends = ends or open_[s] > 0
                depth += 2
                here = []
                if not ends:
                    for s in met:
                        for p in takers[s]:
                            if level_p[p] < 0 and sent[p][s]:
                                level_p[p] = depth
                                here.append(p)
            if not ends:
                break
            next_p, next_s = [0] * n_p, [0] * n_s
            for start in range(n_p):
                while level_p[start] == 0 and room[start]:
                    path, amount = _path(start, members, takers, sent, open_, level_p, level_s, next_p, next_s)
                    if path is None:
                        break
                    amount = min(amount, room[start], open_[path[-1]])
                    room[start] -= amount
                    open_[path[-1]] -= amount
                    for i in range(0, len(path), 2):
                        sent[path[i]][path[i + 1]] += amount
                        if i:
                            sent[path[i]][path[i - 1]] -= amount
    return [{s: f for s, f in arcs.items() if f} for arcs in sent]


def _path(start: int, members, takers, sent, open_, level_p, level_s, next_p, next_s) -> tuple[list[int] | None, int]:
    """A path of patterns and sources in turn, level by level, to a source that is open; and the least words that it moves away."""
    path, least = [start], []
    while path:
        if len(path) % 2:
            p = path[-1]
            while next_p[p] < len(members[p]) and level_s[members[p][next_p[p]]] != level_p[p] + 1:
                next_p[p] += 1
            if next_p[p] < len(members[p]):
                path.append(members[p][next_p[p]])
                continue
            path.pop()
            if path:
                least.pop()
                next_s[path[-1]] += 1
        else:
            s = path[-1]
            if open_[s]:
                return path, min(least, default=open_[s])
            while next_s[s] < len(takers[s]) and not (level_p[takers[s][next_s[s]]] == level_s[s] + 1 and sent[takers[s][next_s[s]]][s]):
                next_s[s] += 1
            if next_s[s] < len(takers[s]):
                least.append(sent[takers[s][next_s[s]]][s])
                path.append(takers[s][next_s[s]])
                continue
            path.pop()
            next_p[path[-1]] += 1
    return None, 0


def _plan(spark: SparkSession, groups: list, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    names = sorted({s for g in groups for s in g["members"]}, key=lambda s: (s is None, s or ""))
    where = {s: i for i, s in enumerate(names)}
    members = [sorted({where[s] for s in g["members"]}) for g in groups]
    sizes = [0] * len(names)
    for g, m in zip(groups, members, strict=True):
        for s in m:
            sizes[s] += g["words"]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], max_epochs)
    sent = [sum(x.values()) for x in route([g["words"] for g in groups], members, [round(t) for t in wanted], max_epochs)]
    rows = []
    for g, m, f in zip(groups, members, sent, strict=True):
        full, rest = divmod(f, g["words"]) if g["words"] else (0, 0)
        rows.append((g["pattern"], full, rest, max(1, g["docs"] // BIN_ROWS), sizes[m[0]], float(wanted[m[0]])))
    return spark.createDataFrame(rows, "pattern string, full long, rest long, bins long, source_size long, target double")


def mix(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 29) -> DataFrame:
    """One row per document: id, size, taken, source_size and target (of the first of its sources in order), and the columns in carry.

    members: an array column, the sources of a document (at least one, null allowed). Sources by code point, null
    last, have the weights in turn. taken: words the mix takes, repeats counted.
    """
    spark = docs.sparkSession
    own = {f"c{i}": F.col(c) for i, c in enumerate(carry)}
    every = docs.select(
        F.col(id_col).alias("doc_id"), F.array_sort(F.array_distinct(members)).alias("members"), word_count(text_col).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).bitwiseAND(F.lit(_TOP - 1)).alias("h"), *[c.alias(k) for k, c in own.items()],
    ).withColumn("pattern", F.to_json("members"))
    # texts are read once for this table; once more only if columns are carried
    sized = store(every.select("doc_id", "members", "size", "h", "pattern"))
    stats = sized.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("words"), F.count("*").alias("docs"))
    groups = sorted(stats.collect(), key=lambda g: g["pattern"])  # a row a pattern
    plan = _plan(spark, groups, weights, max_epochs)
    sent = F.broadcast if len(groups) <= SENT_PATTERNS else lambda df: df
    plan = sent(plan)
    in_bins = lambda rows: rows.join(plan, "pattern").withColumn("bin", F.floor(F.col("h") / (F.lit(_TOP).cast("double") / F.col("bins"))))
    binned = in_bins(sized)
    upto = Window.partitionBy("pattern").orderBy("bin")
    cut = (
        binned.groupBy("pattern", "bin", "rest").agg(F.sum("size").alias("in_bin"))
        .withColumn("upto", F.sum("in_bin").over(upto))
        .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("in_bin") <= F.col("rest")))
        .groupBy("pattern").agg(F.min("bin").alias("cut"), F.min_by(F.col("upto") - F.col("in_bin"), "bin").alias("before"))
    )
    marked = in_bins(every if own else sized).join(sent(cut), "pattern", "left")  # a row a pattern
    outside = marked.filter(F.col("cut").isNull() | (F.col("bin") != F.col("cut"))).withColumn("extra", F.when(F.col("bin") < F.col("cut"), F.col("size")).otherwise(0))
    along = Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.col("rest") - F.col("before") - (F.sum("size").over(along) - F.col("size"))
    inside = marked.filter(F.col("bin") == F.col("cut")).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), room)))
    return outside.unionByName(inside).select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("extra")).cast("long").alias("taken"), *[F.col(k).alias(c) for k, c in zip(own, carry, strict=True)]
    )


def mixed_documents(docs: DataFrame, members: Column, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken (a part of at least half counts as once), columns as given."""
    clash = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(c).alias(k) for c, k in clash.items()], members.alias("of"))
    taken = mix(named, F.col("of"), id_col=clash[options.pop("id_col", "doc_id")], text_col=clash[options.pop("text_col", "text")], carry=tuple(k for k in clash.values() if k != clash["doc_id"]), **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(0), times))).filter(F.col("copy") > 0).select(*[F.col(k).alias(c) for c, k in clash.items()])
