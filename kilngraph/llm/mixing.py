"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to; the patterns' token capacity is routed to the sources'
quotas with a cost that rises with each repetition; then every pattern takes its share from its documents in a seeded
order.  The order is cut by hash buckets, so that no task orders a whole source.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.llm._util import held

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
#: Hash buckets of a pattern; a task orders the documents of a bucket only.
BUCKETS = 4096
#: Membership patterns that are solved at once; more raise an error (group rare sources first).
MAX_PATTERNS = 100_000


def word_count(text: Column) -> Column:
    r"""Number of `[^\x20\x09-\x0D]+` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quotas(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = MAX_REPEATS) -> dict[str | None, float]:
    """Targets of the sources: by code point, null last, the weights repeating.  A target stops at cap times its
    source's size and the excess goes to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), order, {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = float(cap * sizes[s])
        left = max(0.0, left - sum(out[s] for s in full))
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(capacity: dict[tuple, int], want: dict[str | None, int], repeats: int = MAX_REPEATS) -> dict[tuple, dict[str | None, int]]:
    """Words each pattern gives to each of its sources.

    A pattern's r-th use of its words costs r - 1 a word (convex), so fresh words go first.  Successive cheapest
    augmenting paths over the graph of patterns and sources; with costs rising by use, that is optimal.
    """
    flow: dict[tuple, dict] = {p: defaultdict(int) for p in capacity}
    used = dict.fromkeys(capacity, 0)
    need = dict(want)
    members = defaultdict(list)
    for p in capacity:
        for s in p:
            members[s].append(p)

    def room(p: tuple) -> tuple[int, int]:
        """(cost of the next word, words at that cost)"""
        layer = used[p] // capacity[p] if capacity[p] else repeats
        return layer, (capacity[p] * (layer + 1) - used[p] if layer < repeats else 0)

    for cost in range(repeats):  # all paths of a cost before any of a higher one; moving words between sources is free
        for s in sorted(need, key=lambda x: (x is None, x or "")):
            while need[s] > 0:
                queue, came = [(0, 0, s)], {("s", s): None}
                tie, end = 1, None
                while queue and end is None:
                    _, _, at = heapq.heappop(queue)
                    for p in members[at]:
                        if ("p", p) in came:
                            continue
                        came["p", p] = at
                        if room(p)[0] == cost and room(p)[1] > 0:
                            end = p
                            break
                        for other, n in flow[p].items():
                            if n > 0 and ("s", other) not in came:
                                came["s", other] = p
                                heapq.heappush(queue, (1, tie, other))
                                tie += 1
                if end is None:
                    break
                path, p = [], end
                while True:
                    to = came["p", p]
                    path.append((p, to))
                    if to == s:
                        break
                    p = came["s", to]
                amount = min(need[s], room(end)[1], *(flow[q][to] for (_, to), (q, _) in zip(path, path[1:], strict=False)))
                for i, (q, to) in enumerate(path):
                    flow[q][to] += amount
                    if i:
                        flow[q][path[i - 1][1]] -= amount
                used[end] += amount
                need[s] -= amount
    return flow


def mix_sources(docs: DataFrame, sources: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS, seed: int = 42) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    sources is a string column, or an array column for documents that belong to several sources (source_size and target
    are then those of the pattern: sums over its sources).  A null source is a source of its own; an empty array
    belongs to none and is not taken.  A document is taken 0 to repeats times its size; at the border of a pattern's
    share one document a layer is taken in part (its first words), so that the shares are met exactly.  Rows that
    repeat are documents of their own; equal rows may swap what they get.  Reruns agree.
    """
    kind = dict(docs.dtypes)[sources]
    pattern = F.array_sort(F.array_distinct(sources)) if kind.startswith("array") else F.array(F.col(sources).cast("string"))
    pattern = F.coalesce(pattern, F.array().cast("array<string>"))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), pattern.alias("pattern"), word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64("text")).alias("draw"),
    )
    sized = held(sized.withColumn("bucket", F.pmod(F.col("draw"), F.lit(BUCKETS)).cast("int")))
    buckets = sized.groupBy("pattern", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = buckets.groupBy("pattern").agg(F.sum("bucket_size").alias("pattern_size"))
    rows = totals.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {tuple(r[0]): int(r[1]) for r in rows}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, n in capacity.items():
        for s in p:
            sizes[s] += n
    target = quotas(sizes, weights, share, repeats)
    flow = min_cost_flow(capacity, {s: round(t) for s, t in target.items()}, repeats)
    plan = docs.sparkSession.createDataFrame(
        [(list(p), sum(sizes[s] for s in p), float(sum(target[s] for s in p)), n, sum(flow[p].values())) for p, n in capacity.items()],
        "pattern array<string>, source_size long, target double, pattern_size long, share long",
    )
    before = F.sum("bucket_size").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("bucket_size")
    begins = buckets.withColumn("begin", before).drop("bucket_size")
    key = F.to_json(F.struct("pattern"))  # nulls in an array are values here
    laid = sized.withColumn("key", key).join(F.broadcast(plan.withColumn("key", key).drop("pattern")), "key")  # MAX_PATTERNS rows at most
    cut = F.col("share") % F.greatest("pattern_size", F.lit(1))
    rounds = F.floor(F.col("share") / F.greatest("pattern_size", F.lit(1))).cast("long")
    laid = laid.join(begins.withColumn("key", key).drop("pattern"), ["key", "bucket"])
    within = Window.partitionBy("key", "bucket").orderBy("draw", "doc_id", "size")
    begin = F.col("begin") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    part = F.least(F.greatest(cut - begin, F.lit(0).cast("long")), F.col("size"))
    return laid.select("doc_id", "size", "source_size", "target", (rounds * F.col("size") + part).alias("taken"))
