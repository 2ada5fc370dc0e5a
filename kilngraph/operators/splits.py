"""Edge splits, degree strata, coverage, negative samples.  Draws follow from keys, so reruns and other engines agree."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.functions import expressions as X
from kilngraph.operators.ids import surrogate_keys


def degree_strata(edges: DataFrame, bins: int = 8, least: int = 3) -> DataFrame:
    """edges with stratum: the joint bin of both ends' degrees; strata of fewer than least edges are merged into one."""
    for end in ("src", "dst"):
        counts = edges.groupBy(end).agg(F.count("*").alias("_n"))
        edges = edges.join(counts.select(end, X.degree_bin(F.col("_n"), bins).alias(f"_bin_{end}")), end)
    edges = edges.withColumn("_label", (F.col("_bin_src") * bins + F.col("_bin_dst")).cast("int"))
    sizes = edges.groupBy("_label").agg(F.count("*").alias("_n"))  # bins squared rows at most
    label = F.when(F.col("_n") < least, F.lit(bins * bins)).otherwise(F.col("_label"))
    return edges.join(F.broadcast(sizes), "_label").withColumn("stratum", label.cast("int")).drop("_label", "_n", "_bin_src", "_bin_dst")


def draw_order(seed: int) -> list[Column]:
    return [X.draw(seed, F.col("src"), F.col("dst"), below=2**40).alias("_draw"), F.col("src"), F.col("dst")]


def random_split(edges: DataFrame, val: float, test: float, seed: int = 42) -> DataFrame:
    """edges (distinct pairs) with split: test, val, train of exact sizes, in the order of a seeded draw."""
    ordered = surrogate_keys(edges.withColumn("_draw", draw_order(seed)[0]), ["_draw", "src", "dst"], "_at")
    _, n_val, n_test = X.split_counts(edges.count(), val, test)
    part = F.when(F.col("_at") < n_test, "test").when(F.col("_at") < n_test + n_val, "val").otherwise("train")
    return ordered.select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")], part.alias("split"))


def stratum_shares(sizes: DataFrame, total: int, val: int, test: int, stratum: str) -> DataFrame:
    """(stratum, n, n_test, n_val): test and then val are dealt to the strata by their sizes, by largest remainders (ties: the
    smaller stratum number).  sizes: (stratum, n), a row a stratum, bins squared at most."""

    def dealt(df: DataFrame, of: str, count: int, out_of: int, name: str) -> DataFrame:
        exact = F.col(of).cast("decimal(19,0)") * F.lit(count).cast("decimal(19,0)")
        df = df.withColumn("_low", F.floor(exact / F.lit(max(out_of, 1))).cast("long")).withColumn("_rest", exact - F.col("_low") * F.lit(max(out_of, 1)))
        left = F.lit(count) - F.sum("_low").over(Window.partitionBy())
        place = F.row_number().over(Window.orderBy(F.desc("_rest"), stratum))
        return df.withColumn(name, (F.col("_low") + (place <= left).cast("long"))).drop("_low", "_rest")

    out = dealt(sizes, "n", test, total, "n_test").withColumn("_left", F.col("n") - F.col("n_test"))
    return dealt(out, "_left", val, total - test, "n_val").drop("_left")


def stratified_split(edges: DataFrame, val: float, test: float, stratum: str = "stratum", seed: int = 42, buckets: int = 256) -> DataFrame:
    """edges with split: test and val have their exact sizes, and each stratum its share of them by largest remainders.

    A stratum is ordered bucket by bucket of its draw, so a large one does not land in one task."""
    marked = edges.withColumn("_draw", draw_order(seed)[0]).withColumn("_bucket", F.shiftright("_draw", 40 - (buckets.bit_length() - 1)).cast("int"))
    sizes = marked.groupBy(stratum, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(stratum).orderBy("_bucket")) - F.col("_n")  # buckets rows a stratum
    total = edges.count()
    _, n_val, n_test = X.split_counts(total, val, test)
    shares = stratum_shares(sizes.groupBy(stratum).agg(F.sum("_n").alias("n")), total, n_val, n_test, stratum).drop("n")
    begins = sizes.withColumn("_before", before).drop("_n").join(F.broadcast(shares), stratum)  # a row a stratum
    at = F.row_number().over(Window.partitionBy(stratum, "_bucket").orderBy("_draw", "src", "dst")) - 1 + F.col("_before")
    laid = marked.join(F.broadcast(begins), [stratum, "_bucket"]).withColumn("_at", at)  # buckets rows a stratum at most
    part = F.when(F.col("_at") < F.col("n_test"), "test").when(F.col("_at") < F.col("n_test") + F.col("n_val"), "val").otherwise("train")
    return laid.withColumn("split", part).drop("_draw", "_bucket", "_before", "_at", "n_test", "n_val")


def split_edges(edges: DataFrame, val: float, test: float, bins: int = 8, seed: int = 42, stratify: bool = True, cover: bool = True) -> tuple[DataFrame, str]:
    """(edges with split, strategy): stratified by degrees where every stratum has two edges and either part an edge a
    stratum, else random; then rebalanced for train's coverage."""
    strategy = "random"
    if stratify:
        marked = degree_strata(edges, bins)
        seen = marked.groupBy("stratum").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.count("*").alias("kinds"), F.sum("n").alias("n")).first()
        _, n_val, n_test = X.split_counts(seen["n"] or 0, val, test)
        if seen["least"] >= 2 and min(n_val, n_test) >= seen["kinds"]:
            strategy = "stratified"
    out = stratified_split(marked, val, test, seed=seed).drop("stratum") if strategy == "stratified" else random_split(edges, val, test, seed)
    return (covering(out, seed) if cover else out), strategy


def covering(split: DataFrame, seed: int = 42) -> DataFrame:
    """split with more nodes in train, its sizes as they were: of each node that train lacks the val or test edge of least draw
    goes to train, and for each of them a train edge that neither end needs goes back to that part.

    Every node's train edge of least draw is its own; an edge that is no node's own can go, whatever else goes.  Where too
    few can go, as many edges change places as can."""
    drawn = split.withColumn("_draw", draw_order(seed)[0]).persist(StorageLevel.DISK_ONLY)  # read many times
    train, rest = drawn.where("split = 'train'"), drawn.where("split <> 'train'")

    def firsts(df: DataFrame, end: str) -> DataFrame:
        return df.groupBy(end).agg(F.min_by(F.struct("src", "dst"), F.struct("_draw", "src", "dst")).alias("e")).select("e.src", "e.dst")

    lacking = [firsts(rest.join(train.select(end).distinct(), end, "left_anti"), end) for end in ("src", "dst")]
    wanted = lacking[0].union(lacking[1]).distinct().join(rest.select("src", "dst", "split", "_draw"), ["src", "dst"])
    own = firsts(train, "src").union(firsts(train, "dst")).distinct()
    spare = train.select("src", "dst", "_draw").join(own, ["src", "dst"], "left_anti")
    # a place each: the first of the ones goes where the first of the others was
    wanted, spare = surrogate_keys(wanted, ["_draw", "src", "dst"], "_at"), surrogate_keys(spare, ["_draw", "src", "dst"], "_at")
    swaps = wanted.select("_at", F.col("src").alias("in_src"), F.col("dst").alias("in_dst"), F.col("split").alias("part")).join(spare.select("_at", "src", "dst"), "_at")
    moves = swaps.select("src", "dst", F.col("part").alias("_to")).union(swaps.select("in_src", "in_dst", F.lit("train")))
    return split.join(moves, ["src", "dst"], "left").withColumn("split", F.coalesce("_to", "split")).drop("_to")


def coverage(split: DataFrame) -> DataFrame:
    """(end, total, covered): nodes of either end, and those that train has."""
    rows = [split.agg(F.lit(e).alias("end"), F.count_distinct(e).alias("total"), F.count_distinct(F.when(F.col("split") == "train", F.col(e))).alias("covered")) for e in ("src", "dst")]
    return rows[0].unionByName(rows[1])


def known_by_phase(split: DataFrame) -> DataFrame:
    """(phase, src, dst): what each phase treats as known: train, train and val, all."""
    phases = F.when(F.col("split") == "train", F.array(F.lit("train"), F.lit("val"), F.lit("test"))).when(F.col("split") == "val", F.array(F.lit("val"), F.lit("test"))).otherwise(F.array(F.lit("test")))
    return split.select(F.explode(phases).alias("phase"), "src", "dst")


def negatives(positives: DataFrame, known: DataFrame, n_src: int, n_dst: int, k: int = 5, tries: int = 4, seed: int = 42) -> DataFrame:
    """(src, dst, k, neg_src, neg_dst): k pairs for every positive that are not known, one end replaced; ids are 0 to n - 1.

    Which end follows from a draw; the first of `tries` candidates that is not known counts, and where all are known all ids are
    searched, of the other end too (see repaired).  RuntimeError where no pair is left."""
    found, lacking = tried_in_turn(positives, known, n_src, n_dst, k, tries, seed)
    return searched(found, lacking, known, n_src, n_dst, seed)


def tried(positives: DataFrame, known: DataFrame, n_src: int, n_dst: int, k: int, tries: int, seed: int) -> DataFrame:
    """negatives() without the search: positives all of whose candidates are known are missing."""
    return tried_in_turn(positives, known, n_src, n_dst, k, tries, seed)[0]


def tried_in_turn(positives: DataFrame, known: DataFrame, n_src: int, n_dst: int, k: int, tries: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(src, dst, k, neg_src, neg_dst) of what the tries find, and (src, dst, k) of what they leave.

    A try is held against the known pairs only where those before it were known."""
    lacking = positives.select("src", "dst").distinct().select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    found = []
    for t in range(tries):
        turn = X.draw(seed, F.lit("side"), F.col("src"), F.col("dst"), F.col("k"), below=2) == 0
        key = [F.lit("pick"), F.col("src"), F.col("dst"), F.col("k"), F.lit(t)]
        drawn = lacking.withColumns({
            "neg_src": F.when(turn, F.col("src")).otherwise(X.draw(seed, *key, below=n_src)), "neg_dst": F.when(turn, X.draw(seed, *key, below=n_dst)).otherwise(F.col("dst")),
        })
        fresh, lacking = told_apart(drawn, known)
        found.append(fresh)
    return reduce(DataFrame.unionByName, found), lacking


def told_apart(drawn: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """drawn (src, dst, k, neg_src, neg_dst) whose pair is not known, and (src, dst, k) of the rest: one join, whose rows are kept on disk."""
    pairs = known.select(F.col("src").alias("neg_src"), F.col("dst").alias("neg_dst"), F.lit(True).alias("_known")).distinct()
    marked = drawn.select("src", "dst", "k", "neg_src", "neg_dst").join(pairs, ["neg_src", "neg_dst"], "left").persist(StorageLevel.DISK_ONLY)
    return marked.where("_known is null").select("src", "dst", "k", "neg_src", "neg_dst"), marked.where("_known").select("src", "dst", "k")


def free_partner(lacking: DataFrame, known: DataFrame, end: str, other: str, n: int, seed: int) -> DataFrame:
    """lacking (src, dst, k) with free: of the ids 0 to n - 1 that end's node is not linked to at the other end, the one that a
    draw picks; null where there is none.  Only the nodes' own links are held, never all ids."""
    own = known.join(lacking.select(end).distinct(), end, "left_semi").where((F.col(other) >= 0) & (F.col(other) < n))
    used = own.groupBy(end).agg(F.array_sort(F.collect_set(F.col(other).cast("long"))).alias("_used"))
    asked = lacking.join(used, end, "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<bigint>")))
    left = F.lit(n).cast("long") - F.size("_used")
    at = X.draw(seed, F.lit("repair"), F.lit(end), F.col("src"), F.col("dst"), F.col("k"), below=F.greatest(left, F.lit(1).cast("long")))
    asked = asked.withColumn("_at", F.when(left > 0, at))
    return asked.withColumn("free", F.col("_at") + F.size(F.filter("_used", lambda x, i: x - i <= F.col("_at")))).drop("_used", "_at")


def repaired(positives: DataFrame, found: DataFrame, known: DataFrame, n_src: int, n_dst: int, k: int = 5, seed: int = 42) -> DataFrame:
    """found with the missing pairs: the end that negatives() replaces is drawn from all ids that are free there, where there is
    none the other end is; RuntimeError where neither has one.

    Only nodes that lack pairs are searched, each against the ids it is not linked to."""
    each = positives.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    return searched(found, each.join(found, ["src", "dst", "k"], "left_anti"), known, n_src, n_dst, seed)


def searched(found: DataFrame, lacking: DataFrame, known: DataFrame, n_src: int, n_dst: int, seed: int) -> DataFrame:
    """repaired() of what is known to be missing: lacking (src, dst, k)."""
    lacking = free_partner(lacking, known, "src", "dst", n_dst, seed).withColumnRenamed("free", "_dst")
    lacking = free_partner(lacking, known, "dst", "src", n_src, seed).withColumnRenamed("free", "_src").persist(StorageLevel.DISK_ONLY)  # asked twice
    turn = X.draw(seed, F.lit("side"), F.col("src"), F.col("dst"), F.col("k"), below=2) == 0
    keeps_src = F.col("_dst").isNotNull() & (turn | F.col("_src").isNull())
    got = lacking.select("src", "dst", "k", F.when(keeps_src, F.col("src")).otherwise(F.col("_src")).alias("neg_src"), F.when(keeps_src, F.col("_dst")).otherwise(F.col("dst")).alias("neg_dst"))
    if lacking.where("_dst is null and _src is null").take(1):
        raise RuntimeError("both ends of a positive are linked to every node: no negative pair is left")
    return found.unionByName(got)


def weighted_draws(weights: DataFrame, id_col: str, weight: str, draws: DataFrame, unit: int = 2**31) -> DataFrame:
    """draws (with u in [0, 1)) with id_col drawn by weight: exactly one row a draw.

    Weights count in whole parts of the largest, which has `unit` of them (smaller ones are rounded), so running weights are exact: draw u takes the
    id whose interval of [0, total) holds floor(u * total).  [0, total) is cut into about as many equal pieces as there are ids, and a piece
    lists the ids that reach into it: two rows an id at most in all, and a draw meets two ids on average, however unequal the weights
    are (one that has a third of all has a third of the pieces, so its draws are no hot key).  ValueError without a positive weight."""
    from kilngraph.operators.ids import running_totals

    seen = weights.agg(F.max(F.col(weight).cast("double")).alias("most"), F.count("*").alias("n")).first()
    if not seen["most"] or seen["most"] <= 0:
        raise ValueError("no weight is positive")
    whole = F.round(F.col(weight).cast("double") * float(unit) / seen["most"]).cast("long")
    laid = running_totals(weights.select(id_col, whole.alias("_w")).where("_w > 0"), id_col, ["_w"]).persist(StorageLevel.DISK_ONLY)
    total = laid.agg(F.sum("_w")).first()[0]
    step = -(-total // max(1024, seen["n"]))
    at = lambda c: F.expr(f"cast({c} as bigint) div {step}L")
    laid = laid.select(id_col, F.col("before__w").alias("_low"), (F.col("before__w") + F.col("_w")).alias("_high"))
    laid = laid.withColumn("_piece", F.explode(F.sequence(at("_low"), at("_high - 1"))))
    asked = draws.withColumn("_x", F.least(F.floor(F.col("u") * F.lit(float(total))).cast("long"), F.lit(total - 1).cast("long"))).withColumn("_piece", at("_x"))
    return asked.join(laid, "_piece").where((F.col("_x") >= F.col("_low")) & (F.col("_x") < F.col("_high"))).drop("_piece", "_low", "_high", "_x")


def fanout(edges: DataFrame, seeds: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """(src, dst): of each seed's neighbours at most `most`, by a seeded draw.  seeds: (src)."""
    drawn = edges.join(seeds.select("src").distinct(), "src", "left_semi").withColumn("_draw", X.draw(seed, F.col("src"), F.col("dst"), below=2**40))
    at = F.row_number().over(Window.partitionBy("src").orderBy("_draw", "dst"))
    return drawn.withColumn("_at", at).where(F.col("_at") <= most).select("src", "dst")


def fanout_hops(relations: dict[tuple[str, str, str], DataFrame], seeds: DataFrame, fanouts: list[int], seed: int = 42) -> DataFrame:
    """(hop, relation, src_type, src, dst_type, dst): edges into the seeds, then into what was reached, and so on; of a node's
    edges of a relation at most the hop's fanout, by a draw seeded anew at each hop.

    relations: {(source type, name, target type): (src, dst)}; seeds: (type, id).  A node is expanded at each hop that reaches it."""
    rows = [df.select(F.lit(f"{a}__{name}__{b}").alias("relation"), F.lit(a).alias("src_type"), F.col("src").cast("long").alias("src"), F.lit(b).alias("dst_type"), F.col("dst").cast("long").alias("dst")) for (a, name, b), df in relations.items()]
    edges = reduce(DataFrame.unionByName, rows).distinct()
    frontier, out = seeds.select("type", F.col("id").cast("long").alias("id")).distinct(), None
    for hop, most in enumerate(fanouts):
        found = edges.join(frontier.select(F.col("type").alias("dst_type"), F.col("id").alias("dst")), ["dst_type", "dst"], "left_semi")
        found = found.withColumn("_draw", X.draw(seed + hop, F.col("relation"), F.col("src"), F.col("dst"), below=2**40))
        at = F.row_number().over(Window.partitionBy("relation", "dst").orderBy("_draw", "src"))
        found = found.withColumn("_at", at).where(F.col("_at") <= most).select(F.lit(hop + 1).alias("hop"), "relation", "src_type", "src", "dst_type", "dst")
        found = found.persist(StorageLevel.DISK_ONLY)  # the next hop's frontier too
        frontier = found.select(F.col("src_type").alias("type"), F.col("src").alias("id")).distinct()
        out = found if out is None else out.unionByName(found)
    return out


def hard_negatives(positives: DataFrame, known: DataFrame, n_src: int, n_dst: int, k: int = 5, ratio: float = 0.5, power: float = 1.0, seed: int = 42) -> DataFrame:
    """(src, dst, k, neg_src, neg_dst): as negatives(), with the target replaced; of a positive's k pairs the first k * ratio (rounded)
    take targets by weight (links + 1) ** power, the others take any target alike.  What is known is searched anew."""
    hard = int(k * ratio + 0.5)
    each = positives.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    key = [F.lit("hard"), F.col("src"), F.col("dst"), F.col("k")]
    easy = each.where(F.col("k") >= hard).withColumn("neg_dst", X.draw(seed, *key, below=n_dst))
    links = known.groupBy(F.col("dst").cast("long").alias("id")).agg(F.count("*").alias("n"))
    weights = positives.sparkSession.range(n_dst).join(links, "id", "left").select(F.col("id").alias("neg_dst"), F.pow(F.coalesce("n", F.lit(0)) + 1.0, F.lit(power)).alias("w"))
    drawn = weighted_draws(weights, "neg_dst", "w", each.where(F.col("k") < hard).withColumn("u", X.draw(seed, *key, below=2**40) / F.lit(float(2**40))))
    got = easy.select("src", "dst", "k", "neg_dst").unionByName(drawn.select("src", "dst", "k", "neg_dst"))
    fresh, lacking = told_apart(got.withColumn("neg_src", F.col("src")), known)
    return searched(fresh, lacking, known, n_src, n_dst, seed)
