"""Exact ranking and classification metrics.  scored: (y 0/1, score).

Curves are running totals over distinct scores; ordered work is done range by range, never in one task."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.operators.ids import running_totals


def by_score(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    y = F.col("y").cast("long")
    return scored.groupBy(*(by or []), "score").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def divided(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.when(b != 0, a / b)


def auroc(scored: DataFrame) -> DataFrame:
    """(auroc): ties count a half; null with one class only."""
    laid = running_totals(by_score(scored), "score", ["pos", "neg"])
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    return laid.agg(F.round(divided(won, (F.sum("pos") * F.sum("neg")).cast("double")), 6).alias("auroc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """(average_precision): sum of precision at each distinct score times the recall it adds; null without a positive."""
    laid = running_totals(by_score(scored), "score", ["pos", "neg"], descending=True)
    hits, seen = F.col("before_pos") + F.col("pos"), F.col("before_pos") + F.col("pos") + F.col("before_neg") + F.col("neg")
    return laid.agg(F.round(divided(F.sum(F.col("pos") * hits / seen), F.sum("pos").cast("double")), 6).alias("average_precision"))


def curve(scored: DataFrame) -> DataFrame:
    """(score, tpr, fpr, precision) at each distinct score as a threshold (at least it)."""
    laid = running_totals(by_score(scored), "score", ["pos", "neg"], descending=True)
    all_ = laid.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    rates = (divided(tp, F.col("P")), divided(fp, F.col("N")), tp / (tp + fp))
    return laid.join(F.broadcast(all_)).select("score", *[F.round(r, 6).alias(n) for r, n in zip(rates, ("tpr", "fpr", "precision"), strict=True)])  # all_ is one row


def best_threshold(scored: DataFrame) -> DataFrame:
    """(threshold, tpr, fpr) where tpr - fpr is largest; ties: the highest threshold."""
    gain = F.round(F.col("tpr") - F.col("fpr"), 6)
    return curve(scored).agg(F.max(F.struct(gain.alias("gain"), "score", "tpr", "fpr")).alias("best")).select(F.col("best.score").alias("threshold"), "best.tpr", "best.fpr")


def at_thresholds(scored: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1), 0 where undefined; one pass for all thresholds."""
    each = scored.select("y", "score", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    counts = each.groupBy("threshold").agg(*[F.count_if(c).alias(n) for n, c in (("tp", hit & (F.col("y") == 1)), ("fp", hit & (F.col("y") == 0)), ("fn", ~hit & (F.col("y") == 1)))])
    ratio = lambda a, b: F.round(F.coalesce(divided(a, b), F.lit(0.0)), 6)
    return counts.select("threshold", "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, positive) of equal bins; an inner edge belongs to the lower bin, empty bins are missing."""
    bin_ = F.least(F.greatest(F.ceil(F.col("score") * bins).cast("int") - 1, F.lit(0)), F.lit(bins - 1))
    return scored.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("y"), 6).alias("positive"))


def histogram(scored: DataFrame, bins: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(y, bin, n) of equal bins over [low, high]; the upper edge belongs to the last one."""
    bin_ = F.least(F.greatest(F.floor((F.col("score") - low) / (high - low) * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    return scored.groupBy("y", bin_.alias("bin")).agg(F.count("*").alias("n"))


def ranks(scored: DataFrame, group: str, key: str) -> DataFrame:
    """(key, rank) of the positives: 1 + the number of its group's negatives with a higher score; ties favour the positive.

    Negatives are counted by score first, and a positive meets its group's counts, never its negatives."""
    counts = scored.groupBy(group, "score").agg(F.count_if(F.col("y") == 0).alias("neg"))
    down = Window.partitionBy(group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # a group's distinct scores
    above = counts.withColumn("rank", 1 + F.sum("neg").over(down) - F.col("neg")).drop("neg")
    return scored.where("y = 1").select(key, group, "score").join(above, [group, "score"]).select(key, "rank")


def quantiles(counts: DataFrame, key: str, columns: list[str], shares: tuple[float, ...]) -> DataFrame:
    """(of, share, value): exact quantiles of key, between two neighbours by their distance, for each column of how often each value occurs.

    counts: a row a value, none of them null.  By running totals over ranges, so any number of different values may occur; a column of
    zeros has no row."""
    laid = running_totals(counts, key, columns)
    totals = counts.agg(*[F.sum(c).alias(f"_all_{c}") for c in columns])
    picks = []
    for c in columns:
        for share in shares:
            place = (F.col(f"_all_{c}") - 1) * F.lit(share)
            inside = lambda at, c=c: (F.col(f"before_{c}") <= at) & (at < F.col(f"before_{c}") + F.col(c))
            low, high = inside(F.floor(place)), inside(F.ceil(place))
            value = F.col(key).cast("double")
            picks.append(F.when(low | high, F.struct(F.lit(c).alias("of"), F.lit(share).alias("share"), (place - F.floor(place)).alias("part"), F.when(low, value).alias("low"), F.when(high, value).alias("high"))))
    found = laid.join(F.broadcast(totals)).select(F.explode(F.filter(F.array(*picks), lambda p: p.isNotNull())).alias("p")).select("p.*")  # one row
    ends = found.groupBy("of", "share").agg(F.max("part").alias("part"), F.max("low").alias("low"), F.max("high").alias("high"))
    return ends.select("of", "share", (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("value"))


def rank_summary(ranked: DataFrame, hits: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """(mrr, mean_rank, median_rank, hits_k ...); nulls without a rank."""
    counts = ranked.where("rank is not null").groupBy("rank").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)  # read for borders, totals and sums
    median = quantiles(counts, "rank", ["n"], (0.5,)).agg(F.max("value").alias("median_rank"))
    mean = lambda c: F.round(F.sum(c * F.col("n")) / F.sum("n"), 6)
    rest = counts.agg(mean(1.0 / F.col("rank")).alias("mrr"), mean(F.col("rank")).alias("mean_rank"), *[mean((F.col("rank") <= k).cast("int")).alias(f"hits_{k}") for k in hits])
    return rest.join(F.broadcast(median)).select("mrr", "mean_rank", "median_rank", *[f"hits_{k}" for k in hits])  # one row each


def per_entity(scored: DataFrame, entity: str, least_pos: int = 5, least_neg: int = 1) -> DataFrame:
    """(entity, pos, neg, auroc, average_precision) of entities with enough of either class."""
    each = by_score(scored, [entity])
    up = Window.partitionBy(entity).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)  # an entity's distinct scores
    down = Window.partitionBy(entity).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    below = F.sum("neg").over(up) - F.col("neg")
    laid = each.withColumns({"below": below, "hits": F.sum("pos").over(down), "seen": F.sum(F.col("pos") + F.col("neg")).over(down)})
    out = laid.groupBy(entity).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("won"), F.sum(F.col("pos") * F.col("hits") / F.col("seen")).alias("area")
    ).where((F.col("p") >= least_pos) & (F.col("n") >= least_neg))
    return out.select(entity, F.col("p").alias("pos"), F.col("n").alias("neg"), F.round(F.col("won") / (F.col("p") * F.col("n")), 6).alias("auroc"), F.round(F.col("area") / F.col("p"), 6).alias("average_precision"))


def top_predictions(scored: DataFrame, keys: list[str], k: int = 100) -> DataFrame:
    """The k best pairs, each once with its best score, and whether it is a positive."""
    return scored.groupBy(*keys).agg(F.max("score").alias("score"), F.max(F.col("y").cast("int")).alias("known")).orderBy(F.desc("score"), *keys).limit(k)


def worst_errors(scored: DataFrame, keys: list[str], threshold: float, k: int = 50) -> DataFrame:
    """The k lowest positives below the threshold (fn) and the k highest negatives from it on (fp)."""
    fn = scored.where((F.col("y") == 1) & (F.col("score") < threshold)).orderBy("score", *keys).limit(k).withColumn("kind", F.lit("fn"))
    fp = scored.where((F.col("y") == 0) & (F.col("score") >= threshold)).orderBy(F.desc("score"), *keys).limit(k).withColumn("kind", F.lit("fp"))
    return fn.unionByName(fp).select("kind", *keys, "score")


def densities(scored: DataFrame, bins: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """histogram() with density: a bin's share of its class by the bins' width."""
    counts = histogram(scored, bins, low, high)
    total = F.sum("n").over(Window.partitionBy("y"))  # bins rows a class
    return counts.withColumn("density", F.round(F.col("n") / total * bins / (high - low), 6))


def box_statistics(scored: DataFrame) -> DataFrame:
    """(y, n, least, q1, median, q3, most, low_whisker, high_whisker) of each class' scores; a whisker ends at the last score within
    1.5 times the distance of the quartiles."""
    counts = by_score(scored.where("score is not null and y is not null")).persist(StorageLevel.DISK_ONLY)  # read for borders, totals and rows
    named = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    found = quantiles(counts, "score", ["pos", "neg"], tuple(named)).withColumn("y", (F.col("of") == "pos").cast("int"))
    found = found.groupBy("y").agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for p, n in named.items()])
    q = scored.groupBy("y").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most")).join(F.broadcast(found), "y")  # a row a class
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = scored.join(F.broadcast(q.select("y", (F.col("q1") - reach).alias("_low"), (F.col("q3") + reach).alias("_high"))), "y")  # a row a class
    ends = ends.where(F.col("score").between(F.col("_low"), F.col("_high"))).groupBy("y").agg(F.min("score").alias("low_whisker"), F.max("score").alias("high_whisker"))
    return q.join(F.broadcast(ends), "y").select("y", "n", *[F.round(c, 6).alias(c) for c in ("least", "q1", "median", "q3", "most", "low_whisker", "high_whisker")])


def compared(metrics: dict[str, DataFrame], by: str) -> DataFrame:
    """The one-row metrics of several models as a table (model, ...), the best first; models without the metric last."""
    out = None
    for model, df in metrics.items():
        row = df.select(F.lit(model).alias("model"), "*")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out.orderBy(F.desc_nulls_last(by), "model")
