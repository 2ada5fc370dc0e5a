"""Quality classifier: document evidence, corrected by hierarchical empirical Bayes over host and path.

1.  Fit: a bounded, seeded sample of labelled documents (`sample`, a parameter) gives word and style features; those that
    tell the classes apart are kept and weighted by logistic regression, one model for low quality and one for toxicity.
2.  Evidence: every document of the corpus gets its log-odds of being bad from either model.
3.  Sites: the documents' evidence is summed by host and by (host, path) in grouped aggregations over the whole corpus;
    host rates are shrunk toward the global rate and path rates toward their host's, the less a site has seen the more.
    The strength of either level's prior is fitted by moments from the spread of the rates at that level.
4.  Posterior: evidence plus the log-odds shift of the document's path, to which the document itself does not count; documents
    above `threshold` are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.llm._util import ALNUM, as_bytes, bounded, chunked, held, join_texts, mix, prefix_hash, span_hash, words_of

#: Labelled documents the models are fitted on.
SAMPLE = 12_000
#: Features a model keeps.
FEATURES = 2048
#: Standard errors a feature's log-odds must be away from 0.
LEAST_Z = 4.0
THRESHOLD = 0.35
#: The log-odds that one document's evidence is clipped to.
CLIP = 12.0
#: The largest log-odds shift that a site can add.
SHIFT = 2.0
#: Bytes of a word's beginnings that are features too (inflected forms share them).
HEADS = (3, 5)
#: The first step of a weight.
RATE = 0.1
#: How strongly weights are pulled to 0.
PULL = 1e-3
STYLE_BINS = np.array([0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7])


def style_bins(joined: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(text, style) matrix of bins: shares of capitals, of marks, of bars, of doubled words, of long words, of repeated words; and the log length."""
    size = np.maximum(np.diff(bounds) - 1, 1)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])
    first = np.searchsorted(start, bounds)
    count = np.maximum(np.diff(first), 1)
    per_word = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[first])
    again = np.zeros(len(words), np.bool_)
    again[1:] = words[1:] == words[:-1]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    order = np.lexsort((words, text))
    seen = np.zeros(len(words), np.bool_)
    if len(words):
        seen[1:] = (words[order][1:] == words[order][:-1]) & (text[order][1:] == text[order][:-1])
    capital = (joined >= 0x41) & (joined <= 0x5A)
    mark = ((joined >= 0x21) & (joined <= 0x2F) & (joined != 0x2C) & (joined != 0x2E) & (joined != 0x27) & (joined != 0x2D)) | ((joined >= 0x3A) & (joined <= 0x40)) | ((joined >= 0x5B) & (joined <= 0x60)) | (joined >= 0x7B) & (joined <= 0x7F)
    shares = [total(capital) / size, total(mark) / size, total(joined == 0x7C) / size, per_word(again) / count, per_word(end - start > 24) / count, per_word(seen) / count]
    bins = [np.searchsorted(STYLE_BINS, s) for s in shares]
    return np.stack([*bins, np.log2(np.maximum(np.diff(first), 1)).astype(np.int64)], axis=1)


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once: hashes of the texts' words, of the words' first bytes and of the texts' style bins."""
    joined, bounds = join_texts(texts)
    low, start, end = words_of(joined, ALNUM)
    prefix = prefix_hash(low)
    words = span_hash(prefix, start, end)
    heads = [mix(span_hash(prefix, start, np.minimum(start + n, end)) ^ np.uint64(n)) for n in HEADS]
    style = style_bins(joined, bounds, start, end, words)
    text = np.searchsorted(bounds, start, "right") - 1
    styles = mix((np.arange(style.shape[1], dtype=np.uint64) + np.uint64(1)) * np.uint64(1000) + style.astype(np.uint64)).ravel()
    rows = np.concatenate([text] * (1 + len(heads)) + [np.repeat(np.arange(len(texts)), style.shape[1])])
    feature = np.concatenate([words, *heads, styles])
    order = np.lexsort((feature, rows))
    rows, feature = rows[order], feature[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (feature[1:] != feature[:-1]))
    return rows[new], feature[new]


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def log_odds(self, rows: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        if not len(self.feature):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.feature, feature), len(self.feature) - 1)
        hit = self.feature[at] == feature
        return np.clip(self.bias + np.bincount(rows[hit], self.weight[at[hit]], n), -CLIP, CLIP)


def strongest(counts: DataFrame, total: int, positive: int, which: str, keep: int) -> np.ndarray:
    """Sorted hashes of the features whose smoothed log-odds are LEAST_Z standard errors from 0, the keep strongest.

    counts: (feature, n, and how many of the n are positive in the column that which names)."""
    a, b = F.col(which) + 0.5, F.col("n") - F.col(which) + 0.5
    no_a, no_b = F.lit(positive) - F.col(which) + 0.5, F.lit(total - positive) - (F.col("n") - F.col(which)) + 0.5
    z = F.abs(F.log(a / no_a) - F.log(b / no_b)) / F.sqrt(1 / a + 1 / no_a + 1 / b + 1 / no_b)
    found = counts.where("n >= 5").select("feature", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(keep)
    return np.unique(np.array([r["feature"] for r in found.collect()], np.int64).view(np.uint64))  # keep rows at most


def fit(rows: np.ndarray, feature: np.ndarray, label: np.ndarray, chosen: np.ndarray, steps: int = 120) -> Model:
    """Logistic regression on the chosen features, by gradient steps.  Where a class is absent nothing can be told, and the
    model finds nothing bad."""
    n, positive = len(label), int(label.sum())
    if not positive or positive == n:
        return Model(np.empty(0, np.uint64), np.empty(0), -CLIP)
    base = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if not len(chosen):
        return Model(np.empty(0, np.uint64), np.empty(0), min(base, -base))  # too few labels to tell: the rarer side of the odds
    column = np.minimum(np.searchsorted(chosen, feature), len(chosen) - 1)
    hit = chosen[column] == feature
    rows, column = rows[hit], column[hit]
    # full gradients with Adam's step sizes, which suit rare and frequent features alike
    weight, mean, square = (np.zeros(len(chosen) + 1) for _ in range(3))
    weight[-1] = base
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(weight[-1] + np.bincount(rows, weight[column], n), -30, 30)))
        gap = (p - label) / n
        slope = np.append(np.bincount(column, gap[rows], len(chosen)) + PULL * weight[:-1], gap.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        weight -= RATE * (1 - k / (steps + 1)) * mean / (1 - 0.9**k) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
    return Model(chosen, weight[:-1], float(weight[-1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: int = FEATURES, seed: int = 42) -> tuple[Model, Model]:
    """(low quality, toxic) models from the sample labelled documents of least hash.  Labels with a null are left out;
    a document that is labelled twice counts twice.

    Features are counted in an aggregation; the driver gets the keep strongest of either model, and which of them each
    sampled document has."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int"), F.col("toxic").cast("int")).na.drop()
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "quality", "toxic").limit(sample)
    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # sample rows at most
    texts = texts.select("doc_id", (F.col("quality") <= 0).cast("int").alias("low"), (F.col("toxic") > 0).cast("int").alias("toxic"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = as_bytes(batch.column("text")), 0
            for a, b in chunked(texts):
                rows, feature = features_of(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(b - a + 1)), pa.int32()), pa.array(feature.view(np.int64)))
                part = batch.slice(at, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("low"), part.column("toxic"), lists], ["doc_id", "low", "toxic", "features"])
                at += b - a

    seen = held(texts.mapInArrow(scan, "doc_id long, low int, toxic int, features array<long>"))
    total = seen.agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).first()
    counts = seen.select("low", "toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic"))
    counts = held(counts)  # used for either model
    picked = [strongest(counts, total["n"], total[which] or 0, which, keep) for which in ("low", "toxic")]
    wanted = np.union1d(*picked)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x.values.to_numpy().view(np.uint64) for x in batch.column("features")]
            raw = [np.flatnonzero(np.isin(wanted, x)).astype(np.uint16).tobytes() for x in own]  # places in wanted
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("low"), batch.column("toxic"), pa.array(raw, pa.binary())], ["doc_id", "low", "toxic", "features"])

    got = seen.mapInArrow(pick, "doc_id long, low int, toxic int, features binary").toArrow()  # sample rows of 2 * keep places of 2 bytes at most
    parts = [np.frombuffer(x, np.uint16) for x in got.column("features").to_pylist()]
    order = np.lexsort(([len(p) for p in parts], got.column("doc_id").to_numpy()))  # the same whatever order rows come in
    parts = [parts[i] for i in order]
    rows, feature = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), wanted[np.concatenate([np.empty(0, np.uint16), *parts])]
    low, toxic = (got.column(c).to_numpy()[order].astype(np.float64) for c in ("low", "toxic"))
    return fit(rows, feature, low, picked[0]), fit(rows, feature, toxic, picked[1])


def with_evidence(docs: DataFrame, models: tuple[Model, Model], carry: list[str], text: bool = True) -> DataFrame:
    """row (a struct of the columns in carry), text (if asked for), low and toxic (log-odds) for each row of docs."""
    fitted = docs.sparkSession.sparkContext.broadcast(models)  # 2 x FEATURES numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = as_bytes(batch.column("text")), 0
            for a, b in chunked(texts):
                rows, feature = features_of(texts[a:b])
                odds = [pa.array(model.log_odds(rows, feature, b - a)) for model in fitted.value]
                part = batch.slice(at, b - a)
                yield pa.RecordBatch.from_arrays([part.column("row"), *([part.column("text")] if text else []), *odds], ["row", *(["text"] if text else []), "low", "toxic"])
                at += b - a

    packed = bounded(docs).select(F.struct(*[F.col(f"`{n}`") for n in carry]).alias("row"), "text")
    out = packed.withColumns({"low": F.lit(0.0), "toxic": F.lit(0.0)})
    return packed.mapInArrow(scan, (out if text else out.drop("text")).schema)


def chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def odds_of(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


@dataclass
class Prior:
    """The corpus' rate, and the documents that the prior counts for at a host and at a path."""

    rate: float
    host: float
    path: float


def site_sums(evidence: DataFrame) -> tuple[DataFrame, Prior]:
    """(host, path, n, s, host_n, host_s): documents and sums of their evidence by path and by host; and the prior.
    evidence: (host, path, bad).

    A level's prior counts for as many documents as the variance within paths has of the variance between the level's
    sites beyond chance, both by moments over the whole corpus."""
    paths = held(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("bad").alias("s"), F.sum(F.col("bad") * F.col("bad")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.count("*").alias("k")).first()
    n, k = total["n"] or 0, total["k"] or 0
    rate = min(max((total["s"] or 0.0) / max(n, 1), 1e-4), 1 - 1e-4)
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "p.path", "n", "s", "q", "host_n", "host_s")
    both = held(both)
    seen = both.agg(
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("inner"), F.count("*").alias("paths"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("host_s") / F.col("host_n")) ** 2).alias("path"), F.sum(F.col("n") * (F.col("host_s") / F.col("host_n") - rate) ** 2).alias("host"),
    ).first()
    variance = max(seen["inner"] or 0.0, 0.0) / max(n - seen["paths"], 1)

    def strength(spread: float | None, freedom: int) -> float:
        between = max(((spread or 0.0) - freedom * variance) / max(n, 1), 0.0)
        return min(max(variance / between, 1.0), 1e6) if between > 0 and variance > 0 else 1e6

    return both.drop("q"), Prior(rate, strength(seen["host"], k - 1), strength(seen["path"], seen["paths"] - k))


def site_shift(prior: Prior, own: Column) -> Column:
    """The log-odds that a document's path differs by from the corpus, by all its documents but itself (own: its evidence).

    Host rates are shrunk toward the corpus' rate, path rates toward their host's."""
    host = (F.lit(prior.host * prior.rate) + F.col("host_s") - own) / (F.lit(prior.host) + F.col("host_n") - 1)
    path = (F.lit(prior.path) * host + F.col("s") - own) / (F.lit(prior.path) + F.col("n") - 1)
    shift = odds_of(path) - float(np.log(prior.rate / (1 - prior.rate)))
    return F.least(F.greatest(shift, F.lit(-SHIFT)), F.lit(SHIFT))


def posteriors(scored: DataFrame, host: Column, path: Column, sites: DataFrame, prior: Prior, threshold: float) -> DataFrame:
    """scored (with low and toxic) with p_low, p_toxic and keep."""
    out = scored.withColumns({"_host": host, "_path": path}).join(sites, F.col("_host").eqNullSafe(sites["host"]) & F.col("_path").eqNullSafe(sites["path"]), "left")
    shift = F.coalesce(site_shift(prior, chance(F.greatest("low", "toxic"))), F.lit(0.0))
    out = out.select(*scored.columns, chance(F.col("low") + shift).alias("p_low"), chance(F.col("toxic") + shift).alias("p_toxic"))
    return out.withColumn("keep", F.greatest("p_low", "p_toxic") < threshold)


def sited(docs: DataFrame, carry: list[str], host: Column | None, path: Column | None) -> DataFrame:
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    return docs.select(*[F.col(f"`{n}`") for n in dict.fromkeys([*carry, "text"])], host.cast("string").alias("_host"), path.cast("string").alias("_path"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, p_low, p_toxic, keep for each row of docs.

    host and path: columns of docs (source and lang by default).  Null hosts and paths are sites of their own; a null or
    empty text has no words, and goes by its style and site.  Without labels of both classes nothing is bad, and all documents
    stay.  Each row gives a row.
    """
    models = train(docs, labels, sample)
    scored = with_evidence(sited(docs, ["doc_id"], host, path), models, ["doc_id", "_host", "_path"], text=False)
    scored = held(scored.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row._host").alias("host"), F.col("row._path").alias("path"), "low", "toxic"))
    sites, prior = site_sums(scored.select("host", "path", chance(F.greatest("low", "toxic")).alias("bad")))
    out = posteriors(scored.withColumnsRenamed({"host": "own_host", "path": "own_path"}), F.col("own_host"), F.col("own_path"), sites, prior, threshold)
    return out.select("doc_id", F.round("p_low", 6).alias("p_low"), F.round("p_toxic", 6).alias("p_toxic"), "keep")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """docs without the documents that quality_scores rejects; the columns stay.

    Texts are scored twice, so that they are neither stored nor shuffled between the sites' sums and the decision."""
    models = train(docs, labels, sample)
    packed = sited(docs, docs.columns, host, path)
    seen = with_evidence(packed, models, ["_host", "_path"], text=False)
    sites, prior = site_sums(seen.select(F.col("row._host").alias("host"), F.col("row._path").alias("path"), chance(F.greatest("low", "toxic")).alias("bad")))
    out = with_evidence(packed, models, [n for n in packed.columns if n != "text"])
    out = posteriors(out, F.col("row._host"), F.col("row._path"), sites, prior, threshold).where("keep")
    return out.select(*[F.col("text") if n == "text" else F.col(f"row.`{n}`").alias(n) for n in docs.columns])
