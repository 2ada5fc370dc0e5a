"""Record fields to fixed-width vectors.  Each encoder is fitted on a frame and gives one array column; JVM-side but for
the keyed hash of the hashing encoders, which is an Arrow UDF."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.functions import expressions as X
from kilngraph.operators import ids

#: The most places of a dense one-hot or multi-hot vector; sparse() has no bound.
MOST_PLACES = 65_536
#: Rows that a task encodes, about.
TASK_ROWS = 16_384


class Encoder:
    """fit() learns what it needs and returns the encoder; vector() is the array column; names() label its places."""

    def fit(self, df: DataFrame) -> Encoder:
        return self

    def vector(self) -> Column:
        raise NotImplementedError

    def names(self) -> list[str]:
        raise NotImplementedError


@dataclass
class Numeric(Encoder):
    """A number: fill where missing or unreadable, log1p of what is above 0, clip, z-score with the population's std."""

    column: str
    fill: float = 0.0
    log: bool = False
    low: float | None = None
    high: float | None = None
    z: bool = False
    mean: float = 0.0
    std: float = 1.0

    def value(self) -> Column:
        x = F.coalesce(F.col(self.column).cast("string").try_cast("double"), F.lit(self.fill))
        x = F.when(F.isnan(x), F.lit(self.fill)).otherwise(x)
        x = F.log1p(F.greatest(x, F.lit(0.0))) if self.log else x
        x = F.greatest(x, F.lit(self.low)) if self.low is not None else x
        return F.least(x, F.lit(self.high)) if self.high is not None else x

    def fit(self, df: DataFrame) -> Numeric:
        if self.z:
            got = df.agg(F.avg(self.value()), F.stddev_pop(self.value())).first()
            self.mean, self.std = got[0] or 0.0, got[1] if got[1] and got[1] > 1e-12 else 1.0
        return self

    def vector(self) -> Column:
        return F.array((self.value() - F.lit(self.mean)) / F.lit(self.std))

    def names(self) -> list[str]:
        return [self.column]


@dataclass
class Boolean(Encoder):
    """1 for true, for numbers but 0, and for the strings 1, true, yes, y and t in any case; else 0, missing too."""

    column: str

    def vector(self) -> Column:
        text = F.lower(F.trim(F.col(self.column).cast("string")))
        number = text.try_cast("double")
        number = F.coalesce((number != 0) & ~F.isnan(number), text == "true")
        return F.array(F.when(F.when(F.typeof(self.column) == "string", text.isin("1", "true", "yes", "y", "t")).otherwise(number), 1.0).otherwise(0.0))

    def names(self) -> list[str]:
        return [self.column]


@dataclass
class OneHot(Encoder):
    """A place for each value that occurs least times, and one for unknown values; missing: all zero."""

    column: str
    least: int = 1
    lower: bool = True
    vocab: list[str] = field(default_factory=list)

    def token(self) -> Column:
        t = F.trim(F.col(self.column).cast("string"))
        return F.lower(t) if self.lower else t

    counts: ClassVar[bool] = False

    def tokens(self) -> Column:
        """The record's tokens as an array: none where it is missing."""
        return F.filter(F.array(self.token()), lambda t: t != "")

    def kept(self, df: DataFrame) -> DataFrame:
        """(token) of the values that get a place."""
        counts = df.select(F.explode(self.tokens()).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        return counts.where(F.col("n") >= self.least).select("token")

    def fit(self, df: DataFrame) -> OneHot:
        """ValueError if a dense vector would have more than MOST_PLACES places."""
        rows = self.kept(df).limit(MOST_PLACES + 1).collect()
        if len(rows) > MOST_PLACES:
            raise ValueError(f"{self.column} has more than {MOST_PLACES} values: use vocabulary() and sparse()")
        self.vocab = sorted(r["token"] for r in rows)
        return self

    def known(self) -> Column:
        return F.array(*[F.lit(v) for v in self.vocab]).cast("array<string>")

    def vector(self) -> Column:
        t, there = self.token(), ~X.missing(F.col(self.column))
        hits = F.transform(self.known(), lambda v: F.when(there & (t == v), 1.0).otherwise(0.0))
        return F.concat(hits, F.array(F.when(there & ~F.array_contains(self.known(), t), 1.0).otherwise(0.0)))

    def names(self) -> list[str]:
        return [*(f"{self.column}={v}" for v in self.vocab), f"{self.column}=?"]


@dataclass
class MultiHot(OneHot):
    """As OneHot for the items of a delimited string; counts=True: how often each occurs."""

    sep: str = "|"
    counts: bool = False

    def items(self) -> Column:
        parts = F.split(F.coalesce(F.col(self.column).cast("string"), F.lit("")), f"\\Q{self.sep}\\E")
        clean = F.transform(parts, lambda x: F.lower(F.trim(x)) if self.lower else F.trim(x))
        return F.filter(clean, lambda x: x != "")

    def tokens(self) -> Column:
        return self.items()

    def vector(self) -> Column:
        known, items = self.known(), self.items()
        hits = F.transform(known, lambda v: F.size(F.filter(items, lambda x: x == v)).cast("double"))
        other = F.size(F.filter(items, lambda x: ~F.array_contains(known, x))).cast("double")
        out = F.concat(hits, F.array(other))
        return out if self.counts else F.transform(out, lambda x: F.least(x, F.lit(1.0)))


def vocabulary(df: DataFrame, encoder: OneHot) -> DataFrame:
    """(token, place): the values that get a place, in order from 0.  A table of any size; nothing comes to the driver."""
    return ids.surrogate_keys(encoder.kept(df), ["token"], "place").select("token", "place")


def sparse(df: DataFrame, key: str, encoder: OneHot, vocab: DataFrame) -> DataFrame:
    """(key, place, value): the places of the encoder's vector that are not 0; what has no place counts at the one after the last.

    Tokens meet the vocabulary in a join, which Spark splits where a token is frequent.  A record without tokens has no row."""
    tokens = df.select(F.col(key), F.explode(encoder.tokens()).alias("_token"))
    size = vocab.agg(F.count("*").alias("_size"))
    placed = tokens.join(vocab.select(F.col("token").alias("_token"), F.col("place").alias("_place")), "_token", "left").join(F.broadcast(size))  # one row
    out = placed.groupBy(key, F.coalesce("_place", "_size").alias("place")).agg(F.count("*").cast("double").alias("value"))
    return out if encoder.counts else out.withColumn("value", F.lit(1.0))


def dense(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, features) of sparse rows: arrays of the stated width, at most MOST_PLACES."""
    if width > MOST_PLACES:
        raise ValueError(f"at most {MOST_PLACES} places")
    held = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("_at"))  # width entries at most
    places = F.sequence(F.lit(0), F.lit(width - 1)).cast("array<bigint>")
    return held.select(key, F.transform(places, lambda i: F.coalesce(F.try_element_at("_at", i), F.lit(0.0))).alias("features"))


@lru_cache(1 << 17)
def token_hash(token: str) -> int:
    """The token's 8-byte BLAKE2b, little-endian."""
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")


def hashed_counts(tokens: Column, width: int, binary: bool, unit: bool) -> Column:
    """Counts (or 0/1) of the tokens by their token_hash modulo the width; unit: of length 1.  A batch's different tokens are hashed once."""

    @F.arrow_udf("array<double>")
    def count(tokens: pa.Array) -> pa.Array:
        each = pc.list_flatten(tokens).dictionary_encode()
        places = np.array([token_hash(t) % width for t in each.dictionary.to_pylist()], np.int64)[np.asarray(each.indices)]
        v = np.bincount(np.asarray(pc.list_parent_indices(tokens)) * width + places, minlength=len(tokens) * width).astype(np.float64)
        v = np.minimum(v, 1.0) if binary else v
        if unit:
            rows = v.reshape(-1, width)
            norm = np.sqrt((rows * rows).sum(1, keepdims=True))
            v = (rows / np.where(norm > 0, norm, 1.0)).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, width), pa.int32()), pa.array(v))

    return count(tokens)


def word_grams(words: Column, n: int) -> Column:
    """All n consecutive words, joined by _; fewer words: none."""
    each = F.transform(words, lambda _, i: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), "_")))
    return F.filter(each, lambda x: x.isNotNull())


@dataclass
class TextHash(Encoder):
    """Hashed n-grams of the words [A-Za-z0-9]+, counted; unit length."""

    column: str
    width: int = 64
    grams: int = 2

    def vector(self) -> Column:
        words = F.regexp_extract_all(F.lower(F.coalesce(F.col(self.column).cast("string"), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
        each = [words, *(word_grams(words, n) for n in range(2, self.grams + 1))]
        return hashed_counts(F.concat(*each), self.width, False, True)

    def names(self) -> list[str]:
        return [f"{self.column}#{i}" for i in range(self.width)]


@dataclass
class ListHash(Encoder):
    """Hashed items of a delimited string."""

    column: str
    width: int = 32
    sep: str = "|"
    binary: bool = True
    unit: bool = False

    def vector(self) -> Column:
        return hashed_counts(MultiHot(self.column, sep=self.sep).items(), self.width, self.binary, self.unit)

    def names(self) -> list[str]:
        return [f"{self.column}#{i}" for i in range(self.width)]


@dataclass
class Presence(Encoder):
    column: str

    def vector(self) -> Column:
        return F.array(F.when(X.missing(F.col(self.column)), 0.0).otherwise(1.0))

    def names(self) -> list[str]:
        return [f"has {self.column}"]


@dataclass
class UrlStats(Encoder):
    """present, https, has query, has fragment, slashes of the path, different query keys with a value, length of 512, and the
    domain's hash one-hot in `buckets` places (no domain: all zero)."""

    column: str
    buckets: int = 16

    def vector(self) -> Column:
        url = F.trim(F.coalesce(F.col(self.column).cast("string"), F.lit("")))
        rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        query, fragment = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, "#(.*)$", 1)
        keys = F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda p: F.regexp_like(p, F.lit("^[^=]+=.+"))), lambda p: F.substring_index(p, "=", 1)))
        flag = lambda c: F.when(c, 1.0).otherwise(0.0)
        stats = F.array(
            flag(url != ""), flag(F.lower(url).startswith("https://")), flag(query != ""), flag(fragment != ""), F.regexp_count(rest, F.lit("/")).cast("double"), F.size(keys).cast("double"),
            F.least(F.char_length(url) / 512.0, F.lit(1.0)),
        )
        if not self.buckets:
            return stats
        domain = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
        return F.concat(stats, hashed_counts(F.filter(F.array(domain), lambda x: x != ""), self.buckets, True, False))

    def names(self) -> list[str]:
        return [f"{self.column}.{n}" for n in ("present", "https", "query", "fragment", "slashes", "keys", "length", *(f"domain#{i}" for i in range(self.buckets)))]


@dataclass
class Pipeline(Encoder):
    """Encoders in order, their vectors in one."""

    parts: Sequence[Encoder]

    def fit(self, df: DataFrame) -> Pipeline:
        for p in self.parts:
            p.fit(df)
        return self

    def vector(self) -> Column:
        return F.concat(*[p.vector() for p in self.parts])

    def names(self) -> list[str]:
        return [n for p in self.parts for n in p.names()]


def encode(df: DataFrame, encoder: Encoder, name: str = "features") -> DataFrame:
    return df.withColumn(name, encoder.vector())


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt to tasks of about TASK_ROWS: a file of few bytes a row is otherwise one task, whose vectors are many times as large."""
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)))


# ---- encoders by kind of record ------------------------------------------------------------------------------------------

# The fields of a metadata record, and those of each kind of node with how they are encoded, of which of the
# widths (text, id, tree, misc), and what part of it.
METADATA = ("synonyms", "xrefs", "parentIDs", "parentTreeNumbers", "treeNumbers", "ctd", "ctd_url")
METADATA_TEXTS = METADATA[:5]
NODE_FIELDS = {
    "disease": ("DS_OMIM_MESH_ID", "DS_NAME", "DS_DEFINITION", "DS_PARENT_IDS", "DS_TREE_NUMBERS", "DS_PARENT_TREE_NUMBERS", "DS_SYNONYMS", "DS_SLIM_MAPPINGS"),
    "chemical": ("CHEM_MESH_ID", "CHEM_NAME", "CHEM_DEFINITION", "CHEM_PARENT_IDS", "CHEM_TREE_NUMBERS", "CHEM_PARENT_TREE_NUMBERS", "CHEM_SYNONYMS"),
    "gene": ("GENE_NCBI_ID", "GENE_SYMBOL", "GENE_NAME", "GENE_BIOGRID_IDS", "GENE_ALT_IDS", "GENE_SYNONYMS", "GENE_PHARMGKB_IDS", "GENE_UNIPROT_IDS"),
}
NODE_TEXTS = {
    "disease": (("DS_NAME", "text", 4), ("DS_DEFINITION", "text", 1)),
    "chemical": (("CHEM_NAME", "text", 4), ("CHEM_DEFINITION", "text", 1)),
    "gene": (("GENE_SYMBOL", "text", 4), ("GENE_NAME", "text", 2)),
}
NODE_LISTS = {
    "disease": (("DS_OMIM_MESH_ID", "id", 2), ("DS_PARENT_IDS", "id", 1), ("DS_TREE_NUMBERS", "tree", 1), ("DS_PARENT_TREE_NUMBERS", "tree", 1), ("DS_SYNONYMS", "text", 2), ("DS_SLIM_MAPPINGS", "misc", 1)),
    "chemical": (("CHEM_MESH_ID", "id", 2), ("CHEM_PARENT_IDS", "id", 1), ("CHEM_TREE_NUMBERS", "tree", 1), ("CHEM_PARENT_TREE_NUMBERS", "tree", 1), ("CHEM_SYNONYMS", "text", 2)),
    "gene": (("GENE_NCBI_ID", "id", 2), ("GENE_BIOGRID_IDS", "misc", 1), ("GENE_ALT_IDS", "misc", 1), ("GENE_SYNONYMS", "text", 2), ("GENE_PHARMGKB_IDS", "misc", 1), ("GENE_UNIPROT_IDS", "misc", 1)),
}
LEAST_WIDTH = 32


def metadata_encoder(texts: int = 256, id_width: int = 256, tree: int = 256, domains: int = 16) -> Pipeline:
    """Presence of each field of a metadata record, hashed words of its five text or list fields, the flag, and its URL.

    The texts are columns that metadata_records() lays beside the fields."""
    widths = (texts, max(LEAST_WIDTH, id_width // 2), id_width, tree, tree)
    hashed = [TextHash(f"{f}_text", w, g) for f, w, g in zip(METADATA_TEXTS, widths, (2, 1, 1, 2, 2), strict=True)]
    return Pipeline([*map(Presence, METADATA), *hashed, Boolean("ctd"), UrlStats("ctd_url", domains)])


def metadata_records(df: DataFrame) -> DataFrame:
    """df with every field of a metadata record (null where df has none) and the text of the five: items of a list joined by
    spaces, missing ones left out.  An empty list is there, but has no words."""
    df = df.withColumns({f: F.lit(None).cast("string") for f in METADATA if f not in df.columns})
    kinds = dict(df.dtypes)
    for f in METADATA_TEXTS:
        items = F.filter(F.col(f).cast("array<string>"), lambda x: F.trim(x) != "") if kinds[f].startswith("array") else None
        df = df.withColumn(f"{f}_text", F.col(f).cast("string") if items is None else F.array_join(items, " "))
    return df


def node_encoder(kind: str, text: int = 256, id: int = 128, tree: int = 128, misc: int = 64) -> Pipeline:
    """Presence of each field of a node table, then its hashed texts and lists; ValueError for other kinds than disease, chemical
    and gene (in any case, or the plural)."""
    name = kind.strip().lower().removesuffix("s")
    if name not in NODE_FIELDS:
        raise ValueError(f"{kind!r} is none of {', '.join(NODE_FIELDS)}")
    whole = {"text": text, "id": id, "tree": tree, "misc": misc}
    width = lambda of, part: whole[of] if part == 1 and of != "misc" else max(LEAST_WIDTH, whole[of] // part)
    texts = [TextHash(f, width(of, part)) for f, of, part in NODE_TEXTS[name]]
    return Pipeline([*map(Presence, NODE_FIELDS[name]), *texts, *[ListHash(f, width(of, part)) for f, of, part in NODE_LISTS[name]]])
