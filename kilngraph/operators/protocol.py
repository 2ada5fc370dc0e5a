"""What makes evaluations comparable: a protocol's fields, a split artifact's metadata, and checks that name every fault."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.operators.graph import fingerprint

STRATEGIES = ("stratified", "random")
#: Shares that differ by no more are equal.
EQUAL = 1e-12


@dataclass(frozen=True)
class Protocol:
    """How a split is made and evaluated.  strategies: those whose results may be compared."""

    seed: int = 42
    val: float = 0.1
    test: float = 0.1
    negatives: int = 20
    strategies: tuple[str, ...] = ("stratified",)
    artifact_required: bool = True

    @classmethod
    def of(cls, values: Mapping[str, object]) -> Protocol:
        """From a mapping, also from one nested below 'protocol'; ValueError that lists every unknown or unfit field."""
        values = dict(values.get("protocol", values))  # type: ignore[arg-type]
        faults = [f"unknown field {k}" for k in values if k not in cls.__dataclass_fields__]
        for name in ("seed", "negatives"):
            if name in values and (isinstance(values[name], bool) or not isinstance(values[name], int)):
                faults.append(f"{name} must be a whole number")
        for name in ("val", "test"):
            if name in values and not (isinstance(values[name], float) and 0 < values[name] < 1):
                faults.append(f"{name} must be a share between 0 and 1")
        if isinstance(values.get("negatives"), int) and values["negatives"] < 1:  # type: ignore[operator]
            faults.append("negatives must be 1 or more")
        if not set(values.get("strategies", ())) <= set(STRATEGIES):  # type: ignore[arg-type]
            faults.append(f"strategies must be of {', '.join(STRATEGIES)}")
        if faults:
            raise ValueError("; ".join(faults))
        if "strategies" in values:
            values["strategies"] = tuple(values["strategies"])  # type: ignore[arg-type]
        return cls(**values)  # type: ignore[arg-type]

    def violations(self, metadata: Mapping[str, object] | None, seed: int, val: float, test: float, negatives: int) -> list[str]:
        """What an evaluation run departs in, by its split artifact's metadata (None: no artifact) and its own settings."""
        out = []
        for name, now in (("seed", seed), ("negatives", negatives)):
            if now != getattr(self, name):
                out.append(f"{name} is {now}, the protocol's {getattr(self, name)}")
        out += [f"{name} is {now}, the protocol's {getattr(self, name)}" for name, now in (("val", val), ("test", test)) if abs(now - getattr(self, name)) > EQUAL]
        if metadata is None:
            return [*out, "the protocol asks for a split artifact"] if self.artifact_required else out
        missing = [k for k in ("seed", "val", "test", "strategy") if k not in metadata]
        out += [f"the artifact's metadata lack {k}" for k in missing]
        if "strategy" not in missing and metadata["strategy"] not in self.strategies:
            out.append(f"the artifact is {metadata['strategy']}, not {' or '.join(self.strategies)}")
        if "seed" not in missing and metadata["seed"] != seed:
            out.append(f"the artifact's seed is {metadata['seed']}, the run's {seed}")
        out += [f"the artifact's {name} is {metadata[name]}, the run's {now}" for name, now in (("val", val), ("test", test)) if name not in missing and abs(float(metadata[name]) - now) > EQUAL]  # type: ignore[arg-type]
        return out

    def checked(self, metadata: Mapping[str, object] | None, seed: int, val: float, test: float, negatives: int, allow: bool = False) -> dict[str, object]:
        """The protocol as a mapping with comparable and violations; ValueError on a violation unless allowed."""
        found = self.violations(metadata, seed, val, test, negatives)
        if found and not allow:
            raise ValueError("not comparable:\n" + "\n".join(f"- {x}" for x in found))
        return asdict(self) | {"comparable": not found, "violations": found}


def split_metadata(split: DataFrame, nodes: Mapping[str, DataFrame], relation: tuple[str, str, str], seed: int, val: float, test: float, strategy: str, bins: int = 8, covered: bool = True) -> dict[str, object]:
    """What a split was made from: settings, sizes, and a digest of all its edges.  split: (src, dst, split)."""
    sizes = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}  # three rows
    print_ = fingerprint(split).first()
    return {
        "seed": seed, "val": val, "test": test, "strategy": strategy, "bins": bins, "covered": covered, "relation": list(relation), "nodes": {k: df.count() for k, df in nodes.items()},
        "edges": print_["n"], "digest": f"{print_['digest']}:{print_['mixed']}", **{f"{p}_edges": sizes.get(p, 0) for p in ("train", "val", "test")},
    }


def incompatibilities(split: DataFrame, metadata: Mapping[str, object], nodes: Mapping[str, DataFrame], edges: DataFrame, relation: tuple[str, str, str]) -> list[str]:
    """Everything that keeps a split artifact from a graph: another relation, node counts, edge sets, parts that overlap or
    repeat, sizes that are not those of the metadata."""
    out = []
    if list(metadata.get("relation", [])) != list(relation):  # type: ignore[call-overload]
        out.append(f"it is of relation {metadata.get('relation')}, not {list(relation)}")
    counts: Mapping[str, int] = metadata.get("nodes", {})  # type: ignore[assignment]
    for kind in (relation[0], relation[2]):
        if kind in nodes and counts.get(kind) != (n := nodes[kind].count()):
            out.append(f"it was made with {counts.get(kind)} {kind} nodes, the graph has {n}")
    pairs = split.select("src", "dst")
    seen = split.agg(F.count("*").alias("n"), F.count_distinct("src", "dst").alias("kinds")).first()
    if seen["n"] != seen["kinds"]:
        out.append(f"{seen['n'] - seen['kinds']} edges are in it more than once")
    now, own = fingerprint(edges.select("src", "dst").distinct()).first(), fingerprint(pairs.distinct()).first()
    if tuple(now) != tuple(own):
        lost, new = edges.select("src", "dst").exceptAll(pairs).count(), pairs.exceptAll(edges.select("src", "dst")).count()
        out.append(f"the graph has {lost} edges that it lacks, and it has {new} that the graph lacks")
    if "digest" in metadata and metadata["digest"] != (is_ := f"{own['digest']}:{own['mixed']}"):
        out.append(f"its edges' digest is {is_}, its metadata say {metadata['digest']}")
    sizes = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}  # a row a part
    out += [f"its {p} part has {sizes.get(p, 0)} edges, its metadata say {metadata[f'{p}_edges']}" for p in ("train", "val", "test") if metadata.get(f"{p}_edges", sizes.get(p, 0)) != sizes.get(p, 0)]
    return out


def assert_compatible(split: DataFrame, metadata: Mapping[str, object], nodes: Mapping[str, DataFrame], edges: DataFrame, relation: tuple[str, str, str]) -> None:
    """ValueError that lists all incompatibilities."""
    if found := incompatibilities(split, metadata, nodes, edges, relation):
        raise ValueError("the split does not fit the graph:\n" + "\n".join(f"- {x}" for x in found))
