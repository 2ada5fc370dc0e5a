"""Vectors that follow their graph: a refreshed cache equals one built from the start, and only what a change reaches is encoded."""

import numpy as np
import pytest

from kilngraph.operators import following as N
from kilngraph.operators import layers as L
from tests.test_layers import AFFECTS, ATTRIBUTES, BACK, ENRICHED, KINDS, NONE, PLAIN, RELATIONS, brute, close, edges_of, state_of

LIKES, BACKS = ("a", "likes", "b"), ("b", "backs", "a")


def vectors(spark, of):
    return spark.createDataFrame([(i, [float(x) for x in z]) for i, z in of.items()], "id long, z array<double>")


def links(spark, pairs, more=False):
    return spark.createDataFrame(pairs, "src long, dst long" + (", p long, q long" if more else ""))


def rows_of(cache):
    return {(k, i): {r["id"]: r["z"] for r in df.collect()} for k, frames in cache.states.items() for i, df in enumerate(frames)}


def same(got, wanted):
    a, b = rows_of(got), rows_of(wanted)
    assert a.keys() == b.keys()
    for key in a:
        assert a[key].keys() == b[key].keys() and all(np.allclose(a[key][i], b[key][i]) for i in a[key])


def reached(first, into, relations, layers):
    """kind -> stale nodes of each layer, edge by edge"""
    out = {k: [set(first[k])] for k in first}
    for i in range(layers):
        new = {k: out[k][i] | into[k] for k in out}
        for (a, _, b), pairs in relations.items():
            new[b] |= {d for s, d in pairs if s in out[a][i]}
        for k, v in new.items():
            out[k].append(v)
    return out


def test_refresh_equals_a_new_build_and_encodes_what_is_reached(spark):
    rng = np.random.default_rng(3)
    a, b = ({i: rng.normal(size=2) for i in range(n)} for n in (60, 50))
    likes, backs = sorted({(int(rng.integers(60)), int(rng.integers(50))) for _ in range(80)}), sorted({(int(rng.integers(50)), int(rng.integers(60))) for _ in range(70)})
    old = {LIKES: likes, BACKS: backs}
    cache = N.build(N.mean_encoding({"a": vectors(spark, a), "b": vectors(spark, b)}, 3), {r: links(spark, e) for r, e in old.items()})
    # an edge goes, two come, one of them twice; a node's input changes, one goes with its edges dangling, one comes
    added = [e for e in ((7, 9), (8, 8)) if e not in likes]
    new = {LIKES: [*likes[1:], *added, added[0]], BACKS: backs}
    a2, b2 = dict(a) | {5: a[5] + 1, 60: rng.normal(size=2)}, {i: z for i, z in b.items() if i != 11}
    encoding, relations = N.mean_encoding({"a": vectors(spark, a2), "b": vectors(spark, b2)}, 3), {r: links(spark, e) for r, e in new.items()}
    got = N.refresh(cache, encoding, relations)
    same(got, N.build(encoding, relations))
    wanted = reached({"a": {5, 60}, "b": {11}}, {"a": set(), "b": {likes[0][1], *(d for _, d in added)}}, new, 3)
    stale = N.stale(cache.prints, got.prints, relations, 3)
    found = {k: [{r["id"] for r in df.collect()} for df in frames] for k, frames in stale.items()}
    assert found == wanted and len(wanted["a"][3]) < 60
    again = N.refresh(got, encoding, relations)
    same(again, got)
    assert not any(df.count() for frames in N.stale(got.prints, again.prints, relations, 3).values() for df in frames)
    for c in (cache, got, again):
        c.free()


def attention(spark, state, features, edges):
    model = L.model_of({k: v for k, v in state.items() if "node_emb" not in k})
    inputs = {"gene": vectors(spark, dict(enumerate(features)))} | {k: vectors(spark, dict(enumerate(state[f"node_emb.{k}.weight"]))) for k in KINDS if k != "gene"}
    names = {r: ["src", "dst", *ATTRIBUTES.get(r, [])] for r in RELATIONS}
    types = {r: ", ".join(f"{c} {'long' if c in ('src', 'dst') else 'double'}" for c in names[r]) for r in RELATIONS}
    relations = {r: spark.createDataFrame([(row[0], row[1], *map(float, row[2:])) for row in rows], types[r]) for r, rows in edges.items()}
    return N.attention_encoding(model, inputs, ATTRIBUTES), relations


def test_attention_layers_follow_changed_edges_and_weights(spark, tmp_path):
    state, edges = state_of(), edges_of()
    features = np.random.default_rng(2).normal(0, 1, (KINDS["gene"], 3))
    N.save(N.build(*attention(spark, state, features, edges)), str(tmp_path / "one"))
    cache = N.load(spark, str(tmp_path / "one"))
    for k, h in brute(state, edges, features)[0].items():
        close(cache.z[k], h)
    # an action's code changes both ways, an edge goes, one comes to a gene that had none of them; nothing reaches diseases
    changed = edges | {AFFECTS: [(c, g, (t + 1) % 4 if (c, g) == (3, 2) else t, s) for c, g, t, s in edges[AFFECTS]], PLAIN: edges[PLAIN][1:], ENRICHED: [*edges[ENRICHED], (6, 5, 0.1, 0.2, 0.3)]}
    changed[BACK] = [(g, c, t, s) for c, g, t, s in changed[AFFECTS]]
    encoding, relations = attention(spark, state, features, changed)
    got = N.refresh(cache, encoding, relations)
    for k, h in brute(state, changed, features)[0].items():
        close(got.z[k], h)
    stale = N.stale(cache.prints, got.prints, relations, 2)
    assert [df.count() for df in stale["disease"]] == [0, 0, 0] and stale["gene"][0].count() == 0
    N.save(got, str(tmp_path / "two"))
    got = N.load(spark, str(tmp_path / "two"))
    # a relation loses its last edge: the mean counts one relation less for nodes that no edge has left, too
    fewer = changed | {ENRICHED: []}
    last = N.refresh(got, *attention(spark, state, features, fewer))
    assert last.counted == got.counted - {"__".join(ENRICHED)} and "__".join(NONE) not in got.counted
    for k, h in brute(state, fewer, features)[0].items():
        close(last.z[k], h)
    other = state_of(21)
    moved = N.refresh(got, *attention(spark, other, features, changed))
    assert moved.name != got.name
    for k, h in brute(other, changed, features)[0].items():
        close(moved.z[k], h)


def test_digests_tell_nulls_attributes_and_repeats_apart(spark):
    nodes = vectors(spark, {1: [1.0], 2: [2.0]})
    base = [(1, 2, None, 5), (1, 2, 3, 4), (None, 2, 1, 1), (7, 9, 1, 1)]
    prints = lambda pairs: {r["id"]: tuple(r)[1:] for r in N.prints_of(nodes, {("a", "x", "a"): links(spark, pairs, True)}).collect()}
    one = prints(base)
    assert set(one) == {1, 2} and one[1][2:] == (0, 0, 0) and one[2][2] == 2
    assert prints(base[::-1]) == one and prints([*base, (1, None, 1, 1)]) == one
    for other in ([(1, 2, 5, None), *base[1:]], [base[0], *base], [(2, 2, None, 5), *base[1:]], base[1:]):
        assert prints(other)[2] != one[2] and prints(other)[1] == one[1]
    assert N.prints_of(nodes, {}).count() == 2 and N.prints_of(nodes.limit(0), {LIKES: links(spark, [(1, 1)])}).count() == 0


def test_what_is_no_cache(spark, tmp_path):
    spark.createDataFrame([('{"type": "edge_split", "version": 1}',)], "value string").write.text(f"{tmp_path}/x/about")
    with pytest.raises(ValueError, match="not a cache"):
        N.load(spark, f"{tmp_path}/x")


def test_relations_are_kept(spark, sf):
    """Each layer's prints and vectors read them, so they are not computed anew from the tables."""
    from kilngraph.plans import queries

    assert all(df.storageLevel.useDisk for earlier in (True, False) for df in queries.followed(spark, sf, earlier)[1].values())
