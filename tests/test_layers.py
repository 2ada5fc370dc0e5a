"""Attention layers from stored weights against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import DataFrame

from kilngraph.operators import layers as L

WIDTH, HEADS = 8, 2
AFFECTS, BACK, ENRICHED, PLAIN, NONE = ("chemical", "affects", "gene"), ("gene", "rev_affects", "chemical"), ("chemical", "enriched_in", "gene"), ("gene", "interacts_with", "gene"), ("gene", "empty", "disease")
RELATIONS = [AFFECTS, BACK, ENRICHED, PLAIN, NONE]
KINDS = {"chemical": 7, "gene": 6, "disease": 3}
ATTRIBUTES = {AFFECTS: ["t", "s"], BACK: ["t", "s"], ENRICHED: ["p", "q", "r"]}


def state_of(seed=4, layers=2, mixed=False):
    rng = np.random.default_rng(seed)
    new = lambda *shape: rng.normal(0, 0.6, shape)
    out = {"node_proj.gene.0.weight": new(WIDTH, 3), "node_proj.gene.0.bias": new(WIDTH), "node_proj.gene.1.weight": new(WIDTH), "node_proj.gene.1.bias": new(WIDTH), "W_cd": new(WIDTH, WIDTH)}
    out |= {f"node_emb.{k}.weight": new(n, WIDTH) for k, n in KINDS.items() if k != "gene"}
    for i in range(layers):
        out |= {f"convs.{i}.action_type_emb.weight": new(4, 5), f"convs.{i}.action_subject_emb.weight": new(3, 5)}
        for r in RELATIONS:
            name = "__".join(r)
            out |= {f"convs.{i}.{e}.{name}.weight": new(WIDTH, WIDTH) for e in ("lin_src", "lin_dst")} | {f"convs.{i}.{e}.{name}.bias": new(WIDTH) for e in ("lin_src", "lin_dst")}
            out[f"convs.{i}.attn_{name}"] = new(1, HEADS, WIDTH // HEADS)
            if r in (AFFECTS, BACK) and mixed:
                out |= {f"convs.{i}.edge_cat_embs.{name}.0.weight": new(4, 5), f"convs.{i}.edge_gate_proj.{name}.0.weight": new(WIDTH, 6), f"convs.{i}.edge_gate_proj.{name}.0.bias": new(WIDTH)}
                out |= {f"convs.{i}.edge_gate_proj.{name}.2.weight": new(WIDTH, WIDTH), f"convs.{i}.edge_gate_proj.{name}.2.bias": new(WIDTH)}
            elif r in (AFFECTS, BACK):
                out |= {f"convs.{i}.lin_edge_cat.{name}.0.weight": new(WIDTH, 10), f"convs.{i}.lin_edge_cat.{name}.0.bias": new(WIDTH)}
            elif r == ENRICHED:
                out |= {f"convs.{i}.lin_edge_cont.{name}.0.weight": new(WIDTH, 3), f"convs.{i}.lin_edge_cont.{name}.0.bias": new(WIDTH), f"convs.{i}.lin_edge_cont.{name}.2.weight": new(WIDTH, WIDTH), f"convs.{i}.lin_edge_cont.{name}.2.bias": new(WIDTH)}
        out |= {f"convs.{i}.lin_out.{k}.weight": new(WIDTH, WIDTH) for k in KINDS} | {f"convs.{i}.lin_out.{k}.bias": new(WIDTH) for k in KINDS}
        out |= {f"norms.{i}.{k}.weight": new(WIDTH) for k in KINDS} | {f"norms.{i}.{k}.bias": new(WIDTH) for k in KINDS}
    return out


def edges_of(seed=9):
    """Edges with attributes; gene 2 is hot, gene 5 gets nothing, chemical 6 sends nothing."""
    rng = np.random.default_rng(seed)
    affects = [(c, 2, c % 4, c % 3) for c in range(6)] + [(c, g, (c + g) % 4, g % 3) for c in range(6) for g in (0, 1) if rng.random() < 0.6]
    return {
        AFFECTS: affects, BACK: [(g, c, t, s) for c, g, t, s in affects], ENRICHED: [(c, g, *rng.normal(0, 1, 3).tolist()) for c in range(5) for g in range(5)],
        PLAIN: [(a, b) for a in range(6) for b in range(5) if a != b], NONE: [],
    }


def plain_gelu(x):
    return np.array([[0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in row] for row in x])


def plain_norm(x, g, b):
    return np.array([(r - r.mean()) / math.sqrt(r.var() + 1e-5) * g + b for r in x])


def brute(state, edges, features, finish=True, layers=2, mixed=False, attributes=True):
    """(h, attention of the last layer): edge by edge, as the formulas say."""
    h = {k: state[f"node_emb.{k}.weight"].copy() for k in ("chemical", "disease")}
    h["gene"] = plain_gelu(plain_norm(features @ state["node_proj.gene.0.weight"].T + state["node_proj.gene.0.bias"], state["node_proj.gene.1.weight"], state["node_proj.gene.1.bias"]))
    shares = {}
    for i in range(layers):
        got = {k: [] for k in h}
        for (a, n, b), rows in edges.items():
            r = f"{a}__{n}__{b}"
            if not rows:
                continue
            total = np.zeros_like(h[b])
            ps = h[a] @ state[f"convs.{i}.lin_src.{r}.weight"].T + state[f"convs.{i}.lin_src.{r}.bias"]
            pt = h[b] @ state[f"convs.{i}.lin_dst.{r}.weight"].T + state[f"convs.{i}.lin_dst.{r}.bias"]
            logit, message = [], []
            for s, t, *more in rows:
                m = ps[s] + pt[t]
                if more and attributes:
                    if n in ("affects", "rev_affects") and mixed:
                        code = min(max(int(more[0]), 0), 3)
                        x = np.concatenate([state[f"convs.{i}.edge_cat_embs.{r}.0.weight"][code], more[1:]])
                        keys = [f"convs.{i}.edge_gate_proj.{r}.{k}" for k in (0, 2)]
                    elif n in ("affects", "rev_affects"):
                        x = np.concatenate([state[f"convs.{i}.action_type_emb.weight"][int(more[0])], state[f"convs.{i}.action_subject_emb.weight"][int(more[1])]])
                        keys = [f"convs.{i}.lin_edge_cat.{r}.0"]
                    else:
                        x, keys = np.array(more), [f"convs.{i}.lin_edge_cont.{r}.{k}" for k in (0, 2)]
                    for k, key in enumerate(keys):
                        x = (plain_gelu([x])[0] if k else x) @ state[f"{key}.weight"].T + state[f"{key}.bias"]
                    m = m / (1 + np.exp(-x))
                halves = lambda v: v.reshape(HEADS, -1)
                logit.append((halves(ps[s]) * halves(pt[t])).sum(1) / math.sqrt(WIDTH // HEADS) + (halves(m) * state[f"convs.{i}.attn_{r}"][0]).sum(1))
                message.append(halves(m))
            for t in {row[1] for row in rows}:
                own = [k for k, row in enumerate(rows) if row[1] == t]
                e = np.exp([logit[k] for k in own])
                alpha = e / e.sum(0)
                total[t] = sum(alpha[j][:, None] * message[k] for j, k in enumerate(own)).ravel()
                shares |= {(r, rows[k][0], t): alpha[j].mean() for j, k in enumerate(own)}
            got[b].append(total)
        new = {k: np.mean(v, 0) @ state[f"convs.{i}.lin_out.{k}.weight"].T + state[f"convs.{i}.lin_out.{k}.bias"] if v else h[k] for k, v in got.items()}
        h = {k: plain_gelu(plain_norm(new[k] + h[k], state[f"norms.{i}.{k}.weight"], state[f"norms.{i}.{k}.bias"])) for k in h} if finish else new
    return h, shares


@pytest.fixture(scope="module")
def graph(spark):
    features = np.random.default_rng(2).normal(0, 1, (KINDS["gene"], 3))
    edges = edges_of()
    names = {r: ["src", "dst", *ATTRIBUTES.get(r, [])] for r in RELATIONS}
    types = {r: ", ".join(f"{c} {'long' if c in ('src', 'dst') else 'double'}" for c in names[r]) for r in RELATIONS}
    rel = {r: spark.createDataFrame([(row[0], row[1], *map(float, row[2:])) for row in rows], types[r]).repartition(3) for r, rows in edges.items()}
    nodes = {k: spark.range(n) for k, n in KINDS.items()}
    return features, edges, rel, nodes, {"gene": spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(features)], "id long, z array<double>")}


def close(got: DataFrame, wanted: np.ndarray):
    rows = {r["id"]: r["z"] for r in got.collect()}
    assert sorted(rows) == list(range(len(wanted)))
    np.testing.assert_allclose([rows[k] for k in sorted(rows)], wanted, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("slice_rows", [L.SLICE_ROWS, 2])
def test_two_layers_from_a_weight_table(spark, graph, tmp_path, slice_rows):
    features, edges, rel, nodes, given = graph
    state = state_of()
    L.save_weights(L.weight_rows(spark, state), str(tmp_path / "w"))
    table = spark.read.parquet(str(tmp_path / "w"))
    model = L.model_of(L.load_state(table))
    assert model.shape() == {"width": 8, "heads": 2, "layers": 2, "features": {"gene": 3}, "codes": {"chemical__affects__gene": [4, 3], "chemical__enriched_in__gene": [], "gene__rev_affects__chemical": [4, 3]}}
    z = L.encode(model, nodes, rel, given, {k: L.node_rows(table, k) for k in ("chemical", "disease")}, ATTRIBUTES, slice_rows=slice_rows)
    wanted, _ = brute(state, edges, features)
    for k in KINDS:
        close(z[k], wanted[k])
    pairs = spark.createDataFrame([(c, d) for c in range(7) for d in range(3)] + [(99, 0)], "src long, dst long")
    got = {(r["src"], r["dst"]): (r["score"], r["probability"]) for r in L.score_links(model, L.FIRST, z, pairs).collect()}
    assert got.pop((99, 0)) == (None, None)
    for (c, d), (score, p) in got.items():
        assert score == pytest.approx(wanted["chemical"][c] @ state["W_cd"] @ wanted["disease"][d])
        assert p == pytest.approx(1 / (1 + math.exp(-score)))
    with pytest.raises(KeyError, match="gene__x__gene"):
        L.score_links(model, ("gene", "x", "gene"), z, pairs)


def test_conv_alone_attention_and_mixed_gates(spark, graph):
    features, edges, rel, nodes, given = graph
    state = state_of(11, 1, mixed=True)
    model = L.model_of({"encoder." + k: v for k, v in state.items() if "node_emb" not in k})
    table = L.weight_rows(spark, state)
    h = {k: L.initial(k, model, given.get(k), L.node_rows(table, k), df) for k, df in nodes.items()}
    odd = dict(edges) | {r: [(a, b, t + 2, s) for a, b, t, s in edges[r]] for r in (AFFECTS, BACK)}  # codes beyond the table are clamped
    more = {r: rel[r].withColumn("t", rel[r]["t"] + 2) if r in (AFFECTS, BACK) else df for r, df in rel.items()}
    wanted, shares = brute(state, odd, features, finish=False, layers=1, mixed=True)
    for k, df in L.attention_conv(h, more, model.layers[0], HEADS, ATTRIBUTES).items():
        close(df, wanted[k])
    for slice_rows in (2, L.SLICE_ROWS):
        got = L.edge_attention(h, AFFECTS, more[AFFECTS], model.layers[0], HEADS, ATTRIBUTES[AFFECTS], slice_rows).collect()
        assert {(r["src"], r["dst"]): pytest.approx(r["alpha"]) for r in got} == {(s, t): a for (r, s, t), a in shares.items() if r == "__".join(AFFECTS)}


def test_without_attributes_there_are_no_gates(spark, graph):
    features, edges, rel, nodes, given = graph
    state = state_of(3, 1)
    model, table = L.model_of({k: v for k, v in state.items() if "node_emb" not in k}), L.weight_rows(spark, state)
    z = L.encode(model, nodes, rel, given, {k: L.node_rows(table, k) for k in ("chemical", "disease")})
    close(z["gene"], brute(state, edges, features, layers=1, attributes=False)[0]["gene"])


def test_partials_merge_in_any_order():
    rng = np.random.default_rng(0)
    logits, message = rng.normal(0, 300, (50, HEADS)), rng.normal(0, 1, (50, HEADS, 4))
    e = np.exp(logits - logits.max(0))
    wanted = (message * (e / e.sum(0))[:, :, None]).sum(0)
    for cuts in ([0, 50], [0, 1, 17, 50], list(range(51))):
        parts = [L.merged(np.zeros(b - a), logits[a:b], np.ones((b - a, HEADS)), message[a:b])[1:] for a, b in zip(cuts, cuts[1:], strict=False)][::-1]
        _, _, total, vector = L.merged(np.zeros(len(parts)), *(np.concatenate(x) for x in zip(*parts, strict=True)))
        np.testing.assert_allclose(vector[0] / total[0][:, None], wanted, rtol=1e-10, atol=1e-300)


def test_errors_name_what_does_not_fit(spark, graph):
    state = {k: v for k, v in state_of(layers=1).items() if "node_emb" not in k}
    model = L.model_of(state)
    kinds, relations = set(KINDS), set(RELATIONS)
    L.check_graph(model, kinds, relations)
    with pytest.raises(ValueError, match="core graph.*pathway"):
        L.check_graph(model, kinds | {"pathway"}, relations)
    with pytest.raises(ValueError, match="gene__x__gene"):
        L.check_graph(model, kinds, relations | {("gene", "x", "gene")})
    with pytest.raises(ValueError, match="nodes of .*'other'"):
        L.check_graph(model, kinds | {"other"}, relations)
    extended = state | {f"norms.0.pathway.{e}": np.ones(WIDTH) for e in ("weight", "bias")} | {"convs.0.lin_out.pathway.weight": np.ones((WIDTH, WIDTH)), "convs.0.lin_out.pathway.bias": np.ones(WIDTH)}
    with pytest.raises(ValueError, match="lacks.*pathway"):
        L.check_graph(L.model_of(extended), kinds, relations)
    with pytest.raises(ValueError, match="lin_src.*shape"):
        L.model_of(state | {"convs.0.lin_src.chemical__affects__gene.weight": np.ones((WIDTH, 3))})
    with pytest.raises(ValueError, match="attention"):
        L.model_of({"W_cd": np.ones((2, 2))})
    with pytest.raises(ValueError, match="takes 2 attributes"):
        model.layers[0].relations["chemical__affects__gene"].gate.of(np.ones((1, 3)))
    with pytest.raises(ValueError, match="code"):
        model.layers[0].relations["chemical__affects__gene"].gate.of(np.array([[4.0, 0.0]]))
    with pytest.raises(ValueError, match="more than"):
        L.load_state(L.weight_rows(spark, state), limit=8)
    with pytest.raises(ValueError, match="lacks rows"):
        L.load_state(L.weight_rows(spark, {"a": np.ones((3, 2))}).where("row <> 1"))
    with pytest.raises(ValueError, match="features"):
        L.initial("gene", model, None, None, graph[3]["gene"])
