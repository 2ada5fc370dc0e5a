"""A graph from processed tables in one call: which tables are nodes, which are relations, and what their edges carry."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.functions import expressions as X
from kilngraph.operators import tables as T
from kilngraph.operators.graph import KnowledgeGraph, Relation
from kilngraph.operators.ids import assert_ids, encode, vocabulary


@dataclass(frozen=True)
class Edges:
    """A relation's table, the columns of its ends, and its attributes (all or none are there; coded: by a vocabulary each)."""

    table: str
    src: str
    dst: str
    attributes: tuple[str, ...] = ()
    coded: bool = False


# The tables, columns and relations of the surveyed data model.
NODES = {"chemical": ("chemicals", "CHEM_ID"), "disease": ("diseases", "DS_ID"), "gene": ("genes", "GENE_ID"), "pathway": ("pathways", "PATHWAY_ID"), "go_term": ("go_terms", "GO_TERM_ID")}
RELATIONS: dict[Relation, Edges] = {
    ("chemical", "associated_with", "disease"): Edges("chem_disease", "CHEM_ID", "DS_ID"),
    ("chemical", "affects", "gene"): Edges("chem_gene", "CHEM_ID", "GENE_ID", ("ACTION_TYPE", "ACTION_SUBJECT"), coded=True),
    ("disease", "targets", "gene"): Edges("disease_gene", "DS_ID", "GENE_ID", ("DIRECT_EVIDENCE_TYPE", "LOG_PUBMED_COUNT")),
    ("gene", "interacts_with", "gene"): Edges("ppi", "GENE_ID_1", "GENE_ID_2"),
    ("gene", "participates_in", "pathway"): Edges("gene_pathway", "GENE_ID", "PATHWAY_ID"),
    ("disease", "disrupts", "pathway"): Edges("disease_pathway", "DS_ID", "PATHWAY_ID", ("INFERENCE_GENE_COUNT",)),
    ("chemical", "enriched_in", "pathway"): Edges("chem_pathway", "CHEM_ID", "PATHWAY_ID", ("NEG_LOG_PVALUE", "TARGET_RATIO", "FOLD_ENRICHMENT")),
    ("chemical", "enriched_in", "go_term"): Edges("chem_go", "CHEM_ID", "GO_TERM_ID", ("NEG_LOG_PVALUE", "TARGET_RATIO", "FOLD_ENRICHMENT", "ONTOLOGY_TYPE", "GO_LEVEL_NORM")),
    ("chemical", "affects_phenotype", "go_term"): Edges("chem_pheno", "CHEM_ID", "GO_TERM_ID", ("PHENO_ACTION_TYPE",)),
    ("go_term", "associated_with", "disease"): Edges("go_disease", "GO_TERM_ID", "DS_ID", ("ONTOLOGY_TYPE", "LOG_INFERENCE_CHEM", "LOG_INFERENCE_GENE")),
}
CORE = frozenset({"chemical", "disease", "gene"})
INTERACTS = ("gene", "interacts_with", "gene")
#: Attributes that are stored as they are not; what is missing counts one.
LOGGED = {"INFERENCE_GENE_COUNT": 1}


def attribute(name: str) -> Column:
    return F.log1p(F.coalesce(F.col(name), F.lit(LOGGED[name])).cast("double")) if name in LOGGED else F.col(name)


def build_graph(tables: Mapping[str, DataFrame], extended: bool = True, reverse: bool = True) -> tuple[KnowledgeGraph, dict[str, DataFrame]]:
    """(graph, vocabularies of coded attributes) from processed tables by name.

    Core tables must be there (ValueError that lists those missing), others may be absent or empty, and then their relations
    are; extended=False leaves them out.  Node ids must be 0 to n - 1.  ppi_directed, which has both directions, stands for ppi
    and gets no reverse.  A node table with an ontology gets its code as ontology_type."""
    there = {k: df for k, df in tables.items() if extended or k in {"chemicals", "diseases", "genes", "chem_disease", "chem_gene", "disease_gene", "ppi", "ppi_directed"}}
    core = [NODES[k][0] for k in sorted(CORE)] + [e.table for r, e in RELATIONS.items() if {r[0], r[2]} <= CORE and not (r == INTERACTS and "ppi_directed" in there)]
    if missing := sorted(set(core) - set(there)):
        raise ValueError(f"tables are missing: {', '.join(missing)}")
    for name in [k for k in there if k not in core]:
        if not there[name].take(1):
            del there[name]
    nodes = {}
    for kind, (table, id_) in NODES.items():
        if table in there:
            assert_ids(there[table], id_)
            nodes[kind] = there[table].withColumnRenamed(id_, "id")
            if "GO_ONTOLOGY" in there[table].columns:
                nodes[kind] = nodes[kind].withColumn("ontology_type", X.code(F.col("GO_ONTOLOGY"), T.ONTOLOGIES, T.OTHER_ONTOLOGY))
    relations, vocabularies = {}, {}
    directed = "ppi_directed" in there
    for relation, e in RELATIONS.items():
        table = "ppi_directed" if relation == INTERACTS and directed else e.table
        if table not in there or not {relation[0], relation[2]} <= set(nodes):
            continue
        df, own = there[table], [a for a in e.attributes if set(e.attributes) <= set(there[table].columns)]
        for a in own if e.coded else ():
            vocabularies[a.lower()] = vocabulary(df, a)
            df = encode(df, a, vocabularies[a.lower()], f"{a}_ID")
        relations[relation] = df.select(F.col(e.src).cast("long").alias("src"), F.col(e.dst).cast("long").alias("dst"), *[F.col(f"{a}_ID") if e.coded else attribute(a).alias(a) for a in own])
    graph = KnowledgeGraph(nodes, relations)
    return (graph.with_reverses(frozenset({INTERACTS} if directed else ())) if reverse else graph), vocabularies
