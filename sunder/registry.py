"""The operators by id: family, strictness, whether they form groups, what they take, and one way to run them.

``split`` runs any operator that splits one table, whatever it works on, and holds
its result to the contract.  ``splitter`` gives the same as a function of a table, as
the protocols take them.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sunder import contract
from sunder.errors import ConfigurationError, ParameterError, UnknownOperatorError
from sunder.functions.sizes import resolve_sizes
from sunder.operators import baseline, embedding, lineage, pairs, property as prop, protocol, similarity as sim, structure, task
from sunder.plans import groups
from sunder.plans.distance import scaled_vectors, token_links, vector_edges


@dataclass(frozen=True)
class Operator:
    id: str
    family: str
    strictness: str
    run: Callable
    groups: bool = False
    seeded: bool = True
    #: frame (a table, its id and columns), key, keys, vectors, clusters (of vectors), near (clusters by pairs of vectors),
    #: tokens, pair (two keys), or "" for what is composed in Python.
    takes: str = ""


def _table() -> dict[str, Operator]:
    g = groups.assign_groups
    rows = [
        # baseline
        ("random", "baseline", "optimistic", baseline.random_split), ("stratified_random", "baseline", "optimistic", baseline.stratified_random),
        ("k_fold", "baseline", "optimistic", baseline.k_fold), ("monte_carlo", "baseline", "optimistic", baseline.monte_carlo),
        ("predefined", "baseline", "moderate", baseline.predefined),
        # keys: the key is a column expression of the caller
        ("murcko_scaffold", "scaffold", "moderate", structure.scaffold_split), ("generic_scaffold", "scaffold", "strict", g), ("scaffold_tree", "scaffold", "strict", g),
        ("ring_system", "scaffold", "moderate", sim.component_split), ("substructure", "scaffold", "extrapolative", structure.substructure),
        ("matched_molecular_series", "scaffold", "strict", sim.component_split), ("activity_cliff", "scaffold", "extrapolative", structure.activity_cliff),
        # property
        ("property", "property", "strict", prop.property_split), ("label_extrapolation", "property", "extrapolative", prop.label_extrapolation),
        ("distinct_label", "property", "optimistic", prop.distinct_label), ("stratified_distribution", "property", "optimistic", prop.stratified_distribution),
        ("mood", "property", "strict", embedding.mood), ("adversarial", "property", "strict", embedding.adversarial),
        # lineage
        ("temporal", "lineage", "strict", lineage.temporal), ("simpd", "lineage", "strict", task.time_like), ("source", "lineage", "strict", lineage.source_split),
        ("fidelity", "lineage", "extrapolative", lineage.fidelity_split), ("party", "lineage", "extrapolative", lineage.party_split),
        # similarity
        ("similarity_threshold", "similarity", "strict", sim.component_split), ("butina", "similarity", "strict", sim.butina_keys),
        ("sphere_exclusion", "similarity", "strict", sim.sphere_keys), ("k_means_cluster", "similarity", "strict", embedding.k_means_keys),
        ("density_cluster", "similarity", "strict", sim.density_keys), ("spectral", "similarity", "extrapolative", embedding.spectral_keys),
        ("max_min", "similarity", "moderate", sim.max_min), ("spxy", "similarity", "moderate", sim.spxy), ("opti_sim", "similarity", "strict", embedding.opti_sim),
        ("minimal_test_set_dissimilarity", "similarity", "optimistic", sim.minimal_test_dissimilarity), ("support_points", "similarity", "optimistic", embedding.support_points),
        ("duplex", "similarity", "moderate", sim.duplex), ("d_optimal", "similarity", "moderate", embedding.d_optimal),
        ("max_dissimilarity", "similarity", "extrapolative", sim.max_dissimilarity), ("perimeter", "similarity", "extrapolative", sim.perimeter_outliers),
        ("leave_one_cluster_out", "similarity", "extrapolative", sim.leave_one_cluster_out), ("balanced_multi_task", "similarity", "strict", task.balanced_multi_task),
        # task
        ("hi", "task", "extrapolative", task.hi), ("lo", "task", "strict", task.lo), ("scaffold_hop", "task", "extrapolative", task.scaffold_hop),
        ("cold_drug", "task", "strict", pairs.cold_entity), ("cold_target", "task", "extrapolative", pairs.cold_entity), ("cold_pair", "task", "extrapolative", pairs.assign_pairs),
        ("ave", "task", "strict", task.ave_split), ("decoy_benchmark", "task", "strict", task.decoy_cells),
        # embedding
        ("umap_cluster", "embedding", "extrapolative", embedding.umap_keys), ("projection", "embedding", "strict", embedding.projection),
        ("self_organizing_map", "embedding", "strict", embedding.som_keys), ("latent_space", "embedding", "strict", embedding.latent_space),
        # sequences and complexes
        ("sequence_identity", "biomolecular", "strict", sim.component_split), ("protein_family", "biomolecular", "strict", g),
        ("binding_site", "biomolecular", "strict", sim.butina_keys), ("deposition_date", "biomolecular", "strict", lineage.deposition_date),
        ("complex_joint", "biomolecular", "extrapolative", pairs.assign_pairs),
        # protocol
        ("group_k_fold", "protocol", "moderate", protocol.group_k_fold), ("three_way", "protocol", "moderate", protocol.three_way),
        ("repeated", "protocol", "moderate", protocol.repeated), ("nested_cv", "protocol", "moderate", protocol.nested_cv),
        ("external_holdout", "protocol", "moderate", protocol.external_holdout), ("applicability_domain", "protocol", "moderate", protocol.applicability_domain),
        ("intersection", "protocol", "strict", protocol.intersection),
    ]
    forming = {g, structure.scaffold_split, sim.component_split, sim.butina_keys, sim.sphere_keys, sim.density_keys, embedding.k_means_keys, embedding.spectral_keys, embedding.opti_sim, embedding.som_keys, embedding.umap_keys, lineage.source_split, task.hi, pairs.cold_entity}
    takes = {
        "frame": "random stratified_random k_fold monte_carlo predefined property label_extrapolation distinct_label stratified_distribution temporal source fidelity party cold_drug cold_target group_k_fold murcko_scaffold deposition_date",
        "key": "generic_scaffold scaffold_tree protein_family", "keys": "ring_system matched_molecular_series",
        "vectors": "max_min minimal_test_set_dissimilarity support_points duplex d_optimal max_dissimilarity perimeter projection latent_space",
        "clusters": "k_means_cluster opti_sim spectral self_organizing_map umap_cluster", "near": "butina sphere_exclusion density_cluster binding_site",
        "tokens": "similarity_threshold", "pair": "cold_pair complex_joint",
    }
    of = {name: kind for kind, names in takes.items() for name in names.split()}
    return {i: Operator(i, family, strict, run, run in forming, takes=of.get(i, "")) for i, family, strict, run in rows}


OPERATORS = _table()


def get(name: str) -> Operator:
    """An operator by id, in any case and with or without underscores."""
    plain = lambda s: s.lower().replace("_", "").removesuffix("splitter")
    found = {plain(k): v for k, v in OPERATORS.items()}.get(plain(name))
    if found is None:
        near = difflib.get_close_matches(name.lower(), OPERATORS, n=3, cutoff=0.0)
        raise UnknownOperatorError(f"no operator {name!r}; nearest: {', '.join(near)}")
    return found


def _columns(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns or [])


SIZES = ("train", "valid", "test")
SEVERAL = ("fold", "repeat", "window", "held_out", "band")


def split(name: str, df: DataFrame, id_col: str, columns=(), cutoff: float | None = None, share: tuple[int, int] = (8, 10), scale: int = 1024, check: bool = True, **params) -> DataFrame:
    """``id, partition`` (and ``group``, or the column that numbers several splits) of a table by any operator that takes one.

    ``columns``: what the operator reads beside the id: labels, dates, keys (as expressions), an array of keys, tokens or
    components.  ``cutoff``: squared distance of near vectors, in units of 1 / ``scale``; ``share``: least Jaccard similarity of tokens.
    """
    op, columns = get(name), _columns(columns)
    if not op.takes:
        raise ParameterError(f"{op.id} works on more than one table: call it from Python")
    if op.takes not in ("frame", "pair") and len(columns) != 1:
        raise ConfigurationError(f"{op.id} reads one column")
    sizes = {k: params[k] for k in SIZES if k in params}
    ids = df.select(F.col(id_col).alias("id"))
    grouped = lambda keys: groups.assign_groups(keys, "id", F.col("key"), check=False, **sizes)
    own = {k: v for k, v in params.items() if k not in SIZES}
    if op.takes == "frame":
        out = op.run(df, id_col, *columns, **params)
    elif op.takes == "key":
        out = op.run(df, id_col, F.expr(columns[0]), **params)
    elif op.takes == "keys":
        out = sim.component_split(ids, sim.shared_key_edges(df, id_col, columns[0]), **params)
    elif op.takes == "pair":
        if len(columns) != 2:
            raise ConfigurationError(f"{op.id} reads two columns")
        out = op.run(df, id_col, F.expr(columns[0]), F.expr(columns[1]), **params)
    elif op.takes == "tokens":
        out = sim.component_split(ids, token_links(df, id_col, columns[0], *share), **params)
    else:
        vectors = scaled_vectors(df, id_col, columns[0], scale)
        if op.takes == "vectors":
            out = op.run(vectors, **params)
            out = out if "partition" in out.columns else grouped(out)
        elif op.takes == "clusters":
            out = grouped(op.run(vectors, **own))
        else:
            if cutoff is None:
                raise ConfigurationError(f"{op.id} takes a cutoff")
            out = grouped(op.run(vectors, vector_edges(vectors, cutoff), **own))
    if check and "partition" in out.columns and not set(SEVERAL) & set(out.columns):
        n = df.count()
        wanted = resolve_sizes(n, **sizes)
        contract.assert_split(out, n, 0.05, {k: getattr(wanted, k) for k in SIZES})
    return out


def splitter(name: str, id_col: str, columns=(), **params) -> Callable[[DataFrame], DataFrame]:
    """An operator as a function of a table; with a second argument, that is its seed."""

    def run(df: DataFrame, seed: int | None = None) -> DataFrame:
        return split(name, df, id_col, columns, check=False, **(params if seed is None else params | {"seed": seed}))

    return run


def table(spark, family: str | None = None, strictness: str | None = None):
    """The operators as a DataFrame."""
    rows = [(o.id, o.family, o.strictness, o.groups, o.seeded, o.takes or "tables", (o.run.__doc__ or "").strip().split("\n")[0]) for o in OPERATORS.values() if family in (None, o.family) and strictness in (None, o.strictness)]
    return spark.createDataFrame(rows, "id string, family string, strictness string, forms_groups boolean, seeded boolean, takes string, gives string")
