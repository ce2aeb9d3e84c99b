"""All registered queries of the library's own operators."""

from __future__ import annotations

from repseq.plans import cluster, diversity, fixed, lineage, sequence, topology, usage

REGISTRIES = [usage.REGISTRY, sequence.REGISTRY, diversity.REGISTRY, cluster.REGISTRY, topology.REGISTRY, lineage.REGISTRY, fixed.REGISTRY]


def queries() -> dict:
    return {name: q for r in REGISTRIES for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for r in REGISTRIES for name, s in r.sql.items()}
