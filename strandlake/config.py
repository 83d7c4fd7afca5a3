"""Parameters of the operators, with the defaults that users of the command line tools know."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MapParams:
    """Seeding and banded overlap. Lengths of bins are in characters, gaps and spans in bins."""

    bin_size: int = 256
    ksize: int = 0
    psize: int = 21
    kmin: int = 2
    kmax: int = 1000
    ktop: float = 0.05
    ksample: int = 4
    min_bin_degree: int = 2
    max_bgap: int = 4
    max_bvar: int = 4
    pgap: int = -7
    pvar: int = -21
    min_aln: int = 8
    min_mat: int = 200
    min_sim: float = 0.05
    max_gap: float = 0.6
    aln_var: float = 0.25
    max_hit: int = 1000
    best_n: int = 500
    #: Parts of the index that are mapped one after the other; 0: reads by blocks, queries by as many parts as keep each below PART_HITS.
    parts: int = 0

    @property
    def seed(self) -> int:
        """Letters of a seed."""
        return self.ksize + self.psize


@dataclass(frozen=True)
class GraphParams:
    """Nodes, edges and clean-up. Lengths are in bins."""

    reg_len: int = 4
    reg_ovl: int = 1
    min_node_mats: int = 1
    node_drop: float = 0.25
    min_node_cov: int = 3
    max_node_cov: int = 200
    max_overhang: int = 1
    min_edge_cov: int = 3
    max_edge_span: int = 1024
    tip_step: int = 10
    bub_step: int = 40
    yarn_step: int = 200
    ctg_min_nodes: int = 3
    ctg_min_length: int = 20


#: The presets change these map parameters.
PRESETS = {
    "rs": {"ksize": 0, "psize": 21, "ksample": 4, "min_sim": 0.05},
    "sq": {"ksize": 15, "psize": 0, "ksample": 4, "min_sim": 0.05},
    "ont": {"ksize": 15, "psize": 0, "ksample": 2, "min_sim": 0.05},
    "ccs": {"ksize": 21, "psize": 0, "ksample": 4, "min_sim": 0.5},
}


def preset(name: str, base: MapParams | None = None) -> MapParams:
    return replace(base or MapParams(), **PRESETS[name])


def min_edge_cov(bases: int, genome: int) -> int:
    """Edge coverage for the depth of the reads: 2 up to 40, 4 from 80, else 3; 3 if the genome's size isn't known."""
    if genome <= 0:
        return 3
    depth = bases / genome
    return 2 if depth <= 40 else 4 if depth >= 80 else 3


#: Fixture-sized parameters for texts of some hundred letters.
SMALL = MapParams(bin_size=64, ksize=15, psize=0, kmax=100, ksample=4, min_aln=2, min_mat=30)
SMALL_GRAPH = GraphParams(reg_len=4, min_node_cov=2, min_edge_cov=2, max_edge_span=64, ctg_min_length=2)
