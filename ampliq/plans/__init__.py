"""Whole jobs put together from the operators."""
from .binding_alignment import binding_alignment
from .pair_qc import PairQc, pair_qc
from .region_design import design_amplicons, region_design
from .score_rank import score_rank_job, score_rank_pieces

__all__ = ["PairQc", "binding_alignment", "design_amplicons", "pair_qc", "region_design", "score_rank_job", "score_rank_pieces"]
