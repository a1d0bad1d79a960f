"""Parameters of the linking pipeline, in one frozen value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults reproduce the published settings of the method."""

    window: int = 50  # context tokens on each side of a mention
    sif_a: float = 0.001  # smoothing of the inverse-frequency weight
    alpha: float = 0.4  # share of the prior in the initial score
    beta: float = 0.6  # share of the context similarity
    damping: float = 0.4  # share of the initial score in each propagation round
    tolerance: float = 0.001  # L2 change at which propagation stops
    keep_top: int = 120  # candidates kept by context similarity
    many_candidates: int = 50  # above this the rare candidates are dropped
    rare_count: int = 4  # a candidate this rare is dropped then
    max_token: int = 128  # longest token and surface form
    dim: int = 0  # length of usable vectors; 0: the most common length of the word vectors given
    rounds: int = 10_000  # propagation rounds after which a document counts as not converging
