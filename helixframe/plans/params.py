"""Parameters of seeds, support, consensus and correction."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    """k, w: k-mer and window length in bases; xmin, xmax: span bounds; ratio: least depth share of a variant.

    exact: reads don't reuse regions that were corrected with another read; forced for clusters of at most
    exact_limit reads. batch_size reads of a cluster are corrected together; consensus_limit bounds the segments of a
    consensus (one more is admitted). dynamic_window sets w from the size of the batch. aligner: unit aligns segments by edit
    distance, affine globally with affine gaps.
    """

    k: int = 9
    w: int = 20
    xmin: int = 18
    xmax: int = 80
    ratio: float = 0.1
    exact: bool = False
    exact_limit: int = 0
    batch_size: int = 2000
    consensus_limit: int = 200
    dynamic_window: bool = False
    guard_run: int = 10
    aligner: str = "unit"

    def __post_init__(self) -> None:
        if not 1 <= self.k <= self.w <= 100:
            raise ValueError("1 <= k <= w <= 100 is needed")
        if self.batch_size < 1 or self.consensus_limit < 0 or not 0 <= self.ratio <= 1:
            raise ValueError("batch_size, consensus_limit or ratio out of range")
        if self.aligner not in ("unit", "affine"):
            raise ValueError("aligner must be unit or affine")

    @property
    def low(self) -> int:
        """The least span, exclusive: never below two k-mers."""
        return max(self.xmin, 2 * self.k)

    def for_batch(self, reads: int) -> Params:
        """With the window that a batch of so many reads gets."""
        if not self.dynamic_window:
            return self
        w = min(self.w, self.k + reads // 100 + 4) if reads >= 100 else self.k + 1 + reads // 30
        return replace(self, w=max(self.k, w))
