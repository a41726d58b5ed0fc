"""The edge filter shared by every graph query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EdgeFilter:
    """Threshold on the synapse count, optional label substring, optional region.

    Label and region compare without case. A null synapse count never passes.
    """

    threshold: int = 0
    neurotransmitter: str | None = None
    neuropil: str | None = None

    def __post_init__(self) -> None:
        if self.threshold < 0:
            raise ValueError("threshold must be >= 0")

    @classmethod
    def resolve(
        cls,
        threshold: int = 0,
        neurotransmitter: str | None = None,
        neurotransmitter_choice: str | None = None,
        neuropil: str | None = None,
        neuropil_choice: str | None = None,
    ) -> EdgeFilter:
        """Free text wins over a choice from a list; an empty text counts as none."""
        return cls(
            threshold,
            neurotransmitter or neurotransmitter_choice or None,
            neuropil or neuropil_choice or None,
        )

    @property
    def condition(self) -> Column:
        passes = F.col("syn_count") >= self.threshold
        if self.neuropil:
            passes &= F.lower(F.coalesce("neuropil", F.lit(""))) == F.lower(F.lit(self.neuropil))
        if self.neurotransmitter:
            label = F.lower(F.coalesce("dominant_nt", F.lit("")))
            passes &= F.contains(label, F.lower(F.lit(self.neurotransmitter)))
        return passes


ALL_EDGES = EdgeFilter()
