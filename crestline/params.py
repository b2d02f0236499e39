"""Parameters of a detection run, checked before anything is planned."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectParams:
    """What a run needs besides its data.

    k: how many peaks of a series at most. duration: a clip's length in seconds.
    floor: the level below which nothing counts and which fills gaps.
    bucket_seconds: the width of a bucket. min_buckets: how many buckets a series
    must have observed. half_window: rows on either side in the moving average.
    edge_cap: the margin at either end, at most; a tenth of the series if less.
    min_score: the least score of a peak. gap: seconds kept free besides the clip's
    length. lead: the share of a clip that comes before its peak. decimals: the
    fixed decimals of the levels, for sums without rounding errors; None: any.
    """

    k: int = 6
    duration: int = 45
    floor: float = -70.0
    bucket_seconds: float = 1
    min_buckets: int = 30
    half_window: int = 3
    edge_cap: int = 30
    min_score: float = 1.5
    gap: int = 30
    lead: float = 0.4
    decimals: int | None = None

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k must be at least 1")
        if not 15 <= self.duration <= 120:
            raise ValueError("duration must be from 15 to 120")
        if self.bucket_seconds <= 0 or self.half_window < 0 or self.edge_cap < 0 or self.gap < 0:
            raise ValueError("bucket_seconds must be positive, and half_window, edge_cap and gap not negative")
        if not 0 <= self.lead <= 1:
            raise ValueError("lead must be from 0 to 1")

    @property
    def separation(self) -> int:
        return self.duration + self.gap

    @property
    def most_candidates(self) -> int:
        """How many of a series' best candidates decide its peaks: each but the last peak can suppress those within the separation."""
        return 2 * self.separation * (self.k - 1) + 1


@dataclass(frozen=True)
class RunRequest:
    """A run's input and output, checked at once: a path or address, a folder, and a logo if there is one.

    White space and double quotes around them are left out.
    """

    entry: str
    output: str
    k: int | str = 6
    duration: int | str = 45
    logo: str = ""

    def __post_init__(self):
        for name in ("entry", "output"):
            object.__setattr__(self, name, (getattr(self, name) or "").strip().strip('"'))
        if not self.entry:
            raise ValueError("entry must name a recording")
        if not self.output:
            raise ValueError("output must name a folder")
        try:
            for name in ("k", "duration"):
                object.__setattr__(self, name, int(getattr(self, name)))
        except (TypeError, ValueError):
            raise ValueError("k and duration must be whole numbers") from None
        self.params()

    def params(self, **more) -> DetectParams:
        return DetectParams(k=self.k, duration=self.duration, **more)
