"""Settings of the ranking, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Extensions of video files that are looked for by default.
EXTENSIONS = ("avi", "flv", "mov", "f4v", "m2ts", "m4v", "mkv", "mpg", "webm", "wmv", "mp4")


@dataclass(frozen=True)
class FeatureSettings:
    """Buckets of media values and how their tokens are combined."""

    bucket_base: float = 1.5
    fps_base: float = 1.1
    smoothing: int = 1
    combinations: int = 2

    def __post_init__(self):
        if self.bucket_base <= 1 or self.fps_base <= 1:
            raise ValueError("bucket bases must be above 1")
        if self.smoothing < 0 or self.combinations < 0:
            raise ValueError("smoothing and combinations can't be negative")


@dataclass(frozen=True)
class RankSettings:
    """Bias settings are logarithm bases: absent leaves a scorer out, a negative one reverses it."""

    windows: int = 5
    combinations: int = 2
    file_size_bias: float | None = None
    dir_size_bias: float | None = None
    file_age_bias: float | None = None
    file_size_offset: int = 1 << 20
    dir_size_offset: int = 0
    file_age_offset: int = 86_400
    cache_ttl_days: int = 30
    selection_p: float | None = None
    include_classified: bool = False
    extensions: tuple[str, ...] = EXTENSIONS
    exclude: tuple[str, ...] = ()
    features: FeatureSettings = field(default_factory=FeatureSettings)

    def __post_init__(self):
        for bias in (self.file_size_bias, self.dir_size_bias, self.file_age_bias):
            if bias is not None and abs(bias) <= 1:
                raise ValueError("a bias must be above 1 or below -1")
        if self.selection_p is not None and not 0 <= self.selection_p <= 1:
            raise ValueError("selection_p must lie between 0 and 1")
