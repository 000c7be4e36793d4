"""Media values: buckets, ratios, feature tokens and readable numbers, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastemill.config import FeatureSettings


def bucket(value: Column, base: float) -> Column:
    """floor(ln v / ln base), null for what is below 1 or not finite; NaN is above all numbers."""
    return F.when((value >= 1) & (value < float("inf")), F.floor(F.ln(value) / F.lit(math.log(base))).cast("long"))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, of which numbers up to n need 4.785 log10 n + 1.7 at most."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    most = F.ceil(F.log10(F.greatest(F.least(a, b), F.lit(1))) * 4.785 + 1.7).cast("int") + 1
    return F.aggregate(
        F.sequence(F.lit(1), most),
        start,
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))),
        lambda s: s["a"],
    )


def aspect_ratio(w: Column, h: Column) -> Column:
    """w:h in lowest terms, null where either is 0."""
    part = lambda x, g: F.floor(x / g).cast("long").cast("string")
    ratio = once(gcd(w, h), lambda g: F.concat_ws(":", part(w, g), part(h, g)))
    return F.when((w > 0) & (h > 0), ratio)


def neighbours(name: str, index: Column, width: int) -> Column:
    """name:k for the buckets up to ``width`` away, none below 0; an empty array for a null bucket."""
    spread = F.transform(F.sequence(F.greatest(index - width, F.lit(0)), index + width), lambda k: F.concat(F.lit(name + ":"), k.cast("string")))
    return F.when(index.isNotNull(), spread).otherwise(F.array().cast("array<string>"))


def has_probe_data(vc: Column, w: Column, h: Column, d: Column, fps: Column) -> Column:
    return (F.coalesce(vc, F.lit("")) != "") | (d > 0) | ((w > 0) & (h > 0)) | fps.isNotNull()


def feature_tokens(w: Column, h: Column, s: Column, vc: Column, ac: Column, d: Column, fps: Column, settings: FeatureSettings = FeatureSettings()) -> Column:
    """All tokens of a file's media features, in their fixed order."""
    # Only the ratio needs a lambda, which is interpreted; the rest compiles, and shared parts are evaluated once.
    def near(name: str, value: Column, base: float) -> list[Column]:
        index, around = bucket(value, base), range(-settings.smoothing, settings.smoothing + 1)
        named = lambda k: F.concat(F.lit(name + ":"), (index + k).cast("string"))
        return [F.when(index + k >= 0, named(k)) if k < 0 else named(k) for k in around]

    sized = (w > 0) & (h > 0)
    probed = has_probe_data(vc, w, h, d, fps)
    positive = lambda v: F.when(v > 0, v.cast("double"))
    rate = F.when((d > 0) & (d < float("inf")), s * F.lit(8.0) / d)
    tokens = F.array(
        F.when(vc != "", F.concat(F.lit("video_codec:"), vc)),
        F.when(ac != "", F.concat(F.lit("audio_codec:"), ac)).when(probed, F.lit("audio_codec:none")),
        F.concat(F.lit("aspect:"), aspect_ratio(w, h)),
        F.when(sized, F.concat(F.lit("resolution:"), w.cast("long").cast("string"), F.lit("x"), h.cast("long").cast("string"))),
        *near("fps", fps, settings.fps_base),
        *near("duration", positive(d), settings.bucket_base),
        *near("filesize", positive(s), settings.bucket_base),
        *near("bitrate", positive(rate), settings.bucket_base),
    )
    # No token occurs twice, so this drops nulls only; unlike array_compact it compiles.
    return F.array_except(tokens, F.array(F.lit(None).cast("string")))


def round2(x: Column) -> Column:
    """Two decimals, halves away from zero, decided on the double."""
    return F.round(x * 100) / 100


def frame_rate(text: Column) -> Column:
    """n/d as a number; null without a slash, for parts that are no numbers, and for d = 0."""
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    at = F.locate("/", text)
    n, d = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
    value = n.try_cast("double") / F.nullif(d.try_cast("double"), F.lit(0.0))
    return F.when((at > 0) & n.rlike(number) & d.rlike(number), value)


def log_score(value: Column, offset: int, base: float) -> Column:
    """ln(max(v + offset, 1)) / ln|base|, negated for a negative base; 0 where that is not finite."""
    score = F.ln(F.greatest(value.cast("double") + F.lit(float(offset)), F.lit(1.0))) / F.lit(math.log(abs(base)))
    score = score if base > 0 else -score
    return F.when(F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)


def entry_key(path: Column, mtime_s: Column, size: Column) -> Column:
    """SHA-256 of path:seconds:size in lower-case hex; times before 1970 count as 0."""
    return F.sha2(F.concat_ws(":", path, F.greatest(mtime_s, F.lit(0)).cast("string"), size.cast("string")), 256)


def human_size(size: Column) -> Column:
    """Three significant figures in units of 1024; a value that rounds to 1024 takes the next unit."""
    shown = None
    for power, unit in reversed(list(enumerate("KMGTP", 1))):
        x = size / F.lit(1024.0**power)
        text = F.when(F.round(x, 2) < 10, F.format_string("%.2f", x)).when(F.round(x, 1) < 100, F.format_string("%.1f", x)).otherwise(F.format_string("%.0f", x))
        text = F.concat(text, F.lit(unit))
        least = 1024.0**power if power == 1 else 1023.5 * 1024.0 ** (power - 1)
        shown = F.when(size >= least, text) if shown is None else shown.when(size >= least, text)
    return shown.otherwise(F.concat(size.cast("long").cast("string"), F.lit("B")))


def format_secs(secs: Column) -> Column:
    """XhYmZs, YmZs or Zs of the rounded seconds; "-" for what is not above 0."""
    t = F.round(secs).cast("long")
    h, m, s = F.floor(t / 3600).cast("string"), F.floor((t % 3600) / 60).cast("string"), (t % 60).cast("string")
    text = F.when(t >= 3600, F.concat(h, F.lit("h"), m, F.lit("m"), s, F.lit("s"))).when(t >= 60, F.concat(m, F.lit("m"), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))
    return F.when(secs.isNull() | F.isnan(secs) | (secs <= 0), "-").otherwise(text)
