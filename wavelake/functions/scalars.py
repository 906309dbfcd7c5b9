"""Column expressions: signal arithmetic, scores, label policies and text formats.

All arithmetic is in DOUBLE; decimal literals would round differently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column | float) -> Column:
    return (F.lit(float(x)) if isinstance(x, int | float) else x).cast("double")


def magnitude(*axes: Column) -> Column:
    """Euclidean length of the axes; the absolute value of a single one.  Gravity is not subtracted."""
    if len(axes) == 1:
        return F.abs(_d(axes[0]))
    total = _d(axes[0]) * _d(axes[0])
    for a in axes[1:]:
        total = total + _d(a) * _d(a)
    return F.sqrt(total)


def rms(mean_square: Column) -> Column:
    """Root of a mean of squares, kept off zero by 1e-8."""
    return F.sqrt(_d(mean_square) + 1e-8)


def log_loss(label: Column, p: Column, clip: float = 1e-7) -> Column:
    """Binary cross entropy of one row, the score clipped to [clip, 1 - clip]."""
    q = F.greatest(F.least(_d(p), F.lit(1 - clip)), F.lit(clip))
    return -(_d(label) * F.log(q) + (1.0 - _d(label)) * F.log(1.0 - q))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct<low, high>: Wilson interval of k of n, within [0, 1]; null for n = 0."""
    n, k = _d(n), _d(k)
    m = F.when(n > 0, n)
    p, zz = k / m, z * z
    centre = (p + zz / (2.0 * m)) / (1.0 + zz / m)
    half = z * F.sqrt(p * (1.0 - p) / m + zz / (4.0 * m * m)) / (1.0 + zz / m)
    return F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high"))


def blend(a: Column, b: Column, weight: Column | float) -> Column:
    """(1 - weight) a + weight b."""
    w = _d(weight)
    return (1.0 - w) * _d(a) + w * _d(b)


def bankers_round(x: Column, digits: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(x, digits)


def zscore(x: Column, mean: Column | float, sd: Column | float, floor: float = 1e-6) -> Column:
    """(x - mean) / sd, with 1 for a deviation up to ``floor``."""
    s = _d(sd)
    return (_d(x) - _d(mean)) / F.when(s > floor, s).otherwise(1.0)


def quantize_int8(x: Column, scale: float, zero_point: int) -> Column:
    """clamp(round(x / scale) + zero point) to [-128, 127]; halves go away from zero."""
    return F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.round(_d(x) / scale) + float(zero_point))).cast("int")


def dequantize_int8(q: Column, scale: float, zero_point: int) -> Column:
    return (_d(q) - float(zero_point)) * scale


def second_field_class(onset: Column, second: Column, longest: float = 86_400.0) -> Column:
    """What the optional second field of a label row is."""
    return (
        F.when(second.isNull(), "onset_only").when(second <= onset, "duration_or_invalid")
        .when(second - onset <= longest, "usable_offset").otherwise("implausible_offset")
    )


def offset_policy(onset: Column, second: Column, seconds: float = 300.0, longest: float = 86_400.0) -> Column:
    """End of a labelled event: the second field where it is a usable offset, else onset plus ``seconds``."""
    return F.when((second > onset) & (second - onset <= longest), second).otherwise(onset + seconds)


def patient_id(path: Column, prefix: str = "Mayo_") -> Column:
    """The last path component that begins with ``prefix``, else ``unknown``."""
    found = F.regexp_extract(path, f"^(?:.*/)?({prefix}[^/]+)(?:/.*)?$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def channel_mask(channels: dict[str, Column], enabled: Sequence[str]) -> list[Column]:
    """The channels, those not enabled zeroed rather than dropped; unknown names raise."""
    if unknown := sorted(set(enabled) - set(channels)):
        raise ValueError(f"unknown channels: {', '.join(unknown)}")
    return [(c if name in enabled else F.lit(0.0)).alias(name) for name, c in channels.items()]


def feature_names(text: str) -> list[str]:
    """Names of a comma-separated list: trimmed, in upper case, blanks left out."""
    return [name for part in text.split(",") if (name := part.strip().upper())]


def select_channels(vector: Column, names: Sequence[str], wanted: Sequence[str]) -> Column:
    """The named components of a channel vector, in the order wanted."""
    return F.array(*(F.get(vector, F.lit(list(names).index(w))) for w in wanted))


def format_elapsed(seconds: Column) -> Column:
    """``1h 02m 03s``, ``2m 03s`` or ``3s``."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))


def parse_fraction(text: Column) -> Column:
    """struct<detected, total> of ``detected/total``; null where it is no such text."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d+)\s*/\s*(\d+)\s*$", i)
    number = lambda i: F.when(part(i) != "", part(i)).cast("long")
    return F.struct(number(1).alias("detected"), number(2).alias("total"))


def format_or_na(x: Column, digits: int = 4) -> Column:
    """A number with fixed digits, ``n/a`` for null or NaN."""
    v = _d(x)
    return F.when(v.isNull() | F.isnan(v), "n/a").otherwise(F.format_string(f"%.{digits}f", v))


def config_key(config: Column) -> Column:
    """Cache key: sha256 of a struct's JSON, null fields kept out."""
    return F.sha2(F.to_json(config), 256)
