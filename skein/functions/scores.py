"""Scoring rules as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the video quality rule: kilobits per megapixel, tiers, and deductions.
KBPS_PER_MEGAPIXEL = 1500.0
BITRATE_TIERS = ((0.5, 25), (0.75, 18), (1.0, 10))
LOW_CHANNELS, NO_SUBTITLES, RUNTIME_MISMATCH, MANY_LANGUAGES, RUNTIME_TOLERANCE = 10, 10, 10, 3, 0.10
# Fixed values of the folder confidence: weights of signals, and penalties by issue prefix.
WEIGHTS = {"canon": 0.35, "nfo": 0.25, "oshash": 0.20, "name": 0.15, "runtime": 0.05}
PENALTIES = {
    "multiple_primary_videos": 0.10,
    "missing_year": 0.10,
    "missing_canonical_pattern": 0.05,
    "missing_nfo": 0.05,
    "invalid_year": 0.05,
    "no_primary_video": 0.20,
    "unreadable_folder": 0.20,
}
OTHER_PENALTY, FULL_NAME_SCORE, TV_PENALTY = 0.03, 0.85, 0.05


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def bitrate_deduction(width: Column, height: Column, kbps: Column) -> Column:
    share = kbps / (width * height / 1e6) / KBPS_PER_MEGAPIXEL
    out = F.lit(0)
    for limit, points in reversed(BITRATE_TIERS):
        inside = share < limit if limit == 1.0 else share <= limit
        out = F.when(inside, points).otherwise(out)
    return F.when((width > 0) & (height > 0) & (kbps > 0), out).otherwise(0)


def runtime_differs(seconds: Column, minutes: Column) -> Column:
    expected = minutes * 60.0
    return F.coalesce((expected > 0) & (seconds > 0) & (F.abs(seconds - expected) > RUNTIME_TOLERANCE * expected), F.lit(False))


def video_quality(width: Column, height: Column, kbps: Column, channels: Column, audio_langs: Column, sub_langs: Column, subs_expected: Column, seconds: Column, minutes: Column) -> Column:
    """0 to 100: full marks less deductions, plus a little for several languages. The langs are counts."""
    score = 100 - bitrate_deduction(width, height, kbps)
    score = score - F.when(F.coalesce(channels, F.lit(2)) < 2, LOW_CHANNELS).otherwise(0)
    score = score - F.when(subs_expected & (F.coalesce(sub_langs, F.lit(0)) == 0), NO_SUBTITLES).otherwise(0)
    score = score - F.when(runtime_differs(seconds, minutes), RUNTIME_MISMATCH).otherwise(0)
    score = score + F.when(audio_langs > 1, MANY_LANGUAGES).otherwise(0) + F.when(sub_langs > 1, MANY_LANGUAGES).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), score))


def penalty(issues: Column) -> Column:
    """Sum over an array of issues."""
    each = lambda x: F.coalesce(*[F.when(x.startswith(k), F.lit(v)) for k, v in PENALTIES.items()], F.lit(OTHER_PENALTY))
    return F.aggregate(F.transform(F.coalesce(issues, F.array().cast("array<string>")), each), F.lit(0.0), lambda s, x: s + x)


def folder_confidence(canonical: Column, has_nfo: Column, oshash: Column, name_score: Column, runtime: Column, issues: Column) -> Column:
    """Weighted signals less penalties, in [0, 1]."""
    name = F.when(name_score >= FULL_NAME_SCORE, 1.0).otherwise(clamp(F.coalesce(name_score, F.lit(0.0))))
    flags = {"canon": canonical, "nfo": has_nfo, "oshash": oshash, "runtime": runtime}
    total = F.lit(WEIGHTS["name"]) * name
    for key, flag in flags.items():
        total = total + F.when(flag, WEIGHTS[key]).otherwise(0.0)
    return clamp(total - penalty(issues))


def tv_confidence(signals: dict[float, Column], issues: Column) -> Column:
    """Weighted flags less a fixed penalty for each issue, in [0, 1]."""
    total = F.lit(0.0)
    for weight, flag in signals.items():
        total = total + F.when(flag, weight).otherwise(0.0)
    return clamp(F.greatest(F.lit(0.0), total - TV_PENALTY * F.size(F.coalesce(issues, F.array()))))


def bucket(confidence: Column, low: float = 0.50, high: float = 0.80) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= low, "medium").when(confidence.isNotNull(), "low")


def keyword_score(query: Column, name: Column) -> Column:
    """A contained query: share of the name's length, at least 0.2; else the share of its words that the name contains."""
    q, n = F.lower(F.trim(query)), F.lower(name)
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    found = F.size(F.filter(words, lambda w: F.contains(n, w)))
    share = F.when(F.size(words) > 0, found / F.size(words)).otherwise(0.0)
    return F.when((q != "") & F.contains(n, q), clamp(F.length(q) / F.length(n), 0.2)).otherwise(share)


def weighted_mean(parts: dict[float, Column]) -> Column:
    """Mean of clamped similarities by weight."""
    total = F.lit(0.0)
    for weight, x in parts.items():
        total = total + weight * clamp(F.coalesce(x, F.lit(0.0)))
    return clamp(total / sum(parts))
