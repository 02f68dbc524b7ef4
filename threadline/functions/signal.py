"""Signal quality of arrays of samples, as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def decibels(level: Column) -> Column:
    return 20 * F.log10(F.greatest(level, F.lit(1e-6)))


def clipped_ratio(samples: Column, limit: float = 0.98) -> Column:
    return F.when(F.size(samples) > 0, F.size(F.filter(samples, lambda x: F.abs(x.cast("double")) >= limit)) / F.size(samples)).otherwise(F.lit(0.0))


def frame_ratio(samples: Column, least: float, frame: int, hop: int) -> Column:
    """Share of full frames whose level reaches `least`; 0 if there is no full frame."""
    n = F.size(samples) - frame + 1
    levels = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(hop)), lambda s: rms(F.slice(samples, s, F.lit(frame))))
    return F.when(n >= 1, F.size(F.filter(levels, lambda v: v >= least)) / F.size(levels)).otherwise(F.lit(0.0))


def quality(samples: Column, sample_rate: int = 16000, min_rms: float = 0.0015, min_peak: float = 0.006, min_frame_ratio: float = 0.03, clip: float = 0.98) -> Column:
    """struct(rms, peak, decibels, clipped, frame_ratio, seconds, status, is_speech). Clipping doesn't stop speech from counting."""
    least = max(1.75 * min_rms, 0.003)
    level, top, share = rms(samples), peak(samples), frame_ratio(samples, least, max(1, sample_rate * 30 // 1000), max(1, sample_rate * 15 // 1000))
    clipped = clipped_ratio(samples, clip)
    quiet = (level < min_rms) | (top < min_peak)
    status = F.when(F.size(samples) == 0, "silence").when(clipped >= 0.005, "clipped").when(quiet, "silence").when(share < min_frame_ratio, "too_little_speech").otherwise("speech")
    speech = ~quiet & (share >= min_frame_ratio)
    return F.struct(
        level.alias("rms"),
        top.alias("peak"),
        F.when(F.size(samples) == 0, F.lit(-120.0)).otherwise(decibels(level)).alias("decibels"),
        clipped.alias("clipped"),
        share.alias("frame_ratio"),
        (F.size(samples) / sample_rate).alias("seconds"),
        status.alias("status"),
        speech.alias("is_speech"),
    )


def preemphasis(samples: Column, factor: float = 0.97) -> Column:
    value = lambda x, i: F.when(i == 0, x.cast("double")).otherwise(x.cast("double") - factor * F.element_at(samples, F.greatest(i, F.lit(1))).cast("double"))
    return F.transform(samples, value)


def znorm(values: Column, floor: float = 1e-10) -> Column:
    """Values less their mean, by their deviation (of all, not of a sample); a vanishing deviation counts as floor."""
    n = F.greatest(F.size(values), F.lit(1))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    scaled = lambda m: F.element_at(F.transform(F.array(F.sqrt(add(F.transform(values, lambda x: (x - m) * (x - m))) / n)), lambda d: F.transform(values, lambda x: (x - m) / F.greatest(d, F.lit(floor)))), 1)
    return F.element_at(F.transform(F.array(add(values) / n), scaled), 1)


def newest(samples: Column, n: int) -> Column:
    return F.slice(samples, F.greatest(F.size(samples) - n + 1, F.lit(1)), F.lit(n))


def argmax(values: Column) -> Column:
    """Place of the largest value, from 0; the first of equal ones; null if there is none."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def measure(samples: np.ndarray, rate: int = 16000, min_rms: float = 0.0015, min_peak: float = 0.006, min_frame_ratio: float = 0.03, clip: float = 0.98) -> dict:
    """What quality() gives, for one window in a worker."""
    x = np.asarray(samples, float)
    if not len(x):
        return {"rms": 0.0, "peak": 0.0, "decibels": -120.0, "clipped": 0.0, "frame_ratio": 0.0, "seconds": 0.0, "status": "silence", "is_speech": False}
    level = lambda a: np.sqrt((a * a).mean(-1))
    frame, hop = max(1, rate * 30 // 1000), max(1, rate * 15 // 1000)
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop] if len(x) >= frame else np.zeros((0, frame))
    share = float((level(frames) >= max(1.75 * min_rms, 0.003)).mean()) if len(frames) else 0.0
    top, whole, clipped = float(np.abs(x).max()), float(level(x)), float((np.abs(x) >= clip).mean())
    quiet = whole < min_rms or top < min_peak
    status = "clipped" if clipped >= 0.005 else "silence" if quiet else "too_little_speech" if share < min_frame_ratio else "speech"
    return {
        "rms": whole,
        "peak": top,
        "decibels": float(20 * np.log10(max(whole, 1e-6))),
        "clipped": clipped,
        "frame_ratio": share,
        "seconds": len(x) / rate,
        "status": status,
        "is_speech": not quiet and share >= min_frame_ratio,
    }
