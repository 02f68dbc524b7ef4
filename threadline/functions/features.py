"""Log-mel features, in numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from threadline.operators.ordered import with_running

# Sample rate, window, hop, transform length, mel bins, pre-emphasis, floor of the logarithm and of the deviation.
RATE, WINDOW, HOP, N_FFT, N_MELS, EMPHASIS, LOG_FLOOR, DEVIATION_FLOOR = 16000, 400, 160, 512, 80, 0.97, 1e-5, 1e-10


def mel_filters() -> np.ndarray:
    """Triangles of equal area on the mel scale, bins by frequencies."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(RATE / 2), N_MELS + 2) / 2595) - 1)
    at = np.linspace(0, RATE / 2, N_FFT // 2 + 1)
    left, top, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((at - left) / (top - left), (right - at) / (right - top))) * 2 / (right - left)


# Factor, step and first state of the noise's generator, modulo 2 ** 64.
NOISE_FACTOR, NOISE_STEP, NOISE_SEED = 2_862_933_555_777_941_757, 3_037_000_493, 0x1234_5678_90AB_CDEF
NOISE_STATES = 1 << 64


def state_after(n: int, seed: int = NOISE_SEED) -> int:
    """The generator's state n values after the seed, in log n steps: a step is an affine map, and maps that stand for 1, 2, 4, ... steps
    are multiplied, those of n's bits."""
    factor, offset, by, plus = 1, 0, NOISE_FACTOR, NOISE_STEP
    while n > 0:
        if n & 1:
            factor, offset = factor * by % NOISE_STATES, (offset * by + plus) % NOISE_STATES
        by, plus, n = by * by % NOISE_STATES, (by + 1) * plus % NOISE_STATES, n >> 1
    return (factor * seed + offset) % NOISE_STATES


def noise(n: int, amplitude: float = 1e-5, seed: int = NOISE_SEED, drawn: int = 0) -> np.ndarray:
    """n values of a linear congruential generator's upper 24 bits, between plus and minus amplitude, after `drawn` others. So a window
    goes on where the one before it ended, whichever task has it."""
    seed = state_after(drawn, seed)
    powers = np.cumprod(np.full(n, NOISE_FACTOR, np.uint64), dtype=np.uint64)
    before = np.concatenate([[np.uint64(1)], powers[:-1]]) if n else powers
    state = powers * np.uint64(seed) + np.uint64(NOISE_STEP) * np.cumsum(before, dtype=np.uint64)
    return ((state >> np.uint64(40)).astype(float) / 0xFFFFFF * 2 - 1) * amplitude


def log_mel(samples: np.ndarray, dither: float = 0.0, drawn: int = 0) -> np.ndarray:
    """Normalised log-mel features, bins by frames; empty for fewer samples than a window. dither: amplitude of added noise, of which
    `drawn` values are taken already."""
    x = np.asarray(samples, float)
    if len(x) < WINDOW:
        return np.zeros((N_MELS, 0))
    if dither > 0:
        x = x + noise(len(x), dither, drawn=drawn)
    x = np.append(x[0], x[1:] - EMPHASIS * x[:-1])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW))
    power = (np.abs(np.fft.rfft(frames, N_FFT)) / N_FFT) ** 2
    features = np.log(power @ mel_filters().T + LOG_FLOOR).T
    deviation = np.maximum(features.std(1, keepdims=True), DEVIATION_FLOOR)
    return (features - features.mean(1, keepdims=True)) / deviation


def with_drawn(clips: DataFrame, session: str, order: list[str], samples: str = "samples") -> DataFrame:
    """clips with drawn, the values of noise that the session's clips before it take: one for each sample of those that make a window.
    The order must tell a session's clips apart; null sessions are one session, null samples count as none. Long sessions are split."""
    size = F.coalesce(F.size(samples), F.lit(0)).cast("long")
    taken = F.when(size >= WINDOW, size).otherwise(F.lit(0).cast("long"))
    return with_running(clips, [session], order, sums={"drawn": taken}).withColumn("drawn", F.col("drawn") - taken)


@F.pandas_udf(T.StructType([T.StructField("features", T.ArrayType(T.FloatType())), T.StructField("n_mels", T.IntegerType()), T.StructField("n_frames", T.IntegerType())]))
def _mel(samples: pd.Series, dither: pd.Series, drawn: pd.Series) -> pd.DataFrame:
    out = [log_mel(np.zeros(0) if s is None else s, a, int(k)) for s, a, k in zip(samples, dither, drawn, strict=True)]
    return pd.DataFrame({"features": [m.reshape(-1).astype(np.float32) for m in out], "n_mels": [N_MELS] * len(out), "n_frames": [m.shape[1] for m in out]})


def mel_features(samples: Column, dither: float = 0.0, drawn: Column | None = None) -> Column:
    """struct(features, n_mels, n_frames), a bin's frames after the other's. Null counts as no samples. drawn: as with_drawn() gives it;
    without it each row's noise starts anew."""
    drawn = F.lit(0) if drawn is None else F.coalesce(drawn, F.lit(0))
    return _mel(samples, F.lit(float(dither)), drawn.cast("long"))
