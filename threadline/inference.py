"""An acoustic model as a plug: samples become features, logits and text, in a worker that opens the model once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from threadline.config import Problem, SessionError
from threadline.functions.features import log_mel
from threadline.sources.files import check_model

#: A model: features (bins by frames) become logits (steps by tokens), or a batch of one of these.
Model = Callable[[np.ndarray], np.ndarray]


def greedy(logits: np.ndarray, tokens: dict[int, str], blank: int) -> str:
    """The largest class of each step, repeats collapsed, blanks and unknown tokens dropped, joined; of equal classes the first."""
    best = logits.argmax(1) if logits.size else np.zeros(0, np.int64)
    kept = best[np.append(True, best[1:] != best[:-1])] if len(best) else best
    return " ".join("".join(tokens.get(int(i), "") for i in kept if i != blank).replace("▁", " ").split())


@dataclass
class Transcriber:
    """open: makes the model, once in each worker. tokens: the vocabulary. Logits of another width are an error."""

    open: Callable[[], Model]
    tokens: dict[int, str]
    blank: int
    dither: float = 0.0
    _model: Model | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def logits(self, features: np.ndarray) -> np.ndarray:
        if self._model is None:
            self._model = self.open()
        out = np.asarray(self._model(features.astype(np.float32)), np.float32)
        if out.ndim == 3 and len(out) == 1:
            out = out[0]
        if out.ndim != 2:
            raise SessionError(Problem.INFERENCE_FAILED, f"logits of shape {out.shape}")
        if out.shape[1] != len(self.tokens):
            raise SessionError(Problem.WIDTH_MISMATCH, len(self.tokens), out.shape[1])
        return out

    def text(self, samples: np.ndarray, drawn: int = 0) -> str:
        """The text of some samples; empty for fewer than a window's. drawn: values of noise taken by what came before."""
        features = log_mel(samples, self.dither, drawn)
        return greedy(self.logits(features), self.tokens, self.blank) if features.shape[1] else ""

    def attempt(self, samples: np.ndarray, drawn: int = 0) -> tuple[str | None, str | None]:
        """(text, error): an error never ends a stream."""
        try:
            return self.text(samples, drawn), None
        except SessionError as e:
            return None, str(e)
        except Exception as e:  # whatever a model raises
            return None, str(SessionError(Problem.INFERENCE_FAILED, e))


def onnx_model(path: str, threads: int = 1, signal: str = "audio_signal", length: str = "length", output: str = "logprobs") -> Callable[[], Model]:
    """Opens a model file with onnxruntime: a signal [1, bins, frames] and its length become logits."""

    def open_model() -> Model:
        check_model(path)
        try:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = threads
            session = onnxruntime.InferenceSession(path, options)
        except Exception as e:
            raise SessionError(Problem.MODEL_CORRUPT, e) from e
        return lambda x: session.run([output], {signal: x[None], length: np.array([x.shape[1]], np.int64)})[0]

    return open_model


def transcribe(clips: DataFrame, transcriber: Transcriber, samples: str = "samples", drawn: str | None = None) -> DataFrame:
    """clips with text and error, one of which is null; a null clip counts as empty. The model is opened once in each worker, and
    runs once for each row, also where text is filtered on. drawn: the column of features.with_drawn(), where noise goes on from clip
    to clip."""

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch, before in batches:
            done = [transcriber.attempt(np.zeros(0, np.float32) if s is None else np.asarray(s, np.float32), int(k)) for s, k in zip(batch, before, strict=True)]
            yield pd.DataFrame(done, columns=["text", "error"])

    out = clips.drop("text", "error").withColumn("_t", run.asNondeterministic()(F.col(samples), F.coalesce(F.col(drawn).cast("long"), F.lit(0)) if drawn else F.lit(0)))
    return out.select("*", "_t.text", "_t.error").drop("_t")


def check_widths(steps: DataFrame, width: int, logits: str = "logits") -> DataFrame:
    """steps, of which one whose logits aren't this wide fails the query."""
    wrong = F.raise_error(F.concat(F.lit("logits of width "), F.size(logits).cast("string"), F.lit(f" instead of {width}")))
    return steps.withColumn(logits, F.when(F.size(logits) == width, F.col(logits)).otherwise(wrong.cast(steps.schema[logits].dataType)))
