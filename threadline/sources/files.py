"""Readers of corpora, vocabularies, replays and sound, and checks of models, downloads and archives."""

from __future__ import annotations

import hashlib
import io
import os
import shutil
import urllib.request
import wave
import zipfile
from collections.abc import Callable
from pathlib import Path, PurePosixPath

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from threadline.config import RATE, Problem, SessionError
from threadline.operators.corpus import CorpusError

#: Bytes of a download between two reports, and samples of a chunk of sound.
REPORT, CHUNK = 1 << 16, 4096


def _read(path: str, load: Callable[[], DataFrame], **metrics: Column) -> tuple[DataFrame, dict]:
    """A table that can be read, and what is told of its rows, all in one pass; else an error that says whether the file is missing or
    unusable."""
    seen = Observation()
    try:
        rows = load()
        rows.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in metrics.items()]).write.format("noop").mode("overwrite").save()
        return rows, seen.get
    except (PySparkException, Py4JJavaError) as e:
        missing = "PATH_NOT_FOUND" in str(e)
        raise SessionError(Problem.RESOURCE_MISSING if missing else Problem.RESOURCE_CORRUPT, path) from e


def read_corpus(spark: SparkSession, path: str, names: dict[str, str], expected_rows: int | None = None) -> DataFrame:
    """A JSON array of rows; names: from group_id, ordinal, raw_text, clean_text to the fields' names."""
    schema = ", ".join(f"`{names[c]}` {'int' if c in ('group_id', 'ordinal') else 'string'}" for c in ("group_id", "ordinal", "raw_text", "clean_text"))
    rows, seen = _read(path, lambda: spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path))
    if expected_rows is not None and seen["rows"] != expected_rows:
        raise CorpusError(f"{seen['rows']} rows instead of {expected_rows}")
    return rows.select(*[F.col(f"`{names[c]}`").alias(c) for c in ("group_id", "ordinal", "raw_text", "clean_text")])


def read_vocabulary(spark: SparkSession, path: str, blank: int | None = None) -> tuple[DataFrame, int]:
    """token_id and token from a JSON object, and the blank's id: as given, else that of <blank>, else the largest."""
    number = F.col("k").try_cast("int")
    rows, seen = _read(
        path,
        lambda: spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "token")),
        bad=F.count_if(number.isNull()),
        top=F.max(number),
        named=F.max(F.when(F.col("token") == "<blank>", number)),
    )
    if seen["bad"] or seen["top"] is None:
        raise CorpusError("vocabulary keys must be integers")
    if blank is None:
        blank = seen["named"] if seen["named"] is not None else seen["top"]
    return rows.select(number.alias("token_id"), "token"), blank


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """t, discovery_text and tracking_text of recorded windows."""
    rows, _ = _read(path, lambda: spark.read.schema("t double, d string, k string").option("multiLine", True).option("mode", "FAILFAST").json(path))
    return rows.select("t", F.col("d").alias("discovery_text"), F.col("k").alias("tracking_text"))


def mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Frames of 8, 16, 24 or 32 bits as the mean of their channels, from -1 to 1; a broken frame at the end is left out."""
    data = np.frombuffer(raw, np.uint8)
    data = data[: len(data) // (width * channels) * width * channels]
    if width == 1:
        x = data.astype(float) - 128
    else:  # little-endian integers, shifted up to 32 bits
        whole = np.zeros((len(data) // width, 4), np.uint8)
        whole[:, 4 - width :] = data.reshape(-1, width)
        x = whole.reshape(-1).view("<i4").astype(float) / (1 << (32 - 8 * width))
    return x.reshape(-1, channels).mean(1) / (1 << (8 * width - 1))


def decoded(raw: bytes) -> np.ndarray:
    """Samples of a WAV file at RATE, its channels' mean; of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(raw)) as w:
        rate, x = w.getframerate(), mono(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels())
    at = np.arange(int(len(x) * RATE / rate)) * rate / RATE
    return np.interp(at, np.arange(len(x)), x).astype(np.float32) if len(x) else np.zeros(0, np.float32)


def _attempted(raw: bytes) -> tuple[np.ndarray | None, str | None]:
    try:
        return decoded(raw), None
    except (wave.Error, EOFError) as e:
        return None, str(SessionError(Problem.UNSUPPORTED)) + f": {e}"


@F.pandas_udf(T.StructType([T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]))
def _samples(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_attempted(raw) for raw in content], columns=["samples", "error"])


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, samples (16 kHz, mono) and error of sound files; other formats than WAV have an error instead of samples."""
    return spark.read.format("binaryFile").load(path).select("path", _samples.asNondeterministic()("content").alias("_s")).select("path", "_s.samples", "_s.error")


def sample_stream(spark: SparkSession, folder: str, schema: str, most_files: int = 100) -> DataFrame:
    """A stream of chunks from Parquet files that appear in a folder: the source of samples where there is no device."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def wav_chunks(sounds: DataFrame, size: int = CHUNK) -> DataFrame:
    """session_id, ts (seconds), samples, hint and stop: the chunks that a source would send of path and samples, the last one a stop."""
    n = F.greatest(F.ceil(F.size("samples") / size).cast("int"), F.lit(1))
    rows = sounds.where("samples is not null").select("path", "samples", F.explode(F.sequence(F.lit(0), n)).alias("i"), n.alias("n"))
    return rows.select(
        F.col("path").alias("session_id"),
        (F.least(F.col("i") * size, F.size("samples")) / RATE).alias("ts"),
        F.when(F.col("i") < F.col("n"), F.slice("samples", F.col("i") * size + 1, F.lit(size))).alias("samples"),
        F.lit(None).cast("int").alias("hint"),
        (F.col("i") == F.col("n")).alias("stop"),
    )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fetch(url: str, to: str, sha256: str, progress: Callable[[int, int | None], None] = lambda done, size: None) -> str:
    """Downloads a file beside its place and moves it there once its checksum is right. progress: bytes so far, and in all if known."""
    part, digest, done = Path(to + ".part"), hashlib.sha256(), 0
    try:
        with urllib.request.urlopen(url) as source, part.open("wb") as out:
            size = int(source.headers["Content-Length"]) if source.headers["Content-Length"] else None
            while block := source.read(REPORT):
                out.write(block)
                digest.update(block)
                done += len(block)
                progress(done, size)
        if digest.hexdigest() != sha256.lower():
            raise SessionError(Problem.CHECKSUM_MISMATCH, sha256, digest.hexdigest())
        os.replace(part, to)
    except OSError as e:
        raise SessionError(Problem.DOWNLOAD_FAILED, e) from e
    finally:
        part.unlink(missing_ok=True)
    return to


def is_safe(member: str) -> bool:
    """Whether an archive's member stays under the folder it is extracted to."""
    return not PurePosixPath(member).is_absolute() and ".." not in PurePosixPath(member).parts and "\\" not in member


def extract(archive: str, to: str, sha256: str, results: dict[str, str] | None = None) -> list[str]:
    """Members of a checked zip archive (stored or deflated), extracted one by one; paths out of the folder are refused. results:
    checksums that members must have; where all are there already, nothing is extracted."""
    results, folder = results or {}, Path(to)
    if results and all((folder / m).is_file() and _digest(folder / m) == d for m, d in results.items()):
        return sorted(results)
    if (found := _digest(Path(archive))) != sha256:
        raise SessionError(Problem.CHECKSUM_MISMATCH, sha256, found)
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            if not is_safe(info.filename) or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"unsafe or unknown member {info.filename}")
        for info in z.infolist():
            place = folder / info.filename
            if info.is_dir():
                place.mkdir(parents=True, exist_ok=True)
                continue
            place.parent.mkdir(parents=True, exist_ok=True)
            with z.open(info) as source, place.open("wb") as out:
                shutil.copyfileobj(source, out)
            if info.filename in results and (found := _digest(place)) != results[info.filename]:
                place.unlink()
                raise SessionError(Problem.CHECKSUM_MISMATCH, results[info.filename], found)
        return z.namelist()


def is_usable(path: str) -> bool:
    """A file that exists and isn't empty."""
    return Path(path).is_file() and Path(path).stat().st_size > 0


def check_model(path: str) -> None:
    """An error unless there is a model file with something in it."""
    if not Path(path).is_file():
        raise SessionError(Problem.MODEL_MISSING, path)
    if not is_usable(path):
        raise SessionError(Problem.MODEL_CORRUPT, "the file is empty")
