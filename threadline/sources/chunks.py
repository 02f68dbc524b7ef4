"""A source of chunks of sound: WAV files of a folder, as a table or as a stream that goes on where its checkpoint ended.

    spark.dataSource.register(WavChunks)
    spark.readStream.format("wav_chunks").option("path", folder).load()

A file is read in pieces, each by a task of its own that seeks to its place, so long recordings are neither loaded whole nor read by one
task. An offset is the time and name of the last file taken, of the same size however many files there are.
"""

from __future__ import annotations

import time
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from threadline.config import RATE, Problem, SessionError
from threadline.sources.files import CHUNK, mono

#: Bytes of a file that one task reads, and seconds for which a file must have been left alone before a stream takes it.
PIECE_BYTES, SETTLED_SECONDS = 32 << 20, 1.0

SCHEMA = "session_id string, ts double, samples array<float>, hint int, stop boolean"
ARROW = pa.schema([("session_id", pa.string()), ("ts", pa.float64()), ("samples", pa.list_(pa.float32())), ("hint", pa.int32()), ("stop", pa.bool_())])
#: Chunks of an Arrow batch.
BATCH = 64


@dataclass
class Piece(InputPartition):
    """A part of a file: the number-th of `of` parts with equally many chunks."""

    path: str
    size: int
    number: int
    of: int


@dataclass(frozen=True, order=True)
class Place:
    """Where a stream stands: files are taken in the order of their time and name."""

    changed: int
    path: str


class _Folder:
    """The files of a folder and their chunks."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise SessionError(Problem.RESOURCE_MISSING, "path")
        self.files, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.root = self.root.rstrip("/")
        self.chunk, self.piece = int(options.get("chunk", CHUNK)), int(options.get("pieceBytes", PIECE_BYTES))
        self.settled = float(options.get("settledSeconds", SETTLED_SECONDS))
        self.strict = options.get("strict", "false").lower() == "true"
        self.hint = int(options["hint"]) if "hint" in options else None

    def listed(self) -> list[tuple[Place, int]]:
        """Places and sizes of the folder's WAV files, in order."""
        found = self.files.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return sorted((Place(f.mtime_ns, f.path), f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".wav"))

    def pieces(self, files: list[tuple[Place, int]]) -> list[Piece]:
        counts = [(p.path, size, max(1, -(-size // self.piece))) for p, size in files]
        return [Piece(path, size, i, n) for path, size, n in counts for i in range(n)]

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        """The chunks of a piece. A file that is no WAV gives none, or an error if the option strict is true. Spark asks for None where
        there are no pieces."""
        if piece is None:
            return
        with self.files.open_input_file(piece.path) as f:
            try:
                sound = wave.open(f)
            except (wave.Error, EOFError) as e:
                if self.strict:
                    raise SessionError(Problem.RESOURCE_CORRUPT, piece.path) from e
                return
            width = sound.getsampwidth() * sound.getnchannels()
            frames = min(sound.getnframes(), (piece.size - f.tell()) // width)
            total = int(frames * RATE / sound.getframerate())
            n = max(1, -(-total // self.chunk))
            first, last = n * piece.number // piece.of, n * (piece.number + 1) // piece.of
            name, rows = piece.path[len(self.root) + 1 :], []
            for i in range(first, last):
                at = i * self.chunk, min((i + 1) * self.chunk, total)
                rows.append((name, at[0] / RATE, self.samples(sound, frames, *at), False))
                if len(rows) == BATCH:
                    yield self.batch(rows)
                    rows = []
            if piece.number + 1 == piece.of:
                rows.append((name, total / RATE, None, True))
            if rows:
                yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names, at, samples, stop = zip(*rows, strict=True)
        return pa.record_batch([pa.array(list(x), t) for x, t in zip((names, at, samples, [self.hint] * len(rows), stop), ARROW.types, strict=True)], schema=ARROW)

    def samples(self, sound: wave.Wave_read, frames: int, start: int, end: int) -> np.ndarray:
        """Samples start to end at RATE: only the frames between which they lie are read."""
        if end <= start:
            return np.zeros(0, np.float32)
        at = np.arange(start, end) * sound.getframerate() / RATE
        first, last = min(int(at[0]), frames - 1), min(int(at[-1]) + 2, frames)
        sound.setpos(first)
        x = mono(sound.readframes(last - first), sound.getsampwidth(), sound.getnchannels())
        return np.interp(at, np.arange(first, first + len(x)), x).astype(np.float32)


class _Table(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Piece]:
        return self.folder.pieces(self.folder.listed())

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from self.folder.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:
        # never past a file that may still be written, or beside which one of the same time may still appear
        until = time.time_ns() - int(self.folder.settled * 1e9)
        settled = [p for p, _ in self.folder.listed() if p.changed <= until]
        return {"changed": settled[-1].changed, "path": settled[-1].path} if settled else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.folder.pieces([(p, n) for p, n in self.folder.listed() if Place(**start) < p <= Place(**end)])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from self.folder.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept besides the offset, and files stay where they are."""


class WavChunks(DataSource):
    """Chunks (SCHEMA) of the WAV files under `path`, a folder that all executors see; session_id is a file's name within it.

    Options: path, chunk (samples of a chunk), pieceBytes, hint (a group for all sessions), strict (true: a file that is no WAV is an
    error; else it has no rows), and settledSeconds: a stream takes a file once it hasn't changed for so long. Files must be written
    in place or moved in within that time, and not be changed or removed later: a file that appears with an older time than one
    that was taken is not seen. Truncated files have the samples that are there, and a file without samples one empty chunk and a stop.
    An empty or missing folder is an empty table.
    """

    @classmethod
    def name(cls) -> str:
        return "wav_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Table(_Folder(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Folder(self.options))
