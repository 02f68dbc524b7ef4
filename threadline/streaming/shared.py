"""Values for stateful operators. The planner unpickles their code where broadcasts can't be loaded, so they carry them, packed."""

from __future__ import annotations

import pickle
import zlib


class Shared:
    """A value that travels with the code, compressed, and is unpacked once in each worker. One that takes more than
    spark.broadcast.UDFCompressionThreshold (1 MB) needs that setting raised."""

    def __init__(self, value: object):
        self.packed, self.known = zlib.compress(pickle.dumps(value)), value

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "known": None}

    @property
    def value(self):
        if self.known is None:
            self.known = pickle.loads(zlib.decompress(self.packed))
        return self.known
