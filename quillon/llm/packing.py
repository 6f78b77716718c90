"""Best-fit packing of documents into fixed-length training sequences.

Method: bounded-space online best-fit.  Each task streams its documents, tokenises
them, cuts those longer than ``capacity`` and places every piece into the open bin
with the least free space that still holds it.  Open bins are kept in a bitset keyed
by free space (one Python integer, bit f set if some open bin has f free tokens), so
the best fit is one shift and one lowest-bit.  At most ``open_bins`` are open; to
open one more, the fullest closes first.  The pieces of one Arrow batch (at most
10,000 documents or 64 MB) arrive together and are placed longest first, which needs
``open_bins`` of the order of a batch: fewer would close bins that later, shorter
pieces of the batch could fill.

Scale: no shuffle and no state beyond a task; memory is one Arrow batch plus
``open_bins`` counters.  A lost executor's task is run again from the source and
gives the same rows, as sequence ids are made of the partition number and a local
counter.

Cases: a null text is an empty one (only the end token); a text of any length is
taken whole; repeated rows are packed as often as they occur; a null id is kept as
null; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import bpe

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Bins:
    """Open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, open_bins: int, first_id: int = 0):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be at least 1")
        self.capacity, self.most, self.next_id = capacity, open_bins, first_id
        self.mask, self.count = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        level = self.by_free[free]
        bin_id = level.pop()
        if not level:
            self.mask &= ~(1 << free)
        self.count -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin id, offset) for a piece of 1 to capacity tokens."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.next_id
            self.next_id += 1
        rest = free - length
        if rest:
            if self.count == self.most:  # the fullest of the open ones and this one closes
                fullest = (self.mask & -self.mask).bit_length() - 1
                if fullest >= rest:
                    return bin_id, self.capacity - free
                self._take(fullest)
            self.by_free[rest].append(bin_id)
            self.mask |= 1 << rest
            self.count += 1
        return bin_id, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    open_bins: int = 8192,
    vocabulary: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where it comes from and where it lies."""
    path = vocabulary or bpe.default_vocabulary()

    def run(batches):
        from pyspark import TaskContext

        encode = bpe.encoder(path).ids
        bins = Bins(capacity, open_bins, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            pieces = []  # (length, order, doc, piece, start, crc)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py()).astype("<u4", copy=False), end])
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    pieces.append((length, -len(pieces), doc, k, start, zlib.crc32(ids[start : start + length].tobytes())))
            pieces.sort(key=lambda p: p[:2], reverse=True)
            if not pieces:
                continue
            placed = [bins.place(p[0]) for p in pieces]
            length, _, doc, k, start, crc = zip(*pieces)
            seq, offset = zip(*placed)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((doc, k, start, length, crc, seq, offset), _ARROW)], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
