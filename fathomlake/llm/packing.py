"""Packing documents into sequences of bounded length by the sum-of-squares rule.

A bin's gap is the room that is left in it. Each piece goes where the sum, over all gaps, of the
squared number of open bins with that gap becomes smallest: gaps are kept varied, so that later
pieces find one that suits them. Pieces come longest first, and of equal choices the tightest bin
is taken.

Pieces are dealt at random into groups of bounded size, packed one per task. Each group has the
lengths of the whole, and leaves about one bin unfilled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import ROOM, encoder

SEQUENCE = 4096
#: Pieces per group, about: what one task packs.
GROUP = 16_384

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, placed in the order given; lengths are 1 to ``room``."""
    counts = np.zeros(room + 1, np.int64)  # open bins per gap; full bins are closed
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for k, n in enumerate(map(int, lengths)):
        fresh = 2 * counts[room - n] + 1 if n < room else 0
        gaps = np.flatnonzero(counts[n:])
        best = -1
        if len(gaps):
            change = 2 * (counts[gaps] - counts[gaps + n]) + 2
            if gaps[0] == 0:  # an exact fit closes the bin
                change[0] = 1 - 2 * counts[n]
            at = int(np.argmin(change))
            if change[at] <= fresh:
                best = int(gaps[at]) + n
        if best < 0:
            best, chosen = room, made
            made += 1
        else:
            chosen = open_bins[best].pop()
            counts[best] -= 1
        bins[k], offsets[k] = chosen, room - best
        if best > n:
            counts[best - n] += 1
            open_bins[best - n].append(chosen)
    return bins, offsets


def pieces_of(docs: DataFrame, tokenizer: str, end: int | None, room: int, id_col: str = "doc_id", text_col: str = "text", words: int = ROOM) -> DataFrame:
    """The pieces of every document: whole, or cut every ``room`` ids if it is longer."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, words)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some, rows = batch.slice(k, 256), []
                for doc_id, ids in zip(some.column(0).to_pylist(), code.encode(some.column(1).to_pylist(), end), strict=True):
                    for piece, at in enumerate(range(0, len(ids), 4 * room)):
                        part = ids[at : at + 4 * room]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = zip(*rows, strict=True) if rows else [()] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(cut, _PIECES)


def pack_documents(
    docs: DataFrame, tokenizer: str, end: int | None = 1, room: int = SEQUENCE,
    id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, words: int = ROOM,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: its document is the end id alone. Rows that repeat an id are
    documents of their own, null ids stay null, other columns play no part, and an empty table
    gives an empty one. With ``end`` None a document without ids has no piece. ``words`` bounds what
    the encoder remembers.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.cut(pieces_of(docs, tokenizer, end, room, id_col, text_col, words), "pieces")
    groups = max(1, -(-pieces.count() // group))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), room)
        frame = frame.assign(sequence_id=(frame["g"].to_numpy() << 32) + bins, offset=offsets)
        return frame.drop(columns="g")

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(place, _PIECES + ", sequence_id long, offset long")
