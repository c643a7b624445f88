"""Token files: ids in fixed-width bit packing, with block offsets for random access.

Each id takes the fewest bits that hold the vocabulary. A file is, all integers little-endian:

    magic "FLTOK1\\0\\0" | blocks | documents: n x (id i64, null u8, first id u64) | block offsets: u64 each
    | tail: bits u32, ids per block u32, documents u64, ids u64, blocks u64, place of the documents u64, magic

A block holds BLOCK ids, the last one fewer, most significant bit first, padded to whole bytes.
The position of an id gives its block, so ids are read and unpacked (by numpy) from any place.

Files are written and read by the executors through pyarrow's file systems, in the shared folder.
A task names its file after its attempt and returns a row about it; the written table of these
rows is the index, so what a lost or repeated attempt has left behind is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import encoder

MAGIC = b"FLTOK1\0\0"
#: Ids in a block: a multiple of 8, so that each block ends on a byte.
BLOCK = 4096
_TAIL = struct.Struct("<IIQQQQ8s")
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("first", "<u8")])


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # whole bytes: the same result by a cast
        return ids.astype(f">u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(spread).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, 32 - bits :] = spread
    return np.packbits(whole, axis=1).view(">u4").reshape(n).astype("<u4")


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file as the ids come; holds a block and 17 bytes a document."""

    def __init__(self, uri: str, bits: int):
        system, path = file_system(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self._out, self._bits = system.open_output_stream(path, compression=None), bits
        self._out.write(MAGIC)
        self._rest, self._held, self._docs, self._offsets, self.n_ids = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id or 0, doc_id is None, self.n_ids))
        self.n_ids += len(ids)
        self._rest.append(ids)
        self._held += len(ids)
        if self._held >= 64 * BLOCK:
            self._flush(self._held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self._rest) if self._rest else np.zeros(0, "<u4")
        for at in range(0, n, BLOCK):
            self._offsets.append(self._out.tell())
            self._out.write(pack(ids[at : min(at + BLOCK, n)], self._bits))
        self._rest, self._held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self._held)
        place = self._out.tell()
        self._out.write(np.array(self._docs, _DOC).tobytes())
        self._out.write(np.array(self._offsets, "<u8").tobytes())
        self._out.write(_TAIL.pack(self._bits, BLOCK, len(self._docs), self.n_ids, len(self._offsets), place, MAGIC))
        self._out.close()


class Reader:
    """Reads a file's documents, in order or at random; holds its tables, not its ids."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self._file = system.open_input_file(path)
        end = self._file.size()
        self.bits, self.block, n_docs, self.n_ids, n_blocks, place, magic = _TAIL.unpack(self._at(end - _TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.docs = np.frombuffer(self._at(place, n_docs * _DOC.itemsize), _DOC)
        self._offsets = np.frombuffer(self._at(place + n_docs * _DOC.itemsize, n_blocks * 8), "<u8")
        self.bounds = np.append(self.docs["first"], np.uint64(self.n_ids)).astype(np.int64)

    def _at(self, offset: int, n: int) -> bytes:
        self._file.seek(offset)
        return self._file.read(n)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at places first to last, last exclusive; reads the blocks that hold them."""
        if first >= last:
            return np.zeros(0, "<u4")
        a, b = first // self.block, (last - 1) // self.block
        n = min((b + 1) * self.block, self.n_ids) - a * self.block
        found = unpack(self._at(int(self._offsets[a]), (n * self.bits + 7) // 8), self.bits, n)
        return found[first - a * self.block : last - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.bounds[k]), int(self.bounds[k + 1]))

    def __iter__(self) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        """(id, first place, number of ids, ids in parts) of each document in order."""
        at, held, step = 0, np.zeros(0, "<u4"), 256 * self.block
        for k, (doc_id, null, _) in enumerate(self.docs):
            first, last = int(self.bounds[k]), int(self.bounds[k + 1])

            def parts(place=first, last=last):
                nonlocal at, held
                while place < last:
                    if place >= at + len(held):
                        at, held = place, self.ids(place, min(place + step, self.n_ids))
                    upto = min(last, at + len(held))
                    yield held[place - at : upto - at]
                    place = upto

            yield None if null else int(doc_id), first, last - first, parts()

    def close(self) -> None:
        self._file.close()


def write_token_files(
    docs: DataFrame, tokenizer: str, end: int | None, id_col: str = "doc_id", text_col: str = "text", to: str | None = None
) -> DataFrame:
    """Write the ids of every text in ascending order of ``id_col``; returns the index of the files.

    The index has a row per file: part (their order), file, n_docs, n_ids, start (ids in the files
    before it). Null texts count as empty: such a document has the end id alone. Null ids come
    first; rows with equal ids follow one another in order of their texts, and repeated rows are
    written again. Other columns play no part. An empty table gives an index without documents.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = to or scratch.path("files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, n = TaskContext.get().partitionId(), None, 0
        code = encoder(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                if writer is None:
                    file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                    writer = Writer(file, bits_for(code.vocabulary))
                for doc_id, ids in zip(some.column(0).to_pylist(), code.encode(some.column(1).to_pylist(), end), strict=True):
                    writer.add(doc_id, np.frombuffer(ids, "<u4"))
                    n += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [file], "n_docs": [n], "n_ids": [writer.n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange("i", "h").sortWithinPartitions("i", "h", "t").select(F.col("i"), "t")
    index = scratch.cut(rows.mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "index")
    # one row per file; files are as many as partitions, never as documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return scratch.cut(index.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")), "starts")


def read_token_files(index: DataFrame) -> DataFrame:
    """Per document of the files of an index: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, rows = Reader(file), []
                for doc_id, first, n, parts in reader:
                    crc = 0
                    for part in parts:
                        crc = zlib.crc32(part, crc)
                    rows.append((doc_id, start + first, n, crc))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                reader.close()
                yield _batch(rows)

    files = index.count()
    return index.select("part", "file", "start").repartitionByRange(max(1, files), "part").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
