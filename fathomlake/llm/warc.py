"""WARC archives, indexed first and read by coalesced byte ranges.

Writing. Pages are deduplicated by payload: of equal payloads of at least ``least`` bytes one page
is archived as a response and the others as revisits of it. Each task writes its records, every one
a gzip member of its own, to a file named after its attempt, and returns a row per record: file,
offset, length, URL, digest. The written table of these rows is the index; a file that a lost or
repeated attempt has left behind is not in it.

Reading. The selected rows of the index are dealt out in order of file and offset; ranges that
follow one another closely are read at once, and cut into records again by the index.

Files are opened through pyarrow's file systems, in the shared folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .token_files import file_system

LEAST = 1000
#: Ranges at most GAP bytes apart are read together, up to RANGE bytes.
GAP, RANGE = 64 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
_ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame, id_col: str, payload_col: str, url_col: str, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, digest, copy, revisit, refers_to, refers_url.

    Payloads are equal if their lengths, SHA-1 and SHA-256 all are. Of equal ones the page with the largest
    id, then URL, is the response. Pages that repeat id, URL and payload are told apart by ``copy``, from 1.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    keys = (F.octet_length(text).cast("long").alias("n"), F.sha1(text).alias("d"), F.sha2(text, 256).alias("d2"))
    own = (F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), *keys)
    scratch = Scratch(pages.sparkSession, "pages")
    alike = ["i", "u", "n", "d", "d2"]
    repeated = scratch.cut(pages.select(*own).groupBy(*alike).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "repeated")
    rows = pages.select(*own, text.alias("t"))
    once = rows.withColumn("copy", F.lit(1).cast("long"))
    if not repeated.isEmpty():
        other = repeated.select(*(F.col(c).alias(f"{c}_") for c in alike), "copies")
        same = (F.col("d2") == F.col("d2_")) & F.col("i").eqNullSafe(F.col("i_")) & F.col("u").eqNullSafe(F.col("u_"))
        again = rows.join(other, same).groupBy(*alike, "copies").agg(F.min("t").alias("t"))
        again = again.select(*alike, "t", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        once = once.join(other, same, "left_anti").unionByName(again)
    best = (
        pages.select(*own)
        .where(F.col("n") >= least)
        .groupBy("n", "d", "d2")
        .agg(F.max(F.struct(F.coalesce("i", F.lit(-(1 << 63))), F.col("u").isNotNull(), "i", "u")).alias("o"), F.count(F.lit(1)).alias("c"))
        .where("c > 1")
        .select("n", "d", "d2", F.col("o.i").alias("bi"), F.col("o.u").alias("bu"), F.lit(True).alias("several"))
    )
    first = F.col("i").eqNullSafe(F.col("bi")) & F.col("u").eqNullSafe(F.col("bu")) & (F.col("copy") == 1)
    revisit = F.coalesce("several", F.lit(False)) & ~first
    return once.join(best, ["n", "d", "d2"], "left").select(
        F.col("i").alias("page_id"), F.col("u").alias("url"), F.when(~revisit, F.col("t")).alias("payload"),
        F.col("n").alias("payload_bytes"), F.col("d").alias("digest"), "copy",
        revisit.alias("revisit"), F.when(revisit, F.col("bi")).alias("refers_to"), F.when(revisit, F.col("bu")).alias("refers_url"),
    )


def record_id(page_id: int | None, url: str | None, digest: str, copy: int = 1) -> str:
    """The id of a record; pages that repeat id, URL and payload differ in ``copy``."""
    key = json.dumps([page_id, url, digest, copy])
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(key.encode()).hexdigest())}>"


def _uri(url: str | None) -> str | None:
    return None if url is None else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)


def record(
    page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str,
    refers_to: int | None = None, refers_url: str | None = None, copy: int = 1,
) -> bytes:
    """One record as a gzip member; no payload makes it a revisit of the record of ``refers_to`` and ``refers_url``."""
    revisit = payload is None
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, url, digest, copy),
        "WARC-Date": DATE,
        "WARC-Target-URI": _uri(url),
        "WARC-Refers-To": record_id(refers_to, refers_url, digest) if revisit else None,
        "WARC-Refers-To-Target-URI": _uri(refers_url) if revisit else None,
        "WARC-Refers-To-Date": DATE if revisit else None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "X-Page-ID": page_id,
        "X-Payload-Length": n,
        "X-Refers-To-Page": refers_to,
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": len(payload or b""),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + (payload or b"") + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; checks the length, and the digest of a response."""
    plain = zlib.decompress(data, 31)
    top, _, rest = plain.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(head["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"not a whole record: {top[:80]!r}")
    if head["WARC-Type"] == "response" and "sha1:" + hashlib.sha1(block).hexdigest() != head["WARC-Payload-Digest"]:
        raise ValueError(f"the payload differs from its digest: {head['WARC-Record-ID']}")
    return head, block


def write_warc(
    pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = LEAST, to: str | None = None
) -> DataFrame:
    """Archive every row of ``pages`` and return the index (INDEX), a row per record.

    A null payload is an empty one, a null URL or id is left out of its record, null ids are
    smallest. Repeated rows get a record each, with an id of its own. A very long payload is one
    record. Other columns play no part. An empty table gives an empty index.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = to or scratch.path("files")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        file = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            if out is None:
                system, path = file_system(file)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            rows = []
            for page_id, url, payload, n, digest, copy, revisit, refers_to, refers_url in batch.itertuples(index=False, name=None):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                data = record(page_id, url, None if revisit else payload.encode(), n, digest, refers_to, refers_url, copy)
                rows.append((page_id, file, out.tell(), len(data), url, digest, "revisit" if revisit else "response"))
                out.write(data)
            frame = pd.DataFrame(rows, columns=["page_id", "file", "offset", "length", "url", "digest", "record_type"])
            yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return scratch.cut(plan_records(pages, id_col, payload_col, url_col, least).mapInPandas(write, INDEX), "index")


def read_warc(index: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the rows of ``index`` (any selection of them), read from the archives.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for
    (null for revisits). Rows that repeat in ``index`` are read again.
    """

    def cut(file, data: bytes, start: int, run: list[tuple[int, int]]) -> Iterator[tuple]:
        for offset, length in run:
            head, block = parse_record(data[offset - start : offset - start + length])
            whole = lambda k, head=head: int(head[k]) if k in head else None
            kind = head["WARC-Type"]
            row = (
                whole("X-Page-ID"), head.get("WARC-Target-URI"), whole("X-Payload-Length"),
                head["WARC-Payload-Digest"].removeprefix("sha1:"), kind, whole("X-Refers-To-Page"),
            )
            yield (*row, block.decode() if kind == "response" else None) if keep_payload else row

    names = [x.split()[0] for x in _ROWS.split(", ")] + ["payload"] * keep_payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, opened = None, None
        for batch in batches:
            rows: list[tuple] = []
            run: list[tuple[int, int]] = []

            def flush():
                if run:
                    start, end = run[0][0], max(o + n for o, n in run)
                    opened.seek(start)
                    rows.extend(cut(name, opened.read(end - start), start, run))
                    run.clear()

            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
                if file != name:
                    flush()
                    if opened is not None:
                        opened.close()
                    system, path = file_system(file)
                    name, opened = file, system.open_input_file(path)
                elif run and (offset > run[-1][0] + run[-1][1] + GAP or offset + length > run[0][0] + RANGE):
                    flush()
                run.append((offset, length))
                if len(rows) >= 1000:
                    yield _frame(rows, names)
                    rows.clear()
            flush()
            yield _frame(rows, names)
        if opened is not None:
            opened.close()

    places = index.select("file", "offset", "length")
    parts = (index.agg(F.sum("length")).first()[0] or 0) // (8 * RANGE) + 1  # tasks by bytes to read, not by rows of the index
    return places.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInPandas(
        read, _ROWS + (", payload string" if keep_payload else "")
    )


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})
