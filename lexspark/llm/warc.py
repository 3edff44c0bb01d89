"""WARC archives: writing, normalising of whole-file gzip streams, and reading by an offset index.

A whole-file gzip stream can only be read from its start. The normaliser inflates such a stream
once, piece by piece, writes every record again as a gzip member of its own, and writes a sidecar
index with each member's place, so that readers can start at any record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, map_batches, materialize, shared_path

#: Raw bytes after which a writer starts another archive; bounds the work of one normalising task.
ARCHIVE_BYTES = 32 << 20
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1_000
PIECE = 1 << 20
#: Ending of the file that lists where each record of an archive starts.
SIDECAR = ".idx"
#: A payload that more than this share of the repeated pages have is hot, so fewer than 1 / HOT_SHARE are.
HOT_SHARE = 0.001
_WARC, _END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Fixed value: the profile of a revisit with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(path: str):
    """The store of a path, and the path in it; any store that pyarrow knows."""
    return pyarrow.fs.FileSystem.from_uri(path)


# --- records -----------------------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A response record, or a revisit record without the payload if ``refers_to`` is given."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", digest),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head.append(("Content-Length", str(len(block))))
    return _WARC + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + _END


def headers(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first line is left out."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def inflated(stream) -> Iterator[bytes]:
    """A gzip file's bytes piece by piece; several members after one another are one stream."""
    inflater = zlib.decompressobj(31)
    while data := stream.read(PIECE):
        while data:
            yield inflater.decompress(data, PIECE)
            data = inflater.unconsumed_tail
            if inflater.eof:
                data = inflater.unused_data
                inflater = zlib.decompressobj(31)
    if rest := inflater.flush():
        yield rest


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and bytes of each record; holds one record and one piece at a time."""
    have = bytearray()
    more = True

    def need(n: int) -> bool:
        nonlocal more
        while len(have) < n and more:
            piece = next(pieces, None)
            more = piece is not None
            have.extend(piece or b"")
        return len(have) >= n

    while True:
        while need(1) and have[:1] in (b"\r", b"\n"):
            del have[:1]
        if not need(1):
            return
        done = 0  # bytes searched for the end of the head
        while (at := have.find(_END, max(0, done - 3))) < 0:
            done = len(have)
            if not need(done + 1):
                raise ValueError("a record's head does not end")
        head = headers(bytes(have[:at]))
        total = at + 4 + int(head["content-length"])
        if not need(total):
            raise ValueError("a record ends before its length")
        yield head, bytes(have[:total])
        del have[:total]


# --- writing, normalising, reading -------------------------------------------------------------


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, size, n, made = None, "", 0, 0, []
        gz = zlib.compressobj(1, zlib.DEFLATED, 31)

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(gz.flush())
                out.close()
                made.append((path, n))
                out = None

        for batch in batches:
            for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if out is None:
                    path, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    store, inner = _store(path)
                    out = store.open_output_stream(inner, compression=None)
                raw = record(None if pd.isna(page_id) else int(page_id), url, (html or "").encode("utf-8", "surrogatepass"), None if pd.isna(refers_to) else int(refers_to))
                out.write(gz.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pd.DataFrame(made, columns=["archive", "records"])

    return run


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``pages(page_id, url, html, refers_to)`` to whole-file gzip archives; ``(archive, records)`` of those written.

    File names are new for each attempt of a task, so a repeated task leaves a file that is in no
    row and never a half-written one that is.
    """
    store, inner = _store(folder)
    store.create_dir(inner, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return materialize(map_batches(rows, _writer(folder, archive_bytes), "archive string, records long"), "archives")


def _normaliser(folder: str, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch["archive"]:
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                store, inner = _store(source)
                to, to_inner = _store(target)
                n, offset = 0, 0
                with store.open_input_stream(inner, compression=None) as stream, to.open_output_stream(to_inner, compression=None) as out, to.open_output_stream(to_inner + SIDECAR, compression=None) as side:
                    for head, raw in records(inflated(stream)):
                        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = gz.compress(raw + _END) + gz.flush()
                        out.write(member)
                        entry = {"archive": target, "record_id": head.get("warc-record-id", ""), "record_type": head.get("warc-type", ""), "offset": offset, "length": len(member)}
                        side.write((json.dumps(entry) + "\n").encode())
                        n, offset = n + 1, offset + len(member)
                yield pd.DataFrame([(target, n)], columns=["archive", "records"])

    return run


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """``archives(archive)`` of whole-file gzip to archives of one member a record in ``folder``, each with a sidecar ``.idx``.

    Returns ``(archive, records)`` of the archives written. A repeated task writes new names, so a
    file that is in no row is of a lost attempt.
    """
    store, inner = _store(folder)
    store.create_dir(inner, recursive=True)
    spread = archives.select("archive").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 2), "archive")
    return materialize(map_batches(spread, _normaliser(folder, level), "archive string, records long"), "normalised")


def index(archives: DataFrame, folder: str) -> DataFrame:
    """``(archive, record_id, record_type, offset, length)`` from the sidecars in ``folder`` of ``archives(archive)``."""
    entries = archives.sparkSession.read.schema("archive string, record_id string, record_type string, offset long, length long").json(folder, pathGlobFilter="*" + SIDECAR)
    return entries.join(archives.select("archive"), "archive", "left_semi")


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for archive, part in batch.sort_values(["archive", "offset"]).groupby("archive", sort=False):
            store, inner = _store(archive)
            with store.open_input_file(inner) as file:
                for offset, length in zip(part["offset"], part["length"], strict=True):
                    head, raw = next(records(iter([zlib.decompress(file.read_at(int(length), int(offset)), 31)])))
                    block = raw[raw.index(b"\r\n\r\n") + 4 :]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(headers(http)["content-length"])
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"the payload at {archive}:{offset} is not what its record says")
                    number = lambda name, head=head: head.get(name, "").removeprefix("<urn:page:").rstrip(">") or None
                    rows.append((number("warc-record-id"), size, digest, head["warc-type"], number("warc-refers-to"), head.get("warc-target-uri"), archive, offset, length))
        yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "offset", "length"])


def read(index: DataFrame) -> DataFrame:
    """Every record of an index, each inflated on its own and its payload checked against its digest."""
    spread = index.select("archive", "offset", "length").repartition(max(1, index.sparkSession.sparkContext.defaultParallelism * 2), "archive")
    out = map_batches(spread, _reader, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, archive string, offset long, length long")
    return out.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def marked(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages(page_id, url, html)`` with ``refers_to``: of equal payloads from ``least_bytes`` on, the largest page_id if another page has it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.when(F.col("bytes") >= least_bytes, F.sha2("html", 256)))
    last = materialize(keyed.where("digest is not null").groupBy("digest", "bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1"), "payloads")
    # Pages with a hot payload, or one too short to look up, stay where they are; no other payload is a hot key.
    share = F.lit((last.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)
    hot = F.broadcast(last.where(F.col("n") > share).select("digest", "bytes", F.col("top").alias("hot_top")))
    known = keyed.join(hot, ["digest", "bytes"], "left")
    near = known.where("digest is null or hot_top is not null").withColumn("top", F.col("hot_top"))
    far = known.where("digest is not null and hot_top is null").join(last.where(F.col("n") <= share).drop("n"), ["digest", "bytes"], "left")
    columns = ["page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to")]
    return near.select(*columns).unionByName(far.select(*columns))


def archive(pages: DataFrame, least_bytes: int = REVISIT_BYTES, keep: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC, normalise the archives, and read them back.

    Returns ``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` and the place of
    each record. The normalised archives stay in ``keep``, by default a new shared folder.

    A null page has an empty payload; one of any length is one record. Repeated rows with one id are all responses if theirs is the
    largest id of the payload. A row without id refers to the largest id as others do, and is a
    response where no row of its payload has one. An empty table gives an empty result.
    """
    spark: SparkSession = pages.sparkSession
    raw, folder = shared_path(spark, "warc-stream"), keep or shared_path(spark, "warc")
    made = normalise(write(marked(pages, least_bytes), raw, archive_bytes), folder)
    delete(spark, raw)
    return read(index(made, folder))
