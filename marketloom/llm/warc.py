"""WARC archives: write, normalise a monolithic gzip stream to one member a record with an offset index, read back.

``write_archives`` writes each page as a WARC/1.1 record; an archive is what a crawler with plain gzip leaves: one
stream over the whole file.  ``normalise`` inflates each stream once, piece by piece, rewrites every record as a gzip
member of its own and writes a sidecar index (offset, length and heads of each record) beside it.  ``read_archives``
goes by the index: seek, inflate one member, check its digest.

Payloads of at least ``min_bytes`` that are equal are stored once: the largest page_id is the response, the others are
revisit records that refer to it.  Only digests shuffle to find them; the groups with copies are broadcast if their
table is small and joined by a shuffle if not.

Defined cases: a null html is an empty payload; a null url has no target URI; a null page_id is below all others (a
group of nulls alone stays response); rows with the same largest page_id and payload are all responses; extra columns
are ignored; an empty table writes no record.  Files appear under a temporary name and are renamed when complete, so a
task that is run again leaves one whole file.
"""

from __future__ import annotations

import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, new_path, save, settings, small_batches

END = "\r\n\r\n"
INDEX = "archive string, offset bigint, length bigint, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
PIECE = 1 << 20


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, body, payload_bytes, payload_digest, record_type, refers_to."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", body.alias("body"), F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha1(body.cast("binary")).alias("payload_digest"))
    copies = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null")
    copies = checked(save(copies.select("payload_digest", "top"), "copies"))
    revisit = F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id"))
    return rows.join(copies, "payload_digest", "left").select("page_id", "url", "body", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("top")).alias("refers_to"))


def _urn(page_id):
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def record_text(date: str) -> F.Column:
    """The whole record but its closing blank lines, as one string column."""
    response = F.col("record_type") == "response"
    http = F.when(response, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END), F.col("body"))).otherwise(F.lit("HTTP/1.1 200 OK" + END))
    uri = F.regexp_replace(F.regexp_replace("url", r"[\r\n\t ]+", "%20"), r"[\x00-\x1f]", "")
    heads = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.concat(F.lit("X-Refers-To-Page-Id: "), F.col("refers_to").cast("string")),
        F.concat(F.lit("X-Payload-Bytes: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("Content-Type: application/http; msgtype=response")),
        F.concat(F.lit("Content-Length: "), F.octet_length(http).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *heads), F.lit(END), http)


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", max_records: int = 20000) -> None:
    """One gzip stream a file; the record separator is the writer's line separator, so Spark's own sink writes WARC."""
    records.select(record_text(date).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max_records).mode("overwrite").text(path)


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(heads, whole record) of each record of an inflated WARC stream; holds one record at a time."""
    buf = bytearray()
    pieces = iter(pieces)
    done = False

    def more() -> None:
        nonlocal done
        piece = next(pieces, None)
        if piece is None:
            done = True
        else:
            buf.extend(piece)

    while True:
        while not done and len(buf) < 4:
            more()
        while buf[:2] == b"\r\n":
            del buf[:2]
        while (cut := buf.find(b"\r\n\r\n")) < 0 and not done:
            more()
        if cut < 0:
            if bytes(buf).strip():
                raise ValueError("the archive ends inside a record's heads")
            return
        lines = buf[:cut].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        heads = {"version": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = cut + 4 + int(heads["content-length"])
        while len(buf) < size + 4 and not done:
            more()
        if len(buf) < size:
            raise ValueError("the archive ends inside a record")
        yield heads, bytes(buf[:size]) + END.encode()
        del buf[: size + 4]


def inflated(source: bytes | BinaryIO, piece: int = PIECE) -> Iterator[bytes]:
    """A gzip file in pieces of bounded size, members after the first included; of a stream, one piece is held."""
    read = (io.BytesIO(source) if isinstance(source, bytes) else source).read
    one, left = None, b""
    while True:
        left = left or read(piece)
        if not left and one is None:
            return
        one = one or zlib.decompressobj(31)
        ended = not left
        out = one.decompress(left, piece)
        left = one.unused_data if one.eof else one.unconsumed_tail
        if ended and not out and not one.eof:
            raise ValueError("the gzip stream is cut off")
        if one.eof:
            one = None
        if out:
            yield out


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member without a time, so that a rerun writes the same bytes."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def payload_of(record: bytes) -> bytes:
    block = record[record.index(b"\r\n\r\n") + 4 : -4]
    return block[block.index(b"\r\n\r\n") + 4 :]


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _replace(fs: pafs.FileSystem, tmp: str, name: str) -> None:
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(name).type != pafs.FileType.NotFound:
        fs.delete_file(name)
    fs.move(tmp, name)


def _opened(path: str) -> BinaryIO:
    fs, name = _filesystem(path)
    return fs.open_input_stream(name, compression=None)


def _streamed(path: str) -> bool:
    """Whether workers can open the path themselves; one that only Spark reads comes as whole files."""
    try:
        _filesystem(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def _normalise(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(out)
        for batch in batches:
            contents = batch.column(1) if batch.num_columns > 1 else [None] * batch.num_rows
            for path, content in zip(batch.column(0).to_pylist(), contents, strict=True):
                name = hashlib.sha1(path.encode()).hexdigest()[:20]
                archive, attempt = f"{root}/{name}.warc.gz", hashlib.sha1(f"{path}{id(batch)}".encode()).hexdigest()[:8]
                tmp, rows, at = f"{archive}.{attempt}.tmp", [], 0
                with fs.open_output_stream(tmp) as sink, (_opened(path) if content is None else io.BytesIO(content.as_py())) as source:
                    for heads, record in split_records(inflated(source)):
                        data = member(record)
                        sink.write(data)
                        rows.append((name, at, len(data), _number(heads.get("x-page-id")), heads["warc-type"], int(heads["x-payload-bytes"]), heads["warc-payload-digest"].removeprefix("sha1:"), _number(heads.get("x-refers-to-page-id"))))
                        at += len(data)
                with fs.open_output_stream(f"{archive}.{attempt}.idx.tmp") as sink:
                    keys = [x.split()[0] for x in INDEX.split(", ")]
                    sink.write("".join(json.dumps(dict(zip(keys, r, strict=True))) + "\n" for r in rows).encode())
                _replace(fs, f"{archive}.{attempt}.idx.tmp", f"{archive}.idx")
                _replace(fs, tmp, archive)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([at], pa.int64())], names=["archive", "records", "bytes"])

    return run


def normalise(spark: SparkSession, source: str, out: str) -> DataFrame:
    """Rewrite every archive under ``source`` into ``out`` with its index; (archive, records, bytes) of each."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(out)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
    files = files.select("path") if _streamed(source) else files.select("path", "content")
    return save(files.mapInArrow(_normalise(out), "archive string, records bigint, bytes bigint"), "normalised", rows=1)


def _read(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    fs, root = _filesystem(out)
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with fs.open_input_stream(f"{root}/{name}.warc.gz.idx") as f:
                index = [json.loads(x) for x in f.read().splitlines()]
            with fs.open_input_file(f"{root}/{name}.warc.gz") as f:
                rows, held = [], 0
                for entry in index:
                    f.seek(entry["offset"])
                    record = zlib.decompress(f.read(entry["length"]), 31)
                    ((heads, whole),) = list(split_records(iter([record])))
                    payload = payload_of(whole)
                    size, digest = int(heads["x-payload-bytes"]), heads["warc-payload-digest"].removeprefix("sha1:")
                    if heads["warc-type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"record at {entry['offset']} of {name} does not hold its payload")
                    rows.append((_number(heads.get("x-page-id")), heads.get("warc-target-uri"), heads["warc-type"], size, digest, _number(heads.get("x-refers-to-page-id")), payload if heads["warc-type"] == "response" else None))
                    held += len(payload)
                    if held > 8 * PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(spark: SparkSession, archives: DataFrame, out: str) -> DataFrame:
    """Records of the normalised archives, each found by its index entry and checked against its digest; a task an
    archive."""
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(lambda it: _read(it, out), RECORD)


def archive_round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them, and return the records read back by the index."""
    spark = pages.sparkSession
    raw, out = new_path(spark, "warc-raw"), new_path(spark, "warc")
    small_batches(spark)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        write_archives(plan_records(pages, min_bytes), raw)
    done = normalise(spark, raw, out)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(raw)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return read_archives(spark, done, out)
