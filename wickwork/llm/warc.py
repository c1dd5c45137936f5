"""WARC archives: monolithic gzip files, their normaliser, and reading by index.

Archives go to the folder that all executors share, through pyarrow's file systems. A task names its files after
itself and a fresh id, and later steps read only the files that finished tasks have reported, so a
retried task leaves no double records. write_monolithic() makes files that are one gzip stream each, normalise() inflates
each such stream once, writes every record as a gzip member of its own and an index of offsets beside it, and
read_archives() reads records back through the index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import scratch_path, shared_dir

VERSION = b"WARC/1.1"
#: Payloads shorter than this are stored again each time; uncompressed bytes of one archive file.
LEAST_REVISIT, ARCHIVE_BYTES = 1000, 64 << 20
#: Files hold at least this share of all pages' copies to count as a hot payload: at most 1000 payloads.
HOT_SHARE = 0.001
LEVEL = 1
MANIFEST = "path string, records long"


def _open(path: str):
    fs, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, name


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record."""
    head = [VERSION, *(f"{k}: {v}".encode() for k, v in fields), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def split_records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of inflated bytes into whole records, the blank lines after each included."""
    held = b""
    for part in stream:
        held += part
        at = 0
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            head = held[at:end].lower()
            place = head.index(b"content-length:") + 15
            size = int(head[place:].split(b"\r\n", 1)[0])
            after = end + 4 + size + 4
            if after > len(held):
                break
            yield held[at:after]
            at = after
        held = held[at:]
    if held.strip():
        raise ValueError("a truncated WARC record")


def inflated(file, piece: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's bytes, in pieces; files of several members too."""
    engine = zlib.decompressobj(31)
    while data := file.read(piece):
        while data:
            yield engine.decompress(data)
            data = engine.unused_data
            if data or engine.eof:
                engine = zlib.decompressobj(31)
    tail = engine.flush()
    if tail:
        yield tail


def page_fields(page_id, url, digest: bytes, size: int, refers_to) -> list[tuple[str, str]]:
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(url.split())))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    fields.append(("X-Payload-Length", str(size)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    return fields


def with_originals(pages: DataFrame, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """Adds _digest (SHA-1 in hex), _size and refers_to: of pages with equal payloads of at least least_bytes, those below the largest page_id refer to it.

    Payloads with many copies, at most 1 / HOT_SHARE of them, are looked up by broadcast; all others are joined by digest.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    base = pages.withColumn("_digest", F.sha1(body)).withColumn("_size", F.octet_length(body).cast("long"))
    large = base.where(F.col("_size") >= least_bytes).groupBy("_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").checkpoint()
    total = pages.count()
    hot = large.where(F.col("_n") >= max(2, total * HOT_SHARE)).select("_digest", F.col("_first").alias("_hot"))
    rest = large.where(F.col("_n") < max(2, total * HOT_SHARE)).select("_digest", "_first")
    found = base.join(F.broadcast(hot), "_digest", "left")
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))  # a key that meets nothing, spread evenly
    found = found.withColumn("_key", F.when(F.col("_hot").isNull() & (F.col("_size") >= least_bytes), F.col("_digest")).otherwise(alone)).join(rest.withColumnRenamed("_digest", "_key"), "_key", "left")
    first = F.coalesce("_hot", "_first")
    return found.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") < first, first.isNotNull()), first)).drop("_key", "_hot", "_first")


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html, _digest, _size, refers_to) as WARC files that are one gzip stream each; a manifest of the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, made, written, count = None, [], 0, 0
        for pdf in batches:
            for page_id, url, html, size, digest, ref in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["_size"], pdf["_digest"], pdf["refers_to"]):
                if out is None:
                    fs, name = _open(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    out, engine, written, count = fs.open_output_stream(name, compression=None), zlib.compressobj(LEVEL, wbits=31), 0, 0
                    made.append(name)
                block = b"" if ref is not None else (html or "").encode("utf-8")
                data = record(page_fields(page_id, url, bytes.fromhex(digest), size, ref), block)
                out.write(engine.compress(data))
                written, count = written + len(data), count + 1
                if written >= ARCHIVE_BYTES:
                    out.write(engine.flush())
                    out.close()
                    yield pd.DataFrame({"path": [made[-1]], "records": [count]})
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pd.DataFrame({"path": [made[-1]], "records": [count]})

    _open(folder)[0].create_dir(_open(folder)[1])
    number = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  pandas would turn integers beside nulls into floats
    needed = pages.select(number("page_id"), "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "_size", "_digest", number("refers_to"))
    return needed.mapInPandas(run, MANIFEST).checkpoint()


def normalise(manifest: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrite each archive with a gzip member a record, and write its index (offset, length, a line a record) beside it; a manifest of the new files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                fs, _ = _open(folder)
                name = f"{_open(folder)[1]}/{uuid.uuid4().hex}"
                at, lines = 0, []
                with fs.open_input_stream(path, compression=None) as file, fs.open_output_stream(name + ".warc.gz", compression=None) as out:
                    for data in split_records(inflated(file)):
                        engine = zlib.compressobj(LEVEL, wbits=31)
                        member = engine.compress(data) + engine.flush()
                        out.write(member)
                        lines.append(f"{at} {len(member)}\n")
                        at += len(member)
                with fs.open_output_stream(name + ".idx", compression=None) as out:
                    out.write("".join(lines).encode())
                yield pd.DataFrame({"path": [name + ".warc.gz"], "records": [len(lines)]})

    _open(folder)[0].create_dir(_open(folder)[1])
    return spread(manifest).mapInPandas(run, MANIFEST).checkpoint()


def spread(manifest: DataFrame) -> DataFrame:
    """One file a task, for the first few hundred."""
    spark = manifest.sparkSession
    return manifest.repartition(max(spark.sparkContext.defaultParallelism, 64 * spark.sparkContext.defaultParallelism if manifest.count() > 1000 else 0))


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of normalised archives, each inflated by its index entry; digests are those of the payload read, or the field of a revisit."""
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                fs, _ = _open(folder)
                with fs.open_input_stream(path[: -len(".warc.gz")] + ".idx", compression=None) as file:
                    index = [tuple(map(int, x.split())) for x in file.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(path) as file:
                    for offset, size in index:
                        fields, block = parse(zlib.decompress(file.read_at(size, offset), wbits=31))
                        kind = fields["warc-type"]
                        digest = hashlib.sha1(block).digest() if kind == "response" else base64.b32decode(fields["warc-payload-digest"][5:])
                        if kind == "response" and base64.b32encode(digest).decode() != fields["warc-payload-digest"][5:]:
                            raise ValueError(f"{path}: the record at {offset} does not have the payload that it names")
                        number = lambda k: int(fields[k]) if k in fields else None
                        rows.append((number("x-page-id"), fields.get("warc-target-uri"), int(fields["x-payload-length"]), digest.hex(), kind, number("x-refers-to-page-id"), *[block][:payloads]))
                        if len(rows) == 1000:
                            yield _frame(rows, kinds)
                            rows = []
                yield _frame(rows, kinds)

    return spread(manifest).mapInPandas(run, kinds)


def _frame(rows: list[tuple], kinds: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in kinds.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def archive_round_trip(pages: DataFrame, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) as monolithic archives, normalise them, and read all records back.

    Null html is an empty payload, a null url is left out, and a null page_id stays null and is smaller than any other. Repeated rows have a record each;
    all rows that have the largest page_id of a payload are responses. Other columns are not stored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    shared_dir(spark)
    first, second = _uri(scratch_path(spark, "warc-monolithic")), _uri(scratch_path(spark, "warc"))
    raw = write_monolithic(with_originals(pages.select("page_id", "url", "html"), least_bytes), first)
    done = normalise(raw, first, second)
    _open(first)[0].delete_dir(_open(first)[1])
    return read_archives(done, second, payloads=False)
