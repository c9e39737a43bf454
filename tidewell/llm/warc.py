"""WARC archives: written as whole-file gzip streams, normalised, indexed, read back.

``write_archives`` writes one archive per partition as a single gzip stream, as many crawlers
do. ``normalise`` inflates each stream once, from start to end, writes every record
again as a gzip member of its own and beside the archive an index of the members'
offsets. ``read_back`` opens single members by the index.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest
``page_id`` is a response; the others are revisits that refer to it and hold no payload
(their HTTP header keeps its length). Smaller records are all responses.

Files go to the shared folder. A task writes under a name of its own attempt, and only
what a finished task reports is read, so lost executors and repeated tasks do no harm.

Defined cases: a null html is an empty payload; a null url is an empty target; a null
``page_id`` is only a response's if its whole group's are null; rows that share the
largest ``page_id`` are all responses; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import new_dir, settle, table

LEVEL = 3
PIECE = 1 << 18
DATE = "2024-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, page_id long, record_type string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
GZIP = 31  # zlib's window bits for a gzip wrapper


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def _uri(page_id: int | None, row: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:row:{row}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, row: str, revisit: bool) -> bytes:
    """One WARC record with an HTTP response as its block; a revisit's block ends with the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page_id, row)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to, row)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _page(uri: str | None) -> int | None:
    return int(uri[len("<urn:page:") : -1]) if uri and uri.startswith("<urn:page:") else None


def records_of(stream) -> Iterator[bytes]:
    """The records of a stream of gzipped WARC, inflated once; holds one record at a time."""
    inflate, held = zlib.decompressobj(GZIP), bytearray()
    need = -1

    def data() -> Iterator[bytes]:
        nonlocal inflate
        while piece := stream.read(PIECE):
            while piece:
                yield inflate.decompress(piece)
                piece = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(GZIP)

    for more in data():
        held += more
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(parse_head(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise ValueError("the archive ends within a record")


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Every page with its payload, digest and, for a revisit, the page it refers to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    keyed = keyed.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    groups = keyed.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("newest"))
    groups = settle(groups.where("n > 1 and newest is not null").select("sha1", "bytes", "newest"))
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return keyed.join(groups, ["sha1", "bytes"], "left").withColumn("revisit", revisit).select("page_id", "url", "payload", "sha1", "newest", "revisit")


def write_archives(planned: DataFrame, to: str) -> DataFrame:
    """Write one whole-file gzip archive per partition; a row ``(archive, n)`` for each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _open(to)
        path = f"{base}/whole-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        n, out, deflate = 0, None, zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(base)
                out = store.open_output_stream(path, compression=None)
            for k in range(batch.num_rows):
                page_id, url, payload, sha1, newest, revisit = (c[k].as_py() for c in batch.columns)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                out.write(deflate.compress(record(page_id, url, payload, digest, newest, f"{task.partitionId()}-{n}", revisit)))
                n += 1
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "n": [n]})

    return planned.mapInArrow(write, "archive string, n long")


def normalise(archives: DataFrame, to: str) -> DataFrame:
    """Rewrite each archive record by record, with an index beside it; the index's rows."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _open(to)
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                store.create_dir(base)
                name = f"{base}/{path.rsplit('/', 1)[1].replace('whole', 'members').removesuffix('.warc.gz')}-{task.taskAttemptId()}"
                rows: list[tuple] = []
                offset = 0
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(f"{name}.warc.gz", compression=None) as out:
                    for one in records_of(source):
                        head = parse_head(one[: one.find(b"\r\n\r\n")])
                        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = deflate.compress(one) + deflate.flush()
                        out.write(member)
                        rows.append((f"{name}.warc.gz", offset, len(member), _page(head["warc-record-id"]), head["warc-type"]))
                        offset += len(member)
                with store.open_output_stream(f"{name}.index", compression=None) as side:
                    side.write("".join(f"{o}\t{n}\t{'-' if p is None else p}\t{t}\n" for _, o, n, p, t in rows).encode())
                yield pa.RecordBatch.from_pydict(dict(zip(("archive", "offset", "length", "page_id", "record_type"), map(list, zip(*rows)))), schema=_INDEX)

    return archives.select("archive").mapInArrow(rewrite, INDEX)


_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string())])


def read_back(index: DataFrame, at: str) -> DataFrame:
    """What each indexed member says of its page; a response's digest is held against its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(at)
        for batch in batches:
            rows, name, source = [], None, io.BytesIO()
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    source.close()
                    name, source = archive, store.open_input_file(archive)
                source.seek(offset)
                one = zlib.decompress(source.read(length), GZIP)
                end = one.find(b"\r\n\r\n")
                head = parse_head(one[:end])
                block = one[end + 4 : end + 4 + int(head["content-length"])]
                cut = block.find(b"\r\n\r\n")
                size, payload = int(parse_head(block[:cut])["content-length"]), block[cut + 4 :]
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{archive} at {offset}: the payload is not what its record says")
                rows.append((_page(head["warc-record-id"]), size, digest, head["warc-type"], _page(head.get("warc-refers-to"))))
            source.close()
            columns = list(map(list, zip(*rows))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=list(_NAMES))

    return index.select("archive", "offset", "length").mapInArrow(read, RESULT)


_NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())


def archive(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write, normalise and index ``pages``: the whole archives' list and the members' index."""
    spark = pages.sparkSession
    to = new_dir(spark, "warc")
    write_archives(plan(pages, least_bytes), to).write.parquet(f"{to}/whole.parquet")
    archives = spark.read.parquet(f"{to}/whole.parquet")
    spread = archives.repartition(max(1, archives.count()))
    normalise(spread, to).write.parquet(f"{to}/members.parquet")
    return archives, spark.read.parquet(f"{to}/members.parquet")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = archive(table(spark, sf_dir, "pages"))
    return read_back(index, new_dir(spark, "warc"))
