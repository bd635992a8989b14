"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by id into parts of about TASK_BYTES of payload. The bounds of the parts come from exact sums
of bytes over ranges of ids, halved until none is too large, so that the same rows give the same files, however they are
dealt over tasks. Within a part files are rolled by compressed size. Every file is first written under a temporary name that holds the task's attempt, and is listed in a manifest;
Spark commits the rows of one attempt per task, and only files in the committed manifest are renamed to their final,
deterministic names. A lost executor so costs its task's files, and a repeated rename finds its work done. Headers
(lengths, payload and block digests, record ids) are regenerated from the payloads. The reader checks every file
against the manifest's SHA-256 and every payload against its header.

Of records with equal payloads of at least `least` bytes the one with the smallest id is a response; the others are
revisits that refer to it and carry no payload.

Defined cases: a null payload is empty; a null or empty URL becomes about:blank, and line breaks in URLs are escaped;
of rows with the same id and payload the first in URL order is the response, the others revisit that id; a row without
id takes part with no id, and is a revisit only if another row of its payload has an id; other columns are ignored; an
empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column, forget, fresh_path, remove, stored, sub_batches
from .skew import heavy, skew_join

#: Compressed bytes at which a file is rolled, and raw bytes of payload for one part.
ROLL_BYTES, TASK_BYTES = 8 << 20, 64 << 20
#: Bits of the id by which a range that is too large is divided.
DIVIDE_BITS = 6
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
DATE = "2026-01-01T00:00:00Z"

MANIFEST = "part int, seq int, temp string, name string, records bigint, bytes bigint, sha256 string"


def _open(uri: str):
    """A file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{page_id}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time stamp."""
    headers = [*headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in headers)]).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _record(headers, http if revisit else http + payload)


class _Rolling:
    """Writes records to files under temporary names and closes each at the size limit."""

    def __init__(self, folder: str, part: int, attempt: str, roll: int) -> None:
        self.fs, self.root = _open(folder)
        self.part, self.attempt, self.roll, self.seq, self.out = part, attempt, roll, 0, None
        self.fs.create_dir(self.root, recursive=True)

    def add(self, record: bytes) -> Iterator[dict]:
        if self.out is None:
            self.temp = f".tmp-{self.part:06d}-{self.seq:05d}-{self.attempt}"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temp}", compression=None)
            self.sha, self.n, self.records = hashlib.sha256(), 0, 0
            info = f"software: tessera\r\nformat: {VERSION}\r\n".encode()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'file/{self.part}/{self.seq}')}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info))
        self._put(record)
        self.records += 1
        if self.n >= self.roll:
            yield from self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.n += len(data)

    def close(self) -> Iterator[dict]:
        if self.out is not None:
            self.out.close()
            yield {"part": self.part, "seq": self.seq, "temp": self.temp, "name": f"pages-{self.part:06d}-{self.seq:05d}.warc.gz", "records": self.records, "bytes": self.n, "sha256": self.sha.hexdigest()}
            self.out, self.seq = None, self.seq + 1


def _ordered(ids: Column) -> Column:
    """Ids as bit patterns whose unsigned order is theirs; no id comes first."""
    return F.coalesce(ids, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))


def _prefix(pattern: Column, bits: int) -> Column:
    return F.lit(0).cast("bigint") if bits == 0 else F.shiftrightunsigned(pattern, 64 - bits)


def parts_of(rows: DataFrame, task_bytes: int) -> list[tuple[int, int, int]]:
    """(bits, prefix, part): ranges of ids, as leading bits of their patterns, in order, and the part that each is in.

    rows is (id, n bytes). A range of more than task_bytes is divided until it is one id, so that there are at most
    2 ** DIVIDE_BITS ranges for each task_bytes. Only their sums are collected.
    """
    sized = rows.select(_ordered(F.col("id")).alias("u"), "n")
    ends = sized.agg(F.min(F.col("u").bitwiseXOR(F.lit(-(1 << 63)))).alias("a"), F.max(F.col("u").bitwiseXOR(F.lit(-(1 << 63)))).alias("b"), F.sum("n").alias("n")).first()
    if ends["a"] is None:
        return []
    low, high = ends["a"] + (1 << 63), ends["b"] + (1 << 63)
    bits = 64 - (low ^ high).bit_length()
    done, now = [], [(bits, low >> (64 - bits), ends["n"])]
    while now:
        done += [x for x in now if x[2] <= task_bytes or x[0] == 64]
        large = [x[1] for x in now if x[2] > task_bytes and x[0] < 64]
        if not large:
            break
        was, bits = bits, min(64, bits + DIVIDE_BITS)
        wanted = rows.sparkSession.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in large], "p bigint")
        inside = sized.withColumn("p", _prefix(F.col("u"), was)).join(F.broadcast(wanted), "p")
        now = [(bits, r["p"] % (1 << 64), r["n"]) for r in inside.groupBy(_prefix(F.col("u"), bits).alias("p")).agg(F.sum("n").alias("n")).collect()]
    out, part, held = [], 0, 0
    for bits, prefix, n in sorted(done, key=lambda x: x[1] << (64 - x[0])):
        if held and held + n > task_bytes:
            part, held = part + 1, 0
        held += n
        out.append((bits, prefix, part))
    return out


def _dealt(rows: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """rows with their part, one part after the other in tasks of their own, sorted."""
    spark, part = rows.sparkSession, F.lit(None).cast("int")
    for i, bits in enumerate(sorted({b for b, _, _ in ranges})):
        level = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, n) for b, p, n in ranges if b == bits], f"p{i} bigint, part{i} int")
        rows = rows.join(F.broadcast(level), _prefix(_ordered(F.col("id")), bits) == F.col(f"p{i}"), "left")
        part = F.coalesce(part, f"part{i}")
    rows = rows.select("id", "url", "html", "n", "digest", "first", part.alias("part"))
    return rows.repartitionById(max(1, ranges[-1][2] + 1 if ranges else 1), F.coalesce("part", F.lit(0))).sortWithinPartitions("part", "id", "digest", "url")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, roll_bytes: int = ROLL_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Writes all rows to files in folder and commits them; returns the manifest."""
    spark = pages.sparkSession
    text = F.coalesce(column(payload_col).cast("string"), F.lit(""))
    rows = pages.select(column(id_col).cast("bigint").alias("id"), column(url_col).cast("string").alias("url"), text.alias("html")).withColumns({"n": F.octet_length("html").cast("bigint"), "digest": F.sha2("html", 256)})
    firsts = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("many"))
    firsts = stored(firsts.where("many > 1"), "repeats")
    sized = stored(rows.select("id", "n"), "sizes")
    hot = heavy(firsts, "digest", "many", sized.count())
    # on a repeated payload only rows that may become the response carry it on
    rows = skew_join(rows, firsts.select("digest", "first"), "digest", hot, "left").withColumn("other", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    rows = rows.withColumn("html", F.when(F.col("other"), F.lit("")).otherwise(F.col("html")))
    ranges = parts_of(sized, task_bytes)
    # whole numbers with nulls travel as text, as pandas has only doubles for them
    rows = _dealt(rows, ranges).withColumns({"id": F.col("id").cast("string"), "first": F.col("first").cast("string")})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt, out, made, last = uuid.uuid4().hex[:12], None, [], None
        for f in sub_batches(frames, "html"):
            for r in f.itertuples(index=False):
                if out is None or out.part != r.part:
                    made += out.close() if out else []
                    out = _Rolling(folder, int(r.part), attempt, roll_bytes)
                page, first = (None if x is None else int(x) for x in (r.id, r.first))
                refers = first if first is not None and (page != first or last == (page, r.digest)) else None
                last = (page, r.digest)
                made += out.add(page_record(page, r.url, r.html.encode("utf-8", "surrogatepass"), r.digest, int(r.n), refers))
        made += out.close() if out else []
        yield pd.DataFrame(made, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    manifest = stored(rows.mapInPandas(work, MANIFEST), "manifest")
    parts = len({p for _, _, p in ranges})
    forget(firsts, sized)

    def rename(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        from pyarrow.fs import FileType

        for f in frames:
            for temp, name in zip(f["temp"], f["name"], strict=True):
                if fs.get_file_info(f"{root}/{temp}").type != FileType.NotFound:
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
            yield f

    files = max(1, min(spark.sparkContext.defaultParallelism * 4, parts))
    done = manifest.repartition(files, "name").mapInPandas(rename, MANIFEST)
    done.write.parquet(f"{folder}/_manifest")
    _drop_temporary(spark, folder)
    return spark.read.schema(done.schema).parquet(f"{folder}/_manifest")


def _drop_temporary(spark: SparkSession, folder: str) -> None:
    """What failed attempts have left."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/.tmp-*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    for x in found or ():
        remove(spark, x.getPath().toString())


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if line.strip() != VERSION.encode():
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip()] = value.strip()
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut short")
        if headers.get("WARC-Block-Digest", "") != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError("a block doesn't match its digest")
        yield headers, block


class _Hashing(io.RawIOBase):
    """A readable stream that digests what passes."""

    def __init__(self, raw) -> None:
        self.raw, self.sha = raw, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.raw.read(len(buffer))
        buffer[: len(data)] = data
        self.sha.update(data)
        return len(data)


PAGE = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per page record: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    spark = manifest.sparkSession
    arrow = to_arrow_schema(spark.createDataFrame([], PAGE).schema)

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for f in batches:
            for name, sha in zip(f.column(0).to_pylist(), f.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    hashing, rows, size = _Hashing(raw), [], 0
                    buffered = io.BufferedReader(hashing, 1 << 20)
                    for headers, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=buffered))):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload doesn't match its headers")
                        number = lambda key: int(headers[key]) if key in headers else None
                        rows.append((number("X-Page-ID"), headers["WARC-Target-URI"], payload if kind == "response" else None, n, digest, kind, number("X-Refers-To-Page-ID")))
                        size += len(block)
                        if size >= 1 << 22:
                            yield batch(rows)
                            rows, size = [], 0
                    while buffered.read(1 << 20):
                        pass
                    if hashing.sha.hexdigest() != sha:
                        raise ValueError(f"{name} isn't the file that was committed")
                    yield batch(rows)

    files = max(1, spark.sparkContext.defaultParallelism * 4)
    return manifest.select("name", "sha256").repartition(files, "name").mapInArrow(work, PAGE)


def round_trip(pages: DataFrame, **more) -> DataFrame:
    """Writes the pages to a new folder of the shared storage and reads the archive back, without the payloads."""
    folder = fresh_path(pages.sparkSession, "warc")
    back = read(write(pages, folder, **more), folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
