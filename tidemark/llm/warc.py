"""Deterministic sharded WARC archives.

Pages are ordered by id and cut into shards of about equal size at ids that follow from the data
alone, so that the same table always gives the same files, bytes included. Within a shard the
writer regenerates every header and digest from the payload, compresses each record as a gzip
member of its own, and starts a new file when the compressed size reaches ``file_bytes``.

Files are written under temporary names of the task attempt. Each attempt reports what it wrote
as rows of a manifest that Spark commits, so of repeated attempts one counts; a second job moves
the reported files to their final names and can be repeated itself; the final manifest, written
last, makes the archive complete. Files that no manifest names are not part of it.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the largest page
id is a response and the others are revisits of it. Which these are is found on digests; the
payloads cross the network once, to be ordered, together with the marks of their revisits.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BINS, FEWER_BINS, LEVELS = 4096, 64, 8
_OVERHEAD = 512


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8") + block + b"\r\n\r\n") + z.flush()


def _info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def _record(page: str, nth: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:x-page:{page}:{digest}:{nth}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "about:blank", safe="%/:?#[]@!$&'()*+,;=~-._")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}:{digest}:0>")]
    return _member(headers, block)


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder as Hadoop names it: s3a is s3, and one slash after file: is enough."""
    for scheme, known in (("s3a:", "s3:"), ("s3n:", "s3:"), ("abfss:", "abfs:")):
        if root.startswith(scheme):
            root = known + root.removeprefix(scheme)
    if root.startswith("file:"):
        root = "file:///" + root.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(root)


class _Files:
    """Rolls the files of one task."""

    def __init__(self, root: str, limit: int):
        self.fs, self.root = _open(root)
        self.limit, self.attempt, self.out, self.shard, self.seq = limit, uuid.uuid4().hex, None, None, 0
        self.fs.create_dir(f"{self.root}/_tmp", recursive=True)

    def put(self, shard: int, data: bytes) -> Iterator[dict]:
        if self.out is not None and (shard != self.shard or self.size + len(data) > self.limit and self.records):
            yield self.close()
        if self.out is None:
            self.seq = self.seq + 1 if shard == self.shard else 0
            self.shard, self.name = shard, f"pages-{shard:06d}-{self.seq if shard == self.shard else 0:05d}.warc.gz"
            self.tmp = f"_tmp/{self.name}.{self.attempt}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.root}/{self.tmp}", compression=None), 0, 0, hashlib.sha1()
            self._write(_info(self.name))
        self._write(data)
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> dict:
        self.out.close()
        self.out = None
        return {"shard": self.shard, "seq": self.seq, "name": self.name, "tmp": self.tmp, "records": self.records, "bytes": self.size, "sha1": self.sha.hexdigest()}


_MANIFEST = "shard long, seq long, name string, tmp string, records long, bytes long, sha1 string"


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _MANIFEST.split(", ")]))


def _write_shards(root: str, limit: int):
    """Rows come by shard and page id, the marks of a page before its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(root, limit)
        page, marks, seen = object(), {}, {}
        for batch in batches:
            for r in range(batch.num_rows):
                shard, page_id, mark, digest, winner, url, html = (batch.column(i)[r].as_py() for i in range(7))
                if page_id != page:
                    page, marks, seen = page_id, {}, {}
                if mark == 0:
                    marks[digest] = winner
                    continue
                payload = (html or "").encode("utf-8")
                digest = hashlib.sha1(payload).hexdigest()
                nth = seen.get(digest, 0)
                seen[digest] = nth + 1
                refers = marks.get(digest)
                if refers == page_id and nth == 0:
                    refers = None
                for row in files.put(shard, _record("" if page_id is None else str(page_id), nth, url, payload, digest, refers)):
                    yield _batch([row])
        if files.out is not None:
            yield _batch([files.close()])

    return run


def _publish(root: str):
    """Moves reported files to their final names; what an earlier attempt has moved is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for batch in batches:
            for row in batch.to_pylist():
                tmp, final = f"{base}/{row['tmp']}", f"{base}/{row['name']}"
                if fs.get_file_info(tmp).type != pafs.FileType.NotFound:
                    fs.move(tmp, final)
                elif fs.get_file_info(final).size != row["bytes"]:
                    raise OSError(f"{row['name']} is lost")
            yield batch

    return run


def shard_starts(pages: DataFrame, shard_bytes: int) -> list[int]:
    """First ids of all shards but the first, from exact byte sums of id ranges.

    Ranges that hold more than a quarter of a shard are divided further, so that uneven ids make
    no large shard; at most ``BINS`` ranges, and what heavy ones are divided into, reach the driver.
    """
    size = (F.col("payload_bytes") + _OVERHEAD).cast("long")
    lo, hi = pages.agg(F.min("page_id"), F.max("page_id")).first()
    if lo is None:
        return []
    leaves: list[tuple[int, int]] = []
    ranges, count = [(lo, hi + 1)], BINS
    for level in range(LEVELS):
        firsts = np.array([a for a, _ in ranges], np.int64)
        widths = np.array([max(-(-(b - a) // count), 1) for a, b in ranges], np.int64)
        ends = np.array([b for _, b in ranges], np.int64)

        @F.pandas_udf("long")
        def bin_start(x: pd.Series) -> pd.Series:
            v = x.fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
            at = np.maximum(np.searchsorted(firsts, v, side="right") - 1, 0)
            out = firsts[at] + (v - firsts[at]) // widths[at] * widths[at]
            return pd.Series(out).where((v >= firsts[at]) & (v < ends[at]))

        sums = pages.select(bin_start("page_id").alias("first"), size.alias("b")).filter("first is not null").groupBy("first").agg(F.sum("b").alias("b")).collect()
        heavy = []
        for row in sums:
            at = int(np.searchsorted(firsts, row["first"], side="right") - 1)
            if row["b"] > shard_bytes // 4 and widths[at] > 1 and level + 1 < LEVELS:
                heavy.append((row["first"], min(row["first"] + int(widths[at]), int(ends[at]))))
            else:
                leaves.append((row["first"], row["b"]))
        if not heavy:
            break
        ranges, count = sorted(heavy), FEWER_BINS
    starts, held = [], 0
    for first, b in sorted(leaves):
        if held and held + b > shard_bytes:
            starts.append(first)
            held = 0
        held += b
    return starts


def write_warc(pages: DataFrame, root: str, *, revisit_bytes: int = 1000, shard_bytes: int | None = None, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes every row of ``pages`` (``page_id``, ``url``, ``html``) as a WARC record under ``root``.

    ``root`` is a folder that driver and executors share. A shard has about ``shard_bytes`` of
    payload: by default a thousandth of all, 8 MB at least and 1 GB at most. Returns the manifest:
    ``shard``, ``seq``, ``name``, ``records``, ``bytes``, ``sha1``.

    A null html is an empty payload; a null or empty url is ``about:blank``, and characters that no
    URI has are percent-encoded, so that such a url comes back encoded. Rows with a null page_id come
    first and are revisits only of a page that has an id. Of rows that repeat a page and payload
    the first is the response, if this page is the largest with that payload, and the others
    revisit it. An empty table gives an empty manifest and no file. Other columns are ignored.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    full = pages.select(F.col("page_id").cast("long"), "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("digest"))
    slim = full.select("page_id", "payload_bytes", "digest")
    if shard_bytes is None:
        total = slim.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()[0]
        shard_bytes = int(min(max(total // 1000, 8 << 20), 1 << 30))
    starts = np.array(shard_starts(slim, shard_bytes), np.int64)

    @F.pandas_udf("long")
    def shard_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, x.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), side="right"))

    large = slim.filter(F.col("payload_bytes") >= revisit_bytes)
    winners = large.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1 and winner is not null").drop("n")
    marks = large.select("page_id", "digest").join(winners, "digest").distinct()
    rows = full.select("page_id", F.lit(1).alias("mark"), "digest", F.lit(None).cast("long").alias("winner"), "url", "html").unionByName(
        marks.select("page_id", F.lit(0).alias("mark"), "digest", "winner", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    )
    rows = rows.select(shard_of("page_id").alias("shard"), "page_id", "mark", "digest", "winner", "url", "html")
    rows = rows.repartition(len(starts) + 1, "shard").sortWithinPartitions("shard", "page_id", "mark", "digest", "url")
    written = rows.mapInArrow(_write_shards(root, file_bytes), _MANIFEST)
    written.write.parquet(f"{root}/_tmp/written")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{root}/_tmp/written")
    manifest.mapInArrow(_publish(root), _MANIFEST).drop("tmp").write.parquet(f"{root}/manifest")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_tmp")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return spark.read.parquet(f"{root}/manifest")


def _headers(f) -> dict[str, str] | None:
    if not f.readline():
        return None
    out = {}
    while line := f.readline().rstrip(b"\r\n"):
        k, _, v = line.decode("utf-8").partition(": ")
        out[k] = v
    return out


def _read_records(root: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        for batch in batches:
            for row in batch.to_pylist():
                out, held, n = [], 0, 0
                with fs.open_input_stream(f"{base}/{row['name']}", compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as f:
                    while (h := _headers(f)) is not None:
                        block = f.read(int(h["Content-Length"]))
                        f.read(4)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        n += 1
                        if f"sha1:{hashlib.sha1(block).hexdigest()}" != h["WARC-Block-Digest"]:
                            raise ValueError(f"{row['name']}: {h['WARC-Record-ID']} is damaged")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(x[16:] for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")))
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = h["WARC-Type"] == "revisit"
                        if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{row['name']}: {h['WARC-Record-ID']} has another payload")
                        page = h["WARC-Record-ID"].split(":")[2]
                        refers = int(h["WARC-Refers-To"].split(":")[2]) if revisit else None
                        out.append((int(page) if page else None, h["WARC-Target-URI"], length, digest, h["WARC-Type"], refers, payload if payloads and not revisit else None))
                        held += len(payload) if payloads else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])
                            out, held = [], 0
                if n != row["records"]:
                    raise ValueError(f"{row['name']} has {n} records, its manifest says {row['records']}")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])

    return run


def read_warc(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of a complete archive, file by file, with lengths and digests checked.

    ``page_id``, ``url``, ``payload_bytes``, ``payload_digest`` (lower-case hex), ``record_type``,
    ``refers_to`` (a revisit's response) and ``payload`` (null for revisits, or if not asked for).
    """
    files = spark.read.parquet(f"{root}/manifest").select("name", "records")
    files = files.repartition(max(spark.sparkContext.defaultParallelism, files.count() // 4), "name")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return files.mapInArrow(_read_records(root, payloads), schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Workspace(spark, "warc").root
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_warc(spark, root, payloads=False).drop("payload", "url")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN winner IS NULL OR winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM p LEFT JOIN w USING (payload_digest)
"""
