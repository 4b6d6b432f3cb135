"""Operator 7: WARC archives, written by Spark and read by a Python data source.

``write_warc`` makes each record a string and leaves files, tasks and commits to Spark's text writer,
whose line separator is the one between records; so a lost task leaves no half file. ``WarcSource`` plans
partitions of whole files, takes predicates on the record type and other header columns into the scan,
reads headers first and seeks past the payloads that nobody asked for.

Records with equal payloads of at least MIN_REVISIT bytes: the least id is the response, the others are
revisits without payload. Only digests met twice or more are joined back to the pages, and they are sent
out if few, so payloads are not shuffled then.

Defined cases: a null payload is empty; rows that repeat the least id are responses as well; a null id is
greater than any other, and the response where there is none; line breaks in URLs are percent-encoded;
an empty table makes an archive without records; a payload is one string of a task, 2 GB at most; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from growmap.llm.common import bytes_of, join_small, new_folder, table, written

MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of small files read as one partition, and of payloads in one batch.
PACK, BATCH = 32 << 20, 4 << 20
#: Records of a file: a gigabyte of pages of 50 kB.
FILE_RECORDS = 20_000
#: Columns read from headers, in the order of the schema.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "payload_length": "x-payload-length"}


def first_of_payload(pages: DataFrame, id_col: str, payload_col: str, least: int = MIN_REVISIT) -> tuple[DataFrame, int]:
    """(digest, first) of payloads that more than one row has, and their number."""
    data = bytes_of(F.col(payload_col))
    rows = pages.select(F.col(id_col).alias("id"), F.octet_length(data).alias("n"), F.sha2(data, 256).alias("digest")).filter(F.col("n") >= least)
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    first = written(first, "digests")
    return first, first.count()


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """value: a record without the separator after it."""
    data = bytes_of(F.col(payload_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), data.alias("data"), F.octet_length(data).alias("n"), F.sha2(data, 256).alias("digest"))
    first, n_first = first_of_payload(pages, id_col, payload_col, least)
    rows = join_small(rows, first.withColumn("dup", F.lit(True)), ["digest"], n_first, "left", salt=F.xxhash64("id"))
    revisit = F.col("dup").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("data").cast("string")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    rows = rows.withColumn("block", block)
    return rows.select(F.concat(head, line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block")).alias("value"))


def write_warc(pages: DataFrame, path: str, compression: str | None = None, file_records: int = FILE_RECORDS, **columns: str) -> None:
    """Files of at most ``file_records`` records, as each is read by one task. ``compression`` gzip makes each
    file one gzip stream, which the source reads as well."""
    out = records(pages, **columns).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records)
    (out.option("compression", compression) if compression else out).text(path)


def open_fs(path: str):
    """A pyarrow file system and the path in it, on the driver and on executors alike."""
    from pyarrow import fs

    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def read_headers(f: io.BufferedIOBase) -> dict[str, str] | None:
    """Header names are lower-case; None at the end of the file."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins here: {line[:60]!r}")
    out: dict[str, str] = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, set[str]]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes equality and IN on header columns, hands the rest back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if isinstance(f, EqualTo) and name in HEADERS and name != "payload_length":
                self.wanted.append((HEADERS[name], {f.value}))
            elif isinstance(f, In) and name in HEADERS and name != "payload_length":
                self.wanted.append((HEADERS[name], set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = open_fs(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((x for x in found if x.is_file and x.base_name[0] not in "._" and x.size), key=lambda x: x.path)
        packs, size = [], PACK
        for x in found:
            if size + x.size > PACK:
                packs.append(Files([]))
                size = 0
            packs[-1].paths.append(x.path)
            size += x.size
        return packs or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_fs(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                plain = io.BufferedReader(raw, 1 << 20)
                f = gzip.GzipFile(fileobj=plain) if path.endswith(".gz") else plain
                while (head := read_headers(f)) is not None:
                    length = int(head.get("content-length", 0))
                    if any(head.get(name) not in values for name, values in self.wanted):
                        f.seek(length, io.SEEK_CUR)
                        continue
                    payload = None
                    if self.payload and head.get("warc-type") != "revisit":
                        payload = f.read(length)
                        if head.get("content-type", "").startswith("application/http"):
                            payload = payload.partition(b"\r\n\r\n")[2]
                    else:
                        f.seek(length, io.SEEK_CUR)
                    rows.append((*(head.get(h) for h in HEADERS.values()), payload))
                    size += 500 + len(payload or b"")
                    if size >= BATCH:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    k = list(HEADERS).index("payload_length")
    cols[k] = tuple(None if v is None else int(v) for v in cols[k])
    types = [pa.int64() if name == "payload_length" else pa.string() for name in HEADERS] + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [*HEADERS, "payload"])


class WarcSource(DataSource):
    """Options: path; payload=false leaves every payload unread."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ", ".join(f"{c} {'bigint' if c == 'payload_length' else 'string'}" for c in HEADERS) + ", payload binary"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives. Spark takes filters into Python sources only where its setting for that is on
    when a query is planned, so it is switched on in this session and stays on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id(record_id: str, kind: str) -> Column:
    """The id in a record's name, in the type of the pages' ids; none: null."""
    name = F.regexp_extract(record_id, r"(?s)^<urn:page:(.*)>$", 1)
    return F.when(~name.isin("", "null"), name).try_cast(kind)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, which are measured; revisits by their headers alone. The record
    type is pushed into both scans."""
    pages, path = table(spark, sf_dir, "pages"), new_folder(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    write_warc(pages, path)
    names = [page_id("record_id", kind).alias("page_id"), "record_type", page_id("refers_to", kind).alias("refers_to")]
    full = read_warc(spark, path).filter("record_type = 'response'")
    full = full.select(*names, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    bare = read_warc(spark, path, payload=False).filter("record_type = 'revisit'")
    bare = bare.select(*names, F.col("payload_length").alias("payload_bytes"), F.replace("payload_digest", F.lit("sha256:"), F.lit("")).alias("payload_digest"))
    return full.unionByName(bare).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""
