"""WARC archives with a two-level capture index.

write() makes a record of every page: a response, or a revisit where the payload equals that of another page (of equal
payloads of REVISIT_BYTES or more, the largest page_id is the response). Every task streams its records, each
a gzip member, into files of its own. index() sorts the captures by reversed-host URL key and packs them into compressed
blocks of BLOCK_LINES lines, followed by the file's sparse directory, a line per block; it returns a row per file, as many as
there are partitions. captures() finds keys by binary search among the files (the only table that is broadcast), in a file's
directory and in a block; a range read of the archive then brings the record. Wanted keys are sorted by file,
so that a task reads a directory and a block once for all its keys. lookup() does this for URLs.

Files are opened by URI through pyarrow.fs, so any file system that it knows will do. A file is named by task and
attempt, and only files of attempts that reported back are in the tables, so lost executors leave no trace in results.

Cases: null html is an empty payload; a null url gets the empty key; null page_ids are never a revisit's target unless all of
the group are null (then all are responses); repeated rows of the largest page_id are all responses; an empty table
gives no records; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, scratch_path, staged

REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
BLOCK_LINES = 500
DATE = "2024-01-01T00:00:00Z"

CAPTURE = "page_id bigint, url string, url_key string, digest string, record_type string, file string, offset bigint, length bigint"
INDEX = "first_key string, last_key string, lines bigint, blocks bigint, file string, offset bigint, length bigint"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean"


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query: org,example)/path. Scheme, a leading www., port and fragment go."""
    u = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(?:www\.)?", ""), r"#.*$", "")
    host = F.regexp_extract(rest, r"^([^/?:]*)", 1)
    tail = F.regexp_replace(F.substr(rest, F.length(host) + 1), r"^:\d*", "")
    return F.when(rest == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(tail == "", "/").otherwise(tail)))


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, url_key, payload, digest, refers_to (null: a response) for every row of pages."""
    data = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), data.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = p.where(F.octet_length("payload") >= REVISIT_BYTES)
    # one row for each payload that several pages share; texts stay where they are if this is small
    shared = long.groupBy(F.col("digest").alias("__digest")).agg(F.max("page_id").alias("__last"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __last is not null")
    joined = p.join(staged(shared, "warc-shared"), F.col("digest") == F.col("__digest"), "left")
    other = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("__last")), F.col("__last"))
    return joined.select("page_id", "url", url_key(F.col("url")).alias("url_key"), "payload", "digest", other.alias("refers_to"))


def record(page_id, url: str, payload: bytes, digest: str, refers_to, place: str) -> bytes:
    """place: where the record stands, from which its own id is made; page ids, which may repeat, have fields of their own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", f"WARC-Date: {DATE}", f"Page-ID: {'' if page_id is None else page_id}"]
    head += [f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact of a record's bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"][5:], fields["WARC-Type"]
    intact = kind == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
    return int(fields["Page-ID"]) if fields["Page-ID"] else None, size, digest, kind, int(fields["Refers-To-Page-ID"]) if kind == "revisit" else None, intact and rest[len(block) :] == b"\r\n\r\n"


class Out:
    """A new file of this task attempt."""

    def __init__(self, folder: str, prefix: str, number: int, suffix: str):
        c = TaskContext.get()
        self.name = f"{folder}/{prefix}-{c.partitionId():06d}-{c.taskAttemptId()}-{number}{suffix}"
        fs, path = pafs.FileSystem.from_uri(self.name)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream, self.at = fs.open_output_stream(path, compression=None), 0

    def add(self, data: bytes) -> tuple[int, int]:
        at, self.at = self.at, self.at + len(data)
        self.stream.write(data)
        return at, len(data)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Write the archives under folder; CAPTURE rows, settled as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for b in batches:
            rows = []
            for page, url, key, data, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or out.at > FILE_BYTES:
                    if out:
                        out.stream.close()
                    out, n = Out(folder, "archive", n, ".warc.gz"), n + 1
                at, size = out.add(gzip.compress(record(page, url, data, digest, refers, f"{out.name}#{out.at}"), 5, mtime=0))
                rows.append((page, url, key, digest, "response" if refers is None else "revisit", out.name, at, size))
            yield _batch(rows, CAPTURE)
        if out:
            out.stream.close()

    return staged(decided.select("page_id", "url", "url_key", "payload", "digest", "refers_to").mapInArrow(run, CAPTURE), "warc-captures")


def index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index under folder; INDEX rows, one per file, settled as a table."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.to_json(F.struct("url_key", "url", "page_id", "digest", "record_type", "file", "offset", "length"))
    # equal keys, as of a URL captured over and over, are spread by file and place
    ordered = captures.repartitionByRange(parts, "url_key", "file", "offset").sortWithinPartitions("url_key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, keys, lines, directory = None, [], [], []

        def block() -> None:
            at, size = out.add(gzip.compress("\n".join(lines).encode(), 6, mtime=0))
            directory.append((keys[0], keys[-1], at, size, len(lines)))

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = out or Out(folder, "index", 0, ".cdx.gz")
                keys.append(key)
                lines.append(text)
                if len(lines) == block_lines:
                    block()
                    keys, lines = [], []
        if lines:
            block()
        if out:
            at, size = out.add(gzip.compress("\n".join(map(json.dumps, directory)).encode(), 6, mtime=0))
            out.stream.close()
            yield _batch([(directory[0][0], directory[-1][1], sum(d[4] for d in directory), len(directory), out.name, at, size)], INDEX)

    return staged(ordered.select("url_key", line.alias("line")).mapInArrow(run, INDEX), "warc-index")


class Files:
    """Range reads; the last file stays open."""

    def __init__(self) -> None:
        self.name, self.file = "", None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file:
                self.file.close()
            fs, path = pafs.FileSystem.from_uri(name)
            self.name, self.file = name, fs.open_input_file(path)
        self.file.seek(offset)
        return gzip.decompress(self.file.read(length))

    def lines(self, name: str, offset: int, length: int) -> list:
        return [json.loads(x) for x in self.read(name, offset, length).decode().split("\n")]


WANTED, PLACE = "url_key string, index_file string, index_at bigint, index_size bigint", "url_key string, url string, file string, offset bigint, length bigint"


def captures(keys: DataFrame, indexed: DataFrame) -> DataFrame:
    """keys: (url_key), distinct. url_key, url and the RECORD columns of each capture under these keys. indexed: from index()."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a row per index file, as many as index() had partitions; by last key, which is their order by first key, too
    files = spark.sparkContext.broadcast(sorted(tuple(r) for r in indexed.select("last_key", "first_key", "file", "offset", "length").collect()))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [f[0] for f in files.value]
        for b in batches:
            rows = []
            for key in b.column(0).to_pylist():
                at = bisect.bisect_left(last, key)
                while at < len(last) and files.value[at][1] <= key:
                    rows.append((key, *files.value[at][2:]))
                    at += 1
            yield _batch(rows, WANTED)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, named, last, directory, held, keys = Files(), "", [], [], None, []
        for b in batches:
            rows = []
            for key, name, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != named:
                    named, held, directory = name, None, index.lines(name, offset, length)
                    last = [d[1] for d in directory]
                at = bisect.bisect_left(last, key)
                while at < len(last) and directory[at][0] <= key:
                    if held != at:
                        block = index.lines(name, *directory[at][2:4])
                        held, keys = at, [x["url_key"] for x in block]
                    found = block[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                    rows += [(key, x.get("url"), x["file"], x["offset"], x["length"]) for x in found]
                    at += 1
            yield _batch(rows, PLACE)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Files()
        for b in batches:
            key, url, *at = (c.to_pylist() for c in b.columns)
            yield _batch([(k, u, *parse(archives.read(*x))) for k, u, x in zip(key, url, zip(*at, strict=True), strict=True)], "url_key string, url string, " + RECORD)

    wanted = keys.select("url_key").mapInArrow(holders, WANTED).repartitionByRange(parts, "index_file", "url_key").sortWithinPartitions("index_file", "url_key")
    found = wanted.mapInArrow(places, PLACE).repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return found.mapInArrow(records, "url_key string, url string, " + RECORD)


def lookup(urls: DataFrame, indexed: DataFrame, url_col: str = "url") -> DataFrame:
    """url and the RECORD columns of each capture of a wanted URL (of one with the same key)."""
    wanted = urls.select(F.col(url_col).alias("url")).distinct().withColumn("url_key", url_key(F.col("url")))
    found = captures(wanted.select("url_key").distinct(), indexed)
    return wanted.join(found.drop("url"), "url_key").drop("url_key")


def op7_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are archived; then every URL that pages have is looked up, so each record comes back through the index."""
    folder = scratch_path(spark, "warc")
    pages = read_table(spark, sf_dir, "pages")
    indexed = index(write(decide(pages), folder), folder)
    return captures(pages.select(url_key(F.col("url")).alias("url_key")).distinct(), indexed).drop("url_key", "url")


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.last IS NOT NULL AND page_id IS DISTINCT FROM g.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.last IS NOT NULL AND page_id IS DISTINCT FROM g.last THEN g.last END AS refers_to, TRUE AS intact
FROM p LEFT JOIN g ON p.d = g.d
"""
