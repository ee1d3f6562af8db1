"""WARC archives: a Python data source that reads headers first, and a writer that stores equal payloads once.

Reading, ``spark.read.format("warc")`` or :func:`read_archive`. The driver plans partitions from the list of
files: small files share a partition, a large one is its own, since a record's start cannot be told from payload
bytes. A task walks the records of its files: it parses a record's header block, tests the pushed predicates on it, and
passes over the block of a record that fails by seeking. Of a record that stays only the wanted part is read:
nothing, the HTTP head, or the payload, which is then freed of chunked transfer and of gzip or deflate coding.
Columns are chosen by the option ``columns``, as a Python source is not told what a query selects; ``fields`` names
more headers to show as columns. Predicates on header columns are pushed down: =, <=>, IN, null tests, prefix, suffix
and substring, their negations, and order on ``content_length``. Files may be plain or gzip (one member per record or
per file). The session needs spark.sql.python.filterPushdown.enabled; :func:`read_archive` sets it. The path may be in
any store that pyarrow's file systems open. A file that is no archive, or ends inside a record, fails the task and
names the place: nothing is lost silently.

Writing, :func:`write_archive`. Of rows with equal payloads the one with the largest id is a response; the others
become revisits that carry the HTTP head only and refer to it. Spark's text writer writes the records, so tasks
that run again leave no halves. Equality is by SHA-256; the payload digest in the header is SHA-1.

Nulls: a null payload is empty, a null url an empty one; blanks, control and non-ASCII characters of a url are
percent-encoded. A null id is written as an empty one and read as null; it is the largest only among null ids, and
then all of them are responses. Rows that repeat the largest id with the same payload are all responses, as no
id tells them apart. No rows give an archive without records. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orthoflow.llm.common import materialise
from orthoflow.llm.groups import with_group

#: Header columns by the header they show.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type", "profile": "warc-profile",
}
#: The other columns. ``http_length`` is the length the HTTP head states, which a revisit keeps.
OTHERS = {"content_length": "long", "file": "string", "offset": "long", "headers": "map<string,string>",
          "http_status": "int", "http_length": "long", "http_headers": "map<string,string>", "payload": "binary"}
HTTP_COLUMNS = {"http_status", "http_length", "http_headers"}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PARTITION_BYTES = 128 << 20
BUFFER = 1 << 16
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _column_of(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower())


def parse_header(block: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that starts with a blank continues the one before; the first of a name counts."""
    lines: list[str] = []
    for line in block.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        elif line:
            lines.append(line)
    out: dict[str, str] = {}
    for line in lines:
        name, found, value = line.partition(":")
        if found:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _whole(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"[0-9]{1,18}", text) else None


def decode_payload(body: bytes, http: dict[str, str]) -> bytes:
    """The payload without chunked transfer and gzip or deflate coding; as it stands where it does not follow them."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        parts, at = [], 0
        while True:
            size = re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r\n").match(body, at)
            if size is None:
                return body
            n = int(size[1], 16)
            if n == 0:
                break
            parts.append(body[size.end():size.end() + n])
            at = size.end() + n + 2
            if at > len(body):
                return body
        body = b"".join(parts)
    coding = http.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):
            try:
                return zlib.decompress(body, bits)
            except zlib.error:
                continue
    return body


class Cursor:
    """Reads on through a file; what is passed over is sought past where the file allows it."""

    def __init__(self, handle, seekable: bool):
        self.handle, self.seekable = handle, seekable
        self.buffer, self.at, self.start = b"", 0, 0

    @property
    def offset(self) -> int:
        return self.start + self.at

    def _more(self, size: int) -> bool:
        got = self.handle.read(size)
        self.buffer, self.start, self.at = self.buffer[self.at:] + got, self.offset, 0
        return bool(got)

    def until(self, mark: bytes, limit: int | None = None) -> bytes | None:
        """Up to and with the mark, None where it does not come (within the limit)."""
        seen = 0
        while True:
            place = self.buffer.find(mark, self.at + max(0, seen - len(mark) + 1))
            if place >= 0 and (limit is None or place + len(mark) - self.at <= limit):
                out = self.buffer[self.at:place + len(mark)]
                self.at = place + len(mark)
                return out
            seen = len(self.buffer) - self.at
            if place >= 0 or (limit is not None and seen >= limit) or not self._more(max(BUFFER, seen)):
                return None

    def read(self, size: int) -> bytes:
        while len(self.buffer) - self.at < size and self._more(max(BUFFER, size - (len(self.buffer) - self.at))):
            pass
        out = self.buffer[self.at:self.at + size]
        self.at += len(out)
        return out

    def skip(self, size: int) -> None:
        inside = min(size, len(self.buffer) - self.at)
        self.at += inside
        size -= inside
        if size and self.seekable:
            target = self.offset + size
            self.handle.seek(target)
            self.buffer, self.at, self.start = b"", 0, target
        while size and not self.seekable:
            got = len(self.read(min(size, BUFFER)))
            if not got:
                return
            size -= got


@dataclass
class Wanted:
    """What a scan needs of each record."""

    columns: list[str]
    names: dict[str, str]
    tests: list[tuple[str, str, object]] = field(default_factory=list)

    def keeps(self, header: dict[str, str]) -> bool:
        return all(_holds(_whole(header.get("content-length")) if column == "content_length" else header.get(self.names[column]), op, value)
                   for column, op, value in self.tests)


_TESTS: dict[str, Callable] = {
    "=": lambda x, v: x == v, "in": lambda x, v: x in v, "prefix": lambda x, v: x.startswith(v), "suffix": lambda x, v: x.endswith(v),
    "contains": lambda x, v: v in x, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v,
}


def _holds(found, op: str, value) -> bool:
    """Whether a predicate is true; a comparison with null is not, and neither is its negation."""
    if op == "null":
        return (found is None) == value
    if op == "<=>":
        return found == value
    if op == "not <=>":
        return found != value
    if found is None:
        return False
    if op.startswith("not "):
        return not _TESTS[op[4:]](found, value)
    return _TESTS[op](found, value)


_PUSHED = {
    ds.EqualTo: "=", ds.EqualNullSafe: "<=>", ds.In: "in", ds.StringStartsWith: "prefix", ds.StringEndsWith: "suffix",
    ds.StringContains: "contains", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<=",
}


def as_test(pushed: ds.Filter, names: dict[str, str]) -> tuple[str, str, object] | None:
    """(column, operation, value) of a predicate that headers decide alone, else None."""
    negated = isinstance(pushed, ds.Not)
    inner = pushed.child if negated else pushed
    if len(inner.attribute) != 1 or (inner.attribute[0] not in names and inner.attribute[0] != "content_length"):
        return None
    column = inner.attribute[0]
    if isinstance(inner, (ds.IsNull, ds.IsNotNull)):
        return column, "null", isinstance(inner, ds.IsNull) != negated
    op = _PUSHED.get(type(inner))
    if op is None:
        return None
    value = inner.value
    if op == "in":
        if any(v is None for v in value):
            if negated:
                return None
            value = [v for v in value if v is not None]
        value = tuple(value)
    elif value is None and op != "<=>":
        return None
    return column, f"not {op}" if negated else op, value


def records(cursor: Cursor, name: str, wanted: Wanted) -> Iterator[list]:
    """One row per record that the tests keep, in file order."""
    need_http = any(c in HTTP_COLUMNS for c in wanted.columns)
    need_payload = "payload" in wanted.columns
    while True:
        offset = cursor.offset
        version = cursor.until(b"\n", BUFFER)
        while version is not None and not version.strip():
            offset = cursor.offset
            version = cursor.until(b"\n", BUFFER)
        if version is None:
            if cursor.buffer[cursor.at:].strip():
                raise ValueError(f"{name}: no record at byte {offset}")
            return
        block = cursor.until(b"\r\n\r\n") if version.startswith(b"WARC/") else None
        header = parse_header(block) if block is not None else {}
        length = _whole(header.get("content-length"))
        if length is None:
            raise ValueError(f"{name}: no record at byte {offset}")
        left = length
        if wanted.keeps(header):
            http_block = "application/http" in header.get("content-type", "").lower()
            status, http, payload = None, {}, None
            if http_block and (need_http or need_payload):
                head = cursor.until(b"\r\n\r\n", length)
                if head is not None:
                    left -= len(head)
                    first, _, rest = head.partition(b"\r\n")
                    words = first.split()
                    status = _whole(words[1].decode("latin-1")) if len(words) > 1 else None
                    http = parse_header(rest)
            if need_payload:
                payload = cursor.read(left)
                if len(payload) < left:
                    raise ValueError(f"{name}: the record at byte {offset} ends early")
                left = 0
                payload = decode_payload(payload, http)
            values = {
                "content_length": length, "file": name, "offset": offset, "headers": header, "http_status": status,
                "http_length": _whole(http.get("content-length")), "http_headers": http, "payload": payload}
            yield [header.get(wanted.names[c]) if c in wanted.names else values[c] for c in wanted.columns]
        # The block's last byte is read, so a file that ends inside a record is noticed.
        if left:
            cursor.skip(left - 1)
            if len(cursor.read(1)) < 1:
                raise ValueError(f"{name}: the record at byte {offset} ends early")


@dataclass
class Files(ds.InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, wanted: Wanted, schema: StructType, partition_bytes: int):
        self.path, self.wanted, self.partition_bytes = path, wanted, partition_bytes
        self.arrow = _arrow_schema(schema)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for one in filters:
            test = as_test(one, self.wanted.names)
            if test is None:
                yield one
            else:
                self.wanted.tests.append(test)

    def partitions(self) -> Sequence[Files]:
        store, top = pa.fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(top)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(pa.fs.FileSelector(top, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.size and not any(
            part[:1] in ("_", ".") for part in f.path[len(top):].split("/")))
        out: list[list[str]] = []
        room = 0
        for path, size in files:
            if not out or size > room:
                out.append([])
                room = self.partition_bytes
            out[-1].append(path)
            room -= size
        return [Files(paths) for paths in out]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        store, _ = pa.fs.FileSystem.from_uri(self.path)
        at = self.wanted.columns.index("payload") if "payload" in self.wanted.columns else None
        rows, size = [], 0
        for path in partition.paths if partition else []:
            zipped = path.endswith(".gz")
            with (store.open_input_stream(path, compression="gzip") if zipped else store.open_input_file(path)) as handle:
                for row in records(Cursor(handle, not zipped), path, self.wanted):
                    rows.append(row)
                    size += len(row[at]) if at is not None else 0
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([
            pa.array([list(v.items()) for v in column] if pa.types.is_map(f.type) else column, f.type)
            for column, f in zip(columns, self.arrow)], schema=self.arrow)


def _arrow_schema(schema: StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


class WarcSource(ds.DataSource):
    """Options: path; columns (comma-separated, all by default); fields (more headers as columns); partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _wanted(self) -> Wanted:
        names = dict(HEADERS)
        extra = [f.strip() for f in self.options.get("fields", "").split(",") if f.strip()]
        names |= {_column_of(f): f.lower() for f in extra if _column_of(f) not in OTHERS}
        columns = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or [*names, *OTHERS]
        unknown = [c for c in columns if c not in names and c not in OTHERS]
        if unknown:
            raise ValueError(f"no such columns: {', '.join(unknown)}")
        return Wanted(columns, names)

    def schema(self) -> str:
        return ", ".join(f"`{c}` {OTHERS.get(c, 'string')}" for c in self._wanted().columns)

    def reader(self, schema: StructType) -> WarcReader:
        if not self.options.get("path"):
            raise ValueError("the option path is missing")
        return WarcReader(self.options["path"], self._wanted(), schema, int(self.options.get("partitionbytes", PARTITION_BYTES)))


def _uri(path: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path.split("/")[0] else f"file://{path}"


def read_archive(spark: SparkSession, path: str, columns: Sequence[str] = (), fields: Sequence[str] = (), partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The records of a file or folder; sets the session to push predicates down to Python sources."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcSource)
    return (spark.read.format("warc").option("columns", ",".join(columns)).option("fields", ",".join(fields))
            .option("partitionBytes", str(partition_bytes)).load(_uri(path)))


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base32: groups of 20 bits written in base 32, then its letters."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*groups), HEX32, BASE32)


def safe_uri(url: Column) -> Column:
    """Without bytes that would end a header line: controls, blanks and non-ASCII bytes percent-encoded."""
    letters = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"(?s)[\x21-\x7E]+|[^\x21-\x7E]"), F.lit(0))
    return F.array_join(F.transform(letters, lambda x: F.when(x.rlike(r"^[\x21-\x7E]+$"), x).otherwise(
        F.regexp_replace(F.hex(x.cast("binary")), "(..)", "%$1"))), "")


def record_urn(identifier: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(identifier.cast("string"), F.lit("")), F.lit(">"))


def id_of_urn(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit(""))


def write_archive(pages: DataFrame, path: str, identifier: str = "page_id", url: str = "url", payload: str = "html",
                  least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record per row in a new folder; payloads under ``least_bytes`` are never replaced by revisits."""
    rows = pages.select(
        F.col(identifier).alias("id"), F.col(url).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("bytes", F.octet_length("body")).withColumn("key", F.sha2("body", 256))
    groups = materialise(rows.filter(F.col("bytes") >= least_bytes).groupBy("key").agg(
        F.max("id").alias("keep"), F.count("*").alias("n")).filter("n > 1"))
    marked = with_group(rows.withColumn("many", F.col("bytes") >= least_bytes), groups, "key", "n", F.xxhash64("id", "uri"))
    marked = marked.withColumn("again", F.col("many") & F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("id")))
    line = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("bytes"), F.lit(line * 2))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, F.col("body")))
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{line}WARC-Record-ID: "), record_urn(F.col("id")), F.lit(f"{line}WARC-Target-URI: "), safe_uri(F.col("uri")),
        F.lit(f"{line}WARC-Date: {date}{line}Content-Type: application/http; msgtype=response{line}Content-Length: "), F.octet_length(block),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), sha1_base32(F.col("body")),
        F.when(F.col("again"), F.concat(F.lit(f"{line}WARC-Profile: {PROFILE}{line}WARC-Refers-To: "), record_urn(F.col("keep")))).otherwise(F.lit("")),
        F.lit(line * 2))
    # The writer ends each row with one line break; a record ends with two.
    marked.select(F.concat(head, block, F.lit(line)).alias("value")).write.option("lineSep", line).text(path)


def archived_pages(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are taken from the payload read; a revisit's, whose payload is not stored with it,
    from its own head. ``payload_matches`` tells whether a response's payload has the digest its header states.
    """
    columns = ["record_type", "record_id", "refers_to", "payload_digest", "http_length"]
    stated = F.regexp_replace("payload_digest", "^sha1:", "")
    found = read_archive(spark, path, [*columns, "payload"]).filter(F.col("record_type") == "response").withColumn("digest", sha1_base32(F.col("payload")))
    full = found.select(
        id_of_urn(F.col("record_id")).cast(id_type).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast(id_type).alias("refers_to"), (F.col("digest") == stated).alias("payload_matches"))
    again = read_archive(spark, path, columns).filter(F.col("record_type") == "revisit").select(
        id_of_urn(F.col("record_id")).cast(id_type).alias("page_id"), F.col("http_length").alias("payload_bytes"), stated.alias("payload_digest"),
        "record_type", id_of_urn(F.col("refers_to")).cast(id_type).alias("refers_to"), F.lit(None).cast("boolean").alias("payload_matches"))
    return full.unionByName(again)
