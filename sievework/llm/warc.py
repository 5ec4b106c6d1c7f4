"""WARC archives written and read as chunked record tables.

Writing. Every row becomes one WARC/1.1 record, or, when its payload is longer than ``segment_bytes``, a record and
``continuation`` records in the standard's segmentation form. A payload is cut once, into ranges of its bytes, so the time is
proportional to its length, and no row that is shuffled or written after that is larger than one segment. Equal payloads of at
least ``min_bytes`` are stored once: the record with the largest
id is the ``response``, the others are ``revisit`` records without payload. The choice is made on a stored table of (id, digest)
alone: a partial aggregate per digest before the shuffle, and the rows of a hot payload meet its response by broadcast
(``join_counted``). Spark's text sink writes the archives (gzip, line separator CRLF), so any Hadoop file system will do.

Reading. The archives are streamed line by line into a state machine that follows Content-Length. It emits rows
of (record id, chunk number) with at most ``chunk_bytes`` of payload each, carrying the SHA-1 and the byte count
so far; neither a record nor a file is ever held whole. The row marked ``last`` has the digest of the full payload.

Payloads are text, stored in UTF-8. Defined results: a null payload is empty; a null URL has no target header; a row
with a null id is always a response; repeated rows give repeated records, and all rows with the largest id
of a payload are responses; an empty table gives an empty archive and an empty chunk table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, new_path, quoted, small_batches, stored

MIN_BYTES = 1000
SEGMENT_BYTES = 1 << 18
CHUNK_BYTES = 1 << 16
WARC_DATE = "2024-01-01T00:00:00Z"
CHUNKS = "record_id string, record_type string, refers_to string, declared_digest string, declared_bytes long, chunk_no int, data binary, n_bytes long, end_offset long, sha1_so_far string, last boolean"


def plan_records(df: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per input row: id, url, payload, payload_bytes, payload_digest, record_type, refers_to (an id)."""
    payload = F.coalesce(quoted(payload_col), F.lit(""))
    rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.encode("payload", "utf-8"))})
    ids = stored(rows.where((F.col("payload_bytes") >= min_bytes) & F.col("id").isNotNull()).select("id", "payload_digest"), "digests")
    first = stored(ids.groupBy("payload_digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "responses")
    again = join_counted(ids, first, "payload_digest", "n", ids.count()).where("id <> refers_to").select("id", "payload_digest", "refers_to").distinct()
    a, b = rows.alias("a"), again.alias("b")
    out = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.payload_digest") == F.col("b.payload_digest")), "left")
    return out.select("a.*", "b.refers_to").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _urn(id_col: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(id_col.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(records: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write the rows of ``plan_records`` as gzipped WARC files below ``path``."""
    nl = "\r\n"
    revisit = F.col("record_type") == "revisit"
    rows = records.withColumn("raw", F.when(revisit, F.lit(b"")).otherwise(F.encode("payload", "utf-8"))).drop("payload")
    # both columns read raw, so it is made once for a row and not for every segment
    rows = rows.withColumns({
        "parts": F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / F.lit(segment_bytes))).cast("int"),
        "segments": F.when(F.octet_length("raw") <= segment_bytes, F.array("raw")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / F.lit(segment_bytes)).cast("int")), lambda k: F.substring("raw", k * segment_bytes + 1, F.lit(segment_bytes)))),
    })
    rows = rows.select(*[c for c in rows.columns if c not in ("raw", "segments")], F.posexplode("segments").alias("part", "bytes")).withColumn("part", F.col("part") + 1)
    body = F.col("bytes").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(nl + nl))
    block = F.when(F.col("part") == 1, F.concat(http, body)).otherwise(body)
    several, later = F.col("parts") > 1, F.col("part") > 1

    def header(name: str, value: Column, when: Column | None = None) -> Column:
        line = F.concat(F.lit(f"{name}: "), value, F.lit(nl))
        return line if when is None else F.when(when, line).otherwise(F.lit(""))

    uri = F.regexp_replace("url", r"[\s\p{Cntrl}]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{nl}"),
        header("WARC-Type", F.when(later, "continuation").otherwise(F.col("record_type"))),
        header("WARC-Record-ID", F.when(later, F.concat(F.lit("<urn:segment:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(":"), F.col("part").cast("string"), F.lit(">"))).otherwise(_urn(F.col("id")))),
        F.coalesce(header("WARC-Target-URI", uri), F.lit("")),
        header("WARC-Date", F.lit(WARC_DATE)),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")), ~later),
        header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        header("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to"))).otherwise(F.lit("")), revisit),
        header("WARC-Segment-Number", F.col("part").cast("string"), several),
        header("WARC-Segment-Origin-ID", _urn(F.col("id")), later),
        header("WARC-Segment-Total-Length", (F.octet_length(http) + F.col("payload_bytes")).cast("string"), several & (F.col("part") == F.col("parts"))),
        header("Content-Type", F.lit("application/http; msgtype=response"), ~later),
        header("Content-Length", F.octet_length("block").cast("string")),
    )
    text = rows.withColumn("block", block).select(F.concat(head, F.lit(nl), F.col("block"), F.lit(nl)).alias("value"))
    text.write.option("lineSep", nl).option("compression", "gzip").text(path)


class RecordStream:
    """Follows WARC records through a stream of lines; ``feed`` yields chunk rows as tuples in the order of CHUNKS."""

    def __init__(self, chunk_bytes: int = CHUNK_BYTES, keep_data: bool = True):
        self.chunk_bytes, self.keep_data = chunk_bytes, keep_data
        self.state, self.head, self.left, self.open = "between", {}, 0, None

    def feed(self, line: bytes) -> Iterator[tuple]:
        """Take one line with its newline."""
        if self.state == "between":
            if line.strip():
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"a WARC record should start here: {line[:60]!r}")
                self.state, self.head = "head", {}
        elif self.state == "head":
            if line != b"\r\n":
                name, _, value = line.decode("utf-8").partition(":")
                self.head[name.lower()] = value.strip()
            else:
                self._begin()
                if not self.left:
                    yield from self._end()
        else:
            take, self.left = line[: self.left], self.left - min(len(line), self.left)
            if self.state == "http":
                if take == b"\r\n":
                    self.state = "payload"
                elif take.lower().startswith(b"content-length:"):
                    self.declared = int(take.split(b":")[1])
            else:
                yield from self._data(take)
            if not self.left:
                yield from self._end()

    def _begin(self) -> None:
        h, self.left = self.head, int(self.head["content-length"])
        if h["warc-type"] == "continuation":
            if self.open is None or h.get("warc-segment-origin-id") != self.open["warc-record-id"] or int(h["warc-segment-number"]) != self.segment + 1:
                raise ValueError(f"segment {h.get('warc-segment-number')} of {h.get('warc-segment-origin-id')} is out of place")
            self.segment, self.state = self.segment + 1, "payload"
        else:
            if self.open is not None:
                raise ValueError(f"record {self.open['warc-record-id']} lacks its last segment")
            self.open, self.segment = h, int(h.get("warc-segment-number", 1))
            self.sha, self.buffer, self.total, self.number, self.declared = hashlib.sha1(), bytearray(), 0, 0, None
            self.state = "http" if h.get("content-type", "").startswith("application/http") else "payload"

    def _data(self, data: bytes) -> Iterator[tuple]:
        self.buffer += data
        while len(self.buffer) > self.chunk_bytes:
            yield self._row(bytes(self.buffer[: self.chunk_bytes]), False)
            del self.buffer[: self.chunk_bytes]

    def _end(self) -> Iterator[tuple]:
        self.state = "between"
        if "warc-segment-number" not in self.head or "warc-segment-total-length" in self.head:
            yield self._row(bytes(self.buffer), True)
            self.open = None

    def _row(self, data: bytes, last: bool) -> tuple:
        self.sha.update(data)
        self.total += len(data)
        self.number += 1
        h = self.open
        return h["warc-record-id"], h["warc-type"], h.get("warc-refers-to"), h.get("warc-payload-digest", "").rpartition(":")[2] or None, self.declared, self.number - 1, data if self.keep_data else None, len(data), self.total, self.sha.hexdigest(), last

    def close(self) -> None:
        if self.state != "between" or self.open is not None:
            raise ValueError("the archive ends inside a record")


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, keep_data: bool = True) -> DataFrame:
    """The chunk table (CHUNKS) of all archives below ``path``; ``keep_data=False`` leaves the data column null."""
    small_batches(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(CHUNKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, rows, held = RecordStream(chunk_bytes, keep_data), [], 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                for row in stream.feed(line + b"\n"):
                    rows.append(row)
                    held += row[7]
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        stream.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    lines = spark.read.option("lineSep", "\n").schema("value string").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, CHUNKS)


def archive(df: DataFrame, id_col: str, url_col: str, payload_col: str, path: str | None = None, min_bytes: int = MIN_BYTES) -> str:
    """Write all rows as archives below ``path`` (by default a new folder in the shared folder); returns the path."""
    path = path or new_path(df.sparkSession, "warc")
    write_archives(plan_records(df, id_col, url_col, payload_col, min_bytes), path)
    return path
