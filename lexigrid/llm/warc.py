"""WARC archives of pages: a writer that stores equal payloads once, and a salvage reader.

The writer makes one gzip member per record, so every record can be read, lost and found by itself. Spark's text source
writes the members: a member ends in a zero byte (the high byte of its length), which serves as the line separator.

The salvage reader takes members (or plain records that begin at a version line) one after the other. What fails its checks (the
member's checksum and length, the version line, the header, the content length, the payload digest) is put under quarantine up to the
next member or version line from which a whole valid record can be read; later records are recovered, and the gap is logged with its place.
Files are read in splits: what stands before the first record of a split, or after the last whole one, is put together
with its neighbours of the same file in a second step, so no task reads a whole archive and no record is lost at a border.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, discard, encode, noted, remove, shared_dir, stored, texts

#: Payloads from this many bytes on are stored once.
STORED_ONCE = 1000
#: Digests of most copies, whose responses are broadcast; any other has less than a HOTTEST-th of all rows.
HOTTEST = 1000
#: Bytes that are gathered before records are taken from them, and that a member is unpacked by.
GATHERED, UNPACKED = 1 << 22, 1 << 16
MAGIC, LINE, BREAK = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id, url: str | None, payload: bytes | None, length: int, sha1: bytes, refers_to, date: str) -> bytes:
    """One record, uncompressed. Without a payload it is a revisit, which keeps the HTTP header with the payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % length + BREAK + (payload or b"")
    fields = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(url.split())))
    fields += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha1).decode()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if payload is None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    return LINE + b"0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + BREAK


def member(record: bytes) -> bytes:
    """A gzip member without the zero byte at its end; an empty member follows where the record's own one doesn't end so."""
    out = gzip.compress(record, 6, mtime=0)
    return (out if out.endswith(b"\0") else out + gzip.compress(b"", mtime=0))[:-1]


def find_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, length, refers_to of the rows that revisit another. pages: page_id, url, digest (null: never stored once), length.

    Ids of the HOTTEST digests' responses are broadcast; the other rows meet theirs by digest.
    """
    known = pages.where("digest IS NOT NULL")
    largest = known.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1 AND response IS NOT NULL")
    hot = largest.orderBy(F.desc("copies"), "digest").limit(HOTTEST).select("digest", F.col("response").alias("hot"))
    rows = known.join(F.broadcast(hot), "digest", "left")
    # rows that know their response already are spread out, and match nothing
    rows = rows.withColumn("_key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.encode(F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")), "utf-8")))
    rows = rows.join(largest.select(F.col("digest").alias("_key"), "response"), "_key", "left").withColumn("refers_to", F.coalesce("hot", F.when(F.col("_key") == F.col("digest"), F.col("response"))))
    return rows.where("refers_to IS NOT NULL AND NOT page_id <=> refers_to").select("page_id", "url", "digest", "length", "refers_to")


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record for every row of pages: response, or revisit of the row of largest id with an equal payload of STORED_ONCE bytes or more.

    Rows that share the largest id are all responses, and so are rows without an id if no row with one has their payload; other rows
    without an id are revisits. Null payloads are empty, a null url is left out, white space in one as well. Other columns, clashing names
    included, are not read; an empty table gives archives without records. Payloads of revisits are never shuffled.
    """
    html = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("html"))
    html = html.withColumn("length", F.octet_length("html"))
    rows = html.withColumn("digest", F.when(F.col("length") >= STORED_ONCE, F.unhex(F.sha1(F.col("html").cast("binary")))))
    revisits = find_revisits(rows.drop("html"))
    again = revisits.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"))
    responses = rows.join(again, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left_anti")
    none = F.lit(None)
    records = responses.select("page_id", "url", "html", "length", none.cast("binary").alias("digest"), none.cast(pages.schema[id_col].dataType).alias("refers_to"))
    records = records.unionByName(revisits.withColumn("html", none.cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {name: column(batch, name) for name in ("page_id", "url", "length", "digest", "refers_to")}
            made, size = [], 0
            for k, text in enumerate(texts(batch, "html")):
                page, url, length, digest, refers = (own[name][k].as_py() for name in own)
                payload = None if text is None else encode(text)
                made.append(member(warc_record(page, url, payload, length, digest if payload is None else hashlib.sha1(payload).digest(), refers, date)))
                size += len(made[-1])
                if size >= GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    members = records.mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


class Record(NamedTuple):
    """What the reader tells of a record. payload_bytes is the length of the whole payload, of a revisit's too, if its HTTP header has it."""

    type: str
    record_id: str
    target_uri: str | None
    payload_digest: str | None  # lower-case hex without the name of the algorithm
    refers_to: str | None
    payload_bytes: int | None
    payload: bytes


class Damaged(ValueError):
    """The reason why bytes are no record."""


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header")
        out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return out


def _number(digits: str | None) -> int | None:
    return int(digits) if digits and digits.isascii() and digits.isdigit() else None


def _digest(named: str | None) -> tuple[str, str] | tuple[None, None]:
    """Algorithm and lower-case hex digits; digests may be written in hex or in base 32."""
    name, colon, value = (named or "").partition(":")
    if not colon:
        return None, None
    try:
        return name.lower(), (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())).hex()
    except ValueError:
        return name.lower(), value


def plain_record(data: bytes | memoryview, at: int, search) -> tuple[Record | None, int]:
    """The record that begins at `at`, and where it ends; None if it goes on beyond the data. What is no record raises Damaged."""
    end = search(BREAK, at)
    if end < 0:
        return None, at
    head = bytes(data[at:end])
    if not re.match(rb"WARC/1\.[01]\r\n", head + b"\r\n"):
        raise Damaged("version line")
    fields = _fields(head)
    length = _number(fields.get("content-length"))
    if length is None or not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Damaged("header")
    begin, stop = end + len(BREAK), end + len(BREAK) + length
    if stop + len(BREAK) > len(data):
        return None, at
    if bytes(data[stop : stop + len(BREAK)]) != BREAK:
        raise Damaged("content length")
    block = bytes(data[begin:stop])
    http, payload = b"", block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(BREAK)
    kind = fields["warc-type"]
    name, digest = _digest(fields.get("warc-payload-digest"))
    size = len(payload)
    if kind == "revisit":
        size = _number(_fields(http).get("content-length")) if http else None
    elif name == "sha1" and hashlib.sha1(payload).hexdigest() != digest:
        raise Damaged("payload digest")
    return Record(kind, fields["warc-record-id"], fields.get("warc-target-uri"), digest, fields.get("warc-refers-to"), size, payload), stop + len(BREAK)


def packed_records(data: bytearray, at: int) -> tuple[list[Record] | None, int]:
    """The records of the gzip member that begins at `at`, and where it ends; None if it goes on beyond the data."""
    unpack, parts, here = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and here < len(data):
            parts.append(unpack.decompress(data[here : here + UNPACKED]))
            here += UNPACKED
            if len(parts) == 1 and not unpack.eof and len(parts[0]) >= len(LINE) and not parts[0].startswith(LINE):
                raise Damaged("version line")  # no need to unpack the rest
    except zlib.error:
        raise Damaged("checksum or deflate data") from None
    if not unpack.eof:
        return None, at
    end = min(here, len(data)) - len(unpack.unused_data)
    body, records, place = b"".join(parts), [], 0
    while place < len(body):
        record, stop = plain_record(body, place, body.find)
        if record is None:
            raise Damaged("content length")
        records.append(record)
        place = stop
    return records, end


class Salvage:
    """Takes records from bytes that come piece by piece. Bytes that are no record are held as `lost` until a whole valid one follows."""

    def __init__(self, base: int = 0):
        self.data, self.base, self.at, self.need = bytearray(), base, 0, 0
        self.lost: int | None = None
        self.reason = ""

    def feed(self, more: bytes, last: bool = False) -> Iterator[tuple[int, int, str, Record | None]]:
        """(start, end, reason, record) of records, and of gaps (without a record). With `last`, nothing follows."""
        self.data += more
        if len(self.data) < self.need and not last:
            return
        while self.at < len(self.data):
            records, end, reason = None, self.at, "no member or version line"
            try:
                if self.data.startswith(MAGIC, self.at):
                    records, end = packed_records(self.data, self.at)
                elif self.data.startswith(LINE, self.at):
                    record, end = plain_record(self.data, self.at, self.data.find)
                    records = record and [record]
                elif len(self.data) - self.at >= len(LINE) or last:
                    raise Damaged(reason)
                if records is None:
                    if not last:
                        break  # it may go on
                    raise Damaged("truncated")
                if not records and self.lost is not None:
                    raise Damaged(self.reason)  # an empty member proves nothing
            except Damaged as e:
                if self.lost is None:
                    self.lost, self.reason = self.at, str(e)
                found = MARK.search(self.data, self.at + 1)
                self.at = found.start() if found else max(self.at + 1, len(self.data) - (0 if last else len(LINE) - 1))
                continue
            if self.lost is not None:
                yield self.base + self.lost, self.base + self.at, self.reason, None
                self.lost = None
            for record in records:
                yield self.base + self.at, self.base + end, "", record
            self.at = end
        keep = self.at if self.lost is None else self.lost
        if last and self.lost is not None:
            yield self.base + self.lost, self.base + len(self.data), self.reason, None
            self.lost, keep = None, len(self.data)
        del self.data[:keep]
        self.base, self.at = self.base + keep, self.at - keep
        self.lost = None if self.lost is None else 0
        # a record that takes many pieces is not begun anew with each of them
        self.need = max(GATHERED, 2 * len(self.data)) if self.data else 0

    def rest(self) -> bytes:
        return bytes(self.data)


FOUND = "file string, split long, start long, end long, reason string, type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
EDGES = "length long, size long, head binary, tail binary"


def _batch(rows: list[tuple], edges: bool) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in (f"{FOUND}, {EDGES}" if edges else FOUND).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def read_archives(spark: SparkSession, path: str, compressed: bool = True, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives under path: file, start, end (bytes), reason (of a gap, else ''), type, record_id, target_uri,
    payload_digest, refers_to, payload_bytes, payload (null without `payloads`). A gap has only its place and reason.

    Members that unpack to nothing are passed over. Names of files mustn't end in .gz, as Spark's readers would unpack those. `compressed` says by which byte
    the splits are best read: zero bytes, or line ends for plain archives; records are found either way. Damaged, truncated, empty
    and foreign files don't raise. A task holds one split's unclear bytes and one member. What the splits hold is stored (with the payloads, if they
    are asked for), and so the archives may be removed once this returns.
    """
    line = b"\0" if compressed else b"\n"
    lines = spark.read.option("lineSep", line.decode()).text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"))

    def found(file: str, split: int | None, places) -> Iterator[tuple]:
        for start, end, reason, r in places:
            yield (file, split, start, end, reason, *((*r[:6], r.payload if payloads else None) if r else (None,) * 7))

    def split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, salvage, head, length, size = None, Salvage(), None, 0, 0

        def begun(rows: Iterator[tuple]) -> Iterator[tuple]:
            """Rows of one split; bytes before its first record are its head, not yet a gap."""
            nonlocal head
            for row in rows:
                if head is None and row[5] is None:
                    head = row[3]
                    continue
                head = row[2] if head is None else head
                yield row

        def closed() -> tuple:
            # without any record all of the split is its head
            rest = salvage.rest()
            first, tail = (rest, None) if head is None else (bytes(start[:head]), rest)
            return (*now, None, None, "", *(None,) * 7, length, size, first, tail)

        start = bytearray()
        for batch in batches:
            files, splits, sizes = (column(batch, n) for n in ("file", "split", "size"))
            values = column(batch, "line")
            borders = [0, *(k for k in range(1, len(values)) if splits[k] != splits[k - 1] or files[k] != files[k - 1]), len(values)] if splits[0] != splits[-1] or files[0] != files[-1] else [0, len(values)]
            for low, high in zip(borders, borders[1:], strict=False):
                key = (files[low].as_py(), splits[low].as_py())
                if key != now:
                    if now is not None:
                        yield _batch([*begun(found(*now, salvage.feed(b""))), closed()], True)
                    now, salvage, head, length, size, start = key, Salvage(), None, 0, sizes[low].as_py(), bytearray()
                more = line.join(values.slice(low, high - low).to_pylist()) + line
                length += len(more)
                if head is None:
                    start += more
                rows = [(*r, *(None,) * 4) for r in begun(found(*now, salvage.feed(more)))]
                if rows:
                    yield _batch(rows, True)
        if now is not None:
            yield _batch([closed()], True)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, base, begin, size, run = None, 0, 0, 0, bytearray()

        def done(whole_file: bool = False) -> list[tuple]:
            # the reader of lines adds a separator to a file's last line without one
            extra = base - size if whole_file else 0
            return list(found(file, None, Salvage(begin).feed(bytes(run[:-extra] if extra > 0 else run), True)))

        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != file:
                    if file is not None and (rows := done(True)):
                        yield _batch(rows, False)
                    file, base, begin, run = row["file"], 0, 0, bytearray()
                base, size = base + row["length"], row["size"]
                run += row["head"]
                if row["tail"] is not None:
                    if rows := done():
                        yield _batch(rows, False)
                    begin, run = base - len(row["tail"]), bytearray(row["tail"])
        if file is not None and (rows := done(True)):
            yield _batch(rows, False)

    table = stored(lines.mapInArrow(split_rows, f"{FOUND}, {EDGES}"), "splits")
    edges = table.where("length IS NOT NULL").select("file", "split", "length", "size", "head", "tail")
    joined = edges.repartition("file").sortWithinPartitions("file", "split").mapInArrow(between, FOUND)
    bases = edges.select("file", "split", (F.sum("length").over(Window.partitionBy("file").orderBy("split")) - F.col("length")).alias("base"))
    inside = table.where("length IS NULL").drop("length", "size", "head", "tail").join(bases, ["file", "split"])
    inside = inside.withColumn("start", F.col("start") + F.col("base")).withColumn("end", F.col("end") + F.col("base"))
    return inside.drop("base", "split").unionByName(joined.drop("split"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) as archives, read these back, and tell what they hold: page_id, payload_bytes, payload_digest,
    record_type, refers_to, one row per row of pages. See write_archives() and read_archives() for nulls and ties. Gaps raise."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/lexigrid/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    with noted() as tables:
        records = read_archives(spark, path, payloads=False)
        out = stored(records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), "reason"), "records")
    remove(spark, path)
    discard(*(t for t in tables if t is not out))
    if not (gaps := out.where("reason <> ''")).isEmpty():
        raise RuntimeError(f"archives just written are damaged: {gaps.first()['reason']}")
    return out.drop("reason")
