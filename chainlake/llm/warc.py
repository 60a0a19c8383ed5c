"""Operator 8: WARC archives with revisit records, read back by a salvaging reader.

Writing: of pages with equal payloads of at least MIN_BYTES bytes, the one with the largest id is a response, the others are
revisits that refer to it; smaller payloads are all responses. Each record is a gzip member of its own, in archives of at
most about ARCHIVE_BYTES that tasks write to the shared folder; a manifest (Parquet, committed by Spark) names the archives
of the attempts that count, so files of lost or repeated attempts are never read.

Reading: a member is good if it inflates, its checksum and length hold, and it holds a good record: one that starts with a
version line, its headers parse, its block has the stated length and ends in two line ends, and its block digest holds. A
member with several records gives each; what fails between them is searched for the next version line and logged. After a
failed check the reader searches from the next byte for the next member that is good (or, in plain archives, the next version
line that starts a good record), and logs the bytes skipped as a quarantined gap (archive, offset, length, reason). Of a
member that is damaged, the records before the damage are kept. Archives are read in steps; only one member is held at a
time; the search goes over each byte once for members and once for version lines.

Scale: digests and lengths are made by Spark's functions. Only ids and digests are grouped; the winner's id comes back to
the rows by a plain join on the digest, whose skewed keys Spark splits, so a payload that a third of all pages share is
spread over tasks. Revisits take their length from the response they refer to by a join on the record id.

Defined cases: a null html is an empty payload; of repeated rows of the largest page_id each is a response; null ids lose
against others, and among null ids alone each is a response; an empty table writes no archive; other columns than page_id, url and html are ignored; a payload may be of any
size that fits in a task's memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.shared import cut, new_path, table

MIN_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
_STEP = 1 << 20
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_BLANK = b"\r\n\r\n"
#: A record's headers end within so many bytes.
HEADERS_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def one_line(text: str | None) -> str:
    """A header's value: no line ends, and nothing that isn't UTF-8."""
    return re.sub(r"[\r\n\x00]+", "%20", text or "").strip()


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, *, payload_digest: str, refers_to: str | None = None, extra: tuple = ()) -> bytes:
    """A WARC/1.1 record, not compressed. A revisit's block is empty."""
    block = payload if kind == "response" else b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", one_line(uri)), ("Content-Type", "application/octet-stream")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("WARC-Payload-Digest", payload_digest), ("WARC-Block-Digest", sha1_label(block)), *extra, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    deflate = zlib.compressobj(level, wbits=31)
    return deflate.compress(data) + deflate.flush()


class Source:
    """Bytes of a file by absolute offset, of which a window is held."""

    def __init__(self, file, size: int, step: int = _STEP):
        self.file, self.size, self.step, self.start, self.held = file, size, step, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        end = min(offset + n, self.size)
        if offset < self.start or end > self.start + len(self.held):
            self.file.seek(offset)
            self.start, self.held = offset, self.file.read(min(max(n, self.step), self.size - offset))
        return self.held[offset - self.start : end - self.start]

    def find(self, what: bytes, offset: int) -> int:
        """The next place of `what` at or after offset, else the size."""
        while offset < self.size:
            part = self.at(offset, self.step)
            if (i := part.find(what)) >= 0:
                return offset + i
            offset += max(1, len(part) - len(what) + 1)
        return self.size


class Bad(Exception):
    pass


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), block and end of the record that data has at `at`; Bad, with the reason, if a check fails."""
    if not _VERSION.match(data, at):
        raise Bad("no version line")
    end = data.find(_BLANK, at, at + HEADERS_BYTES)
    if end < 0:
        raise Bad("headers don't end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Bad("a header has no name")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in headers or "warc-record-id" not in headers:
        raise Bad("a required header is missing")
    stop = end + 4 + int(length)
    if stop + 4 > len(data) or data[stop : stop + 4] != _BLANK:
        raise Bad("the block's length is wrong")
    block = data[end + 4 : stop]
    digest = headers.get("warc-block-digest")
    if digest and digest.startswith("sha1:") and digest != sha1_label(block):
        raise Bad("the block's digest is wrong")
    return headers, block, stop + 4


def inside(data: bytes, until_bad: bool = False) -> Iterator[tuple]:
    """("record", headers, block) and ("gap", first byte, bytes, reason) of a member's content; only the records up to the first gap if until_bad."""
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            headers, block, end = parse(data, at)
        except Bad as e:
            if until_bad:
                return
            if lost is None:
                lost, why = at, str(e)
            at = data.find(b"WARC/1.", at + 1)
            at = len(data) if at < 0 else at
            continue
        if lost is not None:
            yield "gap", lost, at - lost, why
            lost = None
        yield "record", headers, block
        at = end
    if lost is not None:
        yield "gap", lost, len(data) - lost, why


def _inflate(source: Source, offset: int, at_once: int = 0) -> tuple[bytes, int, str | None]:
    """What the member inflates to, its length in the file, and what is wrong with it. at_once: bytes to inflate at a time, so that
    those before damage are kept (0: all, which is faster)."""
    if source.at(offset, 3) != _MEMBER:
        return b"", 0, "no member starts here"
    inflate, out, at = zlib.decompressobj(wbits=31), [], offset
    try:
        while not inflate.eof:
            part = inflate.unconsumed_tail
            if not part:
                part = source.at(at, 1 << 16)
                at += len(part)
                if not part:
                    return b"".join(out), at - offset, "the member is cut off"
            out.append(inflate.decompress(part, at_once))
    except zlib.error:
        return _inflate(source, offset, 512) if not at_once else (b"".join(out), at - offset, "the member doesn't inflate")
    return b"".join(out), at - len(inflate.unused_data) - offset, None


def _plain(source: Source, offset: int) -> tuple[dict[str, str], bytes, int]:
    """The plain record at offset; its block is read only if what follows it is its end."""
    if not _VERSION.match(source.at(offset, 16)):
        raise Bad("no version line")
    head = source.at(offset, HEADERS_BYTES)
    end = head.find(_BLANK)
    m = re.search(rb"(?i)\ncontent-length:\s*(\d{1,18})\s*\r\n", head[: end + 4])
    if end < 0 or not m:
        raise Bad("a required header is missing" if end >= 0 else "headers don't end")
    size = end + 4 + int(m[1])
    if source.at(offset + size, 4) != _BLANK:
        raise Bad("the block's length is wrong")
    return parse(source.at(offset, size + 4))


def salvage(file, size: int, step: int = _STEP) -> Iterator[tuple]:
    """("record", offset, length, headers, block) and ("gap", offset, length, reason), in order, of a whole archive.

    Records of one member share its offset and length, as do gaps inside of it; those saved from a damaged member have no
    length, and the gap after them is all of the member.
    """
    source, offset, lost, why = Source(file, size, step), 0, None, ""
    seen = {_MEMBER: -1, b"WARC/1.": -1}

    def following(what: bytes, start: int) -> int:
        if seen[what] < start:
            seen[what] = source.find(what, start)
        return seen[what]

    while offset < size:
        items, problem = [], None
        if source.at(offset, 3) == _MEMBER:
            data, length, problem = _inflate(source, offset)
            found = list(inside(data, until_bad=problem is not None))
            if problem is None and not any(f[0] == "record" for f in found):
                problem = found[0][3] if found else "the member is empty"
            elif problem is None:
                items = [("record", offset, length, *f[1:]) if f[0] == "record" else ("gap", offset, length, f"bytes {f[1]} to {f[1] + f[2]} inside the member: {f[3]}") for f in found]
            else:
                items = [("record", offset, None, *f[1:]) for f in found]
        else:
            try:
                headers, block, length = _plain(source, offset)
                items = [("record", offset, length, headers, block)]
            except Bad as e:
                problem = str(e)
        if lost is not None and items:
            yield "gap", lost, offset - lost, why
            lost = None
        yield from items
        if problem is None:
            offset += length
            continue
        if lost is None:
            lost, why = offset, problem
        # the nearer of the next member and the next version line
        offset = min(following(what, offset + 1) for what in seen)
    if lost is not None:
        yield "gap", lost, size - lost, why


def open_shared(path: str):
    """(filesystem, path in it) of a shared folder's path, by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def planned(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to, record_type of every row."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= min_bytes
    winners = rows.where(large).groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("winner"), F.count("*").alias("rows")).where("rows > 1")
    joined = rows.join(winners, (F.col("digest") == F.col("of")) & large, "left")
    is_revisit = F.col("rows").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return joined.select("page_id", "url", "payload", F.when(is_revisit, F.col("winner")).alias("refers_to"), F.when(is_revisit, "revisit").otherwise("response").alias("record_type"))


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all rows to archives in the shared folder; the manifest: path, bytes, records."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, base = open_shared(folder)
        system.create_dir(base, recursive=True)
        out, name, at, records, done = None, "", 0, 0, []
        for batch in batches:
            for page, url, payload, refers, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at, records = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                urn = lambda x: "urn:page:" + ("null" if x is None else str(x))
                data = member(record(kind, urn(page), url, "1970-01-01T00:00:00Z", payload, payload_digest="sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(), refers_to=urn(refers) if kind == "revisit" else None))
                out.write(data)
                at, records = at + len(data), records + 1
                if at >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", at, records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", at, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "bytes", "records"])

    return cut(planned(pages, min_bytes).mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """path, offset, length, problem (of a gap; else null), record_type, record_id, refers_to, url, payload_digest (hex), payload of every record and gap."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("problem", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        plain = lambda v: v.strip("<>") if v else None
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = open_shared(path)
                rows, held = [], 0
                with system.open_input_file(inner) as file:
                    for item in salvage(file, size if size is not None else file.size()):
                        if item[0] == "gap":
                            rows.append((path, *item[1:], None, None, None, None, None, None))
                        else:
                            _, offset, length, h, block = item
                            digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                            digest = base64.b32decode(digest).hex() if re.fullmatch("[A-Z2-7]{32}", digest) else None
                            kind = h["warc-type"]
                            rows.append((path, offset, length, None, kind, plain(h["warc-record-id"]), plain(h.get("warc-refers-to")), h.get("warc-target-uri"), digest, block if kind != "revisit" else None))
                            held += len(block)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    kinds = "path string, offset long, length long, problem string, record_type string, record_id string, refers_to string, url string, payload_digest string, payload binary"
    n = max(1, manifest.count())
    # by range, as hashes of n paths would leave some of n tasks with several
    return manifest.select("path", "bytes").repartitionByRange(min(n, 100_000), "path").mapInArrow(run, kinds)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back; a revisit's length is its response's."""
    number = lambda c: F.expr(f"try_cast(substr({c}, 10) as long)")
    read = records.where("problem is null").select("record_id", "record_type", F.col("refers_to").alias("target"), F.octet_length("payload").cast("long").alias("own"), F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"))
    read = cut(read, "warc-records")
    responses = read.where("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("payload_digest").alias("same"), F.col("own").alias("full"))
    # the digest too, as ids may recur with other payloads; equal rows may recur as well
    responses = responses.distinct()
    joined = read.join(responses, (F.col("target") == F.col("of")) & (F.col("payload_digest") == F.col("same")), "left")
    return joined.select(number("record_id").alias("page_id"), F.coalesce("own", "full").alias("payload_bytes"), "payload_digest", "record_type", number("target").alias("refers_to"))


def op8_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(read_archives(write_archives(table(spark, sf_dir, "pages"))))


QUERIES = {"op8_warc_roundtrip": op8_warc_roundtrip}

SQL = {
    "op8_warc_roundtrip": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS winner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN winner END AS refers_to
FROM w""",
}
