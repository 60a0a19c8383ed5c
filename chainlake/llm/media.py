"""Operator 2: media columns over content-addressed payloads in tar shards.

A payload is a text's UTF-8 bytes with zero bytes up to a positive multiple of 64. It is stored, without loss, as a PNG
image of 8-bit grey samples, 64 a row, as a member of a tar shard whose name is the payload's SHA-256. Rows carry digest,
shard, offset and length. Header-only range reads (the first 33 bytes of a member) fill width, height and bit depth;
reading a member back gives the samples, and the features are made from those.

Scale: tasks write shards of about SHARD_BYTES each to the shared folder while they read the texts, so no text is
shuffled. A task stores a digest once; where several tasks met the same one, the index keeps one place for it (a grouped
minimum), and the others are dead bytes, at most one copy a task. Only what the committed index names is read: shards of
lost or repeated attempts are never looked at. Members are read back in order of shard and offset, TASK_BYTES a task, in steps, each once
however many rows share it; rows get their columns by a plain join on the digest, whose skewed keys Spark splits.

Defined cases: null and empty texts are 64 zero bytes with n_bytes 0; repeated rows share one member; null ids are kept; an
empty table writes no shard; columns other than doc_id and text are ignored; one payload must fit in a task's memory.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.shared import cut, new_path, table
from chainlake.llm.warc import Source, open_shared

ROW = 64
SHARD_BYTES = 256 << 20
#: Bytes of members that a task reads back, up to so many tasks.
TASK_BYTES = 16 << 20
MOST_TASKS = 100_000
#: Signature and first chunk of the image: all that metadata needs.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW or (0 if text else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = 6) -> bytes:
    """A grey 8-bit image of the payload, ROW samples a row, rows not filtered."""
    import numpy as np

    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("this member is no image")
    return struct.unpack(">IIB", first[16:25])


def decode(media: bytes) -> bytes:
    """The payload of encode()'s image, checksums checked."""
    import numpy as np

    width, height, _ = header(media)
    at, parts = 8, []
    while at < len(media):
        n = struct.unpack(">I", media[at : at + 4])[0]
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean sample in thousandths, and the average hash: which of 8 x 8 equal cells are brighter than the mean of all."""
    import numpy as np

    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW).astype(np.int64)
    edges = [i * len(image) // 8 for i in range(9)]
    cells = []
    for a, b in zip(edges, edges[1:]):
        band = image[a:b] if b > a else image[min(a, len(image) - 1)][None, :]
        cells += [(int(s), len(band) * 8) for s in band.sum(axis=0).reshape(8, 8).sum(axis=1)]
    total = int(image.sum())
    bits = sum(1 << i for i, (s, n) in enumerate(cells) if s * image.size > total * n)
    return f"mean={total * 1000 // image.size};ahash={bits:016x}"


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of a plain file; sizes beyond the octal field's are in base 256."""
    digits = b"%011o\0" % size if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    block = struct.pack("100s8s8s8s12s12s8sc100s6s2s32s32s8s8s155s12x", name.encode(), b"0000644\0", b"0000000\0", b"0000000\0", digits, b"%011o\0" % 0, b" " * 8, b"0", b"", b"ustar\0", b"00", b"", b"", b"", b"", b"")
    return block[:148] + b"%06o\0 " % sum(block) + block[156:]


def store(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all payloads to shards in the shared folder; the index, as a written table: doc_id, n_bytes, digest, shard, offset, length."""
    spark = docs.sparkSession
    folder = new_path(spark, "shards")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, base = open_shared(folder)
        system.create_dir(base, recursive=True)
        out, shard, at, have = None, "", 0, {}
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                payload = padded(raw)
                digest = hashlib.sha256(payload).digest()
                if digest not in have:
                    if out is None:
                        shard = f"{folder}/{uuid.uuid4().hex}.tar"
                        out, at = system.open_output_stream(f"{base}/{shard.rpartition('/')[2]}", compression=None), 0
                    media = encode(payload)
                    out.write(tar_header(f"{digest.hex()}.png", len(media)))
                    out.write(media)
                    out.write(bytes(-len(media) % 512))
                    have[digest] = (shard, at + 512, len(media))
                    at += 512 + len(media) + -len(media) % 512
                    if at >= shard_bytes:
                        out.write(bytes(1024))
                        out.close()
                        out = None
                rows.append((len(raw), digest, *have[digest]))
            if rows:
                n_bytes, digests, shards, offsets, lengths = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(digests, pa.binary()), pa.array(shards), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    kind = dict(docs.dtypes)["doc_id"]
    chosen = docs.selectExpr("doc_id", "cast(text as string) text")
    return cut(chosen.mapInArrow(run, f"doc_id {kind}, n_bytes long, digest binary, shard string, offset long, length long"), "media-index")


def members(index: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one place of each digest, in order of place, TASK_BYTES of members a task."""
    place = F.min(F.struct("shard", "offset", "length")).alias("at")
    found = cut(index.groupBy("digest").agg(place).select("digest", "at.*"), "media-members")
    n = (found.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES + 1
    return found.repartitionByRange(min(n, MOST_TASKS), "shard", "offset").sortWithinPartitions("shard", "offset")


def _by_range(step: int, use):
    """Batches of members with the columns that use(source, digest, offset, length) makes; the first four columns stay."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, file, source = None, None, None
        for batch in batches:
            new = []
            for digest, shard, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard != held:
                    if file is not None:
                        file.close()
                    system, path = open_shared(shard)
                    file, held = system.open_input_file(path), shard
                    source = Source(file, file.size(), step)
                new.append(use(source, digest, offset, length))
            if new:
                made = [pa.array([row[name] for row in new]) for name in new[0]]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *new[0]])
        if file is not None:
            file.close()

    return run


def with_metadata(found: DataFrame) -> DataFrame:
    """members() with width, height and bit_depth, by header-only range reads."""

    def use(source: Source, digest: bytes, offset: int, length: int) -> dict:
        width, height, depth = header(source.at(offset, HEADER_BYTES))
        return {"width": width, "height": height, "bit_depth": depth}

    return found.mapInArrow(_by_range(HEADER_BYTES, use), "digest binary, shard string, offset long, length long, width long, height long, bit_depth long")


def with_features(found: DataFrame) -> DataFrame:
    """members() or with_metadata() with what the stored bytes, read back, give; a member that isn't its digest's is an error."""

    def use(source: Source, digest: bytes, offset: int, length: int) -> dict:
        media = source.at(offset, length)
        payload = decode(media)
        if hashlib.sha256(payload).digest() != digest:
            raise ValueError(f"the member at {offset} isn't {digest.hex()}")
        return {"payload_bytes": len(payload), "payload_sha256": digest.hex(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(payload)}

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.mapInArrow(_by_range(1 << 20, use), f"{kinds}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes and all media columns of every row of docs."""
    index = store(docs, shard_bytes)
    found = cut(with_features(with_metadata(members(index))).drop("shard", "offset", "length"), "media-columns").withColumnRenamed("digest", "of")
    return index.select("doc_id", "n_bytes", "digest", "shard", "offset", "length").join(found, F.col("digest") == F.col("of")).drop("of", "digest")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media_columns(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


QUERIES = {"op2_media_columns": op2_media_columns}
SQL: dict[str, str] = {}
