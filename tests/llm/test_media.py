import hashlib
import io
import random
import tarfile
import zlib

from chainlake.llm import media
from chainlake.llm.warc import open_shared


def plain_samples(image):
    """The samples of a grey image of 8 bits, by the format's own rules."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(image):
        n = int.from_bytes(image[at : at + 4], "big")
        body = image[at + 4 : at + 8 + n]
        assert zlib.crc32(body) == int.from_bytes(image[at + 8 + n : at + 12 + n], "big")
        chunks.append((body[:4], body[4:]))
        at += 12 + n
    assert chunks[0][0] == b"IHDR" and chunks[-1] == (b"IEND", b"") and {k for k, _ in chunks[1:-1]} == {b"IDAT"}
    width, height = (int.from_bytes(chunks[0][1][i : i + 4], "big") for i in (0, 4))
    assert chunks[0][1][8:] == bytes([8, 0, 0, 0, 0])
    raw = zlib.decompress(b"".join(d for _, d in chunks[1:-1]))
    assert len(raw) == height * (width + 1)
    lines = [raw[k * (width + 1) : (k + 1) * (width + 1)] for k in range(height)]
    assert all(x[0] == 0 for x in lines)  # no filter
    return width, [list(x[1:]) for x in lines]


def plain_feature(lines):
    """Mean in thousandths, and which cells of a grid of 8 by 8 are brighter than it; a cell without a line takes the nearest one."""
    height, total = len(lines), sum(map(sum, lines))
    bits = 0
    for i in range(8):
        a, b = i * height // 8, (i + 1) * height // 8
        band = lines[a:b] or [lines[min(a, height - 1)]]
        for j in range(8):
            cell = [v for line in band for v in line[8 * j : 8 * j + 8]]
            if sum(cell) * height * 64 > total * len(cell):
                bits |= 1 << (8 * i + j)
    return f"mean={total * 1000 // (height * 64)};ahash={bits:016x}"


def expected(rows):
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * ((64 - len(raw) % 64) % 64 or (64 if not raw else 0))
        image = media.encode(payload)
        width, lines = plain_samples(image)
        assert b"".join(map(bytes, lines)) == payload and width == 64
        out.append((str(i), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), plain_feature(lines), 64, len(lines)))
    return sorted(out)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, digest binary, offset int").repartition(3)
    cols = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature width height".split()
    return sorted((str(r.doc_id), *(r[c] for c in cols[1:])) for r in media.media_columns(docs, **options).collect())


def test_images_round_trip():
    rng = random.Random(1)
    for n in (64, 128, 64 * 9, 64 * 1000):
        payload = rng.randbytes(n)
        image = media.encode(payload)
        assert media.decode(image) == payload and media.header(image[: media.HEADER_BYTES]) == (64, n // 64, 8)
    assert media.padded(b"") == bytes(64) and len(media.padded(b"x" * 64)) == 64 and len(media.padded(b"x" * 65)) == 128


def test_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["é" * 40, "same text", "x" * 64, "", None, "y" * 200_000, f"own {i}"])) for i in range(120)] + [(None, "n"), (1, "same text"), (1, "same text")]
    assert got(spark, rows) == expected(rows)
    assert got(spark, rows, shard_bytes=1000) == expected(rows)
    assert got(spark, []) == []


def test_shards_are_tar_files_with_one_member_a_digest(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string").coalesce(1)
    index = media.store(docs).collect()
    (shard,) = {r.shard for r in index}
    system, path = open_shared(shard)
    with system.open_input_file(path) as file:
        data = file.read()
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        found = {m.name: (m.offset_data, m.size) for m in tar.getmembers()}
    assert found == {f"{bytes(r.digest).hex()}.png": (r.offset, r.length) for r in index} and len(found) == 7
