import hashlib
import io
import random

import pytest

from chainlake.llm import warc


def rec(i, payload):
    return warc.record("response", f"urn:page:{i}", f"http://x/{i}", "1970-01-01T00:00:00Z", payload, payload_digest=warc.sha1_label(payload))


def read(data, step=1 << 20):
    records, gaps, at, last = {}, [], 0, (-1, 0)
    for item in warc.salvage(io.BytesIO(data), len(data), step):
        if item[1:3] != last and item[2] is not None:  # several items of one member
            assert item[1] == at  # records and gaps cover every byte
            at, last = at + item[2], item[1:3]
        if item[0] == "record":
            records[item[3]["warc-record-id"]] = item[4]
        else:
            gaps.append(item[1:])
    assert at == len(data)
    return records, gaps


def payloads(seed):
    rng = random.Random(seed)
    out = [rng.randbytes(rng.randrange(0, 5000)) for _ in range(30)]
    out[3] = b"text WARC/1.1\r\nWARC-Type: response\r\n\r\n inside" + warc.member(b"no record")
    return out


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("step", [64, 1 << 20])
def test_damage_is_skipped_and_logged(packed, step):
    for seed in range(4):
        rng, bodies = random.Random(seed), payloads(seed)
        parts = [warc.member(rec(i, p)) if packed else rec(i, p) for i, p in enumerate(bodies)]
        assert read(b"".join(parts), step) == ({f"<urn:page:{i}>": p for i, p in enumerate(bodies)}, [])
        hurt = set(rng.sample([i for i in range(30) if i != 3], 5))
        damaged = list(parts)
        for i in hurt:
            kind, part = rng.randrange(3), parts[i]
            where = rng.randrange(len(part))
            if kind == 0:
                damaged[i] = part[: where // 2]
            elif kind == 1:
                damaged[i] = part[: len(part) // 2] + bytes(b ^ 0x55 for b in part[len(part) // 2 : len(part) // 2 + 40]) + part[len(part) // 2 + 40 :]
            else:
                damaged[i] = b"\x1f\x8b\x08garbage" + part[10:]
        records, gaps = read(b"".join(damaged), step)
        kept = {f"<urn:page:{i}>": p for i, p in enumerate(bodies) if i not in hurt}
        assert {k: v for k, v in records.items() if k in kept} == kept
        assert {int(k[10:-1]) for k in records} <= set(range(30)) and gaps


def test_members_with_several_records():
    bodies = payloads(9)
    whole = [rec(i, p) for i, p in enumerate(bodies)]
    want = {f"<urn:page:{i}>": p for i, p in enumerate(bodies)}
    data = warc.member(b"".join(whole[:10])) + warc.member(b"".join(whole[10:]))
    assert read(data) == (want, [])
    hurt = b"".join([*whole[:4], whole[4].replace(b"Content-Length", b"Content-Lenght"), *whole[5:]])
    records, gaps = read(warc.member(hurt))
    assert {**records, "<urn:page:4>": bodies[4]} == want and len(records) == 29
    assert [g[2] for g in gaps] == [f"bytes {sum(map(len, whole[:4]))} to {sum(map(len, whole[:5]))} inside the member: a required header is missing"]


def test_records_before_damage_are_kept():
    bodies = [random.Random(i).randbytes(3000) for i in range(40)]
    good = warc.member(b"".join(rec(i, p) for i, p in enumerate(bodies)))
    after = warc.member(rec(99, b"after"))
    for part in (good[: len(good) // 2], good[: len(good) // 2] + b"\xff" * 200 + good[len(good) // 2 + 200 :], good[:-8] + b"\0" * 8):
        records, gaps = read(part + after)
        assert records.pop("<urn:page:99>") == b"after" and 15 <= len(records) <= 40
        assert all(records[f"<urn:page:{i}>"] == bodies[i] for i in range(len(records)))
        assert [g[:2] for g in gaps] == [(0, len(part))]


def test_search_goes_over_each_byte_once():
    """Many places that look like members, in one archive: each search starts where the last one ended."""
    part = b"\x1f\x8b\x08" + b"\0" * 61
    data = part * 3000 + rec(1, b"x" * 10)

    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n):
            out = super().read(n)
            Counting.read_bytes += len(out)
            return out

    found = list(warc.salvage(Counting(data), len(data), 4096))
    assert [f[0] for f in found] == ["gap", "record"] and found[0][2] == 64 * 3000
    assert Counting.read_bytes < 3000 * (1 << 16) * 2 + 10 * len(data)


def plain(rows):
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in bodies:
        same = [j for j, c in bodies if c == b]
        winner = max(same) if len(b) >= 1000 else i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if winner == i else "revisit", None if winner == i else winner))
    return sorted(out, key=str)


def got(spark, rows, **options):
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(4)
    records = warc.read_archives(warc.write_archives(pages, **options))
    return sorted(map(tuple, warc.page_records(records).collect()), key=str)


def test_pages_come_back(spark):
    rng = random.Random(1)
    texts = ["é" * 500, "é" * 499 + "x", "a" * 1000, "", None, "x" * 100_000, "line\r\n\r\nWARC/1.0\r\n" * 99]
    rows = [(i, rng.choice([None, "http://a/b\r\nc", "é"]), rng.choice(texts)) for i in range(200)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, archive_bytes=1) == plain(rows)
    assert got(spark, []) == []


def test_repeated_rows_and_null_ids(spark):
    body = "b" * 2000
    rows = [(1, "u", body), (1, "u", body), (None, "u", body), (2, None, "s"), (2, None, "s"), (None, "u", "n" * 1500), (None, "u", "n" * 1500)]
    found = got(spark, rows)
    digest = hashlib.sha1(body.encode()).hexdigest()
    assert sorted((str(r[0]), r[3], r[4]) for r in found if r[2] == digest) == [("1", "response", None), ("1", "response", None), ("None", "revisit", 1)]
    assert sorted(r[3] for r in found if r[1] == 1500) == ["response", "response"] and all(r[1] in (2000, 1500, 1) for r in found)
    assert [r[3] for r in found if r[1] == 1] == ["response"] * 2
