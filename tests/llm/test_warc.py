import gzip
import hashlib
import os
import random
from collections import defaultdict

import pytest

from lexigrid.llm.warc import Salvage, archive_pages, member, read_archives, warc_record, write_archives

DATE = "2024-05-01T00:00:00Z"


def a_record(i, payload):
    return warc_record(i, f"http://x/{i}", payload, len(payload), hashlib.sha1(payload).digest(), None, DATE)


def payloads(n, seed=1):
    rng = random.Random(seed)
    return [rng.randbytes(rng.randint(0, 3000)) if rng.random() < 0.3 else b"<p>text WARC/1.0 \x1f\x8b\x08 \r\n\r\n</p>" * rng.randint(0, 60) for _ in range(n)]


def packed(data):
    return [member(a_record(i, p)) + b"\0" for i, p in enumerate(data)]


def salvaged(pieces):
    s, out = Salvage(), []
    for k, piece in enumerate(pieces):
        out += s.feed(piece, k == len(pieces) - 1)
    return out


def as_rows(df):
    # why a gap is none may show later or sooner, as a split ends; where it lies may not
    return sorted((r["start"], r["end"], bool(r["reason"]), r["record_id"], None if r["payload"] is None else bytes(r["payload"])) for r in df.collect())


@pytest.mark.parametrize("plain", [False, True])
def test_whole_archives_in_pieces(plain):
    data = payloads(60)
    members = [a_record(i, p) for i, p in enumerate(data)] if plain else packed(data)
    whole, size = b"".join(members), 777
    for pieces in ([whole], [whole[k : k + size] for k in range(0, len(whole), size)]):
        out = salvaged(pieces)
        assert [r.payload for *_, r in out] == data and [(s, e) for s, e, *_ in out] == [(sum(map(len, members[:k])), sum(map(len, members[: k + 1]))) for k in range(60)]


def damaged(members, rng):
    """An archive with a flipped byte, one cut short, junk between two and a truncated end; numbers of the lost records."""
    parts, lost = list(members), [5, 6, 20, len(members) - 1]
    parts[5] = parts[5][:40] + bytes([parts[5][40] ^ 255]) + parts[5][41:]
    parts[6] = parts[6][:4] + rng.randbytes(30) + parts[6][34:]
    parts[20] = parts[20][:-9]
    parts[30] = rng.randbytes(500) + parts[30]
    parts[-1] = parts[-1][:-3]
    return b"".join(parts), lost


@pytest.mark.parametrize("plain", [False, True])
def test_records_after_damage_are_recovered(spark, tmp_path, plain):
    rng = random.Random(2)
    data = [p + b"x" * 50 for p in payloads(40)]
    members = [a_record(i, p.replace(b"WARC/1.", b"warc")) for i, p in enumerate(data)] if plain else packed(data)
    whole, lost = damaged(members, rng)
    out = salvaged([whole])
    assert [r.record_id for *_, r in out if r] == [f"<urn:page:{i}>" for i in range(40) if i not in lost]
    gaps = [(s, e) for s, e, _, r in out if r is None]
    assert len(gaps) == 4 and all(reason for *_, reason, r in out if r is None)
    # records and gaps are all there is, and the gaps are no larger than what was damaged
    places = sorted((s, e) for s, e, *_ in out)
    assert places[0][0] == 0 and places[-1][1] == len(whole) and all(a[1] == b[0] for a, b in zip(places, places[1:], strict=False))
    assert any(e - s == 500 for s, e in gaps)
    (tmp_path / "a.warc").write_bytes(whole)
    expected = sorted((s, e, bool(reason), r and r.record_id, r and r.payload) for s, e, reason, r in out)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4000", "700"):  # splits larger and smaller than a record
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert as_rows(read_archives(spark, str(tmp_path / "a.warc"), compressed=not plain)) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_checks():
    good = a_record(1, b"payload")
    for bad, reason in ((good.replace(b"payload", b"paYload"), "payload digest"), (good.replace(b"WARC/1.0", b"WARC/1.7"), "version line"), (good.replace(b"Content-Length: ", b"Content-Length: 1"), "content length"), (good.replace(b"WARC-Record-ID", b"X"), "header"), (good[:-2] + b"xx", "content length")):
        (start, end, why, record), (*_, after) = salvaged([bad + good])
        assert (start, end, why, record) == (0, len(bad), reason, None) and after.payload == b"payload"
    assert salvaged([b""]) == [] and [r[:3] for r in salvaged([b"junk"])] == [(0, 4, "no member or version line")]
    two = gzip.compress(good + a_record(2, b""))
    assert [r.payload for *_, r in salvaged([two + gzip.compress(b"") + gzip.compress(good)])] == [b"payload", b"", b"payload"]


def brute(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        if html is not None and len(html.encode()) >= 1000 and page is not None:
            groups[html].append(page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        last = max(groups[html]) if html in groups else None
        again = last is not None and page != last
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def test_pages_come_back(spark):
    rng = random.Random(4)
    texts = ["", None, "small", "é" * 499, "é" * 500, "x" * 999, "x" * 1000, "y\0\r\n\r\nWARC/1.0\r\n" * 100, "z" * 3_000_000]
    rows = [(i, rng.choice(["http://a/ b\nc", None, "http://ü"]), rng.choice(texts)) for i in range(150)]
    rows += [rows[3], (200, "u", "x" * 1000), (200, "u", "x" * 1000), (None, "n", "x" * 1000), (None, "n", "only null ids" * 100), (None, None, None)]
    pages = spark.createDataFrame([(*r, "other", 1) for r in rows], "page_id long, url string, html string, digest string, length long")
    out = archive_pages(pages)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)
    assert archive_pages(pages.limit(0)).count() == 0


def test_archives_are_gzip_members_that_others_can_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "q" * 1500), (2, "http://b", "q" * 1500), (3, None, "r")], "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "w"))
    text = b"".join(gzip.decompress((tmp_path / "w" / f).read_bytes()) for f in sorted(os.listdir(tmp_path / "w")) if f.startswith("part-"))
    assert text.count(b"WARC/1.0\r\n") == 3 and text.count(b"q" * 1500) == 1
    rows = {r["record_id"]: r for r in read_archives(spark, str(tmp_path / "w")).collect()}
    assert rows["<urn:page:1>"]["type"] == "revisit" and rows["<urn:page:1>"]["refers_to"] == "<urn:page:2>" and rows["<urn:page:1>"]["payload_bytes"] == 1500
    assert rows["<urn:page:3>"]["target_uri"] is None and bytes(rows["<urn:page:3>"]["payload"]) == b"r"
