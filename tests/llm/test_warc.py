"""WARC archives: exact round trips and revisit resolution."""

import base64
import hashlib
import zlib
from pathlib import Path

from textsieve.llm import warc

PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>two</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (3, None, "<p>one</p>"),
    (4, "http://a/\r\nX-Page-ID: 9", None),
    (5, "http://a/5", ""),
    (6, "http://é/6", "é日本🙂\n\r\r\n"),
    (7, "http://a/7", "<p>one</p>"),
    (8, "u", "big " * 300_000),
    (9, "u", "twice"),
    (9, "u", "twice"),
    (None, "u", "no id"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    folder = warc.write_archives(frame(spark), warc.new_folder(spark, "t"))
    got = sorted(((r["page_id"], r["payload"], r["payload_digest"], r["declared_digest"], r["payload_bytes"]) for r in warc.read_archives(spark, folder, with_payload=True).collect()), key=repr)
    assert got == sorted(((i, h or "", sha(h), sha(h), len((h or "").encode())) for i, _, h in PAGES), key=repr)


def test_revisits(spark):
    folder, records = warc.deduplicate(frame(spark))
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in records.collect()), key=repr)
    lead = {}
    for i, _, h in PAGES:
        lead[h or ""] = max(lead.get(h or "", -1), -1 if i is None else i)
    want = [(i, "response" if i is None or i == lead[h or ""] else "revisit", None if i is None or i == lead[h or ""] else lead[h or ""], sha(h)) for i, _, h in PAGES]
    want[9] = (9, "revisit", 9, sha("twice"))
    assert got == sorted(want, key=repr)
    raw = b"".join(zlib.decompress(p.read_bytes(), 31) for p in Path(folder.removeprefix("file:")).glob("*.gz"))
    parsed = list(warc.parse(raw))
    assert sum(len(b) for _, b in parsed) == sum(len(h.encode()) for h in {h or "" for _, _, h in PAGES})
    assert len({f["warc-record-id"] for f, _ in parsed}) == len(PAGES)
    assert all(f["content-length"] == "0" and "warc-profile" in f for f, _ in parsed if f["warc-type"] == "revisit")


def test_short_payloads_are_all_responses(spark):
    _, records = warc.deduplicate(frame(spark), min_bytes=6)
    kinds = {}
    for r in records.collect():
        kinds.setdefault(r["page_id"], set()).add(r["record_type"])
    assert kinds[9] == {"response"} and kinds[4] == kinds[5] == {"response"} and kinds[1] == kinds[3] == {"revisit"} and kinds[7] == {"response"}


def test_no_pages(spark):
    _, records = warc.deduplicate(frame(spark, []))
    assert records.count() == 0


def test_archives_that_hold_revisits(spark):
    """Revisits with larger ids than the response that holds their payload, and one whose response is elsewhere."""
    rows = [(1, 10, "response", None, "kept"), (2, 20, "response", None, "kept"), (3, 90, "revisit", 10, "kept"), (4, None, "revisit", 5, "kept"), (5, 30, "response", None, "other"), (6, 91, "revisit", 7, "gone")]
    records = [warc._record(no, page, f"http://a/{no}", text, kind, "2020-01-01T00:00:00Z", to, sha(text), len(text)) for no, page, kind, to, text in rows]
    records[3] = records[3].replace("X-Payload-Length: 4\r\n", "")
    folder = warc._write(spark.createDataFrame([(r,) for r in records], "value string"), warc.new_folder(spark, "t"))
    decisions = warc.resolve(warc.read_archives(spark, folder))
    out = warc.write_deduplicated(warc.read_archives(spark, folder, with_payload=True), decisions, warc.new_folder(spark, "t"))
    got = {r["record_no"]: (r["record_type"], r["refers_to"], r["payload"], r["declared_digest"]) for r in warc.read_archives(spark, out, with_payload=True).collect()}
    assert got == {
        1: ("revisit", 20, "", sha("kept")), 2: ("response", None, "kept", sha("kept")), 3: ("revisit", 20, "", sha("kept")),
        4: ("revisit", 20, "", sha("kept")), 5: ("response", None, "other", sha("other")), 6: ("revisit", 7, "", sha("gone")),
    }
