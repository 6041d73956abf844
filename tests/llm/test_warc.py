"""WARC: round trip, revisits, magic inside payloads, splits of any size, broken files."""

import hashlib

import pytest

from repograin.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 0) for i, u, h in rows], "page_id bigint, url string, html string, _id int")


def rows():
    big = "é" * 700
    out = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i * 7 % 90)) for i in range(60)]
    out += [(100, "u", big), (101, "u\r\nX: y", big), (102, None, big), (None, "n", big), (103, "s", "same"), (104, "s", "same")]
    out += [(200, "m", FAKE), (201, "m", "WARC/1." * 300), (202, "m", "x" * 3000 + FAKE * 20 + "\r\n\r\nWARC/1."), (203, "e", None), (204, "e", ""), (102, None, big)]
    return out


@pytest.mark.parametrize("split", ["134217728", "2000", "300"])
def test_round_trip(spark, tmp_path, split):
    given = rows()
    path = str(tmp_path / "archive")
    warc.write_warc(pages(spark, given).coalesce(2), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.read_warc(spark, path, with_payload=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    big = hashlib.sha1(("é" * 700).encode()).hexdigest()

    def want(i, html):
        body = (html or "").encode()
        sha = hashlib.sha1(body).hexdigest()
        if sha == big and i != 102:
            return (str(i), "revisit", "102", "sha1:" + sha, len(body), None, None) if i is not None else (None, "revisit", "102", "sha1:" + sha, len(body), None, None)
        return (i if i is None else str(i), "response", None, "sha1:" + sha, len(body), sha, body)

    have = sorted(((r.page_id, r.type, r.refers_to, r.stated, r.stated_bytes, r.digest, None if r.payload is None else bytes(r.payload)) for r in got), key=repr)
    assert have == sorted((want(i, h) for i, _, h in given), key=repr)
    assert all("\r" not in (r.uri or "") for r in got)


def test_a_chain_ends_at_a_broken_record(spark, tmp_path):
    record = lambda n, body: f"WARC/1.0\r\nWARC-Type: resource\r\nX-Page-Id: {n}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record(1, "one") + record(2, "two") + "junk" + record(3, "three")).encode())
    (tmp_path / "b.warc").write_bytes(("junk" + record(4, "four")).encode())
    (tmp_path / "c.warc").write_bytes((record(5, "five") + record(6, "six")[:-6]).encode())
    got = {r.page_id: r.digest for r in warc.read_warc(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    assert got == {"1": sha("one"), "2": sha("two"), "5": sha("five"), "6": None}


def test_empty(spark, tmp_path):
    warc.write_warc(pages(spark, []), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_a_broken_record_with_an_empty_body_has_the_digest_of_nothing(spark, tmp_path):
    http = f"HTTP/1.1 200 OK\r\nX-Note: {warc.MAGIC}\r\n\r\n" if "\r\n\r\n" not in warc.MAGIC else None
    if http is None:  # the magic ends a header, so it can only stand in a body
        http = f"HTTP/1.1 200 OK\r\n\r\n{warc.MAGIC}"
    record = f"WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: 1\r\nContent-Length: {len(http)}\r\n\r\n{http}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record.encode())
    row = warc.read_warc(spark, str(tmp_path)).first()
    body = http.split("\r\n\r\n", 1)[1].encode()
    assert (row.digest, row.bytes) == (hashlib.sha1(body).hexdigest(), len(body))
