"""WARC archives: written by Spark's text sink, read back in splits with verified record boundaries.

Writing needs nothing but a text sink: a record is a line that ends with CR LF CR LF.

Reading splits files at every occurrence of the record magic, also inside payloads. Each such chunk is a candidate: its
header, if it has one, names the offset of its successor. A record is real if it is reached from the start of its file:

* inside a split, candidates are followed to the offset where their chain leaves the split;
* across splits, pointer jumping over these exits (each round doubles the reach) finds the entry of each split;
* from its entry, each split marks what is reached. Magic inside a payload never is.

Chunks of a payload that holds the magic are put together again, also across splits, in a second pass that runs only if
there are any. A chain that meets a broken record ends there. Memory is bounded by a split and by the longest record; file size is not limited.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repograin.llm.scratch import bucket_of, bucket_table, written
from repograin.llm.ship import ship

MAGIC = "WARC/1."
STEP = len(MAGIC)
GAP = "\r\n\r\n"
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NEVER = "1970-01-01T00:00:00Z"


# ------------------------------------------------------------------------------------------------------------ writing


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", page.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    date: str = _NEVER,
) -> None:
    """One record per row of ``pages``, in as many files as the table has splits.

    Of rows with equal payloads of ``revisit_bytes`` or more, the one with the largest id is a response and the others
    are revisits of it (a null id counts as the smallest; rows repeated with the same id and payload are alike). Null
    payload is empty. The payload follows an HTTP header in the block, as a crawler stores it.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    raw = F.encode(body, "UTF-8")
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), body.alias("_body"), F.sha1(raw).alias("_sha"), F.octet_length(body).alias("_n")
    )
    narrow = written(rows.where(F.col("_n") >= revisit_bytes).select("_id", "_sha"), "warc-digests")
    groups = written(narrow.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k"), "warc-groups")
    again = narrow.join(groups, "_sha").where("_keep IS NOT NULL AND NOT (_id <=> _keep)").distinct()
    again = written(again.withColumnsRenamed({"_id": "_rid", "_sha": "_rsha"}), "warc-revisits")
    # Only revisits are joined: where they are few, Spark sees the size of their files and moves no payload.
    marked = rows.join(again, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_sha") == F.col("_rsha")), "left")
    revisit = F.col("_keep").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_n").cast("string"), F.lit(GAP))
    block = F.when(revisit, http).otherwise(F.concat(http, "_body"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    some = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    record = F.concat(
        F.lit(f"{MAGIC}0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("_id"), F.col("_sha"))),
        line("WARC-Date", F.lit(date)),
        some("WARC-Target-URI", F.regexp_replace("_url", r"[\x00-\x20\x7f]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha"))),
        some("WARC-Refers-To", F.when(revisit, _record_id(F.col("_keep"), F.col("_sha")))),
        some("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        some("X-Page-Id", F.col("_id").cast("string")),
        some("X-Refers-To-Page", F.col("_keep").cast("string")),
        line("X-Payload-Length", F.col("_n").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    marked.select(record.alias("value")).write.option("lineSep", GAP).text(path)


# ------------------------------------------------------------------------------------------------------------ reading

_HEADER = "type string, record_id string, uri string, page_id string, refers_to string, stated string, stated_bytes bigint"
_NAMES = {
    b"warc-type": "type",
    b"warc-record-id": "record_id",
    b"warc-target-uri": "uri",
    b"x-page-id": "page_id",
    b"x-refers-to-page": "refers_to",
    b"warc-payload-digest": "stated",
    b"x-payload-length": "stated_bytes",
    b"content-length": "length",
}


def parse_header(chunk: bytes) -> tuple[int, dict[str, str]] | None:
    """Size of a record's header after the magic, and its fields; None if the chunk does not begin with a header."""
    if chunk[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    size = chunk.find(b"\r\n\r\n")
    fields = {}
    for line in chunk[3 : max(size, 0)].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if key := _NAMES.get(name.strip().lower()):
            fields[key] = value.strip().decode("utf-8", "replace")
    if size < 0 or "type" not in fields or not fields.get("length", "").isdecimal():
        return None
    return size + 4, fields


def _payload(block: bytes) -> bytes:
    """What follows the HTTP header, or all of a block without one."""
    head, gap, body = block.partition(b"\r\n\r\n")
    return body if gap and head.startswith(b"HTTP/") else block


def _chunks(with_payload: bool):
    names = ["file", "block", "rel", "size", "head", "length", *[f.split()[0] for f in _HEADER.split(", ")], "digest", "bytes", "whole", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != split:
                    split, at = (file, block), 0
                head, length, fields, digest, size, payload = None, None, {}, None, None, None
                if parsed := parse_header(value):
                    head, fields = parsed
                    length = int(fields["length"])
                whole = head is not None and head + length <= len(value)  # else its payload goes on, or it is a piece of one
                if whole and fields["type"] != "revisit":
                    payload = _payload(value[head : head + length])
                    digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                stated = fields.get("stated_bytes", "")
                out.append(
                    (file, block, at, len(value), head, length)
                    + tuple(fields.get(k) for k in ("type", "record_id", "uri", "page_id", "refers_to", "stated"))
                    + (int(stated) if stated.isdecimal() else None, digest, size, whole, payload if with_payload else None)
                )
                at += len(value) + STEP
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names)

    kinds = [pa.string(), *[pa.int64()] * 5, *[pa.string()] * 6, pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    schema = f"file string, block bigint, rel bigint, size bigint, head bigint, length bigint, {_HEADER}, digest string, bytes bigint, whole boolean, payload binary"
    return run, schema


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of every chunk, under the same numbers."""
    split, at = None, 0
    for batch in batches:
        rel = []
        for size, file, block in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (file, block) != split:
                split, at = (file, block), 0
            rel.append(at)
            at += size + STEP
        yield pa.RecordBatch.from_arrays([*batch.columns[1:3], pa.array(rel, pa.int64()), batch.column(0)], ["file", "block", "rel", "raw"])


def _exits(frame: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a split leaves the split (only chains that do)."""
    known = frame[frame["succ"].notna()].sort_values("start")
    starts, succ, last = known["start"].tolist(), known["succ"].astype("int64").tolist(), int(frame["start"].max())
    leave: dict[int, int | None] = {}
    for start, to in zip(reversed(starts), reversed(succ)):
        leave[start] = to if to > last else leave.get(to)
    rows = [(s, e) for s, e in leave.items() if e is not None]
    return pd.DataFrame(rows, columns=["node", "next"]).assign(file=frame["file"].iloc[0])[["file", "node", "next"]]


def _marks(frame: pd.DataFrame) -> pd.DataFrame:
    """The record that each chunk of a split belongs to: known from the split's entry on, null before."""
    frame = frame.sort_values("start")
    entries = frame.loc[frame["entry"], "start"]
    succ = dict(zip(frame["start"], frame["succ"]))
    record, at, owners = None, int(entries.iloc[0]) if len(entries) else None, []
    for start in frame["start"]:
        if start == at:
            record, to = start, succ[start]
            at = int(to) if pd.notna(to) else None
        owners.append(record)
    return frame[["file", "block", "rel", "start"]].assign(owner=pd.array(owners, "Int64"))


def _entries(exits: DataFrame) -> DataFrame:
    """``file, node``: the start of each file and every exit that is reached from it."""
    targets = exits.select("file", F.col("next").alias("node")).distinct()
    jump = written(exits.join(targets, ["file", "node"], "left_semi").unionByName(exits.where("node = 0")).distinct(), "warc-jump")
    reached, size = written(exits.where("node = 0").select("file", "node"), "warc-reached"), -1
    while (now := reached.count()) > size:
        size = now
        further = reached.join(jump, ["file", "node"]).select("file", F.col("next").alias("node"))
        reached = written(reached.unionByName(further).distinct(), "warc-reached")
        step = jump.select("file", F.col("node").alias("next"), F.col("next").alias("_after"))
        jump = written(jump.join(step, ["file", "next"]).select("file", "node", F.col("_after").alias("next")), "warc-jump")
    return reached


def _assembled(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, size, payload = [], [], []
            for whole, head, length, kind in zip(*(batch.column(n).to_pylist() for n in ("whole", "head", "length", "type"))):
                body = _payload(whole[head : head + length]) if kind != "revisit" and len(whole) >= head + length else None
                digest.append(None if body is None else hashlib.sha1(body).hexdigest())
                size.append(None if body is None else len(body))
                payload.append(body if with_payload else None)
            names = [n for n in batch.schema.names if n != "whole"]
            columns = [*(batch.column(n) for n in names), pa.array(digest, pa.string()), pa.array(size, pa.int64()), pa.array(payload, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "digest", "bytes", "payload"])

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record that is reached from the start of its file.

    ``file, offset, type, record_id, uri, page_id, refers_to, stated, stated_bytes`` (from the header; null if absent)
    and ``digest`` (hex SHA-1), ``bytes``, ``payload`` of what is stored: null for revisits and for a record that its
    file cuts off. ``payload`` is null unless asked for. A folder without records gives an empty result.
    """
    ship(spark)
    source = spark.read.option("lineSep", MAGIC).text(path)
    scan, schema = _chunks(with_payload)
    lines = source.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    chunks = written(lines.mapInArrow(scan, schema), "warc-chunks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split; a file of a petabyte has some millions.
    bases = chunks.groupBy("file", "block").agg(F.sum(F.col("size") + STEP).alias("_bytes")).select(
        "file", "block", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base")
    )
    start = F.col("_base") + F.col("rel") - STEP  # of the magic
    nodes = written(
        chunks.join(bases, ["file", "block"])
        .where(start >= 0)  # what precedes the first magic of a file is no candidate
        .select("file", "block", "rel", start.alias("start"), (start + STEP + F.col("head") + F.col("length") + len(GAP)).alias("succ")),
        "warc-nodes",
    )
    exits = written(nodes.groupBy("file", "block").applyInPandas(_exits, "file string, node bigint, next bigint"), "warc-exits")
    first = nodes.where("start = 0").select("file", F.col("start").alias("node"))
    entries = _entries(exits).unionByName(first).distinct().select("file", F.col("node").alias("start"), F.lit(True).alias("_entry"))
    flagged = nodes.join(entries, ["file", "start"], "left").withColumn("entry", F.coalesce("_entry", F.lit(False))).drop("_entry")
    marked = written(
        flagged.groupBy("file", "block").applyInPandas(_marks, "file string, block bigint, rel bigint, start bigint, owner bigint"), "warc-marks"
    )
    fields = [f.split()[0] for f in _HEADER.split(", ")]
    real = marked.where("owner = start").join(chunks, ["file", "block", "rel"])
    done = real.where("whole").select("file", F.col("start").alias("offset"), *fields, "digest", "bytes", "payload")
    broken = written(real.where("NOT whole").select("file", F.col("start").alias("owner"), "head", "length", *fields), "warc-broken")
    if not broken.take(1):
        return done

    # Records whose payload holds the magic: the chunks up to the next record, in order, with the magic between them.
    lasts = marked.groupBy("file", "block").agg(F.max("owner").alias("_last"))
    carry = lasts.select("file", "block", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    owned = marked.join(carry, ["file", "block"]).withColumn("owner", F.coalesce("owner", "_carry"))
    key = ["file", "block", "rel"]
    needed = written(owned.join(broken.select("file", "owner"), ["file", "owner"], "left_semi").select(*key, "start", "owner"), "warc-needed")
    # Their bytes come from a second pass; a bounded table of buckets lets few others through to the shuffle.
    again = lines.withColumn("_n", F.octet_length("value")).mapInArrow(_pieces, "file string, block bigint, rel bigint, raw binary")
    near = again.withColumn("_bucket", bucket_of(*key)).join(F.broadcast(bucket_table(needed, *key)), "_bucket", "left_semi")
    magic = F.encode(F.lit(MAGIC), "UTF-8")
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "raw"))),
        F.lit(None).cast("binary"),
        lambda s, x: F.when(s.isNull(), x["raw"]).otherwise(F.concat(s, magic, x["raw"])),
    )
    mended = near.join(needed, key).groupBy("file", "owner").agg(joined.alias("whole"))
    mended = broken.join(mended, ["file", "owner"]).withColumnRenamed("owner", "offset")
    ends = mended.mapInArrow(_assembled(with_payload), f"file string, offset bigint, head bigint, length bigint, {_HEADER}, digest string, bytes bigint, payload binary")
    return done.unionByName(ends.drop("head", "length"))
