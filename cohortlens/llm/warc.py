"""WARC records and a Merkle fixity audit of archive replicas.

Every record is hashed; records lie in files at offsets. Hashes of the records
of an offset range are hashed in order into the range's node, ranges into wider
ranges, these into the file's node and files into wider groups up to one root.
Two replicas agree if their roots do. Where they do not, the audit compares the
children of mismatching nodes alone, level by level, down to the records that
were altered, lost or added.

A node has a bounded number of children, so no group grows with the archive.
"""
from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import Scratch

SPAN_BITS = 18        # bytes of the narrowest offset range
FAN_BITS = 4          # children of a node
FILE_BITS = 26        # bytes of a file, about


def record(url: Column, payload: Column) -> Column:
    """The bytes of a WARC response record (NULL parts are empty)."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def parse(raw: bytes):
    """(offset, length, headers, payload) of every record of a WARC file's bytes; gzip members are unpacked first."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while (start := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", start)
        if end < 0:
            return
        lines = raw[start:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else 0
        stop = min(end + 4 + size, len(raw))
        yield start, min(stop + 4, len(raw)) - start, headers, raw[end + 4:stop]
        at = stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, url, record, payload) of the WARC files under ``path``, plain or gzip."""
    def run(batches):
        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                whole = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                for offset, length, headers, payload in parse(whole):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([file]), pa.array([offset], pa.int64()), pa.array([length], pa.int64()),
                        pa.array([headers.get("warc-target-uri")], pa.string()),
                        pa.array([whole[offset:offset + length]], pa.binary()), pa.array([payload], pa.binary())],
                        ["file", "offset", "length", "url", "record", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(
        run, "file string, offset long, length long, url string, record binary, payload binary")


def lay_out(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Add file and offset to ``rows(length, ...)``: files by hash of ``key``, records in order within a file.

    Files hold about 2^FILE_BITS bytes, so a file's running sum stays bounded.
    """
    total = rows.agg(F.sum("length")).first()[0] or 0
    files = max(1, -(-total // (1 << FILE_BITS)))
    number = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % files
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("file", number)
            .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")))


def _levels(leaves: DataFrame) -> list[tuple[str, str]]:
    """(file expression, range expression) of every level, narrowest first, up to one root."""
    wide = leaves.agg(F.max("offset"), F.max("file")).first()
    top_offset, top_file = wide[0] or 0, wide[1] or 0
    out, shift = [], SPAN_BITS
    while top_offset >> shift:
        out.append(("file", f"shiftright(offset, {shift})"))
        shift += FAN_BITS
    out.append(("file", "0L"))
    shift = FAN_BITS
    while top_file >> (shift - FAN_BITS):
        out.append((f"shiftright(file, {shift})", "0L"))
        shift += FAN_BITS
    return out


def merkle_tree(leaves: DataFrame, levels: list[tuple[str, str]]) -> DataFrame:
    """Nodes of the tree over ``leaves(file, offset, leaf)``: (level, f, r, node, file, offset) with a first leaf's place."""
    below = leaves.select("file", "offset", F.col("leaf").alias("node"))
    tree = None
    for level, (f, r) in enumerate(levels):
        below = (below.groupBy(F.expr(f).alias("f"), F.expr(r).alias("r"))
                 .agg(F.sort_array(F.collect_list(F.struct("file", "offset", "node"))).alias("children"))
                 .select("f", "r", F.col("children")[0]["file"].alias("file"), F.col("children")[0]["offset"].alias("offset"),
                         F.sha2(F.concat_ws(",", F.transform("children", lambda c: F.concat_ws(
                             ":", c["file"].cast("string"), F.expr("cast(0 as string)") if level else c["offset"].cast("string"),
                             c["node"]))), 256).alias("node")))
        rows = below.select(F.lit(level).alias("level"), "f", "r", "node")
        tree = rows if tree is None else tree.unionByName(rows)
        below = below.select("file", "offset", "node")
    return tree


def audit(a: DataFrame, b: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, offset, kind, in_a, in_b) of every record in which two replicas differ.

    ``a`` and ``b`` have (file long, offset long, leaf string): a record's place
    and hash. ``kind`` is altered, missing (only in ``a``) or extra (only in
    ``b``). Several records at one place are one leaf of all their hashes. Empty
    replicas are compared like any other.
    """
    one = lambda x: x.groupBy("file", "offset").agg(F.array_join(F.sort_array(F.collect_set("leaf")), "+").alias("leaf"))
    a, b = scratch.save(one(a), "leaves_a"), scratch.save(one(b), "leaves_b")
    levels = _levels(a.unionByName(b))
    ta, tb = scratch.save(merkle_tree(a, levels), "tree_a"), scratch.save(merkle_tree(b, levels), "tree_b")
    bad = None
    for level in range(len(levels) - 1, -1, -1):
        x, y = ta.where(F.col("level") == level), tb.where(F.col("level") == level)
        if bad is not None:  # children of mismatching nodes only
            f, r = levels[level + 1], levels[level]
            up = _parent(levels, level)
            x = x.selectExpr("f", "r", "node", f"{up[0]} as pf", f"{up[1]} as pr").join(bad, ["pf", "pr"], "left_semi")
            y = y.selectExpr("f", "r", "node", f"{up[0]} as pf", f"{up[1]} as pr").join(bad, ["pf", "pr"], "left_semi")
        differ = (x.select("f", "r", F.col("node").alias("na")).join(y.select("f", "r", F.col("node").alias("nb")), ["f", "r"], "full")
                  .where(~F.col("na").eqNullSafe(F.col("nb"))).select(F.col("f").alias("pf"), F.col("r").alias("pr")))
        bad = scratch.save(differ, f"differ_{level}")
        if not bad.take(1):
            break
    f, r = levels[0]
    pick = lambda t, name: (t.selectExpr("file", "offset", f"leaf as {name}", f"{f} as pf", f"{r} as pr")
                            .join(bad, ["pf", "pr"], "left_semi").select("file", "offset", name))
    found = pick(a, "in_a").join(pick(b, "in_b"), ["file", "offset"], "full").where(~F.col("in_a").eqNullSafe(F.col("in_b")))
    kind = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").otherwise("altered")
    out = scratch.save(found.select("file", "offset", kind.alias("kind"), "in_a", "in_b"), "audit")
    scratch.drop(*(scratch.live - {"audit"}))
    return out


def _parent(levels: list[tuple[str, str]], level: int) -> tuple[str, str]:
    """Expressions for a node's parent from its own f and r."""
    (f, r), (pf, pr) = levels[level], levels[level + 1]
    if f == "file" and pf == "file":
        return "f", ("0L" if pr == "0L" else f"shiftright(r, {FAN_BITS})")
    return f"shiftright(f, {FAN_BITS})", "0L"


DECAY = "cast(conv(substring(md5(concat('decay', coalesce(cast(page_id as string), 'null'))), 1, 4), 16, 10) as int)"


def audit_pages(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Audit of ``pages(page_id, url, html)`` stored as WARC records against a decayed copy.

    The copy is derived from the pages: by a hash of page_id, about 1 in 200
    records has lost its payload's first character, 1 in 400 is missing and 1 in
    400 has a torn second copy one byte further on. Rows: page_id, kind, file,
    offset, length, copies, sorted by nothing. Repeated pages are one record
    with a number of copies; NULL columns are empty parts of a record.
    """
    damaged = F.expr(f"case when {DECAY} < 328 then substring(html, 2) else html end")
    rows = pages.select(
        "page_id", F.octet_length(record(F.col("url"), F.col("html"))).cast("long").alias("length"),
        F.sha2(record(F.col("url"), F.col("html")), 256).alias("whole"),
        F.sha2(record(F.col("url"), damaged), 256).alias("decayed"))
    rows = rows.groupBy("page_id", "length", "whole", "decayed").agg(F.count("*").alias("copies"))
    rows = lay_out(rows, F.col("whole"), ["whole", F.col("page_id").asc_nulls_first()])
    rows = scratch.save(rows.withColumn("decay", F.expr(DECAY)), "records")
    a = rows.select("file", "offset", F.col("whole").alias("leaf"))
    b = (rows.where("decay < 328 or decay >= 492").select("file", "offset", F.col("decayed").alias("leaf"))
         .unionByName(rows.where("decay >= 492 and decay < 656").select("file", (F.col("offset") + 1).alias("offset"),
                                                                        F.col("whole").alias("leaf"))))
    found = audit(a, b, Scratch(scratch.spark, "audit"))
    place = F.when(F.col("kind") == "extra", F.col("offset") - 1).otherwise(F.col("offset"))
    return (found.select("file", "kind", F.col("offset").alias("at"), place.alias("offset")).join(rows, ["file", "offset"])
            .select("page_id", "kind", "file", F.col("at").alias("offset"), "length", "copies"))


AUDIT_SQL = f"""
WITH raw AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
recs AS (
  SELECT page_id, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM raw),
rows_ AS (
  SELECT page_id, html, strlen(rec)::BIGINT AS length, sha256(rec) AS whole, count(*) AS copies
  FROM recs GROUP BY ALL),
sized AS (SELECT greatest(1, ceil(sum(length) / {1 << FILE_BITS}))::BIGINT AS files FROM rows_),
placed AS (
  SELECT *, ('0x' || substr(md5(whole), 1, 8))::BIGINT % files AS file,
    ('0x' || substr(md5('decay' || coalesce(page_id::VARCHAR, 'null')), 1, 4))::INT AS decay
  FROM rows_, sized),
laid AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY whole, page_id NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM placed)
SELECT page_id, CASE WHEN decay < 328 THEN 'altered' WHEN decay < 492 THEN 'missing' ELSE 'extra' END AS kind,
  file, CASE WHEN decay >= 492 THEN off + 1 ELSE off END AS "offset", length, copies
FROM laid WHERE decay < 656 AND (decay >= 328 OR html <> '')
"""
