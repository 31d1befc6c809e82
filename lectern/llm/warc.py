"""WARC archives: writing with revisits, reading with boundary-chain verification.

Writing goes through Spark's text writer with the record end (CR LF CR LF) as line separator, so a
part file is one plain WARC file. Reading splits large files at the magic ``WARC/1.``. Payloads may
hold that magic, even whole records, so every place where it stands is only a candidate:

1. each task reads the candidates of its byte range, their headers, and with the content length
   the offset of the successor; within the range it follows successors to the first one outside;
2. byte ranges get absolute offsets from sums of their lengths; pointer jumping from each file's
   start over the ranges' exits finds where the true chain enters each range;
3. each range is walked from its entry; only records on that walk are kept.

A record that spans several candidates is put together from its pieces in a second scan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.common import binary_column, materialise, small_enough

MAGIC = b"WARC/1."
END = "\r\n\r\n"
_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*$", re.M)


def write_archives(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """One record for each row of ``pages``: ``response``, or ``revisit`` without a payload of its own.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes those with the largest id
    are responses (a row repeated with that id is one each time), the others revisit it. A null
    html is an empty payload, a null url gives no target field, a null id the name ``null``; line
    breaks in a url are percent-encoded. Payloads are never shuffled unless the table of repeated
    digests is too large to broadcast.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("body")
    ).withColumns({"digest": F.sha1("body"), "size": F.octet_length("body")})
    repeated = (
        rows.filter(F.col("size") >= min_revisit_bytes)
        .groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null").select("digest", "first")
    )
    rows = rows.join(small_enough(materialise(repeated, "warc-digests")), "digest", "left")
    rows.select(_record(date).alias("value")).write.option("lineSep", END).text(path)


def _record(date: str) -> Column:
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"{MAGIC.decode()}1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("id")),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", name("first")),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("body")),
    )


_LINE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("rel", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("succ", T.LongType()), T.StructField("exit", T.LongType()),
    T.StructField("head", T.LongType()), T.StructField("length", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("stated", T.StringType()),
    T.StructField("refers", T.StringType()), T.StructField("sha1", T.StringType()),
])


def parse_candidate(segment: bytes) -> dict | None:
    """Header fields of what follows a magic; None if it has no whole header with a content length."""
    end = segment.find(b"\r\n\r\n")
    if end < 0 or not re.match(rb"\d\r\n", segment):
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(segment[3:end].replace(b"\r\n", b"\n"))}
    length = fields.get(b"content-length", b"")
    if not re.fullmatch(rb"\d{1,18}", length) or b"warc-type" not in fields:
        return None
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    head, n = end + 4, int(length)
    body = segment[head : head + n] if len(segment) >= head + n else None
    return {
        "head": head, "length": n, "kind": text(b"warc-type"), "name": text(b"warc-record-id"),
        "uri": text(b"warc-target-uri"), "stated": text(b"warc-payload-digest"), "refers": text(b"warc-refers-to"),
        "sha1": None if body is None else hashlib.sha1(body).hexdigest(),
    }


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, start of the byte range, offset from the range's first line, line), in reading order."""
    at, rel = None, 0
    for batch in batches:
        lines = binary_column(batch, "value")
        places = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        for line, place in zip(lines, places, strict=True):
            if place != at:
                at, rel = place, 0
            yield *place, rel, line
            rel += len(line) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for file, block, rel, line in _ranges(batches):
        if held and (held[0]["file"], held[0]["block"]) != (file, block):
            yield from _exits(held)
            held = []
        row = {"file": file, "block": block, "rel": rel, "size": len(line)}
        found = None if block == 0 and rel == 0 else parse_candidate(line)
        held.append(row | (found | {"succ": rel + found["head"] + found["length"] + len(END) + len(MAGIC)} if found else {}))
    yield from _exits(held)


def _exits(lines: list[dict]) -> Iterator[pa.RecordBatch]:
    """Follows successors to the first offset past the range's last line."""
    if not lines:
        return
    last, to = lines[-1]["rel"], {}
    for row in reversed(lines):
        if "succ" in row:
            # A successor inside the range that is no candidate ends the chain there.
            to[row["rel"]] = row["exit"] = to.get(row["succ"]) if row["succ"] <= last else row["succ"]
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(_LINE)
    for i in range(0, len(lines), 10_000):
        yield pa.RecordBatch.from_pylist(lines[i : i + 10_000], schema=kind)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for file, block, rel, line in _ranges(batches):
        rows.append({"file": file, "block": block, "rel": rel, "value": line})
        held += len(line)
        if held > 8 << 20:
            yield pa.RecordBatch.from_pylist(rows)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _reached(lines: DataFrame) -> DataFrame:
    """(file, at): offsets where the chain from the file's start enters a byte range.

    Pointer jumping: round k knows what lies within 2^k range exits of the start.
    """
    starts = lines.filter("at = 0").select("file", "at")
    exits = lines.filter("exit is not null").select("file", F.col("exit").alias("at")).distinct()
    # Range entries only: a handful for each byte range, however many records it has.
    jump = materialise(
        lines.filter("exit is not null").join(exits.unionByName(starts).distinct(), ["file", "at"], "left_semi")
        .select("file", "at", "exit"), "warc-jumps",
    )
    reached, n = materialise(starts, "warc-reached"), -1
    while (now := reached.count()) != n:
        n = now
        step = reached.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))
        reached = materialise(reached.unionByName(step).distinct(), "warc-reached")
        ahead = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("to"))
        jump = materialise(jump.join(ahead, ["file", "exit"]).select("file", "at", F.col("to").alias("exit")), "warc-jumps")
    return reached


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one byte range: each line's owner, the last record on the walk from ``entry`` (-1: an earlier range's)."""
    rows = rows.sort_values("at", ignore_index=True)
    succ = {a: s for a, s in zip(rows["at"], rows["next"], strict=True) if s == s}
    on, at = set(), rows["entry"].iloc[0]
    while at in succ:
        on.add(at)
        at = succ[at]
    owner = rows["at"].where(rows["at"].isin(on)).ffill().fillna(-1).astype("int64")
    return rows.assign(owner=owner)[["file", "block", "rel", "at", "owner"]]


def verified_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the archives with its absolute offset and the verified record that owns it."""
    scanned = materialise(_segments(spark, path).mapInArrow(_candidates, _LINE), "warc-lines")
    order = Window.partitionBy("file").orderBy("block")
    bases = scanned.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    bases = bases.select("file", "block", (F.sum("total").over(order) - F.col("total") - len(MAGIC)).alias("base"))
    lines = scanned.join(small_enough(materialise(bases, "warc-bases")), ["file", "block"]).withColumns({
        "at": F.col("rel") + F.col("base"), "next": F.col("succ") + F.col("base"), "exit": F.col("exit") + F.col("base"),
    })
    entries = _reached(lines)
    entry = (
        lines.join(small_enough(entries), ["file", "at"], "left_semi")
        .groupBy("file", "block").agg(F.min("at").alias("entry"))
    )
    walked = (
        lines.select("file", "block", "rel", "at", F.col("next").cast("double").alias("next"))
        .join(small_enough(materialise(entry, "warc-entries")), ["file", "block"], "left")
        .groupBy("file", "block")
        .applyInPandas(_walk, "file string, block bigint, rel bigint, at bigint, owner bigint")
    )
    walked = materialise(walked, "warc-walked")
    # Lines before a range's first record belong to the last record of the ranges before it.
    last = walked.groupBy("file", "block").agg(F.max("owner").alias("most"))
    last = last.select("file", "block", F.max("most").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    owned = walked.join(small_enough(materialise(last, "warc-last")), ["file", "block"])
    owned = owned.withColumn("owner", F.when(F.col("owner") < 0, F.col("before")).otherwise(F.col("owner")))
    return materialise(lines.join(owned.select("file", "block", "rel", "owner"), ["file", "block", "rel"]), "warc-owned")


def payloads(spark: SparkSession, path: str, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Payload bytes (file, owner, payload) of the records in ``wanted`` (file, owner), by a second scan."""
    need = lines.join(small_enough(wanted), ["file", "owner"], "left_semi")
    heads = need.filter("at = owner").select("file", "owner", "head", "length")
    need = materialise(need.select("file", "block", "rel", "at", "owner"), "warc-pieces")
    texts = _segments(spark, path).mapInArrow(_texts, "file string, block bigint, rel bigint, value binary")
    pieces = texts.join(small_enough(need), ["file", "block", "rel"]).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("at", F.hex("value").alias("value")))).alias("pieces")
    )
    whole = F.unhex(F.array_join(F.transform("pieces", lambda p: p["value"]), MAGIC.hex().upper()))
    return pieces.join(heads, ["file", "owner"]).select(
        "file", "owner", F.expr("length").alias("n"), whole.alias("whole"), "head"
    ).select("file", "owner", F.expr("substring(whole, int(head) + 1, int(n))").alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: file, offset, type, name, uri, refers_to, payload bytes and SHA-1 of the stored payload.

    Candidates inside payloads are rejected whatever they look like. A chain that breaks (a record
    cut short or a wrong content length) ends there: what follows in that file is not verified and
    not returned. Empty files and empty folders have no records.
    """
    lines = verified_lines(spark, path)
    records = lines.filter("at = owner")
    broken = materialise(records.filter("sha1 is null").select("file", "owner"), "warc-spanning")
    fields = ["file", F.col("at").alias("offset"), F.col("kind").alias("record_type"), "name", "uri", "stated", "refers",
              F.col("length").alias("payload_bytes")]
    if broken.isEmpty():
        return records.select(*fields, "sha1")
    joined = payloads(spark, path, lines, broken).select("file", F.col("owner").alias("offset"), F.sha1("payload").alias("joined"))
    return records.select(*fields, "sha1").join(joined, ["file", "offset"], "left").withColumn(
        "sha1", F.coalesce("sha1", "joined")).drop("joined")


def page_digests(records: DataFrame) -> DataFrame:
    """Per page: length and digest of the full payload; a revisit's come from the response it refers to.

    A record of an empty payload is a page of 0 bytes; repeated records are repeated rows; a record whose name is no
    page's has a null page_id. No records give an empty result.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("bigint")
    rows = records.select(
        page(F.col("name")).alias("page_id"), "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type",
        page(F.col("refers")).alias("refers_to"), F.regexp_extract("stated", "^sha1:(.*)$", 1).alias("stated"),
    )
    own = rows.filter("record_type <> 'revisit'").drop("stated")
    full = own.groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    full = full.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"), "payload_bytes", "payload_digest")
    revisits = rows.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "stated")
    revisits = revisits.join(full, ["refers_to", "stated"], "left").drop("stated")
    return own.unionByName(revisits)
