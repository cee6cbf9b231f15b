"""WARC archives: written and read with Spark's text source and sink, verified by their chain of boundaries.

Writing: a record is one string, the sink's line end is the record's closing CRLF CRLF. Of pages with equal payloads of
at least MIN_PAYLOAD bytes those with the smallest page_id are `response`, the others `revisit` it.

Reading: the source splits files at every version line, also at those inside payloads. Each chunk is a candidate
record; its header gives the offset at which its successor must start. Within a split the candidates' pointers are
jumped (doubled) until they leave it; between splits, over the few targets of such exits, by joins, again doubling;
only what is reached from a file's start is a record. Reached records that lie in one chunk are digested where they are
read; those whose payload holds version lines are put together from their chunks. What a scan says of its splits is stored
once, and a second scan finds chunks again by two hashes of their text, so it may be split in any other way; a reached record
whose text is not found whole, or a chain that doesn't settle, stops the run with an error.

Null html: an empty payload. Null url: no target header. Null page_id: no id header, always a response, never referred
to. Repeated rows: a record each; ties: rows that share the smallest id are all responses. Line breaks in a url are escaped.
No pages: no records. Extra columns are ignored; payloads of any bytes that form UTF-8 text, of any length below 2 GB, are
kept whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import delete_later, discard, shared_path, small_batches, stored, table

VERSION = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
MIN_PAYLOAD = 100
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Revisits up to this number are broadcast (24 bytes each), more are joined by a shuffle.
BROADCAST_ROWS = 200_000
JUMPS = 64


def payload() -> F.Column:
    return F.coalesce(F.col("html"), F.lit(""))


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest, refers_to of the pages whose payload a smaller page_id has too."""
    digests = pages.where("page_id is not null").where(F.octet_length(payload()) >= MIN_PAYLOAD).select(
        "page_id", F.sha2(payload().cast("binary"), 256).alias("payload_digest"))
    digests = stored(digests, "digests")
    first = digests.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most"))
    shared = first.where("most > refers_to").select("payload_digest", "refers_to")
    return digests.join(shared, "payload_digest").where("page_id > refers_to").distinct()


def write(pages: DataFrame, path: str) -> None:
    """pages: page_id, url, html. One record for each row."""
    pages = pages.select("page_id", "url", "html")
    again = stored(revisits(pages), "revisits")
    few = again.count() <= BROADCAST_ROWS
    again = again.select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), "refers_to")
    rows = pages.withColumn("digest", F.sha2(payload().cast("binary"), 256))
    same = (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again_digest"))
    rows = rows.join(F.broadcast(again) if few else again, same, "left")
    old = F.col("refers_to").isNotNull()
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record_id = lambda c: F.concat(F.lit("<urn:x-page:"), F.col(c).cast("string"), F.lit(">"))
    block = F.concat(F.lit(HTTP), F.when(old, F.lit("")).otherwise(payload()))
    record = F.concat(
        F.lit(VERSION),
        F.lit("WARC-Type: "), F.when(old, "revisit").otherwise("response"), F.lit("\r\n"),
        header("WARC-Record-ID", record_id("page_id")),
        header("WARC-Target-URI", url),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        header("WARC-Refers-To", record_id("refers_to")),
        F.when(old, "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n").otherwise(""),
        F.lit("X-Payload-Bytes: "), F.octet_length(payload()).cast("string"), F.lit("\r\n"),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", BREAK).text(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the split), k (order within it), h1, h2 (of the text), value: what lies between version lines.
    block and k hold for one scan only."""
    text = spark.read.option("lineSep", VERSION).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("k"), F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2"), "value")


def fields(head: F.Column) -> dict[str, F.Column]:
    of = lambda name: F.nullif(F.regexp_extract(head, f"(?im)^{name}: *([^\r\n]*)", 1), F.lit(""))
    number = lambda name: F.regexp_extract(of(name), r"(\d{1,18})>?$", 1).try_cast("long")
    return {"record_type": of("WARC-Type"), "page_id": F.regexp_extract(of("WARC-Record-ID"), r"<urn:x-page:(-?\d{1,19})>", 1).try_cast("long"),
            "refers_to": F.regexp_extract(of("WARC-Refers-To"), r"<urn:x-page:(-?\d{1,19})>", 1).try_cast("long"), "url": of("WARC-Target-URI"),
            "told_digest": F.regexp_extract(of("WARC-Payload-Digest"), "sha256:([0-9a-f]{64})", 1), "told_bytes": number("X-Payload-Bytes"),
            "content": number("Content-Length")}


def http_bytes(body: str) -> F.Column:
    """Bytes of the HTTP header, with the empty line."""
    return F.octet_length(F.substring_index(F.col(body).cast("string"), BREAK, 1)) + len(BREAK)


def candidates(parts: DataFrame) -> DataFrame:
    """What each chunk says as a record: its header, the bytes until its successor, and its payload's digest, which
    counts only if the record ends with the chunk."""
    raw = F.col("value").cast("binary")
    head = F.substring_index("value", BREAK, 1)
    rows = parts.withColumn("head", F.when(F.instr("value", BREAK) > 0, head)).withColumn("size", F.octet_length("value"))
    rows = rows.select("file", "block", "k", "h1", "h2", "size", "value", F.octet_length("head").alias("head_bytes"), *[c.alias(n) for n, c in fields(F.col("head")).items()])
    start = F.col("head_bytes") + len(BREAK)
    whole = F.col("size") == start + F.col("content") + len(BREAK)
    body = F.when(whole, F.substring(raw, (start + 1).cast("int"), F.col("content").cast("int")))
    rows = rows.withColumn("body", body).withColumn("skip", http_bytes("body"))
    found = F.substring(F.col("body"), (F.col("skip") + 1).cast("int"), F.lit((1 << 31) - 1))
    return rows.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("found", found).select(
        "file", "block", "k", "h1", "h2", "size", "record_type", "page_id", "refers_to", "url", "told_digest", "told_bytes", "content", "head_bytes", "whole",
        F.sha2("found", 256).alias("payload_digest"), F.octet_length("found").cast("long").alias("payload_bytes"))


def offsets(rows: DataFrame) -> DataFrame:
    """start: where the chunk's version line is in the file; next: where its successor must start. Summed within
    splits, and over the splits of a file."""
    step = F.col("size") + len(VERSION)
    per = rows.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum(step).over(within), F.lit(0))).join(per, ["file", "block"])
    rows = rows.withColumn("start", F.col("base") + F.col("ahead") - len(VERSION))
    after = F.col("start") + len(VERSION) + F.col("head_bytes") + len(BREAK) + F.col("content") + len(BREAK)
    return rows.withColumn("next", F.when(F.col("record_type").isNotNull(), after)).drop("ahead", "base")


def leaps(start: np.ndarray, onward: np.ndarray) -> np.ndarray:
    """For each candidate, the first offset of its chain that is no candidate of these (-1: the chain breaks)."""
    order = np.searchsorted(start, onward)
    inside = (order < len(start)) & (start[np.minimum(order, len(start) - 1)] == onward)
    to = np.where(inside, order, np.arange(len(start)))
    while True:
        further = to[to]
        if (further == to).all():
            return onward[to]
        to = further


def reached(rows: DataFrame) -> DataFrame:
    """The candidates (file, block, k, start, next) that the chain from their file's start reaches."""
    rows = rows.where("start >= 0").select("file", "block", "k", "start", F.coalesce("next", F.lit(-1)).alias("next"))

    def exits(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start")
        return frame[["file", "block", "start"]].assign(exit=leaps(frame["start"].to_numpy(), frame["next"].to_numpy()))

    out = stored(rows.groupBy("file", "block").applyInPandas(exits, "file string, block long, start long, exit long"), "exits")
    targets = out.select("file", F.col("exit").alias("start")).union(out.select("file", F.lit(0).cast("long").alias("start"))).distinct()
    nodes = stored(out.join(targets, ["file", "start"], "left_semi").select("file", "block", "start", "exit"), "nodes")
    jump, seen = nodes.select("file", "start", "exit"), nodes.where("start = 0").select("file", "start")
    count = seen.count()
    for _ in range(JUMPS):
        there = seen.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start")).join(nodes, ["file", "start"], "left_semi")
        seen = stored(seen.union(there).distinct(), "seen")
        before, count = count, seen.count()
        if count == before:
            break
        far = jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("far"))
        jump = stored(jump.join(far, ["file", "exit"], "left").select("file", "start", F.coalesce("far", "exit").alias("exit")), "jump")
    else:
        raise RuntimeError("the chains of records did not settle")
    entered = seen.join(nodes.select("file", "start", "block"), ["file", "start"]).select("file", "block", F.col("start").alias("entry"))

    def follow(frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start")
        start, onward = frame["start"].to_numpy(), frame["next"].to_numpy()
        mark = np.isin(start, entry["entry"].to_numpy())
        at = np.minimum(np.searchsorted(start, onward), max(len(start) - 1, 0))
        to = np.where(start[at] == onward, at, np.arange(len(start))) if len(start) else at
        while len(start):
            more = mark.copy()
            more[to[mark]] = True
            to = to[to]
            if (more == mark).all() and (to[to] == to).all():
                break
            mark = more
        return frame[mark][["file", "block", "k", "start", "next"]]

    return rows.groupBy("file", "block").cogroup(entered.groupBy("file", "block")).applyInPandas(
        follow, "file string, block long, k long, start long, next long")


def owned(rows: DataFrame, real: DataFrame) -> DataFrame:
    """file, from, start, h1, h2: the chunks of each record that isn't whole in its own chunk. A chunk belongs to the last record
    that starts at or before it: in its split, else in the splits before; real: the reached records, with `whole`."""
    heads = real.select("file", "block", "k", F.struct(F.col("start").alias("from"), (~F.col("whole")).alias("torn")).alias("head"))
    marked = rows.select("file", "block", "k", "start", "h1", "h2").join(heads, ["file", "block", "k"], "left")
    carried = heads.groupBy("file", "block").agg(F.max("head").alias("last"))  # a row for each split
    splits = rows.select("file", "block").distinct().join(carried, ["file", "block"], "left")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    here = Window.partitionBy("file", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("own", F.last("head", ignorenulls=True).over(here)).join(splits, ["file", "block"])
    marked = marked.withColumn("own", F.coalesce("own", "carried"))
    return marked.where("own.torn").select("file", F.col("own.from").alias("from"), "start", "h1", "h2")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, told_digest of the records of all archives."""
    small_batches(spark)
    raw = stored(candidates(chunks(spark, path)), "chunks")
    rows = stored(offsets(raw), "candidates")
    discard(raw)
    real = stored(reached(rows), "reached")
    records = rows.join(real.select("file", "block", "k"), ["file", "block", "k"])
    answer = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "told_digest", "told_bytes"]
    plain = records.where("whole").select(*answer)
    torn = stored(records.where("not whole").select("file", "start", "head_bytes", "content", *[c for c in answer if c not in ("payload_bytes", "payload_digest")]), "torn")
    if torn.isEmpty():
        return plain
    parts = stored(owned(rows, records.select("file", "block", "k", "start", "whole")), "owned")
    wanted = parts.select("h1", "h2").distinct()
    text = chunks(spark, path).select("h1", "h2", "value").join(wanted, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    found = parts.join(text, ["h1", "h2"], "left")  # the chunks of one record become one row
    whole = found.groupBy("file", F.col("from").alias("head")).agg(F.max(F.col("value").isNull()).alias("missing"), F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
    whole = whole.select("file", F.col("head").alias("start"), "missing", F.array_join(F.transform("parts", lambda p: p["value"]), VERSION).alias("value"))
    bytes_of = F.substring(F.col("value").cast("binary"), (F.col("head_bytes") + len(BREAK) + 1).cast("int"), F.col("content").cast("int"))
    both = torn.join(whole, ["file", "start"], "left").withColumn("body", bytes_of)
    lost = F.coalesce(F.col("missing") | (F.octet_length("body") != F.col("content")), F.lit(True))
    both = both.withColumn("body", F.when(lost, F.raise_error(F.lit("a record of the archive was not read whole")).cast("binary")).otherwise(F.col("body")))
    both = both.withColumn("found", F.substring(F.col("body"), (http_bytes("body") + 1).cast("int"), F.lit((1 << 31) - 1)))
    both = both.withColumn("payload_digest", F.sha2("found", 256)).withColumn("payload_bytes", F.octet_length("found").cast("long"))
    return plain.unionByName(both.select(*answer))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives of the pages."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    delete_later(spark, path)
    write(pages, path)
    old = F.col("record_type") == "revisit"
    return read(spark, path).select(
        "page_id", F.when(old, F.col("told_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(old, F.col("told_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
  min(page_id) OVER (PARTITION BY sha256(h)) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_PAYLOAD} AND least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_PAYLOAD} AND least < page_id THEN least END AS refers_to
FROM d
"""
