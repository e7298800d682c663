"""WARC records of web pages, and a fixity audit of replicas by Merkle trees.

The leaves of a replica's tree are digests of its own records with their offset ranges, in the order of its files. A node
hashes the digests of up to `FANOUT` neighbours with the offset range that they cover, up to one root. Two replicas
with equal roots are equal; else only the children of nodes that differ are compared, level by level, down to the
records. All levels are DataFrames, so a tree of any size is built and compared without gathering it.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gramwise.llm.common import materialise
from gramwise.shared import checkpoint

#: Records in a file on average, and children of a node.
FILE_RECORDS, FANOUT = 1024, 16
DATE = "2024-01-01T00:00:00Z"
GAP = "\r\n\r\n"
HEAD = b"WARC/1.1\r\nWARC-Type: "
#: Added to the place of a record, it then stands after all others of its file.
AFTER = 10**15


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record, with its ending. Nulls count as empty."""
    body = F.coalesce(html, F.lit(""))
    number = F.md5(F.concat_ws("\x1f", page_id.cast("string"), url).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(number, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(GAP))
    return F.concat(head, body, F.lit(GAP))


def records(pages: DataFrame, files: int) -> DataFrame:
    """(page_id, url, file, place, warc): pages are dealt to files by page_id, null ids by a digest of what they hold.
    place gives the order within a file."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("\x1f", "url", "html").cast("binary")), 1, 8), 16, 10).cast("long")
    number = F.col("page_id").try_cast("long")  # ids that are no whole numbers are dealt as null ones
    file = F.pmod(F.coalesce(number, digest), F.lit(files)).cast("long")
    return pages.select("page_id", "url", file.alias("file"), number.alias("place"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("warc"))


def write_warc(rows: DataFrame, folder: str) -> None:
    """Write (page_id, file, place, warc) as WARC files, one or more in each folder file=N."""
    own = rows.select("file", "place", F.sha2(F.col("warc").cast("binary"), 256).alias("sha256"), F.expr(f"left(warc, length(warc) - {len(GAP)})").alias("value"))
    own.repartition("file").sortWithinPartitions("file", F.col("place").asc_nulls_first(), "sha256").select("file", "value").write.partitionBy("file").option("lineSep", GAP).text(folder)


def _split(content: bytes):
    """(begin, end, whole) of each record. One whose header is cut or names no length, and one whose length is wrong, ends
    where the next begins, or with the file; whole says that the header could be read."""
    gap, at = GAP.encode(), 0
    while at < len(content):
        after = content.find(HEAD, at + 1)
        after = len(content) if after < 0 else after
        body = content.find(gap, at, after)
        size = re.search(rb"\r\nContent-Length: (\d{1,18})(?=\r\n)", content[at : body + 2]) if body >= 0 and content.startswith(HEAD, at) else None
        if not size:
            yield at, after, False
            at = after
            continue
        body += len(gap)
        end = body + int(size[1]) + len(gap)
        whole = end <= len(content) and content[end - len(gap) : end] == gap
        if not whole or not (end == len(content) or content.startswith(HEAD, end) or after >= end):
            end = after
        yield at, end, True
        at = end


def read_warc(spark, folder: str) -> DataFrame:
    """(path, offset, length, record_id, url, html, sha256) of every record below a folder; a file at a time fits a task.
    Whatever the files hold is cut into records; the id of one whose header can't be read is null."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                out = []
                for at, end, whole in _split(content):
                    head, _, body = content[at:end].partition(GAP.encode())
                    fields = dict(line.split(": ", 1) for line in head.decode(errors="replace").split("\r\n") if ": " in line) if whole else {}
                    out.append((path, at, end - at, fields.get("WARC-Record-ID"), fields.get("WARC-Target-URI", ""), body.removesuffix(GAP.encode()).decode(errors="replace"), hashlib.sha256(content[at:end]).hexdigest()))
                if out:
                    yield pd.DataFrame(out, columns=["path", "offset", "length", "record_id", "url", "html", "sha256"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    return found.select("path", "content").mapInPandas(parse, "path string, offset long, length long, record_id string, url string, html string, sha256 string")


def catalogue(rows: DataFrame) -> DataFrame:
    """(page_id, file, record_no, offset, length, sha256): where each record stands. Texts are hashed before anything moves."""
    own = rows.select("page_id", "file", "place", F.sha2(F.col("warc").cast("binary"), 256).alias("sha256"), F.octet_length("warc").cast("long").alias("length"))
    order = W.partitionBy("file").orderBy(F.col("place").asc_nulls_first(), "sha256")
    return own.select("page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("record_no"), (F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "sha256")


def file_catalogue(spark, folder: str) -> DataFrame:
    """The same from WARC files as write_warc leaves them, page_id being the record id, null where it can't be read."""
    rows = read_warc(spark, folder).select(F.col("record_id").alias("page_id"), F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long").alias("file"), "path", "offset", "length", "sha256")
    order = W.partitionBy("file").orderBy("path", "offset")
    return rows.select("page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("record_no"), "offset", "length", "sha256")


def _parents(level: DataFrame, name: str) -> DataFrame:
    """The level above (file, pos, hash, begin, end): a node for each FANOUT positions of a file."""
    own = level.withColumn("up", F.floor(F.col("pos") / FANOUT).cast("long")).groupBy("file", "up")
    parts = own.agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("parts"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    said = F.concat_ws("|", F.transform("parts", lambda x: F.concat_ws(":", x["pos"], x["hash"])), F.col("begin"), F.col("end"))
    return materialise(parts.select("file", F.col("up").alias("pos"), F.sha2(said.cast("binary"), 256).alias("hash"), "begin", "end"), name)


def tree(leaves: DataFrame, longest: int, name: str) -> list[DataFrame]:
    """The levels over leaves (file, pos, hash, begin, end), the leaves first; the last has one node for each file."""
    levels, span = [leaves], longest
    while span > 1:
        levels.append(_parents(levels[-1], name))
        span = -(-span // FANOUT)
    return levels


def over_files(roots: DataFrame) -> DataFrame:
    """The files' roots as leaves of one more tree: file -1, position file."""
    return roots.select(F.lit(-1).cast("long").alias("file"), F.col("file").alias("pos"), "hash", "begin", "end")


def _descend(one: list[DataFrame], other: list[DataFrame], bad: DataFrame | None) -> DataFrame:
    """(file, pos) of the leaves that differ below the nodes `bad`, or below all roots."""
    for a, b in zip(reversed(one), reversed(other), strict=True):
        a, b = a.select("file", "pos", "hash"), b.select("file", "pos", F.col("hash").alias("other"))
        if bad is not None:
            up = bad.select(F.col("file").alias("_file"), F.col("pos").alias("_up"))
            below = (F.col("file") == F.col("_file")) & (F.floor(F.col("pos") / FANOUT) == F.col("_up"))
            a, b = a.join(up, below, "left_semi"), b.join(up, below, "left_semi")
        bad = checkpoint(a.join(b, ["file", "pos"], "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "pos"))
    return bad


def compare_replicas(one: DataFrame, other: DataFrame, files: int, longest: int) -> DataFrame:
    """(file, pos) at which two replicas' leaves differ: from the common roots to the files, and on to the records."""
    a, b = tree(one, longest, "one"), tree(other, longest, "other")
    top_a, top_b = tree(over_files(a[-1]), files, "one-top"), tree(over_files(b[-1]), files, "other-top")
    bad_files = _descend(top_a, top_b, None)
    # A file's root is position 0 of its last level: the level above it would be position 0 too.
    return _descend(a, b, bad_files.select(F.col("pos").alias("file"), F.lit(0).cast("long").alias("pos")))


def damage(rows: DataFrame) -> DataFrame:
    """A replica with planted faults in every fourth file: of 1,000 records there about three are lost, ten have a byte
    changed, five lost their end, two were moved to the end of the file and two stand there again under another id.

    Which ones follows from a digest of the page id, so a test can tell them without the tree.
    """
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 6), 16, 10).cast("long") % 1000
    drawn = rows.withColumn("_draw", F.when(F.col("file") % 4 == 0, draw).otherwise(999))
    changed = F.expr(f"concat(left(warc, length(warc) - {len(GAP)} - 1), '#', '\r\n\r\n')")
    warc = F.when(F.col("_draw") < 13, changed).when(F.col("_draw") < 18, F.expr("left(warc, length(warc) - 7)")).otherwise(F.col("warc"))
    moved = F.when(F.col("_draw").between(18, 19), F.col("place") + AFTER).otherwise(F.col("place"))
    kept = drawn.where("_draw >= 3").withColumns({"warc": warc, "place": moved})
    extra = drawn.where("_draw between 20 and 21").withColumns({"page_id": F.col("page_id") + AFTER, "place": F.col("place") + AFTER})
    return kept.unionByName(extra).drop("_draw")


def compare(one: DataFrame, other: DataFrame) -> DataFrame:
    """(page_id, file, record_no, offset, length, sha256, status) of two replicas' catalogues.

    Each replica's tree is of its own records in its own order. Where roots differ, the children of nodes that differ are
    compared, down to records, and only there records are looked up in the other replica by page_id, the n-th of one with
    the n-th. status is ok, corrupt (other bytes of the same length), truncated (fewer), extended (more), displaced (the
    same bytes at another place), missing, or extra: then the other values are those of the second replica.
    """
    one, other = materialise(one, "one"), materialise(other, "other")
    ends = [x.agg(F.max("record_no").alias("n"), F.max("file").alias("f")).first() for x in (one, other)]
    longest, files = (max((r[c] + 1 for r in ends if r[c] is not None), default=0) for c in ("n", "f"))
    if not longest:
        return one.select("page_id", "file", "record_no", "offset", "length", "sha256", F.lit("ok").alias("status"))
    end = F.col("offset") + F.col("length")
    leaf = F.sha2(F.concat_ws("|", "sha256", "offset", end).cast("binary"), 256)
    trees = [x.select("file", F.col("record_no").alias("pos"), leaf.alias("hash"), F.col("offset").alias("begin"), end.alias("end")) for x in (one, other)]
    bad = compare_replicas(*trees, files, longest).select(F.col("file").alias("_file"), F.col("pos").alias("_pos"), F.lit(True).alias("bad"))
    here = (F.col("file") == F.col("_file")) & (F.col("record_no") == F.col("_pos"))
    marked = one.join(bad, here, "left").drop("_file", "_pos")
    nth = F.row_number().over(W.partitionBy("page_id").orderBy("file", "record_no"))
    ours = marked.where("bad").drop("bad").withColumn("nth", nth)
    theirs = other.join(bad, here, "left_semi").withColumn("nth", nth)
    theirs = theirs.select(*[F.col(c).alias(f"_{c}") for c in theirs.columns])
    both = ours.join(theirs, F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("nth") == F.col("_nth")), "full")
    size, was = F.col("_length"), F.col("length")
    status = F.when(F.col("nth").isNull(), "extra").when(F.col("_nth").isNull(), "missing").when(F.col("sha256") == F.col("_sha256"), "displaced").when(size < was, "truncated").when(size > was, "extended").otherwise("corrupt")
    names = ["page_id", "file", "record_no", "offset", "length", "sha256"]
    found = both.select(*[F.when(F.col("nth").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names], status.alias("status"))
    return marked.where("bad is null").select(*names, F.lit("ok").alias("status")).unionByName(found)


def compare_files(spark, one: str, other: str) -> DataFrame:
    """`compare` of the WARC files of two folders. A record of the second that can't be read counts as the one that stands at its
    place in the first, if the second hasn't that elsewhere: it is corrupt, truncated or extended, and else extra."""
    first, second = materialise(file_catalogue(spark, one), "first"), materialise(file_catalogue(spark, other), "second")
    here = first.join(second.where("page_id is not null").select("page_id"), "page_id", "left_anti").select("file", "record_no", F.col("page_id").alias("_id"))
    named = second.join(here, ["file", "record_no"], "left").withColumn("page_id", F.coalesce("page_id", "_id")).select(*second.columns)
    return compare(first, named)


def audit(pages: DataFrame, replica=damage) -> DataFrame:
    """(page_id, file, record_no, offset, length, sha256, status) for every record of pages, and for those that the second
    copy alone has.

    pages (page_id, url, html) become WARC records in files; replica makes the second copy from (page_id, url, file,
    place, warc). The copies are compared as `compare` says. Nulls count as empty; rows that repeat a page_id are records
    of their own; other columns are not read. An empty table gives no rows.
    """
    files = max(1, -(-pages.count() // FILE_RECORDS))
    own = records(pages, files)
    return compare(catalogue(own), catalogue(replica(own)))
