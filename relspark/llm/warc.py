r"""WARC records and a Merkle fixity audit of replicas.

``records`` turns pages into WARC/1.1 response records, laid out in files by ranges of page numbers with ordered
offsets; ``read_records`` parses such bytes.  ``merkle`` hashes records (leaves) and, level by level, the ordered runs
of up to 16 children of one file into nodes that know their offset range; file roots are hashed on in the same way up
to one root.  ``audit`` compares two replicas' trees from the root and descends only into nodes whose hashes differ.  DataFrame functions only, but for the parser.

A leaf's place is (file, number in the file), ordered by page_id, then by the record's hash, so repeated rows get places
of their own.  Records without a page_id go to files below 0, numbered by the start of their hash; a null url or html
counts as empty.  An empty table has no nodes, and two empty replicas agree.  Columns other than page_id, url and html are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import durable, small, table

FAN = 16
PER_FILE = 1024
LARGE_FILE, RUN = 1 << 18, 4096  # records of a file that one task puts in order; equal records that it writes in a row
FEW_FILES = 1000
DATE = "2024-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The record's text; its Content-Length counts UTF-8 bytes."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """(page_id, file, record text) of each page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.floor(F.coalesce(F.col("page_id").cast("long"), F.lit(0)) / PER_FILE).alias("file"), record(F.col("page_id"), F.col("url").cast("string"), F.col("html").cast("string")).alias("record"))


def read_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record; ValueError if the bytes break off or a record does not start as one."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        if len(body) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at {at} breaks off")
        out.append((head, body))
        at = end + 8 + size
    return out


def leaves(recs: DataFrame) -> DataFrame:
    """(page_id, file, idx, start, end, hash): each record's place, offsets and SHA-256.

    Contents are read once, into a written table of digests; places come from running sums over a file's digests.
    """
    digest = F.sha2("record", 256)
    own = F.when(F.col("page_id").isNull(), -1 - F.conv(F.substring("hash", 1, 5), 16, 10).cast("long")).otherwise(F.col("file"))
    r = recs.select("page_id", "file", F.octet_length("record").cast("long").alias("bytes"), digest.alias("hash")).withColumn("file", own)
    r = durable(r.repartitionByRange("file"))
    large = r.groupBy("file").count().filter(F.col("count") > LARGE_FILE).select(F.col("file").alias("__f"))
    same = F.col("file") == F.col("__f")
    if large.isEmpty():
        return _placed(r)
    large = small(durable(large))
    return _placed(r.join(large, same, "left_anti")).unionByName(_placed_apart(r.join(large, same, "left_semi")))


def _placed(r: DataFrame) -> DataFrame:
    """A file's records in one task."""
    by = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "hash")
    upto = F.sum("bytes").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return r.select("page_id", "file", (F.row_number().over(by) - 1).cast("long").alias("idx"), (upto - F.col("bytes")).alias("start"), upto.alias("end"), "hash")


def _placed_apart(r: DataFrame) -> DataFrame:
    """The same places where a file has very many records of one page_id: equal records count once, and running sums are
    taken over parts (a page_id and the start of the hash) and within each part."""
    part = ["file", "page_id", "part"]
    kinds = r.groupBy("file", "page_id", "hash", "bytes").agg(F.count(F.lit(1)).alias("m")).withColumn("part", F.substring("hash", 1, 3))
    size = F.sum(F.col("m") * F.col("bytes"))
    up = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(up(w)), F.lit(0).cast("long"))
    parts = kinds.groupBy(*part).agg(F.sum("m").alias("k"), size.alias("b"))
    by = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "part")
    parts = parts.select(*(F.col(c).alias(f"__{c}") for c in part), before("k", by).alias("k0"), before("b", by).alias("b0"))
    on = (F.col("file") == F.col("__file")) & F.col("page_id").eqNullSafe(F.col("__page_id")) & (F.col("part") == F.col("__part"))
    within = Window.partitionBy(*part).orderBy("hash")
    kinds = kinds.withColumns({"k1": before("m", within), "b1": before(F.col("m") * F.col("bytes"), within)}).join(parts, on)
    kinds = kinds.select("page_id", "file", "hash", "bytes", "m", (F.col("k0") + F.col("k1")).alias("k"), (F.col("b0") + F.col("b1")).alias("b"))
    # equal records come back in runs, which are dealt out
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(RUN).cast("long")))
    runs = kinds.withColumn("first", run).repartition("file", "hash", "first")
    each = runs.withColumn("i", F.explode(F.sequence(F.col("first"), F.least(F.col("m"), F.col("first") + RUN) - 1)))
    start = F.col("b") + F.col("i") * F.col("bytes")
    return each.select("page_id", "file", (F.col("k") + F.col("i")).alias("idx"), start.alias("start"), (start + F.col("bytes")).alias("end"), "hash")


def _parents(nodes: DataFrame) -> DataFrame:
    """Nodes one level up: the hash of the children's ordered ranges and hashes."""
    child = F.struct("idx", F.concat_ws(":", "start", "end", "hash").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x.t), "\n")
    up = nodes.groupBy("replica", "file", F.floor(F.col("idx") / FAN).alias("up")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(text, 256).alias("hash"))
    return up.withColumnRenamed("up", "idx")


@dataclass(frozen=True)
class Tree:
    """Levels from the leaves up to the root, each (replica, file, idx, start, end, hash): ``inside`` of them above the
    leaves are within files; above those, file is -1 and idx counts files, then runs of files."""

    levels: list[DataFrame]
    inside: int


def merkle(leaf: DataFrame) -> Tree:
    """The replicas' trees, which share the tables.  Each level is written once and is about a sixteenth of the one below."""
    out = [durable(leaf.select("replica", "file", "idx", "start", "end", "hash").repartitionByRange("file"))]
    most, inside = out[0].agg(F.max("idx")).first()[0] or 0, 0
    while most:
        out.append(durable(_parents(out[-1])))
        most, inside = most // FAN, inside + 1
    files = out[-1].select("replica", F.lit(-1).cast("long").alias("file"), F.col("file").alias("idx"), "start", "end", "hash")
    out.append(durable(files))
    low, high = out[-1].agg(F.min("idx"), F.max("idx")).first()
    while low is not None and low < high and (low, high) != (-1, 0):
        out.append(durable(_parents(out[-1])))
        low, high = low // FAN, high // FAN
    return Tree(out, inside)


def audit(tree: Tree) -> DataFrame:
    """(file, idx) of the leaves in which replicas 0 and 1 differ, or that one of them lacks.

    From the top, each level reads only children of the nodes that differ.  Within files the tables lie in the order of
    files: while few files differ, their numbers prune what is read.
    """
    differ = None
    for depth in range(len(tree.levels) - 1, -1, -1):
        nodes = tree.levels[depth]
        if differ is not None:
            if depth == tree.inside:  # from a file's node down to what that file has
                up = differ.select(F.col("idx").alias("__f"))
                nodes = nodes.join(up, F.col("file") == F.col("__f"), "left_semi")
            else:
                up = differ.select(F.col("file").alias("__f"), F.col("idx").alias("__i"))
                nodes = nodes.join(up, (F.col("file") == F.col("__f")) & (F.floor(F.col("idx") / FAN) == F.col("__i")), "left_semi")
            if depth <= tree.inside:
                few = [r[0] for r in up.select("__f").distinct().limit(FEW_FILES + 1).collect()]
                if len(few) <= FEW_FILES:
                    nodes = nodes.filter(F.col("file").isin(few))
        place = F.struct("start", "end", "hash")
        both = nodes.groupBy("file", "idx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
        differ = durable(both.filter((F.col("n") != 2) | (F.col("a") != F.col("b"))).select("file", "idx"), drop=differ)
    return differ


def damaged(recs: DataFrame, every: int = 97) -> DataFrame:
    """A replica with one byte changed in the records whose page_id is a multiple of ``every``."""
    at = F.octet_length("record") - 4  # the last but the closing line ends
    hit = F.concat(F.substring("record", 1, 5), F.lit("0"), F.expr("substring(record, 7)"))
    return recs.withColumn("record", F.when((F.col("page_id") % every == 0) & (at > 0), hit).otherwise(F.col("record")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record: its file, offsets and hash, and whether the audit of a replica with planted damage finds it changed."""
    recs = records(table(spark, sf_dir, "pages"))
    both = leaves(recs).withColumn("replica", F.lit(0)).unionByName(leaves(damaged(recs)).withColumn("replica", F.lit(1)))
    both = durable(both)
    leaf = both.filter("replica = 0")
    found = audit(merkle(both)).select(F.col("file").alias("f"), F.col("idx").alias("i"), F.lit(True).alias("hit"))
    out = leaf.join(found, (F.col("file") == F.col("f")) & (F.col("idx") == F.col("i")), "left")
    return out.select("page_id", F.col("file").alias("warc_file"), F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), F.col("hash").alias("record_sha256"), F.coalesce("hit", F.lit(False)).alias("corrupt"))


QUERIES = {"op6_warc": op6_warc}
ORACLE = {
    "op6_warc": f"""
    WITH r AS (SELECT page_id,
      'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, 'none') || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages),
    h AS (SELECT page_id, strlen(rec)::bigint n, sha256(rec) record_sha256, coalesce(floor(page_id / {PER_FILE})::bigint, -1 - ('0x' || substr(sha256(rec), 1, 5))::bigint) warc_file FROM r)
    SELECT page_id, warc_file::bigint AS warc_file, (sum(n) OVER w - n)::bigint AS start_offset, (sum(n) OVER w)::bigint AS end_offset, record_sha256, coalesce(page_id % 97 = 0, false) AS corrupt
    FROM h WINDOW w AS (PARTITION BY warc_file ORDER BY page_id NULLS FIRST, record_sha256 ROWS UNBOUNDED PRECEDING)"""
}
