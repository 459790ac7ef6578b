r"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct n-word shingles (words ``[^\x20\x09-\x0D]+``, A-Z lower-cased; with fewer words
the whole sequence is one shingle; without words the set is empty and links with nothing).  Two documents link if
100 * |A & B| >= percent * |A | B|; groups are the connected components of links.

* Equal sets are one class, which takes part once.
* A class has a signature of ``HASHES`` min-hashes, b = 16 bits each.  The signature distance (positions that differ) of
  linked classes is at most ``max_distance``, but for a chance of about 1e-6 a pair.  The positions are split into
  chunks; by the pigeonhole principle some chunk of two such signatures has at most E errors.  For each chunk every
  choice of E positions is left out and the others are hashed: so all pairs within the distance share a key.
* Keys only join each class with one member of the key's bucket (drawn anew for each bucket), which connects the bucket:
  families of classes hold all pairs in question, without pairs within buckets.
* Families are cut into blocks of about ``FAMILY_BLOCK`` classes and ``BLOCK_SHINGLES`` shingles; a block is one task.  It
  visits classes in order of set size and counts exact intersections by an inverted index, but only where sizes and
  signatures allow a link and the classes are not connected yet, and returns the links that connect (fewer than its
  classes).  A family of several blocks is cut anew by another hash, which connects near copies across blocks; classes
  that its largest component still lacks then meet all others, each pair of blocks in one task.
* Connected components of these links, by alternating star contraction on shared tables.

Sets are compared as 64-bit fingerprints of their shingles.  Null texts count as empty.  Rows with equal doc_id and text
are equal results; rows with one doc_id and different texts are different documents.  A null doc_id takes part and gives
its group's smallest doc_id that is not null (null if there is none); ``kept`` says whether doc_id is that one.  So null
or repeated ids leave open which document of a group is meant; ``one_of_each`` therefore tells documents apart by doc_id
and text.  Columns other than doc_id and text are not read by ``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import U, durable, give_back, mix, small, table, word_batches

HASHES = 64
FAMILY_BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
MISS = 1e-6
_rng = np.random.default_rng(90210)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_WORD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def max_distance(percent: int, hashes: int = HASHES, miss: float = MISS) -> int:
    """The least distance that pairs at the threshold pass with a chance of at most ``miss``."""
    p, tail, d = 1 - percent / 100, 1.0, 0
    while d < hashes:
        tail -= math.comb(hashes, d) * p**d * (1 - p) ** (hashes - d)
        if tail <= miss:
            break
        d += 1
    return d


def chunk_plan(distance: int, hashes: int = HASHES, errors: int = 1) -> list[np.ndarray]:
    """As few chunks as leave at most ``errors`` errors in one of them."""
    return np.array_split(np.arange(hashes), min(hashes, distance // (errors + 1) + 1))


def shingle_sets(texts: list[bytes | None], n: int):
    """The sorted distinct shingle fingerprints of each whole text."""
    for _, rows, _, h, _, _, off in word_batches(texts):
        s = np.zeros(0, np.uint64)
        if len(h) >= n:
            s = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                s += mix(h[k : len(h) - n + 1 + k] + _WORD[k]) * _WORD[k + 32]
            s = mix(s)
        for i in range(rows):
            a, b = int(off[i]), int(off[i + 1])
            if b - a >= n:
                yield np.unique(s[a : b - n + 1])
            elif b > a:
                x = np.array([b - a], np.uint64)
                for k in range(a, b):
                    x = mix((x + h[k : k + 1]) * _WORD[0])
                yield x
            else:
                yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES min-hashes of a set that is not empty, 16 bits each."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 8192):
        part = s[i : i + 8192]
        np.minimum(best, (part[:, None] * _MUL + _ADD).min(0), out=best)
    return (mix(best) & U(0xFFFF)).astype(np.uint16)


def _set_id(s: np.ndarray) -> tuple[int, int]:
    a = mix(np.array([s.sum(dtype=np.uint64) + U(len(s))], np.uint64))
    b = mix(np.array([(s * s * _WORD[1] + (s >> U(7))).sum(dtype=np.uint64)], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *more)


def _digest() -> Column:
    """Of a row's text, which with doc_id tells documents apart."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def _mark() -> Column:
    """With doc_id it finds a class's text again: so that many texts of one doc_id, or of none, do not meet each other."""
    return F.xxhash64(F.col("text").cast("string")).alias("mark")


def sketch(docs: DataFrame, n: int, digests: bool = False) -> DataFrame:
    """(doc_id, n_shingles, node, check, sig, mark): two 64-bit fingerprints of the set, its signature, and a hash of the text; with the text's digest if asked."""

    def run(batches):
        for b in batches:
            rows = []
            for s in shingle_sets(b.column(1).to_pylist(), n):
                rows.append((len(s), *_set_id(s), signature(s).tobytes()) if len(s) else (0, None, None, None))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *b.columns[2:]], names=names)
            give_back()

    names = ["doc_id", "n_shingles", "node", "check", "sig", "mark"] + ["digest"] * digests
    texts = _texts(docs, _mark(), *[_digest().alias("digest")] * digests)
    return texts.mapInArrow(run, "doc_id long, n_shingles long, node long, check long, sig binary, mark long" + ", digest binary" * digests)


def probe_keys(classes: DataFrame, distance: int, errors: int = 1) -> DataFrame:
    """(node, key): a key for each chunk and each choice of ``errors`` of its positions to leave out."""
    plan = chunk_plan(distance, errors=errors)
    probes = [np.array(kept, int) for c in plan for kept in itertools.combinations(c.tolist(), max(1, len(c) - errors))]

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 2048):
                part = b.slice(i, 2048)
                if not len(part):
                    continue
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(len(part), HASHES).astype(np.uint64)
                keys = np.empty((len(part), len(probes)), np.uint64)
                for k, kept in enumerate(probes):
                    x = np.full(len(part), k + 1, np.uint64) * _WORD[2]
                    for p in kept:
                        x = mix(x + sig[:, p] * _WORD[3])
                    keys[:, k] = x
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), len(probes))), pa.array(keys.view(np.int64).ravel())], names=["node", "key"])

    return classes.select("node", "sig").mapInArrow(run, "node long, key long")


def _to_hub(rows: DataFrame, hubs: DataFrame, key: str) -> DataFrame:
    """``rows`` with their key's row of ``hubs``, which was grouped by ``key``.

    Joined by the key's complement, so that the grouping's own exchange is not used again: Spark splits a hot key only
    if both sides are dealt out for the join itself.
    """
    hubs = hubs.withColumn("__k", F.bitwise_not(key)).drop(key)
    return rows.join(hubs, F.bitwise_not(rows[key]) == F.col("__k")).drop("__k")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of (a, b) edges: root is the smallest node reachable.

    Alternating large-star and small-star steps until nothing changes; each step's table is written to the shared folder.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def state(e):
        return e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()

    def hubs(e):
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    last = None
    while (now := state(edges)) != last and now[0]:
        last = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_hub(both, hubs(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # large star: every larger neighbour of u links to the smallest of u's neighbourhood
        step = durable(large.filter("u <> v").distinct())
        own = step.groupBy("u").agg(F.min("v").alias("m"))
        few = _to_hub(step, own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v")))
        # small star: u and its smaller neighbours link to the smallest of them
        edges = durable(few.filter("u <> v").distinct(), drop=edges)
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def link_block(node: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, side: np.ndarray | None, percent: int, distance: int, label: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect what is linked, and each row's component: among all rows, or (with ``side``) between sides 0 and 1.

    Rows of equal ``label`` are connected already.
    """
    n = len(node)
    size = np.fromiter(map(len, sets), np.int64, n)
    order = np.lexsort((node, size))
    size, sigs = size[order], sigs[order]
    side = None if side is None else side[order]
    sets = [sets[i] for i in order.tolist()]
    owner = np.repeat(np.arange(n), size)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    by = np.argsort(flat, kind="stable")
    token, post = flat[by], owner[by]
    new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    number = np.empty(len(flat), np.int64)
    number[by] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(token))))
    ends = np.append(new, len(token))
    begin = np.concatenate([[0], np.cumsum(size)])
    label, out = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1][order], []
    for i in range(n):
        # |A & B| <= |A| and |A | B| >= |B|: only sizes up to 100/percent of this one's
        hi = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
        if hi <= i + 1:
            continue
        able = label[i + 1 : hi] != label[i]
        if side is not None:
            able &= side[i + 1 : hi] != side[i]
        cand = np.flatnonzero(able) + i + 1
        if not len(cand):
            continue
        cand = cand[(sigs[cand] != sigs[i]).sum(1) <= distance]
        if not len(cand):
            continue
        own = sets[i]
        if len(cand) <= 8:
            both = np.array([len(np.intersect1d(own, sets[j], assume_unique=True)) for j in cand.tolist()])
        else:
            t = number[begin[i] : begin[i + 1]]
            both = np.bincount(np.concatenate([post[ends[k] : ends[k + 1]] for k in t.tolist()]), minlength=n)[cand]
        for j in cand[100 * both >= percent * (size[i] + size[cand] - both)].tolist():
            if label[j] != label[i]:
                out.append((int(node[order[i]]), int(node[order[j]])))
                label[label == label[j]] = label[i]
    group = np.empty(n, np.int64)
    group[order] = label
    return out, group


def family_sets(docs: DataFrame, reps: DataFrame, families: DataFrame, n: int) -> DataFrame:
    """(root, blocks, node, data, sig) of each member of a family: into how many blocks that is cut, set and signature."""
    members = families.join(reps.select("node", "at", "n_shingles"), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / FAMILY_BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    count = members.groupBy("root").agg(blocks.alias("blocks"))
    members = _to_hub(members, count, "root").select(F.col("at.doc_id").alias("__id"), F.col("at.mark").alias("__mark"), F.col("node").alias("__node"), "root", "blocks")

    def run(batches):
        names = ["root", "blocks", "node", "data", "sig"]
        for b in batches:
            rows = []
            for (node, root, blocks), s in zip(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True), shingle_sets(b.column(0).to_pylist(), n), strict=True):
                if len(s) and _set_id(s)[0] == node:  # else another document with that doc_id
                    rows.append((root, blocks, node, s.tobytes(), signature(s).tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark"))
    texts = _texts(docs, _mark()).join(small(members), same).select("text", "__node", "root", "blocks")
    return texts.mapInArrow(run, "root long, blocks int, node long, data binary, sig binary").dropDuplicates(["node"])


def class_links(sets: DataFrame, percent: int, distance: int) -> DataFrame:
    """(a, b): confirmed links within families, enough of them to connect what is linked; ``sets`` is a durable ``family_sets``."""
    block = lambda seed, blocks: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(blocks)).cast("int")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        side = None if pdf.side.isna().any() else pdf.side.to_numpy().astype(np.int8)
        label = None if pdf.label.isna().any() else pdf.label.to_numpy()
        node = pdf.node.to_numpy()
        found, group = link_block(node, [np.frombuffer(d, np.uint64) for d in pdf.data], np.stack([np.frombuffer(d, np.uint16) for d in pdf.sig]), side, percent, distance, label)
        out = pd.DataFrame(found, columns=["a", "b"], dtype="int64").assign(link=True)
        if side is None and pdf.blocks.iloc[0] > 1:  # what has been one so far gets the least name of what it is one with
            was = node if label is None else label
            now = pd.Series(was).groupby(group).transform("min").to_numpy()
            out = pd.concat([out, pd.DataFrame({"a": was, "b": now, "link": False}).drop_duplicates()])
        give_back()
        return out

    def linked(rows: DataFrame, *by: str) -> DataFrame:
        return durable(rows.select("root", *by, "blocks", "node", "data", "sig", "side", "label").groupBy("root", *by).applyInPandas(link, "a long, b long, link boolean"))

    none = {"side": F.lit(None).cast("int"), "label": F.lit(None).cast("long")}
    first = linked(sets.withColumns(none | {"x": block(1, "blocks")}), "x")
    large = sets.filter("blocks > 1")
    if large.isEmpty():
        return first.filter("link").select("a", "b")
    name = lambda links, key: links.filter("not link").groupBy(F.col("a").alias(key)).agg(F.min("b").alias("name"))
    rows = large.join(name(first, "node"), "node").withColumnRenamed("name", "label")
    second = linked(rows.withColumns({"side": none["side"], "x": block(2, "blocks")}), "x")
    # equal names mean that classes are connected; different ones leave it open
    rows = durable(_to_hub(rows, name(second, "label"), "label").drop("label").withColumnRenamed("name", "label"))
    most = F.struct(F.col("count").alias("n"), "label")
    plan = rows.groupBy("root", "label").count().groupBy("root").agg(F.max(most).alias("top"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    # as many blocks as before, shared out between the largest component and the rest
    part = lambda k: F.greatest(F.lit(1), F.ceil(F.col("blocks") * k / F.col("n"))).cast("int")
    rows = _to_hub(rows, plan, "root").withColumns({"rest": F.col("label") != F.col("top.label"), "main_blocks": part(F.col("top.n")), "rest_blocks": part(F.col("n") - F.col("top.n"))})
    rows = rows.withColumn("own", F.when(F.col("rest"), block(3, "rest_blocks")).otherwise(block(3, "main_blocks")))
    every = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    place = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    own = F.col("own")
    to_main = F.transform(every("main_blocks"), lambda m: place(0, m, own))
    to_rest = F.transform(every("rest_blocks"), lambda r: place(1, F.least(r, own), F.greatest(r, own)))
    at = F.when(F.col("rest"), F.concat(to_main, to_rest)).otherwise(F.transform(every("rest_blocks"), lambda r: place(0, own, r)))
    rows = rows.withColumn("at", F.explode(at)).withColumns({"kind": F.col("at.kind"), "x": F.col("at.x"), "y": F.col("at.y")})
    side = F.when(F.col("kind") == 0, F.col("rest").cast("int")).when(F.col("x") != F.col("y"), (own == F.col("y")).cast("int"))
    third = linked(rows.withColumn("side", side), "kind", "x", "y")
    return first.unionByName(second).unionByName(third).filter("link").select("a", "b")


def _document() -> Column:
    """A document in order: by doc_id, null last, then by its text's digest."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")


def _groups(docs: DataFrame, n: int, percent: int, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sketches of all documents, and the classes with their group's root; with digests, also each class's first document."""
    distance = max_distance(percent)
    sketches = durable(sketch(docs, n, digests))
    firsts = [F.min(_document()).alias("document")] if digests else []
    reps = sketches.filter("node is not null").groupBy("node", "check", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first(F.struct("doc_id", "mark")).alias("at"), *firsts)
    reps = durable(reps)
    keys = probe_keys(reps, distance)
    # one member of each bucket, drawn by a hash of member and bucket
    draw = F.struct(F.xxhash64("node", "key").alias("h"), F.col("node").alias("hub"))
    hubs = keys.groupBy("key").agg(F.min(draw).alias("d"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", "d.hub")
    near = _to_hub(keys, hubs, "key").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    families = durable(components(near))
    roots = components(class_links(durable(family_sets(docs, reps, families, n)), percent, distance))
    return sketches, reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document: (doc_id, n_shingles, component_id, kept)."""
    sketches, groups = _groups(docs, n, percent)
    least = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = _to_hub(groups, least, "root").select(F.col("node").alias("__n"), F.col("check").alias("__k"), "component_id")
    out = sketches.join(named, (F.col("node") == F.col("__n")) & (F.col("check") == F.col("__k")), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group; rows that repeat a doc_id with an equal text are one document.

    A group's document is its first by doc_id (null last) and text digest.  Documents without words stay.
    """
    sketches, groups = _groups(docs, n, percent, digests=True)
    first = groups.groupBy("root").agg(F.min("document").alias("first"))
    named = _to_hub(groups, first, "root").select(F.col("node").alias("__n"), F.col("check").alias("__k"), "first")
    rows = sketches.join(named, (F.col("node") == F.col("__n")) & (F.col("check") == F.col("__k")), "left")
    stays = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest")))
    rows = durable(rows.groupBy("doc_id", "digest").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n")))
    gone = rows.filter("not stays").select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__digest"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")) & (F.col("__t") == F.col("__digest"))
    left = docs.withColumn("__t", _digest()).join(small(gone), same, "left_anti")
    if not rows.filter("stays and n > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "__t"])
    return left.drop("__t")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


QUERIES = {"op10_neardup": op10_neardup}
ORACLE: dict[str, str] = {}
