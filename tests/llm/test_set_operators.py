"""Search, host filters, mixing, fixity and near-duplicates: against brute force, and on odd rows."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.llm import mixing, neardup, topk, urls, warc

from .test_text_operators import split


def test_topk(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 0.3, (300, 8)).astype(np.float32)
    x[100:200] = x[0]
    rows = [(i, [float(v) for v in x[i]], "z") for i in range(300)]
    rows += [(300, None, "z"), (301, [1.0, None], "z"), (302, [float("nan")] * 8, "z"), (303, [float("inf")] * 8, "z"), (350, [0.5, 0.25], "z"), (351, [0.25, 0.5], "z"), (None, [1.0] * 8, "z"), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    v = topk.integer_vectors(df)
    got = collections.defaultdict(list)
    for q in topk.top_k(v, v.filter("vec_id % 50 = 0"), k=5, block=64, query_block=3).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.score, q.vec_id))
    ints = [(i, [math.floor(256 * float(np.float32(a))) for a in e]) for i, e, _ in rows if i is not None and i not in (300, 301, 302, 303)]
    for i, e in ints:
        if i % 50 == 0:
            want = sorted(((sum(a * b for a, b in zip(e, f, strict=True)), j) for j, f in ints if j != i and len(f) == len(e)), key=lambda p: (-p[0], p[1]))[:5]
            assert got[i] == want
    assert set(got) == {0, 50, 100, 150, 200, 250, 350}
    none = topk.integer_vectors(df.limit(0))
    assert topk.top_k(none, none).count() == 0


def test_topk_repeated_query(spark):
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(0, [0.0, 1.0])] * 4 + [(50, [-1.0, 0.0]), (50, [-1.0, 0.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = collections.defaultdict(list)
    for q in topk.top_k(v, v.filter("vec_id % 50 = 0"), k=5, block=8, query_block=1).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.rank, q.vec_id))
    assert got == {0: [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)], 50: [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0)]}


def test_topk_scores_of_any_size(spark):
    """Sums beyond 53 bits are exact; beyond a long they count as the largest or least long, and ties go by vec_id."""
    big = 4.0e7
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 0.0]), (3, [-big, 0.0]), (4, [1.0, 0.0])] + [(50, [300_000.0, 3.0]), (60, [300_000.0, 2.0]), (61, [300_000.0, 1.0]), (62, [299_999.0, 9.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert dict(v.collect())[0] == [256 * 40_000_000, 256]
    got = topk.top_k(v, v.filter("vec_id % 50 = 0"), k=8).orderBy("query_id", "rank").collect()
    ints = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q in (0, 50):
        want = sorted(((clip(sum(a * b for a, b in zip(ints[q], e, strict=True))), j) for j, e in ints.items() if j != q), key=lambda p: (-p[0], p[1]))
        assert [(r.score, r.vec_id) for r in got if r.query_id == q] == want
    assert [r.score for r in got if r.query_id == 0][:2] == [(1 << 63) - 1] * 2 and [r.vec_id for r in got if r.query_id == 0][:2] == [1, 2]


def test_topk_prunes(spark):
    """On vectors without any structure the bounds still leave out most of the candidates."""
    v = topk.integer_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    seen = topk.evaluations(v, v.filter("vec_id % 50 = 0")).agg(F.sum("evaluated"), F.sum("candidates"), F.count(F.lit(1))).first()
    assert seen[2] == 40 and seen[1] == 40 * 2000 and seen[0] < 0.35 * seen[1]


def test_pivots_stop_early():
    r = np.random.default_rng(1)
    centers = r.normal(0, 200, (20, 16))
    x = np.floor(np.repeat(centers, 200, 0) + r.normal(0, 3, (4000, 16))).astype(np.int64)
    table_ = topk.PivotTable(np.arange(4000), x, np.floor(centers[:10]))
    for i, ids, scores, seen in table_.search(np.arange(0, 4000, 400), x[::400], 5):
        q = i * 400
        true = sorted(((int(x[j] @ x[q]), j) for j in range(4000) if j != q), key=lambda t: (-t[0], t[1]))[:5]
        assert list(zip(scores.tolist(), ids.tolist(), strict=True)) == true and seen < 1500


def test_urls(spark):
    rows = [
        (1, "http://A.Example.NET/en/1"), (2, "https://example.net/de/2"), (3, "x://m.example.com/de/3?x#y"), (4, "http://example.org/fr/4"), (5, "http://net"), (6, "http://net/"), (7, None),
        (8, "no url"), (9, "http://badexample.net?/en/"), (10, "http://bad.io/en/10"), (11, "a://b://c/d"), (12, "http://bad.io/en/11"), (12, "http://bad.io/en/11"), (None, "http://good.io"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    outcomes = spark.createDataFrame([(k, 1) for k in (10, 11)] + [(2, 0), (3, None)], "page_no long, bad int")
    got = collections.defaultdict(set)
    for r in urls.judge(pages, outcomes).collect():
        got[r.page_id].add((r.host, r.path, r.rule, r.verdict))
    one = {k: next(iter(v)) for k, v in got.items()}
    assert one[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and one[2][2:] == ("net/", "block")
    assert one[3] == ("m.example.com", "/de/3", "example.com/de/", "block") and one[4][2:] == ("org/fr/", "allow")
    assert one[5][:3] == ("net", "", None) and one[6][2:] == ("net/", "block") and one[7][:3] == ("", "", None) == one[8][:3]
    assert one[9][:3] == ("badexample.net", "", None) and one[11][:2] == ("b:", "//c/d")
    assert urls.judge(pages, outcomes).count() == len(rows) and urls.judge(pages.limit(0), outcomes.limit(0)).count() == 0
    many = spark.createDataFrame([("bad.io", 1, 1)] * 40 + [("good.io", 1, 0)] * 400 + [("new.io", 0, 0)], "host string, n long, b long")
    rep, root = urls.reputation(many)
    rep = {r.host: r for r in rep.collect()}
    assert rep["bad.io"].lower > 0.5 > rep["good.io"].mean and rep["new.io"].n == 0 and 0 < rep["new.io"].mean < 1 and root == pytest.approx(41 / 442)


def test_registered_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.example.com", "example.com", "com", "", "localhost", "a.com.br", "m.org.example.de", "a..b"]
    reg, suffix = urls._levels(F.col("host"))
    got = {r.host: (r.reg, r.suffix) for r in spark.createDataFrame([(h,) for h in hosts], "host string").select("host", reg.alias("reg"), suffix.alias("suffix")).collect()}
    assert got["a.b.co.uk"] == got["b.co.uk"] == ("b.co.uk", "co.uk") and got["co.uk"] == ("co.uk", "co.uk") and got["a.com.br"] == ("a.com.br", "com.br")
    assert got["x.y.example.com"] == ("example.com", "com") and got["com"] == ("com", "com") and got[""] == ("", "") and got["m.org.example.de"] == ("example.de", "de")


def test_urls_method_decides(spark):
    """Some hosts of many have mostly bad pages: the method blocks these and no other, most pages having no known outcome."""
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), F.col("id") % 100, F.lit(".s"), F.col("id") % 10, F.lit(".io/x/"), F.col("id")).alias("url"))
    outcomes = spark.range(0, 20_000).filter("id % 3 = 0").select(F.col("id").alias("page_no"), F.when(F.col("id") % 100 < 7, F.floor(F.col("id") / 100) % 5 > 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(8)) == 0).cast("int").alias("bad"))
    said = urls.judge(pages, outcomes).groupBy("host").agg(F.collect_set("verdict").alias("v"), F.first("host_n").alias("n"), F.first("host_bad").alias("b"), F.first("host_mean").alias("mean"), F.first("host_lower").alias("lower")).collect()
    assert len(said) == 100 and {r.host for r in said if r.v == ["block"]} == {f"h{k}.s{k}.io" for k in range(7)} and all(len(r.v) == 1 and r.lower < r.mean < 1 and 0 < r.n < 200 for r in said)


def brute_targets(size):
    """Sources' targets by repeated resharing."""
    order = sorted(size, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, capped = 1.5 * sum(size.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 2 * size[s]
            left -= capped[s]


def test_mixing(spark, docs, nothing, texts):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    src = {(r.doc_id): r.source for r in docs.select("doc_id", "source").collect()}
    size = collections.Counter()
    for r in docs.select("text", "source").collect():
        size[r.source] += len(split(r.text))
    want = brute_targets(size)
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        s = src[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        assert r.size == 0 and r.taken == 0 or r.taken % r.size == 0
        if r.doc_id is not None and r.doc_id < len(texts):
            assert r.size == len(split(texts[r.doc_id]))
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] + 1
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    times = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    for r in rows:
        if r.size and r.doc_id != 9:
            assert times[r.doc_id] == r.taken // r.size
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    g = mixing.mix(big).join(big.select(F.col("doc_id"), "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 41 for r in g)


def test_mixing_of_repeated_rows(spark):
    """Many equal rows are not one large document: sources stay within one document of their targets."""
    rows = [(1, "w " * 30, "a")] * 301 + [(2, "w " * 30, "a")] * 7 + [(None, f"x{k} " * 20, "b") for k in range(40)] + [(3, "w", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken, target = collections.Counter(), {}
    for r in mixing.mix(df).collect():
        s = {30: "a", 20: "b", 1: "c"}[r.size]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= {"a": 30, "b": 20, "c": 1}[s] for s in target)
    words = collections.Counter()
    for r in mixing.mixed_documents(df).collect():
        words[r.source] += len(r.text.split())
    assert words == {s: n for s, n in taken.items() if n}


def test_mixing_is_fair(spark):
    one = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") == 0, "a").otherwise("b").alias("source"))
    assert {r.source: r.target for r in one.join(mixing.mix(one), "doc_id").collect()} == {"a": 6.0, "b": 3.0}
    odd = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit(10).cast("long").alias("size"))
    half = mixing.decide(odd, weights=(1.0,), total=0.5)[0].agg(F.sum("copies")).first()[0]  # sources of one document each, at even odds
    assert 150 < half < 250


def test_warc(spark):
    rows = [(i, f"http://h/{i}", "é" * (i % 50)) for i in range(0, 5000, 3)] + [(3, "http://h/3", "again"), (3, "http://h/3", "again"), (None, None, None), (99, None, ""), (-5, "u", "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("?"))
    recs = warc.records(pages)
    leaf = warc.leaves(recs)
    files = collections.defaultdict(list)
    text = {(r.page_id, r.record): r for r in recs.collect()}
    for r in leaf.collect():
        files[r.file].append(r)
    by_hash = collections.defaultdict(list)
    import hashlib

    for _, record in text:
        by_hash[hashlib.sha256(record.encode()).hexdigest()].append(record.encode())
    for own in files.values():
        own.sort(key=lambda r: r.idx)
        data = b"".join(by_hash[r.hash][0] for r in own)
        assert [r.idx for r in own] == list(range(len(own))) and own[-1].end == len(data) and all(hashlib.sha256(data[r.start : r.end]).hexdigest() == r.hash for r in own)
        assert len(warc.read_records(data)) == len(own)
    with pytest.raises(ValueError):
        warc.read_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nxx")
    twin = lambda a, b: a.withColumn("replica", F.lit(0)).unionByName(b.withColumn("replica", F.lit(1)))
    assert warc.audit(warc.merkle(twin(leaf, leaf))).count() == 0
    hurt = recs.withColumn("record", F.when(F.col("page_id").isin(300, 4500), F.concat("record", F.lit("!"))).otherwise(F.col("record")))
    places = {(r.file, r.idx) for r in warc.audit(warc.merkle(twin(leaf, warc.leaves(hurt)))).collect()}
    for page in (300, 4500):
        assert any((r.file, r.idx) in places for own in files.values() for r in own if r.page_id == page)
    assert not any(f == 1 for f, _ in places)  # a file without damage is not entered
    assert {r.file < 0 for r in leaf.filter("page_id is null").collect()} == {True}
    lost = {(r.file, r.idx) for r in warc.audit(warc.merkle(twin(leaf, leaf.filter("file <> 2")))).collect()}
    assert {f for f, _ in lost} == {2} and len(lost) == len(files[2])
    empty = warc.leaves(recs.limit(0))
    assert warc.audit(warc.merkle(twin(empty, empty))).count() == 0


def test_warc_large_file(spark, monkeypatch):
    """Places do not depend on how a file is put in order."""
    rows = [(7, "u", f"page {k % 40}") for k in range(900)] + [(None, "u", f"x{k}") for k in range(60)] + [(None, "u", "same")] * 300 + [(k, "u", "y") for k in range(3000)] + [(-9, None, None)] * 3
    recs = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    plain = collections.Counter(map(tuple, warc.leaves(recs).collect()))
    monkeypatch.setattr(warc, "LARGE_FILE", 50)
    monkeypatch.setattr(warc, "RUN", 7)
    apart = warc.leaves(recs)
    assert collections.Counter(map(tuple, apart.collect())) == plain and sum(plain.values()) == len(rows)
    monkeypatch.setattr(warc, "FEW_FILES", 1)
    hurt = warc.leaves(recs.withColumn("record", F.when(F.col("page_id").isin(7, 2900), F.concat("record", F.lit("!"))).otherwise(F.col("record"))))
    both = apart.withColumn("replica", F.lit(0)).unionByName(hurt.withColumn("replica", F.lit(1)))
    assert {r.file for r in warc.audit(warc.merkle(both)).collect()} == {0, 2}


def brute_groups(rows, n, percent):
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_neardup(docs, nothing, n, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = neardup.near_duplicates(docs, n, percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(brute_groups(rows, n, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.component_id is not None)
    assert neardup.near_duplicates(nothing, n, percent).count() == 0 and neardup.one_of_each(nothing).count() == 0
    kept = neardup.one_of_each(docs, n, percent)
    assert kept.columns == docs.columns
    groups = {c for d, _, c in brute_groups(rows, n, percent) if d is not None}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(groups)


def test_one_of_each_by_document(spark):
    """Null ids, and ids with several texts: one document of each group stays, whatever its id."""
    text = lambda c, more="": " ".join(f"{c}{k}" for k in range(80)) + more
    groups = {
        "a": [(0, text("a")), (None, text("a", " x")), (1, text("a", " y"))], "b": [(1, text("b"))], "c": [(None, text("c"))], "d": [(None, text("d")), (None, text("d", " x")), (None, text("d"))],
        "e": [(2, text("e")), (2, text("e", " x")), (2, text("e").upper())], "f": [(3, text("f")), (3, text("f"))], "g": [(None, text("g")), (4, text("g"))],
    }
    rows = [r for own in groups.values() for r in own] + [(5, None), (6, ""), (None, " ")]
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter(r.text[0].lower() for r in kept if (r.text or "").strip()) == dict.fromkeys(groups, 1)
    assert {r.text[0].lower(): r.doc_id for r in kept if (r.text or "").strip()} == {"a": 0, "b": 1, "c": None, "d": None, "e": 2, "f": 3, "g": 4}
    assert {(r.doc_id, r.text) for r in kept if not (r.text or "").strip()} == {(5, None), (6, ""), (None, " ")}


def test_neardup_of_one_doc_id(spark):
    """Many texts without an id, or of one id, are looked up by their texts and do not meet each other."""
    r = random.Random(6)
    base = [f"w{k}" for k in range(70)]
    rows = []
    for i in range(500):
        t = list(base)
        t[r.randrange(70)] = f"v{i}"
        rows.append((None if i % 2 else 4, " ".join(t)))
    docs = spark.createDataFrame(rows + [(9, "alone here it is"), (None, "and so is this one")], "doc_id long, text string")
    got = neardup.near_duplicates(docs, 3, 85)
    assert collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == collections.Counter(brute_groups([tuple(x) for x in docs.collect()], 3, 85))
    sketches, groups = neardup._groups(docs, 3, 85)
    families = groups.select("node", "root").filter("node <> root or doc_id = 4")
    assert neardup.family_sets(docs, groups.drop("root"), families, 3).count() == families.count()


@pytest.mark.parametrize(("name", "most"), [("FAMILY_BLOCK", 16), ("BLOCK_SHINGLES", 700)])
def test_neardup_large_family(spark, monkeypatch, name, most):
    """More members than a block holds, all near copies of one text or of each other."""
    monkeypatch.setattr(neardup, name, most)
    r = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(r.randint(0, 9)):
            t[r.randrange(60)] = f"v{r.randrange(40)}"
        rows.append((i, " ".join(t)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute_groups(rows, 3, 85))


def test_pigeonhole():
    for percent in (80, 85, 95):
        d = neardup.max_distance(percent)
        plan = neardup.chunk_plan(d)
        assert sum(map(len, plan)) == neardup.HASHES and d < 2 * len(plan)


def test_components(spark):
    r = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(7, 7)]
    got = {x.node: x.root for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: find(v) for v in linked}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
