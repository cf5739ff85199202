"""Packing, neighbours, n-gram join, mixing, sharding, language model and pipeline against brute force and edge rows."""

import itertools
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventframe.llm import lm_scoring, mixing, nearest_neighbours, ngram_join, packing, queries, quality_rules, sharding, toxicity
from eventframe.llm.common import Memo, hash64, remainder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one two", "b"), (5, "one  TWO", "b"), (6, "a b c d e", None), (6, "a b c d e", None),
        (7, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "c"), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y Z z", "c"),
        (None, "a b c d e f g h i j k l m n o p q r s t u v w x y", "c"), (10, "w " * 30_000, "a"), (11, "b a c d e", "é"),
    ]
    return spark.createDataFrame([(*r, "en", 1, 2.0, 3) for r in rows], "doc_id long, text string, source string, lang string, size int, score double, node int")


def sets_of(text):
    words = WORD.findall(lower(text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(rows):
    """doc_id, set size and smallest reachable id of each (doc_id, text)."""
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    return Counter((d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows))


def test_ngram_join(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, edges):
        want = brute_classes([(r["doc_id"], r["text"]) for r in table.collect()])
        assert Counter(map(tuple, ngram_join.similarity_classes(table).collect())) == want
    assert ngram_join.similarity_classes(edges.where("false")).count() == 0


def test_ngram_join_of_large_groups(spark):
    """Near copies around the threshold, in chains, with a passage that all share."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    base, passage, rows = rng.choice(words, 60).tolist(), rng.choice(words, 12).tolist(), []
    for i in range(150):
        text = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            text[at] = str(rng.choice(words))
        rows.append((i, " ".join(text)))
    rows += [(200 + i, " ".join([*rng.choice(words, 30), *passage])) for i in range(100)]
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_classes(rows)


@pytest.mark.parametrize("limits", [{"HOT": 20}, {"TILE": 7}, {"TILE_BYTES": 4096}, {"LEADERS": 0}, {"LEADERS": 0, "TILE": 11, "HOT": 30}])
def test_ngram_join_deals_large_groups_to_many_tasks(spark, monkeypatch, limits):
    """A shingle's nodes in several buckets, a block in several tiles, no leaders: the classes stay the same."""
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for group in range(3):
        base = rng.choice(words, 40).tolist()
        for i in range(50):
            text = list(base)
            for at in rng.choice(40, rng.integers(0, 3), replace=False):
                text[at] = str(rng.choice(words))
            rows.append((100 * group + i, " ".join(text[: 40 - int(rng.integers(0, 8))])))
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_classes(rows)


def test_one_of_each(spark, edges):
    for name in ("row", "_row", "node"):
        marked = edges.withColumn(name, F.lit("mine"))
        assert {r[name] for r in ngram_join.one_of_each(marked).collect()} == {"mine"}
    kept = ngram_join.one_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 10, 11]


def test_bounds_are_bounds():
    rng, memo = np.random.default_rng(2), Memo(hash64)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = [str(x) for x in rng.integers(0, 300, n)]
        b = [x if rng.random() > 0.1 else "y" for x in a]
        x, y = ngram_join.shingle_sets([" ".join(a).encode(), " ".join(b).encode()], memo)
        apart = len(np.setxor1d(x, y))
        for bits in (None, 512):
            s, t = ngram_join.signature(x, bits), ngram_join.signature(y, bits)
            size = min(len(s), len(t))
            seen = int(np.bitwise_count(ngram_join.folded(s, size) ^ ngram_join.folded(t, size)).sum())
            assert seen <= apart
            assert not ngram_join.links(x, y) or ngram_join.may_link(len(x) + len(y), seen)
        if ngram_join.links(x, y):
            assert abs(ngram_join.band_of(len(x)) - ngram_join.band_of(len(y))) <= 1
            assert set(x[: ngram_join.prefix_length(len(x))].tolist()) & set(y[: ngram_join.prefix_length(len(y))].tolist())


def test_mixing_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(mixing.ORACLE_SQL).fetchall()
    got = queries.op5_mixing(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_mixing_targets(spark, edges):
    rows = mixing.mix_report(edges).collect()
    assert len(rows) == 12 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sizes = Counter()
    for r in edges.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    targets = {(r["source_size"], r["target"]) for r in rows}
    assert all(t <= 2 * s for s, t in targets)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    report = mixing.mix_report(docs)
    per = report.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["largest"] for r in per)
    total = report.agg(F.sum("size")).first()[0]
    assert math.isclose(sum(r["target"] for r in per), 1.5 * total)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {r["doc_id"]: r["taken"] // r["size"] for r in report.collect() if r["taken"]}
    assert mixing.mix_report(edges.where("false")).count() == 0 and mixing.mixed_documents(edges.where("false")).count() == 0


def test_mixing_follows_its_inclusion_odds(spark):
    """Over many sources alike, each size is taken as often as its expected copies say, and long documents more often."""
    sizes = [3, 10, 30, 100, 200, 300, 500, 800, 1000, 1500]
    text = {n: " ".join(["w"] * n) for n in sizes}
    rows = [(1000 * s + 10 * i + k, text[n], f"s{s:03d}") for s in range(240) for i, n in enumerate(sizes) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).collect()
    for target in {r["target"] for r in got}:
        own = [r for r in got if r["target"] == target]
        total, rate = own[0]["source_size"], target / own[0]["source_size"]
        score = {n: 1000 * n // (n + mixing.HALF_SIZE) for n in sizes}
        mean = sum(3 * n * score[n] for n in sizes) / (1000 * total)
        tilt = min(mixing.TILT, (mixing.MOST_COPIES - rate) / rate)
        want = {n: rate * (1 + tilt * (score[n] / 1000 - mean)) for n in sizes}
        assert math.isclose(sum(3 * n * want[n] for n in sizes), target, rel_tol=1e-9)
        taken = {n: np.mean([r["taken"] / n for r in own if r["size"] == n]) for n in sizes}
        assert all(abs(taken[n] - want[n]) < 0.12 for n in sizes), (target, taken, want)
        if rate < 1.9:
            assert want[1500] - want[3] > 0.1 and taken[1500] > taken[3]


def test_mixing_of_rows_that_share_an_id(spark):
    """Null ids, with different texts and with the same: each source comes near its target, whatever the partitions."""
    rows = [(None, f"a{i} b c", "x") for i in range(110)] + [(None, "same words here", "y")] * 110 + [(i, "d e f g", "z") for i in range(50)]
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        report = mixing.mix_report(docs).collect()
        for target in {r["target"] for r in report}:
            own = [r for r in report if r["target"] == target]
            assert abs(sum(r["taken"] for r in own) - target) <= 4 and all(r["taken"] <= 2 * r["size"] for r in own)
        mixed = Counter(r["source"] for r in mixing.mixed_documents(docs).collect())
        assert sum(mixed.values()) * 3 <= sum(r["taken"] for r in report) <= sum(mixed.values()) * 4


def test_no_operator_has_names_of_its_own(spark, edges):
    taken = ["slot", "shard", "at", "index", "u", "uid", "size", "cut", "times", "whole", "ratio", "of", "doc", "id", "__slot", "__shard", "__row", "row", "bucket", "chunk", "content", "length"]
    for name in taken:
        marked = edges.select("doc_id", "text", "source", F.lit("mine").alias(name))
        for out in (mixing.mixed_documents(marked), sharding.shard_documents(marked, slot_into="s1", shard_into="s2"), ngram_join.one_of_each(marked) if name in ("row", "__row") else marked):
            assert name in out.columns and {r[name] for r in out.select(name).collect()} == {"mine"}
    assert packing.packed_documents(edges.withColumn("length", F.lit("x"))).count() == 12
    assert sharding.shard_documents(edges.where("false")).count() == 0


def test_sharding(spark, edges):
    table = sharding.lookup_table()
    assert len(table) == sharding.TABLE_SIZE and set(table) == set(range(len(sharding.SHARDS)))
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.1 * len(table)
    for bad in ((("a", "a"), 7), ((), 7), (("a", "b"), 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)
    got = sharding.shard_documents(edges.withColumn("slot", F.lit("x")))
    assert got.count() == 12 and len({(r["doc_id"], r["shard"]) for r in got.collect()}) == 11
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, queries.op6_sharding(spark, SF).select("doc_id", "slot", "shard").collect())) == sorted(con.execute(sharding.oracle_sql()).fetchall())


def brute_padding(lengths, buckets):
    values = sorted(set(lengths))
    best = math.inf
    for cuts in itertools.combinations(values[:-1], min(buckets, len(values)) - 1):
        ends = [*cuts, values[-1]]
        best = min(best, sum(next(e for e in ends if e >= n) - n for n in lengths))
    return best


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = rng.integers(0, 60, rng.integers(1, 25)).tolist()
        k = int(rng.integers(1, 5))
        values, counts = np.unique(lengths, return_counts=True)
        ends = packing.best_boundaries(values, counts, k)
        assert len(ends) <= k and ends[-1] == values[-1]
        assert sum(next(e for e in ends if e >= n) - n for n in lengths) == brute_padding(lengths, k)


def test_boundaries_of_long_lengths_are_optimal():
    """Lengths of any size are exact; sums beyond what a double holds as well."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        lengths = rng.integers(200, 20_000, rng.integers(1, 14)).tolist()
        k = int(rng.integers(1, 5))
        values, counts = np.unique(lengths, return_counts=True)
        ends = packing.best_boundaries(values, counts, k)
        assert sum(next(e for e in ends if e >= n) - n for n in lengths) == brute_padding(lengths, k)
        assert packing.best_boundaries(values, counts * 10**15, k) == ends or k > 1
    assert packing.best_boundaries(np.array([], np.int64), np.array([], np.int64), 3) == []


def test_batches_do_not_depend_on_partitions(spark):
    docs, seen = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (3, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            seen.append(Counter(map(tuple, packing.packed_documents(docs.repartition(parts)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_packing(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, edges):
        rows = packing.packed_documents(table, budget=4096).collect()
        assert Counter((r["doc_id"], r["n_words"]) for r in rows) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in table.collect())
        assert all(r["n_words"] <= r["bucket_length"] for r in rows)
        batches = defaultdict(list)
        for r in rows:
            batches[r["bucket"], r["batch"]].append(r)
        for (bucket, batch), members in batches.items():
            room = max(1, 4096 // max(1, members[0]["bucket_length"]))
            assert len(members) <= room and sorted(m["batch_row"] for m in members) == list(range(len(members)))
            assert len(members) == room or batch == max(b for k, b in batches if k == bucket)
    assert packing.packed_documents(edges.where("false")).count() == 0


def test_neighbours(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = defaultdict(list)
    for r in queries.op3_nearest_neighbours(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    rows = vectors.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    hits = 0
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    for i in asked:
        score = x @ x[i]
        best = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        found = got[ids[i]]
        assert len(found) == 20 and all(math.isclose(s, score[np.flatnonzero(ids == v)[0]], abs_tol=1e-12) for v, s in found)
        hits += len({ids[j] for j in best} & {v for v, _ in found})
    assert len(got) == len(asked) and hits / (20 * len(asked)) >= 0.9


@pytest.mark.parametrize("scale", [1.0, 1e200, 1e-200, 1e22])
def test_neighbours_over_several_blocks(spark, scale):
    """Recall against brute force with many blocks, at any magnitude."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 12)) + 3 * rng.normal(size=(10, 12))[rng.integers(0, 10, 700)]
    df = spark.createDataFrame([(int(i), (v * scale).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nearest_neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=10, vector_block=150, query_block=9).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len(got[q] & {int(j) for j in np.argsort(-(x @ x[q]), kind="stable") if j != q and list(np.argsort(-(x @ x[q]), kind="stable")).index(j) <= 10}) for q in range(0, 700, 20))
    assert all(len(v) == 10 for v in got.values()) and len(got) == 35
    if scale != 1e200 and scale != 1e-200:  # there inner products leave the range of a double
        assert hits / 350 >= 0.9


def test_neighbours_of_one_length_each(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (20, [1.0]), (1 << 62, [3.0]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2.0), (20, 1, 1 << 62, 3.0)]


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [3.0, 1.0]), (7, [1.0]), (None, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest_neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got if r["query_id"] == 0] == [(0, 1, 6, 3.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (0, 4, None, 0.5)]
    assert nearest_neighbours.nearest_neighbours(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_language_model_base(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, edges):
        rows = [(r["doc_id"], [*WORD.findall(lower(r["text"] or "")), None]) for r in table.collect()]
        trains = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 != 1
        counts = Counter(w for d, ws in rows if trains(d) for w in ws)
        n, v = sum(counts.values()), len(counts)
        base = Counter((d, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for d, ws in rows)
        got = lm_scoring.lm_scores(table, remainder(F.col("doc_id"), 5) != 1).collect()
        assert {r["train_tokens"] for r in got} == {n}
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == base
        assert all(r["score"] <= 1e-9 for r in got)
    assert lm_scoring.lm_scores(edges.where("false"), F.lit(True)).count() == 0


def test_language_model_beats_base_on_held_out(spark):
    held = queries.op8_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_filter_keeps_quantised_counts():
    rng = np.random.default_rng(5)
    keys, counts = rng.integers(0, 1 << 62, 5000).astype(np.uint64), rng.integers(1, 2000, 5000)
    steps = lm_scoring.steps_of(counts)
    blocks = max(1, int(steps.sum()) * lm_scoring.BITS_PER_ENTRY // (64 * lm_scoring.BLOCK_WORDS))
    f = lm_scoring.LogFrequencyFilter(blocks)
    f.insert(keys, steps)
    got = f.steps(keys)
    assert (got >= steps).all() and (got == steps).mean() > 0.95
    assert (f.steps(rng.integers(0, 1 << 62, 5000).astype(np.uint64)) > 0).mean() < 0.05
    assert (np.abs(np.log(lm_scoring.count_of(steps) / counts)) <= math.log(lm_scoring.BASE)).all()


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "ngram_join", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        if name != "packing":
            assert set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
        after = out.collect()
        ids = Counter(r["doc_id"] for r in after)
        if name == "quality_rules":
            assert set(ids) == {r["doc_id"] for r in before if quality_rules.measure((r["text"] or "").encode(), r["lang"])["kept"]}
        elif name == "toxicity":
            scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf}/labels.parquet"), into="p").collect()
            assert set(ids) == {r["doc_id"] for r in scores if r["p"] < toxicity.THRESHOLD}
        elif name == "ngram_join":
            assert set(ids) == {d for d, _, c in brute_classes([(r["doc_id"], r["text"]) for r in before]) if d == c}
        elif name == "mixing":
            assert ids == Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_report(docs).collect() if r["taken"]})
        else:
            assert Counter(r["doc_id"] for r in before) == ids
        docs = spark.createDataFrame(after, out.schema) if k < len(names) - 1 else docs


def test_pipeline_edges(spark, edges):
    labels_dir = SF
    table = edges.withColumn("n_chars", F.length("text").cast("long"))
    for rows in (table, table.where("false")):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, labels_dir)
        assert docs.count() >= 0


def test_language_model_grows_with_the_corpus(spark):
    """Pairs of words beyond any fixed vocabulary count: a text of seen pairs beats its words in another order."""
    words = [f"w{i:05d}" for i in range(12_000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[6000:6400])), (2, " ".join(words[6400:6000:-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.lm_scores(docs, F.col("doc_id") == 0).collect()}
    assert got[1]["n_known"] == got[2]["n_known"] == 401
    assert got[1]["score"] > got[2]["score"] + 800
    share = 1.5 / (12_001 + 0.5 * 12_002)
    assert abs(got[0]["score"] / 12_001 - math.log10((1 + lm_scoring.PRIOR * share) / (1 + lm_scoring.PRIOR))) < 0.01  # each pair was seen once, after a word seen once


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_language_model_against_brute_force(spark, monkeypatch, frequent):
    """Whatever part of the words is broadcast, scores are those of the interpolation, up to steps of the counts."""
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.6, 60) % 200)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = {d: [None, *t.split(), ""] for d, t in rows}
    trains = [t for d, t in tokens.items() if d < 40]
    count, pairs = Counter(w for t in trains for w in t[1:]), Counter(p for t in trains for p in itertools.pairwise(t))
    held = {p: float(lm_scoring.count_of(lm_scoring.steps_of(np.array([c])))[0]) for p, c in pairs.items()}
    n = sum(count.values()) + 0.5 * (len(count) + 1)
    histories = Counter(a for t in trains for a in t[:-1])

    def log(a, b):
        share = (count[b] + 0.5) / n
        return math.log10((held.get((a, b), 0) + lm_scoring.PRIOR * share) / (histories[a] + lm_scoring.PRIOR))

    want = {d: sum(log(a, b) for a, b in itertools.pairwise(t)) for d, t in tokens.items()}
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(docs, F.col("doc_id") < 40).collect()}
    assert max(abs(got[d] - want[d]) / len(tokens[d]) for d in want) < (1e-6 if frequent == 1000 else 0.01)  # chance hits of the filter are few


@pytest.mark.parametrize("step", ["words", "pairs"])
def test_language_model_reads_no_word_alone(step):
    """Words that were never seen before cost no call of Python each: tokens are hashed and counted as arrays."""
    texts = pa.RecordBatch.from_arrays([pa.array([" ".join(f"new{i}x{j}" for j in range(2000)) for i in range(10)])], ["text"])
    run = lm_scoring._word_counts(4) if step == "words" else lm_scoring._pair_counts(SimpleNamespace(value=np.zeros(0, np.uint64)), 4)
    list(run(iter([texts])))
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        rows = list(run(iter([texts])))
    finally:
        sys.setprofile(None)
    assert sum(len(lm_scoring.unpacked_counts(e)[0]) for b in rows for e in b.column(1).to_pylist()) >= 20_000
    assert sum(calls.values()) < 5000


def test_token_hashes_tell_words_apart():
    rng = np.random.default_rng(8)
    pieces = ["a", "B", "b", "\0", "é", "É", " ", "\x1c", "x" * 7, "x" * 8, "y" * 63, "y" * 64, "Y" * 65, "z" * 500, " ", " ", " ", "\t", "\n", "\x0b", "\x0c", "\r"]
    texts = ["", " ", "end", " end", *("".join(rng.choice(pieces, n)) for n in rng.integers(0, 60, 2000)), *("q" * n for n in range(200)), "w" * 100_000]
    want = [[*WORD.findall(lower(t)), None] for t in texts]
    hashes, lengths = lm_scoring.token_hashes([t.encode() for t in texts])
    assert lengths.tolist() == [len(ws) for ws in want]
    of = dict(zip((w for ws in want for w in ws), hashes.tolist()))
    assert [of[w] for ws in want for w in ws] == hashes.tolist() and len(set(of.values())) == len(of) and len(of) > 2000
    alone = [lm_scoring.token_hashes([t.encode()])[0].tolist() for t in texts[:300]]
    assert [h for hs in alone for h in hs] == hashes[: sum(map(len, alone))].tolist()
    assert [len(x) for x in lm_scoring.token_hashes([])] == [0, 0]


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_places_among_hashes(n):
    rng = np.random.default_rng(n)
    among = np.unique(np.concatenate([rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 9, n // 2, np.uint64)]))
    asked = np.concatenate([among, among + np.uint64(1), rng.integers(0, 1 << 64, 500, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
    for held in (among, np.append(among[among < (1 << 64) - 1], np.uint64((1 << 64) - 1))):
        place = {k: i for i, k in enumerate(held.tolist())}
        assert lm_scoring.Places(held).of(asked).tolist() == [place.get(k, -1) for k in asked.tolist()]


def test_filter_is_built_in_any_cut(monkeypatch):
    rng = np.random.default_rng(4)
    keys, counts = rng.integers(0, 1 << 64, 60_000, np.uint64), rng.integers(1, 100, 60_000)
    whole = lm_scoring.filter_of(keys, counts)
    assert whole.n_blocks > 20 and (whole.steps(keys) >= lm_scoring.steps_of(counts)).all()
    for spread in (1, 7, whole.n_blocks):
        monkeypatch.setattr(lm_scoring, "SPREAD", spread)
        assert (lm_scoring.filter_of(keys, counts).words == whole.words).all()


@pytest.mark.parametrize("buckets", [4, 8])
def test_filter_of_a_bucket_uses_all_its_blocks(buckets):
    """Keys of one bucket, whose number of blocks has the number of buckets as a factor, meet few chance hits."""
    keys = np.random.default_rng(7).integers(0, 1 << 64, 6_000 * buckets**2, np.uint64)
    keys = keys[lm_scoring.mixed(keys) % np.uint64(buckets) == 1]
    f = lm_scoring.LogFrequencyFilter(buckets)
    held, others = keys[: 2_000 * buckets], keys[2_000 * buckets : 5_000 * buckets]
    f.insert(held, np.full(len(held), 10))
    assert (f.steps(held) >= 10).all() and (f.steps(others) > 0).mean() < 0.02
