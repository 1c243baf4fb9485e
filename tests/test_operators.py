import itertools
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill.plans import skew
from strandmill.operators import affinity, cluster, counts, denoise, denoise_counts, density, ensemble, hamming, kmers, knn, metrics, neighbors, parsing, partition, permute
from strandmill.plans.components import components
from strandmill.plans.skew import lookup, star_edges


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def misses(a, b):
    return sum(x != y for x, y in zip(a, b))


def union_find(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_lines_count_once(spark):
    rows = [(1, "AA", 2.0), (1, "AA", 2.0), (2, "AA", float("nan")), (2, "AA", float("nan")), (None, "AA", 1.0), (None, "AA", 1.0), (None, "AA", None), (None, None, None), (3, None, None)]
    got = counts.distinct_lines(spark.createDataFrame(rows, "line_id long, seqs string, counts double")).select("line_id", "seqs").collect()
    want = [(1, "AA"), (2, "AA"), (None, "AA"), (None, "AA"), (None, None), (3, None)]
    assert sorted((repr(tuple(r)) for r in got)) == sorted(map(repr, want))


def test_counts_and_labels(spark):
    reads = spark.createDataFrame([("R1", " ARD "), ("R1", "ARD"), ("R2", ""), ("R2", None)], "round string, seq string")
    got = {(r["round"], r["seq"]): r["n"] for r in counts.round_counts(reads).collect()}
    assert got == {("R1", "ARD"): 2, ("R2", ""): 1}
    rows = [("a", 0.0, 1.0, 4.0), ("b", 5.0, 3.0, 3.0), ("c", 1.0, 1.0, 1.0), ("d", 2.0, 2.0, 0.0), ("e*", 9.0, 9.0, 9.0), ("F" * 21, 9.0, 9.0, 9.0), ("g", None, None, 5.0)]
    got = {r["seq"]: (r["l"], r["l2"]) for r in counts.labelled(spark.createDataFrame(rows, "seq string, r1 double, r2 double, r3 double")).collect()}
    assert got == {"a": (1, 0), "b": (0, 1), "c": (0, 1), "g": (1, 0)}
    long = spark.createDataFrame([("a", "r1", 2), ("a", "r3", 1), ("b", "r2", 1)], "seq string, round string, n int")
    assert {tuple(r) for r in counts.enrichment(long, ["r1", "r2", "r3"]).collect()} == {("a", 2.0, 0.0, 1.0), ("b", 0.0, 1.0, 0.0)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("AB", min_size=0, max_size=7), unique=True, max_size=40), st.integers(0, 3))
def test_neighbours_equal_brute_force(spark, words, radius):
    rows = spark.createDataFrame(list(enumerate(words)), "id bigint, seq string")
    got = {tuple(r) for r in neighbors.levenshtein_pairs(rows, radius).collect()}
    assert got == {(i, j, d) for (i, a), (j, b) in itertools.combinations(enumerate(words), 2) if (d := edits(a, b)) <= radius}
    got = {tuple(r) for r in hamming.hamming_pairs(rows, radius).collect()}
    assert got == {(i, j, d) for (i, a), (j, b) in itertools.combinations(enumerate(words), 2) if len(a) == len(b) and (d := misses(a, b)) <= radius}


def test_mismatches_of_long_sequences(spark):
    rng = random.Random(1)
    base = "".join(rng.choices("ACGTN", k=150))
    words = [base, base[:70] + "X" + base[71:], "C" + base[1:-1] + "-", base.lower()]
    rows = spark.createDataFrame(list(enumerate(words)), "id int, seq string")
    got = {(r["src"], r["dst"]): r["dist"] for r in hamming.hamming_pairs(rows, 3).collect()}
    assert got == {(i, j): d for i, j in itertools.combinations(range(4), 2) if (d := misses(words[i].upper(), words[j].upper())) <= 3}


def test_nearest(spark):
    left = spark.createDataFrame([(1, "AATTC", "x"), (2, "ACCTA", "y"), (3, None, "z")], "id int, seq string, x string")
    right = spark.createDataFrame([(1, "ATTTA"), (2, "TACTT"), (0, None)], "id int, seq string")
    assert {tuple(r) for r in neighbors.nearest(left, right).collect()} == {(1, "AATTC", "ATTTA", 2), (2, "ACCTA", "ATTTA", 2)}
    assert neighbors.nearest(left, right.limit(0)).count() == 0
    wide = spark.createDataFrame([(7, "AATTCGG")], "id int, seq string")
    assert neighbors.nearest(spark.createDataFrame([(1, "TTC")], "id int, seq string"), wide, mode="shift").first()["mindist"] == 0


@pytest.mark.parametrize("n,m", [(1, 0), (60, 45), (60, 120)])
def test_components(spark, n, m):
    rng = random.Random(n * m)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    want = union_find([(a, b) for a, b in pairs if a is not None and a != b])
    assert got == want


def test_stars_and_skew(spark):
    rows = spark.createDataFrame([(i, 1 if i % 3 else None, "c") for i in range(500)], "id bigint, key int, src string")
    edges = star_edges(rows, "id", "key").collect()
    assert len(edges) < 2 * 500
    assert set(union_find([(r["src"], r["dst"]) for r in edges]).values()) == {1}
    left = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(2000)], "k bigint, v bigint")
    right = spark.createDataFrame([(i, i * 10) for i in range(1500)], "k bigint, w bigint")
    assert sorted(map(tuple, lookup(left, right, "k", min_rows=10).collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert lookup(left, right, "k", how="left", min_rows=10).count() == 2000


def test_cluster(spark):
    rows = spark.createDataFrame([(7, "ARDYYY", 9.0), (2, "ARDYYA", 5.0), (3, "CCCCCC", 4.0), (4, "ARDYAA", 1.0), (5, "WWWWWWWWW", 1.0), (6, None, 1.0)], "id bigint, seq string, count double")
    got = {r["id"]: (r["group"], r["group_size"]) for r in cluster.cluster(rows, n_seeds=3, cutoff=1).collect()}
    assert got == {7: (7, 3), 2: (7, 3), 4: (7, 3), 3: (3, 1), 5: (5, 1)}


def test_density(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("AC", k=rng.choice([6, 9]))) for _ in range(60)})
    rows = spark.createDataFrame(list(enumerate(words)), "id bigint, seq string")
    f = density.rho_delta(rows, 3)
    got = {r["id"]: (r["rho"], r["delta"]) for r in f.collect()}
    same = {i: [j for j, b in enumerate(words) if len(b) == len(a)] for i, a in enumerate(words)}
    rho = {i: sum(misses(a, words[j]) < 3 for j in same[i]) for i, a in enumerate(words)}
    want = {}
    for i, a in enumerate(words):
        above = [misses(a, words[j]) for j in same[i] if rho[j] > rho[i]]
        want[i] = (rho[i], min(above) if above else max(misses(a, words[j]) for j in same[i]))
    assert got == want
    c = density.centres(f, min_rho=1, min_delta=1)
    own = {r["id"] for r in c.collect()}
    assert own and all(r["centre_id"] == r["id"] for r in density.assign(f, c).collect() if r["id"] in own)


def test_denoising(spark):
    rows = spark.createDataFrame([(1, "ACGTACGTAC", 900), (2, "ACGTACGTAA", 1), (3, "TTTTTTTTTT", 40)], "id bigint, seq string, n bigint")
    f = denoise.max_neighbour_counts(rows)
    assert {r["id"]: r["max_neighbor_cnt_d1"] for r in f.collect()} == {1: 1, 2: 900, 3: 0}
    p = denoise.noise_probabilities(f)
    assert {r["id"] for r in denoise.real_reads(p, 100).collect()} == {1, 3}
    a = spark.createDataFrame([("x", 1e-6), ("y", 0.9)], "seq string, p double")
    b = spark.createDataFrame([(f"z{i}", 1.0) for i in range(8)], "seq string, p double")
    assert [r["seq"] for r in denoise.accepted_in_replicates(a, b).collect()] == ["x"]


def test_primers(spark):
    cdr = "GCAAAAGACTACGGG"
    good, far = parsing.HEAD, "TATTGAGCGCGA"
    reads = spark.createDataFrame([(1, f"CC{good}{cdr}{parsing.TAILS['tail_seq1_DV']}AA"), (2, f"{far}{cdr}"), (3, None), (4, "")], "read_id int, seq string")
    (row,) = parsing.find_cdrs(reads).collect()
    assert (row["read_id"], row["cdr"]) == (1, cdr + "GACGTC")
    hit = spark.range(1).select(parsing.locate(F.lit("GG" + parsing.HEAD[2:] + "AA"), {"h": parsing.HEAD}).alias("h")).first()["h"]
    assert (hit["qstart"], hit["qend"], hit["sstart"], hit["send"], hit["score"]) == (3, 12, 3, 12, 10)
    hits = spark.createDataFrame([("r", 0.1, 5), ("r", 0.01, 7), ("r", 0.01, 6)], "qseqid string, evalue double, sstart int")
    assert parsing.best_hits(hits).first()["sstart"] == 6


def test_kmers(spark):
    rows = spark.createDataFrame([(1, "AAAAA"), (2, "AABBA"), (3, "A"), (4, None)], "id int, seq string")
    assert {tuple(r) for r in kmers.kmer_counts(rows, 2).collect()} == {(1, "AA", 2), (2, "AA", 1)}


def test_kmer_models(spark):
    rows = [(i, ("AR" * 5 if i % 2 else "WY" * 5) + "DY", float(i % 2)) for i in range(60)]
    v = kmers.kmer_vectors(spark.createDataFrame(rows, "id bigint, seq string, label double"))
    for model in (kmers.forest(v, trees=5), kmers.linear_svm(v)):
        assert metrics.confusion(model.transform(v)).first()["balanced_accuracy"] == 1.0


def test_knn(spark):
    train = spark.createDataFrame([(f"t{i}", s, float(i)) for i, s in enumerate(["ARDY", "ARDA", "WWWW", "ARDYY", None])], "id string, seq string, target double")
    q = spark.createDataFrame([("q", "ARDY")], "id string, seq string")
    near = knn.k_nearest(q, train, k=2).collect()
    assert [(r["id"], r["dist"]) for r in sorted(near, key=lambda r: r["r"])] == [("t0", 0.0), ("t1", 0.05)]
    assert knn.predicted(knn.k_nearest(q, train, k=2)).first()["prediction"] == 0.5
    long = spark.createDataFrame([("l", "A" * 69 + "W", 3.0), ("m", "A" * 68 + "WW", 4.0)], "id string, seq string, target double")
    asked = spark.createDataFrame([("q", "A" * 70)], "id string, seq string")
    assert [(r["id"], r["r"]) for r in knn.k_nearest(asked, long, k=1).collect()] == [("l", 1)]


def test_partition(spark):
    sizes = [30, 3, 4, 2, 10, 3, 3, 9, 3, 2, 3, 4]
    rows = spark.createDataFrame([(g, i) for g, n in enumerate(sizes) for i in range(n)], "group bigint, i int")
    parts = partition.partition_groups(rows, {"a": 0.8, "b": 0.1, "c": 0.1})
    got = {r["part"]: r["n"] for r in partition.expand(parts, rows).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 76 and abs(got["a"] - 60) <= 1 and abs(got["b"] - 7) <= 1 and abs(got["c"] - 9) <= 1
    with pytest.raises(ValueError, match="no division"):
        partition.partition_groups(rows.where("group = 0").withColumn("group", F.col("i") % 2), {"a": 0.25, "b": 0.75})
    rng = random.Random(5)
    rows = [(None, 0)] + [(g, i) for g in range(3000) for i in range(rng.choice([1, 1, 2, 5] if g else [700]))]
    rows = spark.createDataFrame(rows, "group bigint, i int").withColumn("part", F.lit("clash")).drop("part")
    parts = {"a": 0.8, "b": 0.1, "c": 0.1}
    placed = partition.expand(partition.partition_groups(rows, parts), rows)
    check = partition.partition_check(placed, rows, parts).collect()
    assert len(check) == 3 and all(r["within"] and r["n_parted"] == 0 for r in check) and placed.count() == rows.where("group IS NOT NULL").count()


def test_permute(spark):
    seeds = spark.createDataFrame([(1, "ARDYY"), (2, "ARDYA"), (3, None), (4, "W")], "id bigint, seq string")
    summary = spark.createDataFrame([(5, 2, 3), (5, 9, 1)], "length int, dist int, n bigint")
    got = permute.permuted(seeds, summary, trials=20).collect()
    assert len(got) == 60 and all(misses(r["seq"], r["permuted"]) == r["changes"] for r in got)
    assert {r["changes"] for r in got if len(r["seq"]) == 5} == {2, 5} and {r["permuted"] for r in got if r["id"] == 4} == {"W"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, permute.permuted(seeds.repartition(3), summary, trials=20).collect()))


def test_affinities(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, "".join(rng.choices("ACDEFG", k=8))) for i in range(45)], "id bigint, seq string")
    b = affinity.batches(rows, 20)
    assert b.count() == 40 and {(r["batch"], r["i"]) for r in b.collect()} == {(k, i) for k in range(2) for i in range(20)}
    p = affinity.joint_affinities(b, perplexity=5).collect()
    for batch in (0, 1):
        part = {(r["i"], r["j"]): r["p"] for r in p if r["batch"] == batch}
        assert sum(part.values()) == pytest.approx(1)
        assert all(part[i, j] == pytest.approx(part[j, i]) for i, j in part)
    d = np.array([[1.0, 4.0, 9.0, 16.0, 25.0], [4.0, 4.0, 1.0, 36.0, 9.0]])
    rows_p = affinity._row_affinities(d, 3.0, 1e-6, 60)
    assert np.exp(-(rows_p * np.log(rows_p)).sum(1)) == pytest.approx(3.0, rel=1e-4)


def test_mixture(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.poisson(1, 400), rng.poisson(40, 200)])
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "r double")
    got = {r["components"]: r for r in denoise_counts.mixtures(rows, "r", max_components=3, trials=4).collect()}
    assert got[2]["score"] > got[1]["score"]
    assert got[2]["means"] == pytest.approx([1, 40], rel=0.15)
    clean = denoise_counts.denoise(rows.where("r = r"), "r", got[2]["means"], got[2]["weights"], out="c")
    assert clean.where("r < 5 and c <> 0").count() == 0
    half = spark.createDataFrame([(2.5,), (3.5,), (1.5,)], "r double")
    out = [r["c"] for r in denoise_counts.denoise(half, "r", [0.001, 1.0], [0.5, 0.5], out="c").orderBy("r").collect()]
    assert out == [0.0, 2.0, 2.0]
    assert denoise_counts.mixtures(rows.limit(0), "r").count() == 0


def test_votes_and_metrics(spark):
    v = [F.lit(x) for x in (1, 1, 1, 0, 0, 0)]
    r = spark.range(1).select(metrics.majority(v).alias("a"), metrics.nonspecific(F.lit(0), F.lit(0), F.lit(1)).alias("b")).first()
    assert (r["a"], r["b"]) == (0, "Non-specific")
    scored = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label int, score double")
    assert metrics.roc_auc(scored).first()["auc"] == pytest.approx(0.875)
    assert metrics.roc_auc(scored.limit(0)).first()["auc"] is None


def test_ensemble_learns(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("ACDEFGHIKL", k=8)) + ("WW" if i % 2 else "YY"), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "seq string, label int")
    models = ensemble.train_ensemble(df, steps=20)
    assert set(models) == set(ensemble.MODELS)
    out = ensemble.predict(df.withColumn("id", F.col("seq")), models, keep=("id", "label")).collect()
    assert sum(r["vote"] == r["label"] for r in out) > 380 and all(abs(r["mean_p"] - sum(r[f"p_{m}"] for m in models) / 6) < 1e-9 for r in out)
    odd = ensemble.predict(spark.createDataFrame([(1, None), (2, ""), (3, "X" * 99)], "id int, seq string"), models)
    assert odd.count() == 3


def test_lookup_of_hot_keys_equals_a_join(spark):
    rng = random.Random(6)
    left = spark.createDataFrame([(rng.choice([None, 7, 7, 8, rng.randrange(3000)]), i) for i in range(6000)], "k bigint, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 3000, 2)] + [(7, "r7")], "k bigint, w string")
    for how in ("inner", "left"):
        plain = skew.lookup(left, right, "k", how=how)
        hot = skew.lookup(left, right, "k", how=how, min_rows=0)
        assert "BroadcastHashJoin" in hot._jdf.queryExecution().toString()
        assert sorted(map(tuple, hot.select("k", "v", "w").collect()), key=str) == sorted(map(tuple, plain.select("k", "v", "w").collect()), key=str)


def test_blocks_meet_everything_once(spark):
    few, many = spark.range(7).withColumnRenamed("id", "a"), spark.range(100).withColumnRenamed("id", "b")
    got = skew.in_blocks(few, many, by="b", rows=100, block=9).select("q.a", "p.b").collect()
    assert len(got) == 700 == len(set(map(tuple, got)))


def test_pairs_with_two_agreeing_segments(spark):
    rng = random.Random(7)
    base = ["".join(rng.choices("ACGT", k=24)) for _ in range(12)]
    rows = {"".join(c if rng.random() > 0.2 else rng.choice("ACGTN*-") for c in rng.choice(base)) for _ in range(150)}
    df = hamming.with_planes(spark.createDataFrame([(i, s) for i, s in enumerate(sorted(rows))], "id int, seq string"), 24)
    seqs = sorted(rows)
    want = sorted((i, j, misses(seqs[i], seqs[j])) for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if misses(seqs[i], seqs[j]) <= 7)
    for agree in (1, 2):
        pairs = hamming.close_to(df, df, 7, 24, also=F.col("q.id") < F.col("p.id"), agree=agree).select(F.col("q.id").alias("i"), F.col("p.id").alias("j"), "dist")
        assert sorted(map(tuple, pairs.collect())) == want  # each pair once
