"""Queries and operators do the whole job: no cap, whatever the number of rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill import registry
from strandmill.functions.stats import collision_bound, collision_bounds
from strandmill.operators import affinity, permute


def _edits(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def peptide(k: int, length: int) -> str:
    return "".join("ACDEFGHIKLMNPQRSTVWY"[k // 20**i % 20] for i in range(length))


@pytest.fixture
def folder(spark, tmp_path):
    """A function that writes training and test peptides (lists of sequences) and returns their folder."""

    def write(train, test, to="all"):
        for name, seqs in (("knn_train", train), ("knn_test", test)):
            rows = [(f"{name}_{i:05d}", s, float(i)) for i, s in enumerate(seqs)]
            spark.createDataFrame(rows, "id string, seq string, target_num double").write.parquet(f"{tmp_path}/{to}/{name}.parquet")
        return f"{tmp_path}/{to}"

    return write


def test_collision_bound_of_all_sequences(spark, folder):
    train = [peptide(7 * k, 8) for k in range(120)] + [peptide(k, 3) for k in range(70)] + [peptide(k, 2) for k in range(3)] + ["W"]
    got = {r["len"]: (r["n"], r["bound"]) for r in registry.queries()["q37_collision_bound"](spark, folder(train, [])).collect()}
    assert got == {8: (120, round(collision_bound(120, 8, 20, 2), 6)), 3: (70, round(collision_bound(70, 3, 20, 2), 6)), 2: (3, 1.0), 1: (1, 0.0)}
    assert got[8][1] > round(collision_bound(50, 8, 20, 2), 6)


def test_collision_bounds_in_logarithms(spark):
    cases = [(n, length, letters, cutoff) for n, length in itertools.product((1, 2, 5, 60, 3000, 8000, 200_000), (3, 4, 8, 23, 300)) for letters, cutoff in ((20, 0), (20, 2))]
    for letters, cutoff in ((20, 0), (20, 2)):
        own = [c[:2] for c in cases if c[2:] == (letters, cutoff)]
        df = spark.createDataFrame(own, "n bigint, len int")
        for r in df.select("n", "len", collision_bounds(F.col("n"), F.col("len"), letters, cutoff).alias("bound")).collect():
            whole = letters ** r["len"]
            if r["n"] > whole:
                assert r["bound"] == 1
                continue
            near = sum(math.comb(r["len"], k) * (letters - 1) ** k for k in range(cutoff + 1)) / whole
            power = r["n"] * (r["n"] - 1) // 2 * math.log1p(-near) - math.fsum(math.log1p(-i / whole) for i in range(r["n"]))
            want = -math.expm1(power) if power < 700 else -math.inf
            assert r["bound"] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_affinities_meet_the_whole_batch(spark, folder):
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACDEFG", k=rng.randint(5, 9))) for _ in range(301)]
    got = registry.queries()["q32_affinities"](spark, folder(seqs, [])).collect()
    assert len(got) == 301 * 300 and {r["batch"] for r in got} == {0}
    few = registry.queries()["q32_affinities"](spark, folder(seqs[:40], [], "few")).collect()
    p = np.zeros((40, 40))
    for r in few:
        p[r["i"], r["j"]] = r["p"]
    d = np.array([[_edits(a.encode(), b.encode()) ** 2 for j, b in enumerate(seqs[:40]) if j != i] for i, a in enumerate(seqs[:40])], dtype=float)
    want = np.zeros((40, 40))
    want[~np.eye(40, dtype=bool)] = affinity._row_affinities(d, 30.0, 1e-5, 50).ravel()
    want = want + want.T
    assert p == pytest.approx(np.maximum(want / want.sum(), affinity.EPSILON) * (1 - np.eye(40)), rel=1e-6)


def test_permute_every_seed_and_distance(spark, folder):
    rng = random.Random(4)
    train = ["".join(rng.choices("ACDEFGHIKL", k=rng.randint(9, 14))) for _ in range(50)]
    test = ["".join(rng.choices("MNPQRSTVWY", k=rng.randint(9, 14))) for _ in range(40)] + ["MNPQ"]
    got = registry.queries()["q33_permute"](spark, folder(train, test)).collect()
    assert {(r["seq"], r["trial"]) for r in got} == {(s, t) for s in test for t in range(3)} and len(got) == 3 * len(test)
    known = {(len(s), min(len(s), _edits(s.encode(), t.encode()))) for s, t in zip(test, train)}
    assert {(len(r["seq"]), r["changes"]) for r in got} <= known and max(r["changes"] for r in got) > 2


def test_permute_proposals_start_over(spark):
    seeds = spark.createDataFrame([(k, s) for k, s in enumerate(["AA", "AC", "AD", None, "AE", "AF"])], "id bigint, seq string")
    proposals = spark.createDataFrame([("y", "WW"), ("x", "YY")], "id string, seq string")
    assert sorted(map(tuple, permute.paired(seeds, proposals).collect())) == [("AA", "YY"), ("AC", "WW"), ("AD", "YY"), ("AE", "WW"), ("AF", "YY")]
