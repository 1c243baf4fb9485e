import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import sequence as S
from strandmill.functions.stats import _tail, collision_bound, noise_probability, noise_probability_any


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_padding(spark):
    pad = lambda s, **k: one(spark, S.centre_pad(F.lit(s), **k))
    assert pad("ARDY") == "JJJJJJJJARDYJJJJJJJJ"
    assert pad("ARD") == "JJJJJJJJARDJJJJJJJJJ"
    assert pad("A" * 21) == "A" * 21
    assert len(pad("A" * 21, overlong_as_reference=True)) == 22
    assert len(pad("A" * 22, overlong_as_reference=True)) == 22
    assert one(spark, S.right_repad(F.lit("JJARJDJJ"), 6)) == "ARDJJJ"
    assert one(spark, S.right_repad(F.lit("ARDARDAR"), 6)) == "ARDARDAR"
    assert one(spark, S.strip_chars(F.lit("JJAJRJ"), "J")) == "AJR"
    assert one(spark, S.strip_chars(F.lit("JJA"), "")) == "JJA"


def test_distances(spark):
    assert one(spark, S.shift_distance(F.lit("AATTCGG"), F.lit("TTC"))) == 0
    assert one(spark, S.shift_distance(F.lit("TTC"), F.lit("AATTCGG"))) == 0
    assert one(spark, S.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2
    assert one(spark, S.hamming(F.lit("ACG"), F.lit("AGGA"))) is None
    assert one(spark, S.hamming(F.lit(""), F.lit(""))) == 0
    assert one(spark, S.hamming_share(F.lit("ACGT"), F.lit("AGGA"))) == 0.5


def test_translation_and_cdr(spark):
    assert one(spark, S.translate_codons(F.lit("ATGGCATAG"))) == "MA*"
    assert one(spark, S.translate_codons(F.lit("atgnnAC"))) == "MX"
    assert one(spark, S.translate_codons(F.lit("AC"))) == ""
    assert one(spark, S.translate_codons(F.lit(None).cast("string"))) is None
    got = [r[0] for r in spark.createDataFrame([("A" * n,) for n in (6, 9, 10)], "s string").select(S.is_valid_cdr(F.col("s"))).collect()]
    assert got == [False, True, False]


def test_one_hot(spark):
    hot = np.array(one(spark, S.one_hot(F.lit("ARD")))).reshape(20, 40)
    assert hot.sum() == 3 and hot[S.RESIDUES.index("A"), 18] == 1 and hot[S.RESIDUES.index("D"), 20] == 1
    with pytest.raises(Exception, match="alphabet"):
        one(spark, S.one_hot(F.lit("AR*")))
    assert one(spark, S.argmax_label(F.array(F.lit(0), F.lit(3), F.lit(3)))) == 1


def test_clean_sequence(spark):
    assert one(spark, S.clean_sequence(F.lit(" ar-dJ*y "))) == "ARDY"
    assert one(spark, S.is_header(F.lit("  >x"))) is True
    assert one(spark, S.is_header(F.lit(None).cast("string"))) is False


def test_tails(spark):
    cases = [(30, 1000, 1, 3, 0.07554904911), (30, 1000, 1, 10, 9.032571058e-08), (12, 0, 1, 2, 0.0)]
    for size, near, k, m, want in cases:
        got = one(spark, noise_probability(*(F.lit(v) for v in (size, near, k, m))))
        assert got == pytest.approx(want, rel=1e-8)
    for size, near, k, m, want in [(30, 1000, 1, 3, 0.9052637467), (30, 1000, 2, 1, 0.3451874075)]:
        got = one(spark, noise_probability_any(*(F.lit(v) for v in (size, near, k, m))))
        assert got == pytest.approx(want, rel=1e-8)
    exact = sum(math.comb(12, i) * 0.3**i * 0.7 ** (12 - i) for i in range(5, 13))
    assert _tail(np.array([5.0]), np.array([12.0]), np.array([0.3]))[0] == pytest.approx(exact)


def test_collisions(spark):
    assert collision_bound(3, 2, 2, 0) == pytest.approx(-0.125)
    assert collision_bound(10, 8, 20, 2) == pytest.approx(1.8034997e-05, rel=1e-4)
