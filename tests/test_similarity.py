"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lakeseek.functions import similarity as sim


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def words(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


@pytest.mark.parametrize(("a", "b", "want"), [((1, 2, 3), (3, 2, 1), 0.7142857), ((1, 2, 3), (3, 3, 3), 0.9258201), ((0, 0), (1, 1), 0.0), ((1, 0, 5), (1, 0), 1.0)])
def test_cosine(spark, a, b, want):
    assert value(spark, sim.cosine(vec(*a), vec(*b))) == pytest.approx(want, abs=1e-6)


def test_cosine_shapes(spark):
    assert value(spark, sim.norm_cosine(F.lit(0.5))) == 0.75
    assert value(spark, sim.abs_cosine(F.lit(-0.5))) == 0.5
    assert value(spark, sim.angular(F.lit(0.5))) == pytest.approx(2 / 3)
    assert value(spark, sim.angular(F.lit(1.0000000001))) == 1.0


@pytest.mark.parametrize(("a", "b", "want"), [("ab", "ab", 1.0), ("ab", "cd", 0.0), ("", "", 0.0), ("ab", "bc", 1 / 3), ("abcd", "defg", 1 / 7)])
def test_jaccard(spark, a, b, want):
    assert value(spark, sim.jaccard(words(*a), words(*b))) == pytest.approx(want)


def test_weighted_jaccard(spark):
    w = F.create_map(F.lit("s"), F.lit(2.0), F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(3.0), F.lit("u"), F.lit(-1.0))
    assert value(spark, sim.weighted_jaccard(words("s", "x", "u"), words("s", "y"), w)) == pytest.approx(1 / 3)
    assert value(spark, sim.weighted_jaccard(words(), words(), w)) == 0.0


def test_adjusted(spark):
    assert value(spark, sim.adjusted(F.lit(False), F.lit(1.0))) == 0.95
    assert value(spark, sim.adjusted(F.lit(True), F.lit(0.0))) == 1.0


def test_tuple_measures(spark):
    d = sim.weighted_distance(vec(0.5, 0.9), vec(1, 1), vec(0.25, 0.75))
    assert value(spark, sim.distance_similarity(d)) == pytest.approx(0.790779, abs=1e-6)
    assert value(spark, sim.cosine_to_ones(vec(0.5, 0.9))) == pytest.approx(0.961524, abs=1e-6)
    assert value(spark, sim.cosine_to_ones(vec(0, 0))) == 0.0


@pytest.mark.parametrize(("a", "b", "want"), [(1, 2, 12), (0, 12, 12), (3, 10, 310), (9, 99, 999)])
def test_concat_digits(spark, a, b, want):
    assert value(spark, sim.concat_digits(F.lit(a).cast("long"), F.lit(b).cast("long"))) == want


def test_bands_and_hamming(spark):
    ints = lambda *xs: F.array(*map(F.lit, xs))
    assert value(spark, sim.fletcher(ints(3, 5), 16)) == 8
    assert value(spark, sim.fletcher(ints(200, 100, 7), 1024)) == 564
    assert value(spark, sim.bit_band(ints(1, 0, 1, 1), 16)) == 13
    assert [value(spark, sim.hamming(ints(1, 2, 3), ints(*b))) for b in ((1, 2, 3), (1, 2, 4), (1, 0, 4))] == [0, 1, 2]
    assert value(spark, sim.hamming(ints(1), ints(1, 2))) is None
