"""Period lookup against a search over all periods."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from parcelio.operators import intervals, lifecycle

EPOCH = date(2000, 1, 1)
LONG = "key string, a date, b date, name string"


def day(n):
    return None if n is None else EPOCH + timedelta(days=n)


def in_force(periods, key, at):
    if at is None or key is None:
        return None
    open_ = [
        (a or date.min, name) for k, a, b, name in periods
        if k == key and (a or date.min) <= at <= (b or date.max)
    ]
    return min(open_)[1] if open_ else None


def random_periods(rng, n, keys):
    rows = []
    for i in range(n):
        a = rng.randint(0, 900)
        b = a + rng.choice([-3, 0, 1, 20, 300])
        rows.append((
            rng.choice(keys), day(a) if rng.random() > 0.03 else None,
            rng.choice([None, date(9999, 12, 31)]) if rng.random() < 0.02 else day(b), f"p{i:04}",
        ))
    return rows


@pytest.mark.parametrize("few", [intervals.FEW_SEGMENTS, 0])
@pytest.mark.parametrize("by", [["key"], []])
def test_against_all_periods(spark, few, by):
    rng = random.Random(4)
    keys = ["x", "y", None, "hot"] if by else ["x"]
    rows = random_periods(rng, 60, keys) + [("void", day(5), day(4), "no")] * bool(by)
    points = [(i, rng.choice([*keys, "none"] if by else keys), day(rng.randint(-50, 1300))) for i in range(500)]
    points += [(900, "x", None), (901, "x", date(1, 1, 1)), (902, "x", date(9999, 12, 31)), (903, None, day(3))]
    asked = spark.createDataFrame(points, "id int, key string, at date")
    periods = spark.createDataFrame(rows, LONG)
    got = {r.id: r.name for r in intervals.lookup(asked, "at", periods, "a", "b", ["name"], by, few).collect()}
    same = (lambda k: k) if by else (lambda k: "x")
    assert got == {i: in_force(rows, same(k), at) for i, k, at in points}


def test_segments_are_disjoint_and_cover_the_same_days(spark):
    rng = random.Random(5)
    rows = random_periods(rng, 40, ["x", "y"])
    segments = intervals.disjoint(spark.createDataFrame(rows, LONG), "a", "b", ["name"], ["key"]).collect()
    for key in "xy":
        own = sorted((r.seg_from, r.seg_to) for r in segments if r.key == key)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
        for n in range(-10, 1300):
            held = any(a <= day(n) <= b for a, b in own)
            assert held == (in_force(rows, key, day(n)) is not None)


@pytest.mark.parametrize("few", [intervals.FEW_SEGMENTS, 1000])
def test_a_hundred_thousand_periods(spark, few):
    n = 100_000
    periods = spark.range(n).select(
        (F.col("id") * 10).alias("a"), (F.col("id") * 10 + F.col("id") % 13).alias("b"), F.col("id").alias("name")
    )
    points = spark.range(50_000).select("id", ((F.col("id") * 7919) % (n * 10 + 50)).alias("at"))
    wrong = intervals.lookup(points, "at", periods, "a", "b", ["name"], few=few).filter(
        # A period may reach up to two places into the next one, which then begins later.
        ~F.col("name").eqNullSafe(
            F.when((F.col("at") % 10 <= 2) & (F.col("at") >= 10) & ((F.floor(F.col("at") / 10) - 1) % 13 >= 10 + F.col("at") % 10), F.floor(F.col("at") / 10) - 1)
            .when((F.col("at") % 10 <= F.floor(F.col("at") / 10) % 13) & (F.col("at") < n * 10), F.floor(F.col("at") / 10))
            .when((F.col("at") >= n * 10) & (F.col("at") - (n - 1) * 10 <= (n - 1) % 13), F.lit(n - 1))
        )
    )
    assert wrong.count() == 0


def test_a_hot_key_is_spread_over_ranges(spark):
    periods = spark.range(30_000).select(F.lit("hot").alias("key"), (F.col("id") * 5).alias("a"), (F.col("id") * 5 + 2).alias("b"), F.col("id").alias("name"))
    segments = intervals.disjoint(periods, "a", "b", ["name"], ["key"])
    assert segments.count() == 30_000
    dealt = intervals._in_ranges(periods, "key", "a").groupBy("__range").count().collect()
    assert max(r["count"] for r in dealt) < 0.1 * 30_000


def test_empty_tables(spark):
    none = spark.createDataFrame([], LONG)
    asked = spark.createDataFrame([(1, "x", day(1))], "id int, key string, at date")
    for few in (intervals.FEW_SEGMENTS, 0):
        assert [r.name for r in intervals.lookup(asked, "at", none, "a", "b", ["name"], ["key"], few).collect()] == [None]
        assert intervals.lookup(asked.limit(0), "at", none, "a", "b", ["name"], ["key"], few).count() == 0
    assert [r.name for r in intervals.lookup(asked, "at", none, "a", "b", ["name"]).collect()] == [None]


def test_regimes_with_open_ends(spark):
    names = [("I", None, date(2010, 6, 30)), ("II", date(2010, 5, 1), date(2012, 1, 1)), ("IV", date(2015, 1, 1), None)]
    terms = "tipo_regencia string, inicio date, fim date, carencia int, amortizacao string, pgto_juros int, percent_garantia int"
    regimes = spark.createDataFrame([(*r, 3, "x", 100, 80) for r in names], terms)
    days = {date(1990, 1, 1): "I", date(2010, 6, 30): "I", date(2010, 7, 1): "II", date(2013, 1, 1): "III", date(2090, 1, 1): "IV", None: None}
    contracts = spark.createDataFrame([(str(k), k) for k in days], "cpf string, dt_assinatura_contrato date")
    for way in (lifecycle.assign_regime, lifecycle.join_regimes):
        got = {r.dt_assinatura_contrato: r.tipo_regencia for r in way(contracts, regimes).collect()}
        assert got == days
