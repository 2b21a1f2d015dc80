"""Validation statistics, samples and the model, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelio.operators import metrics, model, sampling


def scored_rows(n, seed, skew=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = 0.5 if skew and rng.random() < 0.34 else rng.random() ** (9 if skew else 1)
        rows.append((i, int(rng.random() < 0.3 + 0.4 * p), p if rng.random() < 0.95 else None))
    return rows


@pytest.fixture(scope="module", params=[False, True])
def scored(request, spark):
    rows = scored_rows(3000, 5, request.param)
    return spark.createDataFrame(rows, "id int, y int, p double").cache(), rows


def split(rows):
    known = [(y, p) for _, y, p in rows if p is not None]
    return [p for y, p in known if y == 1], [p for y, p in known if y == 0]


def test_running_totals(spark, scored):
    df, rows = scored
    counts = metrics.score_counts(df)
    for descending in (False, True):
        got = metrics.running_totals(counts, "p", ["positives", "negatives"], descending)
        total = {"positives": 0, "negatives": 0}
        for r in sorted(got.collect(), key=lambda r: r.p, reverse=descending):
            for m in total:
                total[m] += r[m]
                assert r[f"run_{m}"] == total[m]
        assert sum(total.values()) == sum(p is not None for _, _, p in rows)


def test_auc_and_ks(scored):
    df, rows = scored
    ones, zeros = split(rows)
    won = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    assert metrics.auc(df).first().auc == pytest.approx(won / len(ones) / len(zeros))
    gap = max(
        abs(sum(a <= c for a in ones) / len(ones) - sum(b <= c for b in zeros) / len(zeros))
        for c in set(ones + zeros)
    )
    got = metrics.ks_two_sample(df).first()
    assert (got.n1, got.n0) == (len(ones), len(zeros))
    assert got.d == pytest.approx(gap)
    assert 0 <= got.p_value < 1e-6


def test_roc_ends(scored):
    df, _ = scored
    points = sorted(metrics.roc_curve(df).collect(), key=lambda r: -r.cutoff)
    assert math.isinf(points[0].cutoff) and (points[0].tpr, points[0].fpr) == (0, 0)
    assert (points[-1].tpr, points[-1].fpr) == (1, 1)
    assert all(a.tpr <= b.tpr and a.fpr <= b.fpr for a, b in zip(points, points[1:]))


def test_one_score_only(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y int, p double")
    assert metrics.auc(df).first().auc == 0.5
    assert metrics.ks_two_sample(df).first().d == 0.0
    assert metrics.ks_two_sample(df).first().p_value == 1.0


def test_kolmogorov_tail(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (1.0,), (1.36,), (3.0,)], "z double")
    got = [r.t for r in df.select(metrics.kolmogorov_tail(F.col("z")).alias("t")).collect()]
    known = [1.0, 0.9639452436, 0.2699996717, 0.0494858, 3.045996e-08]
    assert got == pytest.approx(known, rel=1e-5)


def test_threshold_edges(spark):
    df = spark.createDataFrame([(0.35,), (0.3500001,), (None,)], "p double")
    got = [r.c for r in df.select(metrics.threshold_class(F.col("p")).alias("c")).collect()]
    assert got == [0, 1, None]


def test_confusion_report(spark):
    cells = [(1, 1, 40), (1, 0, 10), (0, 1, 20), (0, 0, 30)]
    rows = [(p, a) for p, a, n in cells for _ in range(n)]
    report = metrics.confusion_report(spark.createDataFrame(rows, "p int, a int"), "p", "a")
    assert (report["tp"], report["fp"], report["fn"], report["tn"]) == (40, 10, 20, 30)
    assert report["accuracy"] == 0.7
    assert report["kappa"] == pytest.approx(0.4)
    assert report["no_information_rate"] == 0.6
    assert report["sensitivity"] == pytest.approx(2 / 3)
    assert report["balanced_accuracy"] == pytest.approx((2 / 3 + 0.75) / 2)
    assert report["mcnemar_chi2"] == pytest.approx(81 / 30)
    assert report["mcnemar_p_value"] == pytest.approx(0.1003482, rel=1e-5)
    tail = sum(math.comb(100, k) * 0.6**k * 0.4 ** (100 - k) for k in range(70, 101))
    assert report["accuracy_p_value"] == pytest.approx(tail, rel=1e-9)


def test_exact_interval(spark):
    rows = [(7, 10), (0, 10), (10, 10), (600_000_000, 1_000_000_000), (0, 0), (70_000, 100_000)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i int, x long, n long")
    low, high = metrics.exact_interval(F.col("x"), F.col("n"))
    found = {r.i: (r.low, r.high) for r in df.select("i", low.alias("low"), high.alias("high")).collect()}
    assert found[0] == pytest.approx((0.3475471, 0.9332605), abs=1e-6)
    assert found[1] == pytest.approx((0.0, 0.3084971), abs=1e-6)
    assert found[2][1] == 1.0 and found[4] == (None, None)
    assert found[3][0] < 0.6 < found[3][1] and found[3][1] - found[3][0] < 1e-4
    assert found[5] == pytest.approx((0.6971486, 0.7028400), abs=2e-5)


def test_tails_against_sums(spark):
    rng = random.Random(1)
    rows = [(x, n, rng.random()) for n in (1, 3, 20, 400) for x in {0, 1, n // 3, n - 1, n}]
    rows += [(5, 10, 0.0), (5, 10, 1.0)]
    df = spark.createDataFrame(rows, "x int, n int, p double")
    got = df.select("x", "n", "p", metrics.upper_tail(F.col("x"), F.col("n"), F.col("p")).alias("t")).collect()
    for r in got:
        want = sum(math.comb(r.n, k) * r.p**k * (1 - r.p) ** (r.n - k) for k in range(r.x, r.n + 1))
        assert r.t == pytest.approx(want, rel=1e-10, abs=1e-13)
    z = spark.createDataFrame([(x / 10,) for x in range(0, 90)], "z double")
    for r in z.select("z", metrics.normal_tails(F.col("z")).alias("t")).collect():
        assert r.t == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-11)


def test_statistics_of_one_class_and_of_nothing(spark):
    none = spark.createDataFrame([], "p int, a int")
    report = metrics.confusion_report(none, "p", "a")
    assert report["tp"] == 0 and report["accuracy_lower"] is report["mcnemar_p_value"] is report["accuracy_p_value"] is None
    right = metrics.confusion_report(spark.createDataFrame([(1, 1)] * 5, "p int, a int"), "p", "a")
    assert right["accuracy_upper"] == 1.0 and right["accuracy_p_value"] == 1.0 and right["mcnemar_p_value"] is None


def test_ranges_are_even_for_values_of_many_powers_of_ten(spark):
    """Values over 300 powers of ten: a cut into parts of equal width would put all but a few in one."""
    df = spark.range(20000).select(F.pow(F.lit(10.0), F.rand(3) * -300).alias("v"), F.lit(1).alias("one"))
    df = df.groupBy("v").agg(F.sum("one").alias("one"))
    for descending in (False, True):
        running = metrics.running_totals(df, "v", ["one"], descending)
        tasks = [r["count"] for r in running.groupBy(F.spark_partition_id()).count().collect()]
        assert max(tasks) <= 0.05 * sum(tasks)
        order = sorted(running.collect(), key=lambda r: r.v, reverse=descending)
        assert [r.run_one for r in order] == list(range(1, len(order) + 1))


def test_percent_table(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    got = {r.x: r.percent for r in metrics.percent_table(df, "x").collect()}
    assert got == pytest.approx({"a": 200 / 3, "b": 100 / 3})


# Samples --------------------------------------------------------------------


def test_dense_index_numbers_every_row(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    for partitions in (1, 7):
        got = sampling.with_dense_index(df.repartition(partitions), "k").collect()
        assert sorted(r.row_index for r in got) == list(range(1, 5001))
        if partitions == 1:
            reference = {r.k: r.row_index for r in got}
        else:
            assert {r.k: r.row_index for r in got} == reference


def test_split_is_exact_and_disjoint(spark):
    df = spark.range(1013).withColumnRenamed("id", "k")
    marked = sampling.mark_test_rows(df, "k", 30)
    assert marked.count() == 1013
    assert marked.filter("is_test").count() == 303
    rest = sampling.complement(df, marked.filter("is_test"), "k")
    assert rest.count() == 710


def test_bootstrap_draws_with_replacement(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    got = sampling.bootstrap_sample(df, "k", 4000).collect()
    assert sorted(r.draw for r in got) == list(range(1, 4001))
    assert len({r.k for r in got}) == 50
    again = {r.draw: r.k for r in sampling.bootstrap_sample(df, "k", 4000).collect()}
    assert {r.draw: r.k for r in got} == again
    other = {r.draw: r.k for r in sampling.bootstrap_sample(df, "k", 4000, seed=7).collect()}
    assert again != other


# Model ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def signal(spark):
    rng = random.Random(3)
    effect = {"a": 0.0, "b": 1.0, "c": -1.0}
    rows = []
    for _ in range(20000):
        x, z, noise = rng.choice("abc"), rng.choice(["p_1", "q"]), rng.choice("uv")
        odds = -0.5 + effect[x] + (0.8 if z == "q" else 0.0)
        rows.append((x, z, noise, int(rng.random() < 1 / (1 + math.exp(-odds)))))
    rows += [(None, "q", "u", 1), ("a", "q", "u", None)]
    return spark.createDataFrame(rows, "x string, x_z string, noise string, y int").cache()


PREDICTORS = ["x", "x_z", "noise"]


@pytest.fixture(scope="module")
def frame(signal):
    return model.combinations(signal, "y", PREDICTORS)


def test_combinations_are_few(frame):
    assert frame.count() == 12
    assert frame.agg(F.sum(model.WEIGHT)).first()[0] == 20000


def test_fit_recovers_the_signal(spark, frame):
    fitted = model.fit(frame, PREDICTORS)
    assert fitted.terms() == [("x", "c"), ("x", "b"), ("x_z", "q"), ("noise", "v")]
    effects = fitted.effects()
    assert effects["x", "b"] == pytest.approx(1.0, abs=0.12)
    assert effects["x", "c"] == pytest.approx(-1.0, abs=0.12)
    assert effects["x_z", "q"] == pytest.approx(0.8, abs=0.12)
    assert effects["x", "a"] == 0.0
    table = {r.term: r for r in model.coefficient_table(spark, fitted).collect()}
    assert table["xb"].importance > 10 > table["noisev"].importance
    assert 0.02 < table["xb"].std_error < 0.05


def test_fit_equals_a_fit_on_single_contracts(signal, frame):
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    single = RFormula(
        formula="y ~ x + x_z + noise", stringIndexerOrderType="alphabetDesc"
    )
    rows = signal.na.drop()
    encoded = single.fit(rows).transform(rows)
    direct = GeneralizedLinearRegression(family="binomial").fit(encoded)
    fitted = model.fit(frame, PREDICTORS)
    ours = fitted.pipeline.stages[-1]
    assert list(ours.coefficients) == pytest.approx(list(direct.coefficients), abs=1e-6)
    assert fitted.aic == pytest.approx(direct.summary.aic, abs=1e-6)
    assert list(ours.summary.coefficientStandardErrors) == pytest.approx(
        list(direct.summary.coefficientStandardErrors), rel=1e-6
    )


def test_backward_selection_drops_noise(frame):
    chosen, steps = model.backward_aic(frame, PREDICTORS)
    aics = [aic for _, _, aic in steps]
    assert aics == sorted(aics, reverse=True)
    assert set(chosen.predictors) >= {"x", "x_z"}
    assert chosen.aic == pytest.approx(aics[-1], abs=1e-6)


def test_scores_keep_every_row(spark, signal, frame, tmp_path):
    fitted = model.fit(frame, PREDICTORS)
    fitted.save(spark, str(tmp_path / "model"))
    stored = model.FittedModel.load(spark, str(tmp_path / "model"))
    assert stored.effects() == fitted.effects()
    unseen = signal.limit(1).withColumn("x", F.lit("never"))
    scored = model.score_contracts(signal.unionByName(unseen), stored)
    assert scored.count() == signal.count() + 1
    assert scored.filter("score IS NULL").count() == 2
    by_model = fitted.pipeline.transform(signal.na.drop(subset=PREDICTORS))
    by_column = model.score_contracts(by_model, stored)
    gap = by_column.agg(F.max(F.abs(F.col("score") - F.col(model.PREDICTION)))).first()[0]
    assert gap < 1e-12


def test_single_level_predictor_is_left_out(spark, signal):
    constant = signal.withColumn("one", F.lit("k"))
    frame = model.combinations(constant, "y", ["x", "one"])
    assert model.fit(frame, ["x", "one"]).predictors == ("x",)


@pytest.fixture(scope="module")
def copied(signal):
    """The signal with a copy of a predictor, one coarser than another, and a level of its own."""
    return signal.withColumns({
        "x_copy": F.translate("x", "abc", "klm"),
        "x_is_b": F.when(F.col("x") == "b", "yes").when(F.col("x").isNotNull(), "no"),
        "joint": F.when((F.col("x") == "c") & (F.col("noise") == "v"), "both").when(F.col("x").isNotNull(), "other"),
    })


def test_dependent_columns_have_no_estimate(spark, copied, frame):
    names = [*PREDICTORS, "x_copy", "x_is_b"]
    fitted = model.fit_logit(copied, "y", names)
    plain = model.fit(frame, PREDICTORS)
    assert fitted.aliased == {("x_copy", "l"), ("x_copy", "m"), ("x_is_b", "yes")}
    assert fitted.inference.rank == plain.inference.rank == 5
    assert fitted.aic == pytest.approx(plain.aic, abs=1e-6)
    table, want = ({r.term: r for r in model.coefficient_table(spark, f).collect()} for f in (fitted, plain))
    assert set(table) - set(want) == {"x_copyl", "x_copym", "x_is_byes"}
    for term, row in table.items():
        if term in want:
            assert tuple(row)[1:] == pytest.approx(tuple(want[term])[1:], rel=1e-6, abs=1e-9)
            assert row.std_error > 0
        else:
            assert set(tuple(row)[1:]) == {None}
    scored = model.score_contracts(model.score_contracts(copied, fitted), plain, "plain")
    assert scored.agg(F.max(F.abs(F.col("score") - F.col("plain")))).first()[0] < 1e-9


def test_first_of_two_copies_keeps_its_estimate(copied):
    fitted = model.fit_logit(copied, "y", ["x_is_b", "x", "joint"])
    # In model order x's level b repeats x_is_b; c is left.
    assert fitted.aliased == {("x", "b")}


def test_selection_ignores_a_copy(copied, frame):
    chosen, steps = model.backward_aic(frame, PREDICTORS)
    with_copy = model.combinations(copied, "y", [*PREDICTORS, "x_copy"])
    again, more = model.backward_aic(with_copy, [*PREDICTORS, "x_copy"])
    assert again.predictors == chosen.predictors
    assert [d for _, d, _ in more] == [d for _, d, _ in steps]
    assert [a for *_, a in more] == pytest.approx([a for *_, a in steps], abs=1e-6)


def test_standard_errors_are_those_of_the_regression(spark, frame):
    fitted = model.fit(frame, PREDICTORS)
    ours = {r.term: r for r in model.coefficient_table(spark, fitted).collect()}
    summary = fitted.pipeline.stages[-1].summary
    terms = [p + v for p, v in [*fitted.terms(), (model.INTERCEPT, "")]]
    for term, error, z, p in zip(terms, summary.coefficientStandardErrors, summary.tValues, summary.pValues):
        assert ours[term].std_error == pytest.approx(error, rel=1e-6)
        assert ours[term].z_value == pytest.approx(z, rel=1e-6)
        assert ours[term].p_value == pytest.approx(p, rel=1e-4, abs=1e-12)


def test_saved_model_keeps_its_inference(spark, copied, tmp_path):
    fitted = model.fit_logit(copied, "y", [*PREDICTORS, "x_copy"])
    fitted.save(spark, str(tmp_path / "m"))
    stored = model.FittedModel.load(spark, str(tmp_path / "m"))
    assert model.coefficient_table(spark, stored).collect() == model.coefficient_table(spark, fitted).collect()
    assert (stored.aic, stored.aliased, stored.levels) == (fitted.aic, fitted.aliased, fitted.levels)
    known = stored.inference
    assert (known.covariance == fitted.inference.covariance).all() and known.rank == 5
    assert (known.contracts, known.deviance) == (20000, fitted.inference.deviance)
    path = f"{tmp_path}/m/inference"
    spark.read.parquet(path).withColumn("version", F.lit(99)).write.parquet(f"{tmp_path}/other/inference")
    for part in ("pipeline", "levels"):
        (tmp_path / "other" / part).symlink_to(tmp_path / "m" / part)
    with pytest.raises(ValueError, match="layout 99"):
        model.FittedModel.load(spark, str(tmp_path / "other"))


def test_scores_add_up_to_the_defaults_of_each_level(copied):
    names = [*PREDICTORS, "x_copy", "joint"]
    rows = model.combinations(copied.withColumn("one", F.lit("k")), "y", [*names, "one"])
    fitted = model.fit(rows, names)
    observed = {}
    for p in [*names, "one"]:
        for r in rows.groupBy(p).agg(F.sum(model.WEIGHT), F.sum(model.POSITIVES)).collect():
            observed[p, r[0]] = (r[1], r[2])
    got = {(r.predictor, r.level): (r.contracts, round(r.score_sum, 3)) for r in model.score_balance(rows, fitted, [*names, "one"]).collect()}
    assert got == observed
    # The sums tell a wrong coefficient: a ten-thousandth is enough.
    effect = model.FittedModel.effects
    other = type("Shifted", (model.FittedModel,), {"effects": lambda self: {k: v + 1e-4 * (k == ("x", "b")) for k, v in effect(self).items()}})
    shifted = other(fitted.predictors, fitted.levels, fitted.pipeline, fitted.aic, fitted.aliased)
    off = {(r.predictor, r.level): round(r.score_sum, 3) for r in model.score_balance(rows, shifted, names).collect()}
    assert off["x", "b"] != observed["x", "b"][1]


def test_independent_columns_of_random_indicators():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        x = np.hstack([np.ones((40, 1)), rng.integers(0, 2, (40, 6)).astype(float)])
        for _ in range(rng.integers(0, 4)):
            extra = x @ rng.integers(-1, 2, x.shape[1])
            x = np.insert(x, rng.integers(1, x.shape[1] + 1), extra, axis=1)
        ranks = [0, *(np.linalg.matrix_rank(x[:, : k + 1]) for k in range(x.shape[1]))]
        want = [k for k in range(x.shape[1]) if ranks[k + 1] > ranks[k]]
        assert model.independent_columns(x.T @ x) == want


def test_whole_credit_flow(spark, sf_dir, signal):
    from parcelio.plans import catalog, credit, provisioning, views

    keyed = signal.withColumn("id", F.monotonically_increasing_id())
    path = f"{spark.conf.get('spark.checkpoint.dir')}/signal"
    keyed.write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    for draws, rows in ((None, 6000), (1000, 300)):
        marked = credit.split_sample(table, "id", draws)
        result = credit.train_and_validate(marked, PREDICTORS, "y", cut_off=0.5)
        assert result.scored.count() == rows
        assert 0.62 < result.auc().first().auc < 0.85
        report = result.confusion_report()
        assert report["accuracy_lower"] < report["accuracy"] < report["accuracy_upper"]
        assert result.ks_two_sample().first().p_value < 0.01
        assert sum(r.percent for r in result.shares().collect()) == pytest.approx(100)
    fitted = model.fit_logit(catalog._model_table(spark, sf_dir), "resposta", ["ufies_cat"])
    scores = credit.payer_scores(
        model.score_contracts(catalog._model_table(spark, sf_dir), fitted)
    )
    totals = provisioning.provision_all(
        views.contracts(spark, sf_dir), scores, views.regimes(spark)
    )
    assert totals.count() == 26
