"""Validation statistics of a scored table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelio.session import shared_folder

#: Ranges that a running sum is cut into, at least; more if the session has more shuffle partitions.
LEAST_RANGES = 64


def running_totals(
    df: DataFrame, value: str, measures: list[str], descending: bool = False
) -> DataFrame:
    """Running sums of `measures` in the order of a distinct `value`.

    A window without partitions would put every value in one task. Here Spark
    deals the rows to ranges of the value, whose bounds it takes from a sample,
    so that the ranges are even however the values are spread. The ranges are
    checkpointed, because other bounds would be drawn if they were computed
    again. Totals of the ranges, one row each, give the sum before each range;
    the windows inside the ranges run in parallel. Adds `run_<measure>` (up to
    and including the row). An unknown value comes first, or last if descending.
    """
    spark = df.sparkSession
    ordered = F.col(value).desc() if descending else F.col(value).asc()
    ranges = max(LEAST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared_folder(spark)
    dealt = df.repartitionByRange(ranges, ordered)
    dealt = dealt.withColumn("__range", F.spark_partition_id()).checkpoint()
    totals = dealt.groupBy("__range").agg(*[F.sum(m).alias(m) for m in measures])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__range",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"__before_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy("__range")
        .orderBy(ordered)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        dealt.repartitionByRange(ranges, "__range")
        .join(F.broadcast(offsets), "__range")
        .withColumns(
            {f"run_{m}": F.sum(m).over(inside) + F.col(f"__before_{m}") for m in measures}
        )
        .drop("__range", *[f"__before_{m}" for m in measures])
    )


def score_counts(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Positives and negatives per distinct score; unknown scores are left out."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(F.col(score).alias("p")).agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
    )


def _with_class_totals(running: DataFrame, counts: DataFrame) -> DataFrame:
    """Add the struct `__all` with all positives (`n1`) and negatives (`n0`)."""
    totals = counts.agg(
        F.struct(F.sum("positives").alias("n1"), F.sum("negatives").alias("n0")).alias("t")
    )
    return running.withColumn("__all", totals.scalar())


def _rate(measure: str, total: str) -> Column:
    return F.try_divide(f"run_{measure}", F.col(f"__all.{total}"))


def roc_curve(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """True and false positive rate at every distinct cut-off.

    The first point has an infinite cut-off and both rates zero.
    """
    counts = score_counts(df, score, label)
    running = running_totals(counts, "p", ["positives", "negatives"], descending=True)
    points = _with_class_totals(running, counts).select(
        F.col("p").alias("cutoff"),
        _rate("positives", "n1").alias("tpr"),
        _rate("negatives", "n0").alias("fpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("cutoff"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")
    )
    return origin.unionByName(points)


def auc(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Area under the ROC curve: pairs ranked rightly, ties counting half."""
    counts = score_counts(df, score, label)
    ranked = running_totals(counts, "p", ["negatives"])
    below = F.col("run_negatives") - F.col("negatives")
    won = F.col("positives") * (below + F.lit(0.5) * F.col("negatives"))
    return ranked.agg(
        F.try_divide(F.sum(won), F.sum("positives") * F.sum("negatives").cast("double")).alias(
            "auc"
        )
    )


def ks_two_sample(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Two-sided two-sample Kolmogorov-Smirnov distance and asymptotic p-value."""
    counts = score_counts(df, score, label)
    running = running_totals(counts, "p", ["positives", "negatives"])
    gap = F.abs(_rate("positives", "n1") - _rate("negatives", "n0"))
    widest = _with_class_totals(running, counts).agg(
        F.sum("positives").alias("n1"), F.sum("negatives").alias("n0"), F.max(gap).alias("d")
    )
    effective = F.col("n1").cast("double") * F.col("n0") / (F.col("n1") + F.col("n0"))
    return widest.withColumn("p_value", kolmogorov_tail(F.sqrt(effective) * F.col("d")))


def kolmogorov_tail(z: Column, terms: int = 100) -> Column:
    """Upper tail of the Kolmogorov distribution, by its alternating series.

    Below 0.2 the tail is 1 to more digits than a double holds.
    """
    steps = F.sequence(F.lit(1), F.lit(terms))
    series = F.aggregate(
        steps,
        F.lit(0.0),
        lambda total, k: total
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        * F.exp(F.lit(-2.0) * k * k * z * z),
    )
    return F.when(z < 0.2, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))
    )


def threshold_class(score: Column, threshold: float = 0.35) -> Column:
    """0 up to the threshold, 1 above; an unknown score stays unknown."""
    return F.when(score <= threshold, 0).when(score > threshold, 1).cast("bigint")


def contingency_table(df: DataFrame, row: str, column: str, levels: list) -> DataFrame:
    """Counts per value of `row` with one column per level of `column`."""
    return (
        df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row)
        .pivot(column, levels)
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def percent_table(df: DataFrame, column: str) -> DataFrame:
    """Share of each known value in percent; the window runs over the counts."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n").alias("t")).select("t").scalar()
    return counts.select(column, (F.lit(100.0) * F.col("n") / total).alias("percent"))


def confusion_counts(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: true and false positives and negatives (positive class 1)."""
    p, a = F.col(predicted), F.col(actual)
    return df.agg(
        F.count_if((p == 1) & (a == 1)).alias("tp"),
        F.count_if((p == 1) & (a == 0)).alias("fp"),
        F.count_if((p == 0) & (a == 1)).alias("fn"),
        F.count_if((p == 0) & (a == 0)).alias("tn"),
    )


def confusion_matrix(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """The four counts and the statistics that follow from them.

    Among them the exact 95 % interval of the accuracy, the probability of as
    many right answers at the no-information rate, and that of McNemar's
    statistic; all are expressions over the one row of counts.
    """
    counts = confusion_counts(df, predicted, actual)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    right = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    recall = F.try_divide(tp, tp + fn)
    specificity = F.try_divide(tn, tn + fp)
    correction = F.greatest(F.abs(fp - fn) - 1, F.lit(0.0))
    chi2 = F.try_divide(correction * correction, fp + fn)
    uninformed = F.try_divide(F.greatest(tp + fn, fp + tn), n)
    low, high = exact_interval(tp + tn, n)
    return counts.select(
        "tp",
        "fp",
        "fn",
        "tn",
        right.alias("accuracy"),
        low.alias("accuracy_lower"),
        high.alias("accuracy_upper"),
        uninformed.alias("no_information_rate"),
        upper_tail(tp + tn, n, uninformed).alias("accuracy_p_value"),
        F.try_divide(right - chance, 1 - chance).alias("kappa"),
        chi2.alias("mcnemar_chi2"),
        normal_tails(F.sqrt(chi2)).alias("mcnemar_p_value"),
        recall.alias("sensitivity"),
        specificity.alias("specificity"),
        F.try_divide(tp, tp + fp).alias("pos_pred_value"),
        F.try_divide(tn, tn + fn).alias("neg_pred_value"),
        F.try_divide(tp + fn, n).alias("prevalence"),
        F.try_divide(tp, n).alias("detection_rate"),
        F.try_divide(tp + fp, n).alias("detection_prevalence"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
    )


def confusion_report(df: DataFrame, predicted: str, actual: str) -> dict[str, float]:
    """The statistics of `confusion_matrix` as a dictionary."""
    return confusion_matrix(df, predicted, actual).first().asDict()


def exact_interval(successes: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Clopper-Pearson interval of a proportion; unknown where there are no trials."""
    tail = (1 - level) / 2
    low = beta_quantile(F.lit(tail), successes, n - successes + 1)
    high = beta_quantile(F.lit(1 - tail), successes + 1, n - successes)
    return (
        F.when(n == 0, None).when(successes == 0, 0.0).otherwise(low),
        F.when(n == 0, None).when(successes == n, 1.0).otherwise(high),
    )


def upper_tail(successes: Column, n: Column, rate: Column) -> Column:
    """Probability of at least so many successes in n trials."""
    return F.when(n == 0, None).when(successes == 0, 1.0).otherwise(
        incomplete_beta(successes, n - successes + 1, rate)
    )


def normal_tails(z: Column) -> Column:
    """Probability that a standard normal value lies at least z from zero.

    For a normal value, the square over two is gamma distributed with shape
    one half; up to z = 2 by the series of that distribution, beyond by its
    continued fraction.
    """
    x = z * z / 2
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(F.lit(2.0).alias("term"), F.lit(2.0).alias("total")),
        lambda s, k: F.struct(
            (s["term"] * x / (k + 0.5)).alias("term"),
            (s["total"] + s["term"] * x / (k + 0.5)).alias("total"),
        ),
    )["total"]
    fraction = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)),
        F.lit(0.0),
        lambda rest, k: k * (k - 0.5) / (x + 2 * k + 0.5 - rest),
    )
    front = F.exp(-x) * F.sqrt(x) / math.sqrt(math.pi)
    return F.when(x < 2, 1 - front * series).otherwise(front / (x + 0.5 - fraction))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number, by Stirling's series from x + 8 on."""
    y = x + 8
    # The first terms of Stirling's series.
    terms = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
    series = sum(
        (F.lit(c) / F.pow(y, F.lit(2.0 * k + 1)) for k, c in enumerate(terms)), F.lit(0.0)
    )
    steps = sum((F.ln(x + k) for k in range(8)), F.lit(0.0))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function, by its continued fraction.

    The fraction converges within a few times the square root of the parameters
    where x is below (a + 1) / (a + b + 2); beyond, the mirrored function is taken.
    It is evaluated from its end, so that no step divides by nothing.
    """
    a, b, x = (c.cast("double") for c in (a, b, x))
    mirrored = x > (a + 1) / (a + b + 2)
    given = F.struct(
        F.when(mirrored, b).otherwise(a).alias("a"),
        F.when(mirrored, a).otherwise(b).alias("b"),
        F.when(mirrored, 1 - x).otherwise(x).alias("x"),
    )
    # One pass over a list of one keeps the parameters from being computed again at every step.
    value = F.transform(F.array(given), lambda p: _beta_below(p["a"], p["b"], p["x"]))[0]
    inside = F.when(mirrored, 1 - value).otherwise(value)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def _beta_below(a: Column, b: Column, x: Column) -> Column:
    depth = (F.lit(40) + 4 * F.sqrt(F.greatest(a, b))).cast("int")

    def step(rest: Column, m: Column) -> Column:
        # Two terms for each m, the odd one innermost.
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return even / (1 + odd / (1 + rest))

    tail = F.aggregate(F.sequence(depth, F.lit(1), F.lit(-1)), F.lit(0.0), step)
    first = -(a + b) * x / (a + 1)
    front = log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x)
    return F.exp(front) / a / (1 + first / (1 + tail))


def beta_quantile(probability: Column, a: Column, b: Column) -> Column:
    """Where the regularised incomplete beta function has this value, by bisection."""

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        below = incomplete_beta(a, b, middle) < probability
        return F.struct(
            F.when(below, middle).otherwise(s["low"]).alias("low"),
            F.when(below, s["high"]).otherwise(middle).alias("high"),
        )

    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(56)),
        F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")),
        halve,
    )
    return (found["low"] + found["high"]) / 2
