"""Logistic default model: fit, backward selection, coefficients and scoring.

All predictors are categorical, so the contracts are first reduced to the
distinct combinations of predictor values, each with its number of contracts
and its share of defaults. A weighted fit on the combinations has the same
coefficients, standard errors and likelihood as a fit on the contracts, and
the large table is read only once.

Indicator columns may depend on each other (a predictor that copies another, a
level that only occurs with one of another predictor). A Cholesky factorisation
of the columns' cross-product, with the columns in model order as pivots, finds
those that earlier ones determine; they are aliased and left out of the fit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelio.session import shared_folder

WEIGHT = "n_contracts"
POSITIVES = "n_defaults"
RATE = "default_rate"
FEATURES = "fit_features"
PREDICTION = "fit_probability"
INTERCEPT = "(Intercept)"


#: Share of a column's own square below which what earlier columns leave of it counts as nothing.
TOLERANCE = 1e-11
#: Layout of a saved model's inference table.
VERSION = 1
_SAVED = (
    "version int, aic double, deviance double, contracts double, defaults double, "
    "terms array<struct<predictor:string,level:string,estimate:double,covariance:array<double>>>"
)

Term = tuple[str, str]


@dataclass(frozen=True)
class Inference:
    """What is known of a fit beside its effects.

    `terms` are those with an estimate, the intercept first, `covariance` the
    matrix over them; `contracts` and `defaults` are the sizes of the sample.
    """

    terms: tuple[Term, ...]
    estimates: np.ndarray
    covariance: np.ndarray
    deviance: float
    contracts: float
    defaults: float

    @property
    def rank(self) -> int:
        return len(self.terms)


@dataclass(frozen=True)
class FittedModel:
    """A fitted logistic model.

    `levels` lists the levels of each predictor, the reference level first;
    `aic` is that of the fit on single contracts, with the rank of the model as
    number of parameters. `aliased` terms depend on earlier ones: they have no
    estimate and don't count.
    """

    predictors: tuple[str, ...]
    levels: dict[str, list[str]]
    pipeline: PipelineModel
    aic: float | None = None
    aliased: frozenset[Term] = frozenset()
    inference: Inference | None = field(default=None, compare=False)

    def terms(self) -> list[Term]:
        """(predictor, level) of each level but the reference, aliased ones included."""
        return [(p, v) for p in self.predictors for v in reversed(self.levels[p][1:])]

    def effects(self) -> dict[Term, float]:
        """Effect of each level on the log-odds; zero for reference levels and aliased terms."""
        zero = {(p, self.levels[p][0]): 0.0 for p in self.predictors}
        kept = [t for t in self.terms() if t not in self.aliased]
        fitted = self.pipeline.stages[-1].coefficients.toArray().tolist()
        return {**zero, **dict.fromkeys(self.terms(), 0.0), **dict(zip(kept, fitted))}

    @property
    def intercept(self) -> float:
        return float(self.pipeline.stages[-1].intercept)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the pipeline, the levels and the inference below `path`."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        rows = [
            (i, p, k, v, (p, v) in self.aliased)
            for i, p in enumerate(self.predictors)
            for k, v in enumerate(self.levels[p])
        ]
        layout = "position int, predictor string, place int, level string, aliased boolean"
        spark.createDataFrame(rows, layout).write.mode("overwrite").parquet(f"{path}/levels")
        known = self.inference
        terms = [
            (p, v, float(b), row.tolist())
            for (p, v), b, row in zip(known.terms, known.estimates, known.covariance)
        ]
        sizes = (float(known.deviance), float(known.contracts), float(known.defaults))
        spark.createDataFrame([(VERSION, self.aic, *sizes, terms)], _SAVED).write.mode(
            "overwrite"
        ).parquet(f"{path}/inference")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedModel:
        pipeline = PipelineModel.load(f"{path}/pipeline")
        rows = spark.read.parquet(f"{path}/levels").orderBy("position", "place").collect()
        levels: dict[str, list[str]] = {}
        for row in rows:
            levels.setdefault(row["predictor"], []).append(row["level"])
        aliased = frozenset((r["predictor"], r["level"]) for r in rows if r["aliased"])
        one = spark.read.parquet(f"{path}/inference").first()
        if one["version"] != VERSION:
            raise ValueError(f"{path} has a model of layout {one['version']}, not {VERSION}")
        known = Inference(
            tuple((t["predictor"], t["level"]) for t in one["terms"]),
            np.array([t["estimate"] for t in one["terms"]]),
            np.array([t["covariance"] for t in one["terms"]]),
            one["deviance"],
            one["contracts"],
            one["defaults"],
        )
        return cls(tuple(levels), levels, pipeline, one["aic"], aliased, known)


def combinations(df: DataFrame, response: str, predictors: Sequence[str]) -> DataFrame:
    """Distinct predictor values with their contracts and defaults.

    Rows with an unknown predictor or response are left out, for all predictors
    at once, so that models on fewer predictors see the same rows. The result
    is checkpointed: it is small and every fit reads it again.
    """
    named = [response, *predictors]
    counted = (
        df.select(*named)
        .na.drop(subset=named)
        .groupBy(*predictors)
        .agg(
            F.count(F.lit(1)).cast("double").alias(WEIGHT),
            F.sum(F.col(response).cast("double")).alias(POSITIVES),
        )
    )
    shared_folder(df.sparkSession)
    return counted.checkpoint()


def merge(frame: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Combinations of fewer predictors, from those of more."""
    return (
        frame.groupBy(*predictors)
        .agg(F.sum(WEIGHT).alias(WEIGHT), F.sum(POSITIVES).alias(POSITIVES))
        .withColumn(RATE, F.col(POSITIVES) / F.col(WEIGHT))
    )


def _encoder(predictors: Sequence[str]) -> Pipeline:
    """Indicator columns of every level but the alphabetically first."""
    indexed = [f"{p}_index" for p in predictors]
    coded = [f"{p}_code" for p in predictors]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=list(predictors), outputCols=indexed, stringOrderType="alphabetDesc"
            ),
            OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True),
            VectorAssembler(inputCols=coded, outputCol=FEATURES),
        ]
    )


def _regression(features: str = FEATURES, tol: float = 1e-6) -> GeneralizedLinearRegression:
    return GeneralizedLinearRegression(
        family="binomial",
        link="logit",
        featuresCol=features,
        weightCol=WEIGHT,
        labelCol=RATE,
        predictionCol=PREDICTION,
        tol=tol,
    )


def _columns(levels: dict[str, list[str]]) -> list[Term]:
    """The model's columns in order: the intercept, then each predictor's levels but the first."""
    return [(INTERCEPT, ""), *[(p, v) for p in levels for v in levels[p][1:]]]


def cross_product(frame: DataFrame, levels: dict[str, list[str]], weight: str) -> np.ndarray:
    """The weighted cross-product of the intercept and the indicator columns, in model order.

    An entry is the weight of the rows that have both levels, so all of them
    come from one grouped sum over pairs of predictors. It is combined before
    the shuffle, and its size depends on the number of levels alone.
    """
    names = list(levels)
    place = {term: k for k, term in enumerate(_columns(levels))}
    product = np.zeros((len(place), len(place)))
    product[0, 0] = frame.agg(F.sum(weight)).first()[0] or 0.0
    if not names:
        return product
    pairs = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(p).alias("a"), F.col(q).alias("b"))
        for i, p in enumerate(names)
        for j, q in enumerate(names[: i + 1])
    ]
    summed = (
        frame.select(F.explode(F.array(*pairs)).alias("pair"), weight)
        .groupBy("pair.i", "pair.j", "pair.a", "pair.b")
        .agg(F.sum(weight).alias("total"))
    )
    for i, j, a, b, total in summed.collect():
        row, column = place.get((names[i], a)), place.get((names[j], b))
        if row is not None and column is not None:
            product[row, column] = product[column, row] = total
            if i == j:
                product[0, row] = product[row, 0] = total
    return product


def independent_columns(product: np.ndarray) -> list[int]:
    """The columns that don't depend on earlier ones, from a cross-product.

    Each column in turn is a pivot of a Cholesky factorisation, unless what the
    pivots so far leave of it is nothing.
    """
    left, own = product.astype(float).copy(), np.diag(product).copy()
    kept = []
    for k in range(len(left)):
        if left[k, k] > TOLERANCE * own[k]:
            kept.append(k)
            left -= np.outer(left[:, k], left[k]) / left[k, k]
    return kept


def _varying(frame: DataFrame, predictors: Sequence[str]) -> list[str]:
    """Predictors with at least two levels; the others carry no information."""
    levels = frame.agg(*[F.count_distinct(p).alias(p) for p in predictors]).first()
    return [p for p in predictors if levels[p] > 1]


def _saturated(frame: DataFrame) -> float:
    """Log-likelihood of single contracts if each combination had its own rate.

    The deviance of a fit on combinations is measured against this value.
    """
    negatives = F.col(WEIGHT) - F.col(POSITIVES)
    hits = F.when(F.col(POSITIVES) > 0, F.col(POSITIVES) * F.ln(RATE)).otherwise(0.0)
    misses = F.when(negatives > 0, negatives * F.ln(1 - F.col(RATE))).otherwise(0.0)
    return frame.agg(F.sum(hits + misses)).first()[0]


def _aic(deviance: float, saturated: float, rank: int) -> float:
    return deviance - 2 * saturated + 2 * rank


def fit(frame: DataFrame, predictors: Sequence[str]) -> FittedModel:
    """Fit on a table of combinations.

    The first level of each predictor, in alphabetical order, is the reference
    level. A predictor with one level is left out; a term that earlier ones
    determine is aliased.
    """
    used = _varying(frame, predictors)
    merged = merge(frame, used).cache()
    encoder = _encoder(used).fit(merged)
    labels = encoder.stages[0].labelsArray
    levels = {p: list(reversed(names)) for p, names in zip(used, labels)}
    columns = _columns(levels)
    kept = independent_columns(cross_product(merged, levels, WEIGHT))
    aliased = frozenset(columns) - {columns[k] for k in kept}
    stages = list(encoder.stages)
    features = FEATURES
    if aliased:
        encoded = [(p, v) for p in used for v in reversed(levels[p][1:])]
        indices = [i for i, term in enumerate(encoded) if term not in aliased]
        features = f"{FEATURES}_kept"
        stages.append(VectorSlicer(inputCol=FEATURES, outputCol=features, indices=indices))
    prepared = PipelineModel(stages).transform(merged)
    regression = _regression(features, tol=1e-10).fit(prepared)
    deviance = regression.summary.deviance
    aic = _aic(deviance, _saturated(merged), len(kept))
    plain = FittedModel(tuple(used), levels, PipelineModel([*stages, regression]), aic, aliased)
    known = _inference(plain, merged, columns, kept, deviance)
    merged.unpersist()
    return FittedModel(plain.predictors, levels, plain.pipeline, aic, aliased, known)


def _inference(
    fitted: FittedModel, merged: DataFrame, columns: list[Term], kept: list[int], deviance: float
) -> Inference:
    """Covariance of the estimates: the inverse of the information at the fit."""
    rate = score_column(fitted)
    informed = merged.withColumn("information", F.col(WEIGHT) * rate * (1 - rate))
    information = cross_product(informed, fitted.levels, "information")[np.ix_(kept, kept)]
    effects = {**fitted.effects(), (INTERCEPT, ""): fitted.intercept}
    sizes = merged.agg(F.sum(WEIGHT), F.sum(POSITIVES)).first()
    return Inference(
        tuple(columns[k] for k in kept),
        np.array([effects[columns[k]] for k in kept]),
        np.linalg.inv(information),
        deviance,
        *sizes,
    )


def fit_logit(df: DataFrame, response: str, predictors: Sequence[str]) -> FittedModel:
    """Fit on a table of contracts."""
    return fit(combinations(df, response, predictors), predictors)


def backward_aic(
    frame: DataFrame, predictors: Sequence[str], parallelism: int = 8
) -> tuple[FittedModel, list[tuple[int, str, float]]]:
    """Drop predictors one at a time while the AIC falls.

    The combinations are encoded once; a candidate is a fit on the independent
    indicator columns of its own predictors, which its part of one cross-product
    tells. The candidates of one step are fitted at the same time. A predictor
    that earlier ones determine is left out from the start; one without which
    the rank stays the same is no candidate. Returns the chosen model and the
    accepted steps (number, dropped predictor, AIC).
    """
    used = _varying(frame, predictors)
    merged = merge(frame, used).cache()
    encoder = _encoder(used).fit(merged)
    encoded = encoder.transform(merged).select(FEATURES, WEIGHT, POSITIVES, RATE)
    # Many short jobs follow: one task per fifty thousand combinations is enough.
    encoded = encoded.coalesce(1 + merged.count() // 50_000).cache()
    saturated = _saturated(encoded)
    levels = {p: list(reversed(names)) for p, names in zip(used, encoder.stages[0].labelsArray)}
    columns = _columns(levels)
    product = cross_product(merged, levels, WEIGHT)
    slot = {t: i for i, t in enumerate((p, v) for p in used for v in reversed(levels[p][1:]))}

    def independent(chosen: Sequence[str]) -> list[Term]:
        own = [k for k, (p, _) in enumerate(columns) if p in (INTERCEPT, *chosen)]
        return [columns[own[k]] for k in independent_columns(product[np.ix_(own, own)])]

    def aic_of(terms: list[Term]) -> float:
        indices = sorted(slot[t] for t in terms if t in slot)
        sliced = VectorSlicer(inputCol=FEATURES, outputCol="slice", indices=indices)
        fitted = _regression("slice").fit(sliced.transform(encoded))
        return _aic(fitted.summary.deviance, saturated, len(terms))

    def candidate(dropped: str) -> tuple[float, str]:
        terms = independent([p for p in current if p != dropped])
        return (math.inf if len(terms) == rank else aic_of(terms)), dropped

    first = independent(used)
    current = [p for p in used if any(p == q for q, _ in first)]
    rank, best_aic = len(first), aic_of(first)
    steps = [(0, "", best_aic)]
    with ThreadPoolExecutor(parallelism) as pool:
        while len(current) > 1:
            aic, dropped = min(pool.map(candidate, current))
            if aic >= best_aic:
                break
            best_aic = aic
            current = [p for p in current if p != dropped]
            rank = len(independent(current))
            steps.append((len(steps), dropped, aic))
    encoded.unpersist()
    merged.unpersist()
    return fit(frame, current), steps


def coefficient_table(spark: SparkSession, model: FittedModel) -> DataFrame:
    """Estimate, standard error, z and p value of each term, and its importance.

    The importance of a term is the absolute z value. Aliased terms have none of
    them. A saved and loaded model gives the same table.
    """
    known = model.inference
    errors = np.sqrt(np.diag(known.covariance))
    of = {t: (float(b), float(e)) for t, b, e in zip(known.terms, known.estimates, errors)}
    rows = []
    for p, v in [*model.terms(), (INTERCEPT, "")]:
        if (p, v) in of:
            estimate, error = of[p, v]
            z = estimate / error
            rows.append((p + v, estimate, error, z, math.erfc(abs(z) / math.sqrt(2)), abs(z)))
        else:
            rows.append((p + v, None, None, None, None, None))
    return spark.createDataFrame(
        rows,
        "term string, estimate double, std_error double, z_value double, p_value double, "
        "importance double",
    )


def score_balance(frame: DataFrame, model: FittedModel, predictors: Sequence[str]) -> DataFrame:
    """`predictor`, `level`, `contracts`, `score_sum`: the scores of the fit's own contracts, added up by level.

    By the likelihood equations of a logistic fit, they add up to the number of
    defaults within every level of every predictor, those included that the fit
    left out for having one level or for being aliased.
    """
    scored = frame.withColumn("score", score_column(model))
    each = F.explode(
        F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).alias("level")) for p in predictors])
    )
    return (
        scored.select(each.alias("of"), WEIGHT, (F.col("score") * F.col(WEIGHT)).alias("scores"))
        .groupBy("of.predictor", "of.level")
        .agg(F.sum(WEIGHT).cast("bigint").alias("contracts"), F.sum("scores").alias("score_sum"))
    )


def score_column(model: FittedModel) -> Column:
    """Probability of default as a plain column expression.

    A missing value, or a level the model has not seen, gives an unknown score.
    Every row is kept, and no join or user function is needed.
    """
    effects = model.effects()
    total = F.lit(model.intercept)
    for predictor in model.predictors:
        chain = None
        for level in model.levels[predictor]:
            effect = F.lit(effects[predictor, level])
            hit = F.col(predictor) == level
            chain = F.when(hit, effect) if chain is None else chain.when(hit, effect)
        total = total + chain
    return 1 / (1 + F.exp(-total))


def score_contracts(df: DataFrame, model: FittedModel, name: str = "score") -> DataFrame:
    return df.withColumn(name, score_column(model))
