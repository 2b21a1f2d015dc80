"""From a raw portfolio to a fitted and validated default model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelio.functions.nulls import drop_null_rows
from parcelio.operators import columns, features, metrics, model, sampling
from parcelio.operators import dictionaries as d
from parcelio.session import new_shared_path


def clean_portfolio(
    portfolio: DataFrame, sponsors: DataFrame, drop_unknown_delay: bool = False
) -> DataFrame:
    """Derived columns, sponsor data, casts, recoding and outlier removal.

    Rows with an unknown delay are dropped when the portfolio comes from the
    database and kept, with an unknown response, when it comes from a file.
    """
    if drop_unknown_delay:
        portfolio = drop_null_rows(portfolio, "DiasAtraso")
    derived = features.derive(portfolio)
    joined = features.join_sponsors(derived, sponsors)
    pruned = columns.drop_columns(joined, d.UNUSED_COLUMNS)
    texts = [c for c in d.TEXT_COLUMNS if c in pruned.columns]
    numbers = [c for c in d.NUMBER_COLUMNS if c in pruned.columns]
    typed = columns.batch_cast(columns.batch_cast(pruned, texts, "string"), numbers, "double")
    recoded = columns.masked_update(
        typed,
        "CursouEnsinoMedioEscolaPublica",
        F.col("CursouEnsinoMedioEscolaPublica") == "P",
        F.lit("S"),
    ).withColumn("NomeCurso", F.upper("NomeCurso"))
    return features.remove_outliers(recoded)


def model_table(portfolio: DataFrame, sponsors: DataFrame, courses: DataFrame) -> DataFrame:
    """Cleaned portfolio with course code, course group and bucket columns."""
    coded = features.join_course_codes(clean_portfolio(portfolio, sponsors), courses)
    named = coded.withColumn("nome_curso_cat", features.canonical_course(F.col("NomeCurso")))
    return features.add_buckets(features.pool_rare(named))


@dataclass(frozen=True)
class Validation:
    """A fitted model and its scored test rows.

    `scored` holds `score`, the class at the cut-off (`predicted`) and the
    response. The statistics are computed when asked for.
    """

    fitted: model.FittedModel
    scored: DataFrame
    response: str = "resposta"

    def roc_curve(self) -> DataFrame:
        return metrics.roc_curve(self.scored, "score", self.response)

    def auc(self) -> DataFrame:
        return metrics.auc(self.scored, "score", self.response)

    def ks_two_sample(self) -> DataFrame:
        return metrics.ks_two_sample(self.scored, "score", self.response)

    def confusion_report(self) -> dict[str, float]:
        return metrics.confusion_report(self.scored, "predicted", self.response)

    def shares(self, column: str = "predicted") -> DataFrame:
        return metrics.percent_table(self.scored, column)


def split_sample(
    table: DataFrame, key: str = "id", draws: int | None = None, seed: int = 42
) -> DataFrame:
    """Mark the test rows of a table, or of `draws` bootstrap draws from it.

    Draws may put copies of one contract in both parts, as the published model
    did (`SAMPLE_SIZE` draws); a split of the table itself keeps them apart.
    Draws are written to the shared folder, so that the split, the fit and each
    statistic don't draw anew.
    """
    if draws is None:
        return sampling.mark_test_rows(table, key, d.TEST_PERCENT, seed)
    sample = sampling.bootstrap_sample(table, key, draws, seed).drop("row_index")
    path = new_shared_path(table.sparkSession, "draws")
    sample.write.parquet(path)
    drawn = table.sparkSession.read.schema(sample.schema).parquet(path)
    return sampling.mark_test_rows(drawn, "draw", d.TEST_PERCENT, seed)


def train_and_validate(
    marked: DataFrame,
    predictors: Sequence[str] = d.FINAL_PREDICTORS,
    response: str = "resposta",
    cut_off: float = d.CUT_OFF,
) -> Validation:
    """Fit on the training rows and score the test rows."""
    typed = marked.withColumn(response, F.col(response).cast("double"))
    fitted = model.fit_logit(typed.filter(~F.col("is_test")), response, predictors)
    scored = model.score_contracts(typed.filter("is_test"), fitted)
    predicted = metrics.threshold_class(F.col("score"), cut_off)
    return Validation(fitted, scored.withColumn("predicted", predicted), response)


def payer_scores(scored: DataFrame, key: str = "id") -> DataFrame:
    """The score table the provisioning flow reads."""
    return scored.select(F.col(key).alias("cpf"), "score")
