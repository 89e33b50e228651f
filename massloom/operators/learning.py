"""Models fitted on matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.proteins import peptide_spectra


def rescore(df: DataFrame, features: Sequence[str], label: str, penalty: float = 1.0) -> DataFrame:
    """Add probability of label 1 by a ridge logistic regression (penalty: inverse strength, as for a sum over rows)."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(df)
    n = max(rows.count(), 1)
    model = LogisticRegression(featuresCol="_features", labelCol=label, regParam=1 / (penalty * n), elasticNetParam=0.0, standardization=False, maxIter=50).fit(rows)
    return model.transform(rows).withColumn("probability", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "prediction")


def binomial_fit(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Add fitted, the mean of a binomial model with a logit link."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(df)
    model = GeneralizedLinearRegression(featuresCol="_features", labelCol=label, family="binomial", link="logit", maxIter=25).fit(rows)
    return model.transform(rows).withColumn("fitted", F.col("prediction")).drop("_features", "prediction")


def rescoring_features(matches: DataFrame, scan: Sequence[str], scores: Sequence[str], mass_error: Column, missed: Column, peptide: str, form: str, protein: str, ties: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """matches (a row for each match and protein) with the features that rescoring is fitted on, and their names.

    The scores; the absolute mass error; of each score the distance to the next match of the scan (0 for
    its last; ties in the order given); missed cleavages; the spectra of the peptide in all forms;
    and the unique and shared spectra of its best linked protein, without itself.
    """
    out = matches.withColumn("mass_error", F.abs(mass_error)).withColumn("missed", missed)
    for s in scores:
        following = F.lead(s).over(Window.partitionBy(*scan).orderBy(F.desc(s), *ties))
        out = out.withColumn(f"{s}_diff", F.col(s) - F.coalesce(following, F.col(s)))
    # the same for all forms of a peptide; a match without one has no features
    graph = peptide_spectra(matches.where(F.col(form).isNotNull()), peptide, protein)
    names = [*scores, "mass_error", *(f"{s}_diff" for s in scores), "missed", "peptide_spectra", "linked_spectra"]
    return out.where(F.col(form).isNotNull()).join(graph, peptide), names
