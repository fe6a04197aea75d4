"""A classifier of units at risk: matrix, boosted trees, report against rules, permutation importance."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .evaluate import average_precision
from .ranks import ranked


def matrix(numeric: list[str], boolean: list[str], category: list[str]) -> list:
    """Stages that make `features`: numbers (unknown: -1), booleans as 0 and 1, categories by an index fixed in training (unseen ones get one more)."""
    index = [StringIndexer(inputCol=c, outputCol=f"__i_{c}", handleInvalid="keep") for c in category]
    return [*index, VectorAssembler(inputCols=[f"__n_{c}" for c in [*numeric, *boolean]] + [f"__i_{c}" for c in category], outputCol="features")]


def prepared(rows: DataFrame, numeric: list[str], boolean: list[str], category: list[str]) -> DataFrame:
    number = {f"__n_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in [*numeric, *boolean]}
    return rows.withColumns(number | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in category})


def train(rows: DataFrame, numeric: list[str], boolean: list[str], category: list[str], label: str = "label", iterations: int = 20, depth: int = 4, seed: int = 7) -> PipelineModel:
    """Boosted trees; positives weigh min(50, 0.1 / share of them)."""
    share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    weight = F.when(F.col(label) == 1, F.lit(max(1.0, min(50.0, 0.1 / max(share, 1e-6))))).otherwise(1.0)
    data = prepared(rows, numeric, boolean, category).withColumns({"__w": weight, "__y": F.col(label).cast("double")})
    trees = GBTClassifier(featuresCol="features", labelCol="__y", weightCol="__w", maxIter=iterations, maxDepth=depth, maxBins=64, seed=seed)
    return Pipeline(stages=[*matrix(numeric, boolean, category), trees]).fit(data)


def predicted(model: PipelineModel, rows: DataFrame, numeric: list[str], boolean: list[str], category: list[str]) -> DataFrame:
    """rows with score, the probability of label 1."""
    out = model.transform(prepared(rows, numeric, boolean, category))
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("score"))


def permuted(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """rows with one column's values dealt anew, each once: ranks by one hash take values by another. Equal rows are told apart by their place in a stored table."""
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "shuffled")
    by = lambda s: [F.xxhash64(F.col("__row"), F.lit(s)), F.col("__row")]
    values = ranked(rows.select("__row", F.col(column).alias("__v")), [], by(seed), "__k").select("__k", "__v")
    return ranked(rows, [], by(seed + 1), "__k").join(values, "__k").withColumn(column, F.col("__v")).drop("__k", "__v", "__row")


def importance(model: PipelineModel, sample: DataFrame, numeric: list[str], boolean: list[str], category: list[str], seed: int = 7) -> DataFrame:
    """feature, drop: how much average precision a sample(…, label) loses when a column is shuffled."""
    spark, ap = sample.sparkSession, lambda d: average_precision(predicted(model, d, numeric, boolean, category).select(F.lit(0).alias("g"), "score", "label"), ["g"], spread=True).first()[1] or 0.0
    whole = ap(sample)
    return spark.createDataFrame([(c, whole - ap(permuted(sample, c, seed))) for c in [*numeric, *boolean, *category]], "feature string, drop double")
