"""Pair classifiers: logistic regression with a grid, boosted trees, out-of-fold scores, coefficients and variants."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.vectors import canonical
from pairforge.operators.metrics import auc
from pairforge.session import side_by_side


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns as z-scores with the population deviation; a constant column becomes 0."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns}).select(*df.columns)


def design(df: DataFrame, columns: list[str], scale: bool = True) -> DataFrame:
    """Adds features: the columns at six decimals, assembled and, with scale, standardised."""
    rounded = df.select(*[c for c in df.columns if c not in columns], *[canonical(F.col(c)).alias(c) for c in columns])
    out = VectorAssembler(inputCols=columns, outputCol="_raw" if scale else "features").transform(rounded)
    return StandardScaler(withMean=True, inputCol="_raw", outputCol="features").fit(out).transform(out).drop("_raw") if scale else out


def vectors(df: DataFrame, column: str) -> DataFrame:
    """Adds features: an array column as vectors."""
    return df.withColumn("features", array_to_vector(F.col(column)))


#: Rows of a task of a fit, at least where there are so many: a fit is a hundred short jobs, whose tasks cost more than their rows.
FIT_ROWS = 100_000


def gathered(train: DataFrame, n: int) -> DataFrame:
    """train, of n rows, in as many tasks as its rows ask for."""
    return train.coalesce(max(-(-n // FIT_ROWS), 1))


def logistic(train: DataFrame, c: float):
    """L2 logistic regression with inverse strength c, summed over rows."""
    n = train.count()
    return LogisticRegression(labelCol="y", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=60).fit(gathered(train, n))


def boosted(train: DataFrame, seed: int = 1):
    return GBTClassifier(labelCol="y", maxIter=20, maxDepth=3, seed=seed).fit(gathered(train, train.count()))


def score(model, df: DataFrame) -> DataFrame:
    """Adds score: the chance of label 1."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def pick_c(train: DataFrame, dev: DataFrame, grid: list[float]):
    """The model of the greatest average precision on dev, and (c, pr_auc) of all."""
    def tried(c: float) -> tuple[Model, float | None]:
        model = logistic(train, c)
        return model, auc(score(model, dev)).head().pr_auc

    found = side_by_side(train.sparkSession, tried, grid)
    best = max(range(len(grid)), key=lambda i: (found[i][1] or 0.0, -i))
    return found[best][0], [(c, area) for c, (_, area) in zip(grid, found, strict=True)]


def out_of_fold(df: DataFrame, folds: int, fit: Callable[[DataFrame], Model] = lambda train: logistic(train, 1.0)) -> DataFrame:
    """Scores of rows with fold and features, each from a model of the other folds."""
    made = side_by_side(df.sparkSession, lambda f: score(fit(df.where(F.col("fold") != f)), df.where(F.col("fold") == f)), range(folds))
    return reduce(DataFrame.unionByName, made)


def coefficients(model, columns: list[str]) -> list[tuple[str, float]]:
    """(column, weight), the strongest first."""
    return sorted(zip(columns, map(float, model.coefficients), strict=True), key=lambda x: -abs(x[1]))


def variants(base: list[str], groups: dict[str, list[str]], lexical: list[str], clusters: list[str] = ()) -> dict[str, tuple[str, list[str]]]:
    """Kind of model (lr, trees) and columns of each variant: base alone, with groups, with more, and without each group."""
    all_ = [*base, *dict.fromkeys(c for g in groups.values() for c in g)]
    less = lambda k: [c for c in all_ if c not in groups[k] or any(c in g for n, g in groups.items() if n != k)]
    out = {"recal": ("lr", list(base)), "constraints": ("lr", all_), "no_specificity": ("lr", less("specificity")), "plus_lexical": ("lr", list(dict.fromkeys([*all_, *lexical])))}
    if clusters:
        out["plus_cluster"] = ("lr", [*all_, *clusters])
    out |= {"trees": ("trees", all_), "recal_trees": ("trees", list(base))}
    return out | {f"minus_{k}": ("lr", less(k)) for k in groups} | {f"trees_minus_{k}": ("trees", less(k)) for k in groups}


def fitted(train: DataFrame, kind: str):
    return logistic(train, 1.0) if kind == "lr" else boosted(train)
