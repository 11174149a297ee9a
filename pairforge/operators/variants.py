"""Choice among variants of a classifier: one draw of weights for all, gains of named pairs, and a saved bundle of the chosen one."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.vectors import canonical
from pairforge.operators import models, poisson, thresholds
from pairforge.operators.metrics import best_threshold


def fit(train: DataFrame, kind: str, columns: list[str], seed: int = 1) -> PipelineModel:
    """A pipeline from columns to a probability: its scaler knows the training rows only."""
    assemble = VectorAssembler(inputCols=columns, outputCol="_raw" if kind == "lr" else "features")
    n = train.count()
    rows = models.gathered(rounded(train, columns), n)
    if kind != "lr":
        return Pipeline(stages=[assemble, GBTClassifier(labelCol="y", maxIter=20, maxDepth=3, seed=seed)]).fit(rows)
    scale = StandardScaler(withMean=True, inputCol="_raw", outputCol="features")
    return Pipeline(stages=[assemble, scale, LogisticRegression(labelCol="y", regParam=1.0 / max(n, 1), standardization=False, maxIter=60)]).fit(rows)


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: canonical(F.col(c)) for c in columns})


class Bundle:
    """A fitted variant with all that scores need: columns, model and threshold."""

    def __init__(self, model: PipelineModel, name: str, columns: list[str], threshold: float):
        self.model, self.name, self.columns, self.threshold = model, name, columns, threshold

    def score(self, df: DataFrame) -> DataFrame:
        """Adds score and pred to rows with the columns. Other columns stay as they are."""
        made = models.score(self.model, rounded(df.select(F.struct("*").alias("_row"), *self.columns), self.columns))
        return made.select("_row.*", "score", (F.col("score") >= self.threshold).alias("pred"))

    def save(self, path: str) -> None:
        """Writes the model and a table of one row to a shared folder."""
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.name, self.columns, self.threshold)], "name string, columns array<string>, threshold double").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        r = spark.read.parquet(f"{path}/about").head()
        return cls(PipelineModel.load(f"{path}/model"), r.name, list(r.columns), r.threshold)


def tuned(scored: DataFrame, names: list[str]) -> dict[str, float]:
    """The best threshold of each column of scores."""
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("score")) for n in names])).alias("_v")
    found = best_threshold(scored.select("y", stacked).select("y", "_v.*"), ("variant",))
    return {r.variant: r.threshold for r in found.collect()}


def gains(scored: DataFrame, taus: dict[str, float], pairs: list[tuple[str, str]], replicates: int, seed: int = 2, key: str = "id") -> DataFrame:
    """variant, over, and gain (of the table itself), mean, low and high (95 %) in pr_auc and in f1 at each one's threshold.

    Each variant is a column of scores; a row has one weight a replicate, by a hash of its key, that all variants share. Rows that lack
    a label or any of the scores are left out of all.
    """
    rows = scored.dropna(subset=["y", *taus])
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).cast("double").alias("score")) for n in taus])).alias("_v")
    all_ = poisson.replicate_areas(rows.select(key, "y", stacked).select(key, "y", "_v.*"), taus, replicates, seed, "variant", key).select("variant", "boot", "f1", "pr_auc")
    asked = F.broadcast(scored.sparkSession.createDataFrame(pairs, "variant string, over string"))
    other = all_.withColumnsRenamed({"variant": "over", "f1": "f1_over", "pr_auc": "pr_auc_over"})
    d = all_.join(asked, "variant").join(other, ["over", "boot"]).select("variant", "over", "boot", *[(F.col(m) - F.col(f"{m}_over")).alias(m) for m in ("pr_auc", "f1")])
    drawn = lambda m: F.when(F.col("boot") > 0, F.col(m))
    made = [(f(m), f"{m}_{n}") for m in ("pr_auc", "f1") for n, f in (("gain", lambda m: F.max(F.when(F.col("boot") == 0, F.col(m)))), ("mean", lambda m: F.avg(drawn(m))), ("low", lambda m: F.percentile(drawn(m), F.lit(0.025))), ("high", lambda m: F.percentile(drawn(m), F.lit(0.975))))]
    return d.groupBy("variant", "over").agg(*[c.alias(n) for c, n in made])


def chosen(found: DataFrame, first: str, simpler: str, richer: dict[str, tuple[str, ...]], least: float = 0.005) -> str:
    """The variant that choose_stepwise takes by the mean gain in average precision and its lower bound. found: a row for each named pair."""
    rows = {(r.variant, r.over): (r.pr_auc_mean or 0.0, r.pr_auc_low or 0.0) for r in found.collect()}
    return thresholds.choose_stepwise(first, simpler, richer, rows, least)
