"""Fitted models: win probability, receivers, runs, style components, clusters of colours and shapes."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def win_features(df: DataFrame) -> DataFrame:
    """Regressors of a match state (minute, diff, men, elo, home): lead, its weight late on, men, rating, its fading."""
    left = (90 - F.col("minute")) / 90
    return df.withColumns({"f_diff": F.col("diff").cast("double"), "f_late": F.col("diff") * (1 - left), "f_men": F.col("men").cast("double"), "f_elo": F.col("elo") / 400, "f_elo_left": F.col("elo") / 400 * left, "f_home": F.col("home").cast("double"), "f_left": left, "f_sq": F.col("diff") * F.abs(F.col("diff"))})


FEATURES = ["f_diff", "f_late", "f_men", "f_elo", "f_elo_left", "f_home", "f_left", "f_sq"]


def fit_outcomes(train: DataFrame, *, c: float = 1.0) -> PipelineModel:
    """Standardised multinomial logistic regression of result (0 loss, 1 draw, 2 win)."""
    n = max(train.count(), 1)
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol="result", family="multinomial", regParam=1 / (c * n), maxIter=100)]
    return Pipeline(stages=stages).fit(win_features(train))


def outcomes(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with p_loss, p_draw, p_win."""
    out = model.transform(win_features(df)).withColumn("_p", vector_to_array("probability"))
    return out.select(*df.columns, *(F.col("_p")[i].alias(n) for i, n in enumerate(("p_loss", "p_draw", "p_win"))))


def elo_expected(own: Column, other: Column, *, home: float = 60.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own - home) / 400))


def receiver_model(cands: DataFrame, features: list[str]) -> PipelineModel:
    v = VectorAssembler(inputCols=features, outputCol="_v")
    d = cands.withColumn("label", F.col("is_receiver").cast("double"))
    return Pipeline(stages=[v, LogisticRegression(featuresCol="_v", labelCol="label", maxIter=50)]).fit(d)


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")


def run_features(tracks: DataFrame, targets: DataFrame) -> DataFrame:
    """Speed, heading and place of a player and the displacement to come."""
    t = targets.join(tracks, ["chunk", "track_id", "frame"]).where("speed IS NOT NULL")
    a = F.atan2("vy", "vx")
    return t.select("chunk", "track_id", "frame", "x_s", "y_s", "speed", F.cos(a).alias("cos_h"), F.sin(a).alias("sin_h"), "dx", "dy")


def ridge(train: DataFrame, features: list[str], label: str, *, alpha: float = 1.0) -> PipelineModel:
    n = max(train.count(), 1)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_v"), LinearRegression(featuresCol="_v", labelCol=label, regParam=alpha / n, elasticNetParam=0.0)]).fit(train)


def displacement_scores(df: DataFrame, px: str, py: str) -> DataFrame:
    """(rmse, mae, hit3, cosine) of forecast displacements."""
    ex, ey = F.col("dx") - F.col(px), F.col("dy") - F.col(py)
    e = F.sqrt(ex * ex + ey * ey)
    cos = F.try_divide(F.col("dx") * F.col(px) + F.col("dy") * F.col(py), F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) * F.sqrt(F.col(px) ** 2 + F.col(py) ** 2))
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mae"), F.avg((e <= 3).cast("double")).alias("hit3"), F.avg(cos).alias("cosine"))


def components(df: DataFrame, key: str, features: list[str], k: int = 3) -> tuple[DataFrame, list[float]]:
    """(key, scores) on the first k principal components of standardised features, and their shares of variance."""
    m = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True), PCA(k=k, inputCol="_z", outputCol="_c")]).fit(df)
    return m.transform(df).select(key, vector_to_array("_c").alias("scores")), m.stages[-1].explainedVariance.toArray().tolist()


def clustered(df: DataFrame, vec: str, k: int, *, seed: int = 1) -> DataFrame:
    """Rows with the cluster of an array column."""
    d = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(d).transform(d).drop("_v")


def prototypes(df: DataFrame, vec: str, k: int, *, seed: int = 1) -> DataFrame:
    """(cluster, centre, weight): cluster centres with their share of the rows."""
    c = clustered(df, vec, k, seed=seed)
    e = c.select("cluster", F.posexplode(F.col(vec).cast("array<double>")).alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("v"))
    centre = e.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centre"))
    w = c.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return centre.join(w.drop("n"), "cluster")


def colour_teams(tracks: DataFrame) -> DataFrame:
    """(chunk, track_id, team): two clusters of track colours (l, a, b) relative to their chunk's mean; the darker is team 0."""
    w = Window.partitionBy("chunk")
    d = tracks.withColumn("rel", F.array(*(F.col(c) - F.avg(c).over(w) for c in ("l", "a", "b"))))
    c = clustered(d, "rel", 2)
    dark = c.groupBy("cluster").agg(F.avg("l").alias("m")).agg(F.min_by("cluster", "m").alias("dark"))
    return c.crossJoin(F.broadcast(dark)).select("chunk", "track_id", F.when(F.col("cluster") == F.col("dark"), 0).otherwise(1).alias("team"))
