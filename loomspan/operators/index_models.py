"""Index models of a 0/1 outcome, compared on rows they were not fitted on."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.ranges import auc_and_brier

#: Penalties that the lasso chooses among, by squared miss on a third part.
PENALTIES = (0.0, 0.001, 0.01, 0.1)


def compare(df: DataFrame, key: str, truth: str, features: list[str]) -> DataFrame:
    """``model, n, auc, brier`` on the rows held out: of six hashed parts three
    fit, one chooses the lasso's penalty and two are held out. Rows with a
    null go; with one kind of outcome only there is no model and no row."""
    rows = df.dropna(subset=[key, truth, *features]).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(6)))
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(rows).withColumn("_y", F.col(truth).cast("double"))
    fit, choose, held = rows.where("_part < 3"), rows.where("_part = 3"), rows.where("_part > 3")
    schema = "model string, n long, auc double, brier double"
    if fit.select("_y").distinct().count() < 2:
        return df.sparkSession.createDataFrame([], schema)
    common = {"featuresCol": "_x", "labelCol": "_y"}
    lassos = [LinearRegression(**common, elasticNetParam=1.0, regParam=p).fit(fit) for p in PENALTIES]
    miss = [m.transform(choose).agg(F.avg(F.pow(F.col("prediction") - F.col("_y"), 2))).first()[0] or 0.0 for m in lassos]
    models = {
        "linear": lassos[0], "lasso": lassos[miss.index(min(miss))], "logit": LogisticRegression(**common).fit(fit),
        "poisson": GeneralizedLinearRegression(**common, family="poisson", link="log").fit(fit), "forest": RandomForestClassifier(**common, numTrees=20, maxDepth=5, seed=7).fit(fit),
    }
    out = []
    for name, model in models.items():
        done = model.transform(held)
        chance = vector_to_array("probability")[1] if name in ("logit", "forest") else F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))
        r = auc_and_brier(done.select(F.round(chance, 9).alias("s"), F.col("_y").alias("y")), "s", "y").first()
        out.append((name, int(r["n"]), r["auc"], r["brier"]))
    return df.sparkSession.createDataFrame(out, schema)
