"""Parameter grids, result summaries and small models over sweep results."""

from __future__ import annotations

from pyspark import InheritableThread
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvecast.operators import bands, depth, scores

PARAMS = "param_id int, forget_rate_f double, forget_rate_e double, length_scale_f double, length_scale_e double, lookup_rate double, trust_rate double, nu double, gamma double, xi double, kappa_min int, kappa_max int"


def param_grid(spark: SparkSession, fixed: dict[str, float], name: str, values: list[float]) -> DataFrame:
    """One parameter swept, the others fixed: a product of one-row and value tables."""
    swept = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"param_id int, {name} double")
    rest = {k: v for k, v in fixed.items() if k != name}
    return swept.withColumns({k: F.lit(v) for k, v in rest.items()})


def median_by_param(results: DataFrame, param: str, score: str, by: list[str] = ()) -> DataFrame:
    return results.groupBy(*by, param).agg(F.median(score).alias("median"))


def best_param(results: DataFrame, param: str, score: str) -> DataFrame:
    """Per asset and t the value of least median score, then the assets' median per t, side by side."""
    best = median_by_param(results, param, score, ["asset", "t"]).groupBy("asset", "t").agg(F.min_by(param, F.struct(F.round("median", 9), param)).alias("best"))
    return best.groupBy("t").agg(F.median("best").alias("best"))


def label_argmin(results: DataFrame, param: str, score: str, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.min_by(param, F.struct(score, param)).alias("label"))


def metrics(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """R2, RMSE, MAPE by the truth, and MAPE by the prediction."""
    d = F.col(truth) - F.col(pred)
    return rows.agg(
        (1 - F.sum(d * d) / (F.sum(F.col(truth) * F.col(truth)) - F.count(truth) * F.avg(truth) * F.avg(truth))).alias("r2"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d) / F.when(F.col(truth) != 0, F.abs(truth))).alias("mape"),
        F.avg(F.abs(d) / F.when(F.col(pred) != 0, F.abs(pred))).alias("mape_by_prediction"),
    )


def level_bands(scen: DataFrame, levels: tuple[float, ...], grid: list[tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """Bands (method, level, zeta, event_id, param_id, s, lower, upper) that trim the share zeta for each
    of grid's (level, zeta), by depth (MBD, and DQ at the level) or by marginal ranks (eCDF); and the
    leads' sorted values and medians.

    A curve's depth rank is taken once for each level; the grid multiplies rows only before sums
    that are formed where the rows are.
    """
    spark, keys, band = scen.sparkSession, ["event_id", "param_id"], ["method", "level", "zeta", "event_id", "param_id", "s"]
    steps = F.broadcast(spark.createDataFrame(grid, "level double, zeta double"))
    sets, order = bands.as_sets(scen), ["method", "level", "set_id"]
    every = F.explode(F.array(*[F.lit(a) for a in levels])).alias("level")
    deep = depth.mbd(sets).select(F.lit("MBD").alias("method"), every, "set_id", "curve_id", F.round("depth", 9).alias("depth"))
    for a in levels:
        deep = deep.unionByName(depth.directional_quantile(sets, a / 2, bounded=True).select(F.lit("DQ").alias("method"), F.lit(a).alias("level"), "set_id", "curve_id", F.round(-F.col("depth"), 9).alias("depth")))
    whole = Window.partitionBy(*order)
    ranked = deep.withColumns({"r": F.row_number().over(whole.orderBy("depth", "curve_id")), "n": F.count(F.lit(1)).over(whole)})
    kept = ranked.join(steps, "level").where(F.col("r") > F.floor(F.col("n") * F.col("zeta"))).select("method", "level", "zeta", F.col("set_id.event_id").alias("event_id"), F.col("set_id.param_id").alias("param_id"), "curve_id")
    cut = scen.join(kept, [*keys, "curve_id"]).groupBy(*band).agg(F.min("m").alias("lower"), F.max("m").alias("upper"))
    leads = scen.groupBy(*keys, "s").agg(F.sort_array(F.collect_list("m")).alias("v"), F.median("m").alias("mid"))  # at most kappa_max values
    at = lambda q: F.element_at("v", F.greatest(F.lit(1), F.ceil(F.size("v") * q)).cast("int"))
    ecdf = leads.crossJoin(steps).select(F.lit("eCDF").alias("method"), "level", "zeta", *keys, "s", at(F.col("zeta") / 2).alias("lower"), at(1 - F.col("zeta") / 2).alias("upper"))
    return cut.unionByName(ecdf), leads


def calibrate(scen: DataFrame, truth: DataFrame, levels: tuple[float, ...], grid: list[tuple[float, float]]) -> DataFrame:
    """method, level, zeta, event_id, param_id, wis, cs..: bands trimmed by the share zeta of grid's
    (level, zeta) while the other levels trim their own share; wis is the median over leads."""
    keys, band = ["event_id", "param_id"], ["method", "level", "zeta", "event_id", "param_id", "s"]
    both, leads = level_bands(scen, levels, grid)
    y = scores.with_truth(both, truth).join(leads.select(*keys, "s", "mid"), [*keys, "s"])
    part = F.col("level") / 2 * scores.interval(F.col("lower"), F.col("upper"), F.col("y"), F.col("level"))
    hit = ((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).cast("double")
    rows = y.select(*band, "y", "mid", part.alias("part"), hit.alias("hit"))
    base = rows.where("level = zeta")
    total = base.groupBy("method", *keys, "s").agg(F.sum("part").alias("total"))
    own = base.select("method", "level", *keys, "s", F.col("part").alias("own"))
    wis = F.median((0.5 * F.abs(F.col("y") - F.col("mid")) + F.col("total") - F.col("own") + F.col("part")) / (len(levels) + 0.5))
    scored = rows.join(total, ["method", *keys, "s"]).join(own, ["method", "level", *keys, "s"]).groupBy(*band[:-1]).agg(wis.alias("wis"), F.avg("hit").alias("cs"))
    others = base.groupBy("method", *keys).pivot("level", list(levels)).agg(F.avg("hit"))
    names = [(a, f"cs{round(100 * (1 - a))}") for a in levels]
    return scored.join(others, ["method", *keys]).select(*band[:-1], "wis", *[F.when(F.col("level") == a, F.col("cs")).otherwise(F.col(f"`{a}`")).alias(n) for a, n in names])


def _cross_validated(rows: DataFrame, features: list[str], label: str, model, grid, folds: int) -> DataFrame:
    """Predictions for the fifth of the rows that is kept out; both parts by a hash of the features."""
    data = rows.select(*features, F.col(label).cast("double").alias("label")).dropna()
    train = data.where(F.pmod(F.xxhash64(*features), F.lit(5)) > 0)
    test = data.where(F.pmod(F.xxhash64(*features), F.lit(5)) == 0)
    steps = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model])
    # Pyspark gives all threads of one CrossValidator the same table of local properties, in which a query that ends takes away
    # the execution id that another is about to read ("Cannot parse null string"). So each thread has a validator of its own.
    own = lambda part: CrossValidator(estimator=steps, estimatorParamMaps=part, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=folds, seed=7, parallelism=1)
    size = -(-len(grid) // 4)
    parts, done = [grid[i : i + size] for i in range(0, len(grid), size)], {}

    def fit(i: int) -> None:
        try:
            done[i] = own(parts[i]).fit(train)
        except Exception as failure:
            done[i] = failure

    threads = [InheritableThread(target=fit, args=(i,)) for i in range(len(parts))]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    for model_or_failure in done.values():
        if isinstance(model_or_failure, Exception):
            raise model_or_failure
    found = min((done[i] for i in range(len(parts))), key=lambda m: min(m.avgMetrics))  # the first of the least, as in one validator
    return found.transform(test).select(*features, "label", "prediction")


def linear(rows: DataFrame, features: list[str], label: str, lasso: bool, strengths: list[float], folds: int = 5) -> DataFrame:
    """Held-out predictions of a cross-validated lasso or ridge."""
    model = LinearRegression(elasticNetParam=1.0 if lasso else 0.0, standardization=False)
    return _cross_validated(rows, features, label, model, ParamGridBuilder().addGrid(model.regParam, strengths).build(), folds)


def tree(rows: DataFrame, features: list[str], label: str, depths: list[int], leaves: list[int], folds: int = 5) -> DataFrame:
    model = DecisionTreeRegressor(seed=7)
    grid = ParamGridBuilder().addGrid(model.maxDepth, depths).addGrid(model.minInstancesPerNode, leaves).build()
    return _cross_validated(rows, features, label, model, grid, folds)
