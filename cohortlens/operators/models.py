"""Supervised models on Spark ML: preparation, hash folds, comparison, calibration and audits.

Fits run on the executors; the driver keeps fitted models and metrics. Folds and splits come from a
hash of the row id, so a row keeps its fold whatever the partitioning. Linear models under folds come from
``penalised``. Boosting takes missing values as they are: a tree meets every numeric column that has any twice, with the missing
rows below all values in one copy and above them in the other, so each split learns the side to which they go.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import ratio
from . import boosting as trees
from . import ordering, penalised
from .guards import require
from .lineage import cut
from .resample import hash32

FIT_ROWS = 50_000


@dataclass
class ModelResult:
    model: PipelineModel | None
    metrics: dict[str, float]
    predictions: DataFrame
    report: DataFrame | None = None


def hash_fold(entity: str, folds: int, seed: int = 0) -> Column:
    return F.pmod(hash32(seed, entity), F.lit(folds)).cast("int")


def stratified_position(df: DataFrame, strata: str, entity: str, seed: int = 0) -> DataFrame:
    """Position of every row in a hash-shuffled order of its class, and the class size."""
    h = df.select(strata, entity).withColumn("_h", hash32(seed, entity))
    at = ordering.row_positions(h, [strata], ["_h", entity]).select(F.col(entity).alias("_e"), F.col("position").alias("_pos"), F.col("n_total").alias("_size"))
    return cut(df.join(at, F.col(entity) == F.col("_e")).drop("_e"))


def stratified_split(df: DataFrame, strata: str, entity: str, share: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the test share taken from every class."""
    d = stratified_position(df, strata, entity, seed)
    test = F.col("_pos") <= F.round(F.col("_size") * share)
    return d.filter(~test).drop("_pos", "_size"), d.filter(test).drop("_pos", "_size")


def stratified_folds(df: DataFrame, strata: str, entity: str, folds: int = 5, seed: int = 0) -> DataFrame:
    d = stratified_position(df, strata, entity, seed)
    return d.withColumn("fold", F.pmod(F.col("_pos"), F.lit(folds)).cast("int")).drop("_pos", "_size")


def classify_types(df: DataFrame, features: list[str], label: str, entity: str, *, trees: int = 200, seed: int = 42, depth: int = 5) -> ModelResult:
    """Random forest for a type label with a stratified 25% hold-out and a per-class report."""
    require(df, [*features, label, entity], "training table")
    d = cut(df.dropna(subset=[*features, label]).select(entity, label, *features))
    if not d.limit(1).count():
        raise ValueError("no complete rows to train on")
    train, test = stratified_split(d, label, entity, seed=seed)
    index = StringIndexer(inputCol=label, outputCol="_y").fit(d)
    stages = [index, VectorAssembler(inputCols=features, outputCol="_x"),
              RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed, maxDepth=depth),
              IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)]
    model = Pipeline(stages=stages).fit(train)
    pred = cut(model.transform(test).select(entity, label, "predicted"))
    return ModelResult(model, accuracy(pred, label), pred, class_report(pred, label))


def accuracy(pred: DataFrame, label: str) -> dict[str, float]:
    r = pred.agg(F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("a"), F.count("*").alias("n")).collect()[0]
    return {"accuracy": r["a"], "n_test": r["n"]}


def class_report(pred: DataFrame, label: str) -> DataFrame:
    """Precision, recall, f1 and support per class from one contingency count."""
    c = pred.groupBy(F.col(label).cast("string").alias("actual"), F.col("predicted").cast("string").alias("predicted")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("actual").alias("class"), F.lit("a").alias("side")), F.struct(F.col("predicted").alias("class"), F.lit("p").alias("side")))
    s = c.withColumn("hit", F.col("actual") == F.col("predicted")).select("n", "hit", F.inline(sides))
    g = s.groupBy("class").agg(F.sum(F.when((F.col("side") == "a") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
                               F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("support"),
                               F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("_pred"))
    p, r = F.coalesce(ratio("tp", "_pred"), F.lit(0.0)), F.coalesce(ratio("tp", "support"), F.lit(0.0))
    return g.select("class", p.alias("precision"), r.alias("recall"), F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def errors(pred: DataFrame, y: str, p: str = "prediction") -> DataFrame:
    e = F.col(p) - F.col(y)
    return pred.agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def forecast(df: DataFrame, features: list[str], y: str, year: str, last_train: int | None, *, model: str = "linear", seed: int = 42,
             keep: tuple[str, ...] = ("unitid",), iterations: int = 100, depth: int = 3) -> ModelResult:
    """Temporal split (random 25% of entities held out if ``last_train`` is None), then a linear or boosted regression; MAE and RMSE on the rest."""
    from .cleaning import split_by_year
    d = df.dropna(subset=[*features, y]).select(*keep, year, F.col(y).cast("double").alias(y), *[F.col(c).cast("double").alias(c) for c in features])
    d = cut(d)
    train, test = split_by_year(d, year, last_train) if last_train is not None else (d.filter(hash_fold(keep[0], 4, seed) != 0), d.filter(hash_fold(keep[0], 4, seed) == 0))
    for part, name in ((train, "training"), (test, "test")):
        if part.isEmpty():
            raise ValueError(f"no complete {name} rows")
    est = (LinearRegression(featuresCol="_x", labelCol=y, solver="normal") if model == "linear" else
           GBTRegressor(featuresCol="_x", labelCol=y, seed=seed, maxIter=iterations, maxDepth=depth))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), est]).fit(train)
    pred = fitted.transform(test).drop("_x")
    r = errors(pred, y).collect()[0]
    return ModelResult(fitted, {"mae": r["mae"], "rmse": r["rmse"], "n": r["n"]}, pred)


# --- comparison under shared folds -----------------------------------------------------------

def preparation(numeric: list[str], categorical: list[str], *, indicators: bool = True, scale: bool = True) -> list:
    """Median imputation (with missing indicators), scaling and one-hot coding as pipeline stages.

    The alphabetically first level of a categorical is the reference level; a level not seen in fitting is an error.
    The caller adds the indicator columns with ``with_indicators`` so that they exist at fit time.
    """
    filled = [f"_f_{c}" for c in numeric]
    stages: list = [Imputer(strategy="median", inputCols=numeric, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_num")]
    if scale:
        stages.append(StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True))
    parts = ["_scaled" if scale else "_num", *([f"_miss_{c}" for c in numeric] if indicators else [])]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"_i_{c}", stringOrderType="alphabetDesc"), OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_h_{c}")]
        parts.append(f"_h_{c}")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="_x")]


def with_indicators(df: DataFrame, numeric: list[str]) -> DataFrame:
    return df.withColumns({f"_miss_{c}": F.col(c).isNull().cast("double") for c in numeric})


def out_of_fold(df: DataFrame, stages: list, folds: int, output: Column, name: str = "p") -> DataFrame:
    """Predictions of every row from the model that did not see its fold; input has a fold column."""
    with ThreadPool(folds) as pool:  # the folds' jobs share the executors; each thread has its own estimators
        fits = pool.map(lambda i: Pipeline(stages=[s.copy() for s in stages]).fit(df.filter(F.col("fold") != i)), range(folds))
    parts = [m.transform(df.filter(F.col("fold") == i)).select(*df.columns, output.alias(name)) for i, m in enumerate(fits)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def two_sided(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Two copies of each numeric column, missing values below all others in ``_lo_`` and above them in ``_hi_``."""
    v = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numeric}
    far = F.lit(1.7e308)
    return df.withColumns({**{f"_lo_{c}": F.coalesce(v[c], -far) for c in numeric}, **{f"_hi_{c}": F.coalesce(v[c], far) for c in numeric}})


def tree_preparation(numeric: list[str], categorical: list[str]) -> list:
    """Columns for trees: both copies of the numeric ones, and every level of the categorical ones."""
    stages: list = []
    parts = [f"_{side}_{c}" for c in numeric for side in ("lo", "hi")]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"_i_{c}", stringOrderType="alphabetDesc"), OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_h_{c}", dropLast=False)]
        parts.append(f"_h_{c}")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="_x")]


def boosting(kind, y: str, seed: int, iterations: int):
    """300 trees of at most 32 leaves at a step of 0.05, split at up to 256 cut points."""
    return kind(featuresCol="_x", labelCol=y, seed=seed, maxIter=iterations, maxDepth=5, stepSize=0.05, maxBins=256, minInstancesPerNode=20)


def few_files(df: DataFrame) -> DataFrame:
    """The written table in about a part per ``FIT_ROWS`` rows: a tree is many short jobs, and each pays for every part."""
    df = cut(df)
    return cut(df.coalesce(df.count() // FIT_ROWS + 1))


def fold_rmse(oof: DataFrame, y: str, model: str) -> DataFrame:
    """Mean and spread of the per-fold RMSE, and the multiplicative error on a log10 scale."""
    f = oof.groupBy("fold").agg(F.sqrt(F.avg(F.pow(F.col("p") - F.col(y), 2))).alias("r"))
    return f.agg(F.avg("r").alias("rmse"), F.stddev_pop("r").alias("fold_sd")).select(
        F.lit(model).alias("model"), "rmse", "fold_sd", F.pow(F.lit(10.0), F.col("rmse")).alias("multiplicative_error"))


def mean_baseline(df: DataFrame, y: str) -> DataFrame:
    """Out-of-fold mean: total minus the own fold, from one small aggregate per fold."""
    per = df.groupBy("fold").agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    total = per.agg(F.struct(F.sum("_s").alias("s"), F.sum("_n").alias("n"))).scalar()
    means = per.withColumn("_t", total).select(F.col("fold").alias("_fold"), ratio(F.col("_t.s") - F.col("_s"), F.col("_t.n") - F.col("_n")).alias("p"))
    return df.join(means, F.col("fold") == F.col("_fold")).drop("_fold")


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and spread of the per-fold RMSE by model, the multiplicative error on a log10 scale, and the penalties fold by fold."""
    f = per_fold.groupBy("model").agg(F.avg("rmse").alias("rmse"), F.stddev_pop("rmse").alias("fold_sd"), F.sort_array(F.collect_list(F.struct("fold", "penalty"))).alias("_p"))
    return f.select("model", "rmse", "fold_sd", F.pow(F.lit(10.0), F.col("rmse")).alias("multiplicative_error"),
                    F.filter(F.transform("_p", lambda x: x["penalty"]), lambda x: x.isNotNull()).alias("penalties"))


def boosted_folds(df: DataFrame, numeric: list[str], categorical: list[str], y: str, entity: str, *, folds: int = 5, seed: int = 42, iterations: int = 300) -> DataFrame:
    """(fold, y, p): out-of-fold predictions of boosting on the folds of ``penalised``; missing values stay missing."""
    d = df.select(entity, F.col(y).cast("double").alias(y), *numeric, *categorical).dropna(subset=[y, *categorical])
    d = cut(d.withColumn("fold", hash_fold(entity, folds, seed)))
    fit = trees.fit_folds(d, numeric, categorical, y, boosting(GBTRegressor, y, seed, iterations), folds, binary=False)
    return cut(fit.transform(d.select("fold", y, *numeric, *categorical)).select("fold", y, "p"))


def compare_regressions(df: DataFrame, numeric: list[str], categorical: list[str], y: str, entity: str, *, folds: int = 5, seed: int = 42,
                        iterations: int = 300, names: tuple[str, ...] = ("OLS", "ridge", "lasso", "gradient boosting")) -> DataFrame:
    """Cross-validated RMSE of the mean, OLS, ridge, lasso and boosting on the same folds, with the penalties that were chosen."""
    d = cut(df.select(entity, F.col(y).cast("double").alias(y), *numeric, *categorical).dropna(subset=[y, *categorical]))
    no_penalty = F.array().cast("array<double>")
    parts = [fold_rmse(mean_baseline(d.withColumn("fold", hash_fold(entity, folds, seed)), y), y, "baseline (mean)").withColumn("penalties", no_penalty)]
    linear = tuple(n for n in names if n != "gradient boosting")
    if linear:
        parts.append(fold_summary(penalised.linear_comparison(d, numeric, categorical, y, entity, folds=folds, seed=seed, names=linear)))
    if "gradient boosting" in names:
        oof = boosted_folds(d, numeric, categorical, y, entity, folds=folds, seed=seed, iterations=iterations)
        parts.append(fold_rmse(oof, y, "gradient boosting").withColumn("penalties", no_penalty))
    return reduce(lambda a, b: a.unionByName(b), parts)


def missing_strategies(df: DataFrame, numeric: list[str], sparse: str, categorical: list[str], y: str, entity: str, *, folds: int = 5, seed: int = 42,
                       iterations: int = 300, native: bool = True) -> DataFrame:
    """One sparse predictor, all ways on the same folds: drop it, impute with indicator, boosting on the missing values as they are;
    and on its reporters only complete cases, the predictor dropped, and boosting again."""
    reporters = df.filter(F.col(sparse).isNotNull() & ~F.isnan(F.col(sparse).cast("double")))
    every = [*numeric, sparse]

    def ols(d, cols, label, sample):
        out = fold_summary(penalised.linear_comparison(d, cols, categorical, y, entity, folds=folds, seed=seed, names=("OLS",)))
        return out.drop("penalties").withColumns({"model": F.lit(label), "sample": F.lit(sample)})

    def boosted(d, sample):
        return fold_rmse(boosted_folds(d, every, categorical, y, entity, folds=folds, seed=seed, iterations=iterations), y, "boosting, missing as it is").withColumn("sample", F.lit(sample))

    parts = [ols(df, numeric, "drop the variable", "all"), ols(df, every, "impute and indicator", "all"),
             ols(reporters, every, "complete cases", "reporters"), ols(reporters, numeric, "drop the variable", "reporters")]
    if native:
        with ThreadPool(2) as pool:  # a scan is short: both samples share the executors
            parts += pool.starmap(boosted, [(df, "all"), (reporters, "reporters")])
    return reduce(lambda a, b: a.unionByName(b), parts)


def permutation_importance(model: PipelineModel, test: DataFrame, features: list[str], y: str, entity: str, *, repeats: int = 20, seed: int = 0,
                           prepare=lambda d: d) -> DataFrame:
    """RMSE increase when one predictor is shuffled, over ``repeats`` shuffles per predictor.

    A shuffle pairs each row's position with the row at the same place in a hash order; every repeat
    and predictor is scored in the same job. ``prepare`` adds the columns that the model reads.
    """
    t = cut(test)
    at = cut(ordering.row_positions(t.select(entity), [], [entity]).select(entity, "position"))
    base = t.join(at, entity)
    reps = t.select(entity, *features, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")).withColumn("_h", hash32(seed, "rep", entity))
    order = ordering.row_positions(reps.select("rep", "_h", entity), ["rep"], ["_h", entity]).select("rep", entity, "position")
    donors = cut(order.join(t.select(entity, *[F.col(f).alias(f"_d_{f}") for f in features]), entity).drop(entity))
    scored = base.join(donors, "position")
    start = errors(model.transform(prepare(t)), y).select("rmse").collect()[0][0]
    parts = []
    for f in features:
        p = model.transform(prepare(scored.withColumn(f, F.col(f"_d_{f}"))))
        per = p.groupBy("rep").agg((F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(y), 2))) - start).alias("up"))
        parts.append(per.agg(F.avg("up").alias("rmse_increase"), F.stddev_pop("up").alias("sd")).select(F.lit(f).alias("feature"), "rmse_increase", "sd"))
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- binary classification -------------------------------------------------------------------

def binary_metrics(df: DataFrame, y: str, p: str, groups: list[str] | None = None) -> DataFrame:
    """AUC by ranks (ties count half), Brier score and log loss."""
    gs = groups or []
    c = ordering.value_counts(df, gs, p, {"pos": F.sum(F.col(y).cast("long"))}).withColumn("neg", F.col("n") - F.col("pos"))
    r = ordering.running(c, gs, ["_value"], ["pos", "neg"])
    auc = ratio(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.sum("pos").cast("double") * F.sum("neg"))
    q = F.least(F.greatest(F.col("_value"), F.lit(1e-15)), F.lit(1 - 1e-15))
    brier = F.sum(F.col("pos") * F.pow(1 - F.col("_value"), 2) + F.col("neg") * F.pow(F.col("_value"), 2))
    loss = -F.sum(F.col("pos") * F.log(q) + F.col("neg") * F.log(1 - q))
    return r.groupBy(*gs).agg(F.sum("n").alias("n"), auc.alias("auc"), ratio(brier, F.sum("n")).alias("brier"), ratio(loss, F.sum("n")).alias("log_loss"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean predicted against observed share in quantile bins."""
    b = ordering.quantile_bins(df.select(y, p), [], p, bins, "bin")
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed"))


def subgroup_audit(df: DataFrame, by: str, y: str, p: str, bins: int = 3, threshold: float = 0.5) -> DataFrame:
    """Base rate, mean predicted, false-positive and false-negative rate per quantile group of ``by``."""
    b = ordering.quantile_bins(df.filter(F.col(by).isNotNull()), [], by, bins, "group")
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    g = b.groupBy("group").agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("base_rate"), F.avg(p).alias("mean_predicted"),
                               F.count_if(hit & ~pos).alias("_fp"), F.count_if(~pos).alias("_neg"), F.count_if(~hit & pos).alias("_fn"), F.count_if(pos).alias("_pos"))
    return g.select("group", "n", "base_rate", "mean_predicted", ratio("_fp", F.greatest(F.col("_neg"), F.lit(1))).alias("false_positive_rate"),
                    ratio("_fn", F.greatest(F.col("_pos"), F.lit(1))).alias("false_negative_rate"))


PROBABILITY = vector_to_array


def classification_models(numeric: list[str], categorical: list[str], y: str, n_train: int, seed: int = 42) -> dict[str, list]:
    """Unit penalty strength: 1 / n_train in Spark's scale, where the loss is a mean."""
    lab = dict(featuresCol="_x", labelCol=y)
    return {"logistic": [*preparation(numeric, categorical, indicators=False), LogisticRegression(**lab, regParam=1 / max(1, n_train), standardization=False)]}


def classify_oof(df: DataFrame, numeric: list[str], categorical: list[str], y: str, entity: str, model: str, *, folds: int = 5, seed: int = 42,
                 iterations: int = 300, carry: tuple[str, ...] = ()) -> DataFrame:
    """Out-of-fold probabilities of one model on stratified folds: (entity, y, p, carried columns)."""
    cols = list(dict.fromkeys([entity, y, *numeric, *categorical, *carry]))
    d = stratified_folds(df.select(*cols).withColumn(y, F.col(y).cast("double")), y, entity, folds, seed)
    if model == "gradient boosting":
        d = cut(d)
        oof = trees.fit_folds(d, numeric, categorical, y, boosting(GBTClassifier, y, seed, iterations), folds, binary=True).transform(d)
    else:
        d = few_files(with_indicators(d, numeric))
        stages = classification_models(numeric, categorical, y, d.count() * (folds - 1) // folds, seed)[model]
        oof = out_of_fold(d, stages, folds, F.get(vector_to_array("probability"), F.lit(1)))
    return cut(oof.select(entity, y, "fold", "p", *[c for c in carry if c not in (entity, y)]))


def prevalence_metrics(df: DataFrame, y: str) -> DataFrame:
    """The scores of always predicting the prevalence."""
    p = F.avg(F.col(y).cast("double"))
    g = df.agg(F.count(y).alias("n"), p.alias("m"))
    m = F.col("m")
    return g.select("n", F.lit(0.5).alias("auc"), (m * (1 - m)).alias("brier"), (-(m * F.log(m) + (1 - m) * F.log(1 - m))).alias("log_loss"))


def standardised_coefficients(df: DataFrame, numeric: list[str], categorical: list[str], y: str, seed: int = 42) -> DataFrame:
    """Logistic coefficients per standard deviation, largest magnitude first; a level's is against the reference level."""
    d = cut(df.select(*numeric, *categorical, F.col(y).cast("double").alias(y)))
    model = Pipeline(stages=classification_models(numeric, categorical, y, d.count(), seed)["logistic"]).fit(d)
    levels = [f"{s.getInputCol()}={level}" for s in model.stages if isinstance(s, StringIndexerModel) for level in s.labels[:-1]]
    coef = model.stages[-1].coefficients.toArray()
    rows = sorted(((n, float(c)) for n, c in zip([*numeric, *levels], coef, strict=True)), key=lambda r: -abs(r[1]))
    return df.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "rank int, feature string, log_odds_per_sd double")
