"""Estimators by key, and fold-aware evaluation.

A key gives an estimator: ``fit(df, features, target, ...)`` returns a fitted model,
whose ``scored(df)`` adds column p to all rows: the probability of class 1, a score or a
predicted number. Estimators of pyspark.ml are fitted on all rows; those of
``estimators`` on at most SAMPLE rows, chosen by hash (a documented bound), and applied
to all rows in batches; series models see the last SAMPLE values of the target.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.control import estimators as E
from tarnwell.control.boosting import BoostedOnAllRows
from tarnwell.control.estimators import cox_ph, isolation_scores  # noqa: F401
from tarnwell.operators import metrics, survival
from tarnwell.operators.running import ranked

SAMPLE = 5000
#: Fewer and longer steps than the sampled fit takes, as each level is a pass over all rows.
FOCAL_ROUNDS, FOCAL_RATE = 20, 0.4


@dataclass
class Fitted:
    """add: what gives a frame its column p."""

    add: Callable[[DataFrame], DataFrame]

    def scored(self, df: DataFrame) -> DataFrame:
        return self.add(df)


@dataclass
class OnAllRows:
    """A pyspark.ml estimator behind an assembler; of classifiers p is the probability of class 1."""

    make: Callable[[int], object]
    classifies: bool = False
    scaled: bool = False
    signed: bool = False  # labels as -1 and 1, the answer as 0 or 1
    weighted: bool = False  # rows of the rarer class count more
    alpha: float | None = None  # strength of a ridge on sums of squares, as others state it; Spark's is for means
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], target: str, time: str | None = None, key: Sequence[str] = ()) -> Fitted:
        stages: list = [VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")]
        if self.scaled:
            stages.append(StandardScaler(inputCol="__x", outputCol="__z", withMean=True))
        estimator = self.make(self.seed).setFeaturesCol("__z" if self.scaled else "__x").setLabelCol("__y").setPredictionCol("__p")
        if isinstance(estimator, C.MultilayerPerceptronClassifier):
            estimator = estimator.setLayers([len(features), 32, 2])
        if self.alpha is not None:
            # Spark divides the label, and with it this strength, by the label's deviation.
            n, spread = df.agg(F.count(target), F.stddev_pop(F.col(target).cast("double"))).first()
            estimator = estimator.setRegParam(self.alpha / max(1, n) * (spread or 1.0) * (2 if self.signed else 1)).setStandardization(False)
        if self.weighted:
            estimator = estimator.setWeightCol("__w")
            sizes = df.groupBy(F.col(target).alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
            total = sizes.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
            df = df.join(F.broadcast(sizes.join(F.broadcast(total))), F.col(target) == F.col("__of")).withColumn("__w", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__of", "__n", "__all", "__k")
        y = F.col(target).cast("double")
        model = Pipeline(stages=[*stages, estimator]).fit(df.withColumn("__y", 2 * y - 1 if self.signed else y))
        p: Column = F.col("__p")
        if self.classifies:
            p = vector_to_array("probability")[1]
        elif self.signed:
            p = (F.col("__p") > 0).cast("double")
        return Fitted(lambda rows: model.transform(rows).withColumn("p", p).select(*rows.columns, "p"))


@dataclass
class OnSample:
    """A numpy model."""

    make: Callable[[int], object]
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], target: str, time: str | None = None, key: Sequence[str] = ()) -> Fitted:
        columns = [*features, target]
        drawn = df.select(*columns, F.xxhash64(*(key or columns), F.lit(self.seed)).alias("__draw")).orderBy("__draw", *columns).limit(SAMPLE)
        rows = np.array([r[:-1] for r in drawn.collect()], float).reshape(-1, len(columns))
        model = self.make(self.seed).fit(rows[:, :-1], rows[:, -1]) if len(rows) else None

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.stack(x.to_list()).astype(float)) if len(x) else np.zeros(0))

        p = predicted(F.array(*[F.col(c).cast("double") for c in features])) if model else F.lit(None).cast("double")
        return Fitted(lambda of: of.withColumn("p", p))


@dataclass
class OnRiskSets:
    """Proportional hazards over all rows, features standardised over all rows; p is the linear predictor, higher for earlier events."""

    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], target: str, time: str | None = None, key: Sequence[str] = ()) -> Fitted:
        moments = df.agg(*[e for c in features for e in (F.avg(c), F.stddev_pop(c))]).first()
        scaled = [((F.col(c) - F.lit(moments[2 * i] or 0.0)) / F.lit(moments[2 * i + 1] or 1.0)).alias(f"x{i}") for i, c in enumerate(features)]
        names = [f"x{i}" for i in range(len(features))]
        beta = survival.cox_coefficients(df.select(*scaled, F.col(target).alias("t")), names, "t")
        p = sum((float(b) * ((F.col(c) - F.lit(moments[2 * i] or 0.0)) / F.lit(moments[2 * i + 1] or 1.0)) for i, (c, b) in enumerate(zip(features, beta, strict=True))), F.lit(0.0))
        return Fitted(lambda of: of.withColumn("p", p))


@dataclass
class Boosted:
    """Trees on the focal loss, fitted on all rows."""

    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], target: str, time: str | None = None, key: Sequence[str] = ()) -> Fitted:
        model = BoostedOnAllRows(rounds=FOCAL_ROUNDS, rate=FOCAL_RATE).fit(df, features, target)
        return Fitted(lambda of: of.withColumn("p", model.column(features)))


@dataclass
class OnSeries:
    """A forecast by step: the rows to score are the steps after the fitted ones, in time order."""

    make: Callable[[np.ndarray], tuple[list[float], float]]
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], target: str, time: str | None = None, key: Sequence[str] = ()) -> Fitted:
        if not time:
            raise ValueError("a series model needs a time column")
        tail = df.where(F.col(target).isNotNull()).orderBy(F.desc(time), *key).select(F.col(target).cast("double")).limit(SAMPLE)
        pattern, slope = self.make(np.array([r[0] for r in tail.collect()][::-1], float))
        at = F.element_at(F.array(*map(F.lit, pattern)), (F.pmod(F.col("__step"), F.lit(len(pattern))) + 1).cast("int"))
        return Fitted(lambda of: ranked(of, time, then=key, name="__step").withColumn("p", at + F.lit(slope) * F.col("__step")).drop("__step"))


@dataclass
class Blend:
    """The mean of members' probabilities, or a logistic regression on them, fitted on the half of the rows that they are not fitted on."""

    members: tuple[str, ...]
    stacked: bool = False
    resampled: bool = False  # each member sees rows with Poisson-like multiplicities
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], target: str, time: str | None = None, key: Sequence[str] = ()) -> Fitted:
        drawn = lambda seed: F.pmod(F.xxhash64(*(key or [*features, target]), F.lit(seed)), F.lit(1000))
        half = drawn(self.seed) < 500
        own = df.where(half) if self.stacked else df
        fits = []
        for i, member in enumerate(self.members):
            rows = own
            if self.resampled:
                times = sum(((drawn(self.seed + 17 * (i + 1)) >= cut).cast("int") for cut in (368, 736, 920, 981, 996)), F.lit(0))
                rows = own.withColumn("__times", F.explode(F.array_repeat(F.lit(1), times))).drop("__times")
            fits.append(build(member, features, target, self.seed + i).fit(rows, time, key))
        names = [f"__m{i}" for i in range(len(fits))]

        def members(of: DataFrame) -> DataFrame:
            for name, fit in zip(names, fits, strict=True):
                of = fit.scored(of).withColumnRenamed("p", name)
            return of

        if not self.stacked:
            return Fitted(lambda of: members(of).withColumn("p", sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names))
        meta = OnAllRows(lambda seed: C.LogisticRegression(regParam=1e-3), classifies=True).fit(members(df.where(~half)), names, target)
        return Fitted(lambda of: meta.scored(members(of)).drop(*names))


def _logistic(net: float = 0.0) -> OnAllRows:
    return OnAllRows(lambda seed: C.LogisticRegression(regParam=1e-3, elasticNetParam=net), classifies=True)


def _boosted(**more) -> OnAllRows:
    return OnAllRows(lambda seed: C.GBTClassifier(maxIter=30, seed=seed), classifies=True, **more)


def _boosted_regressor() -> OnAllRows:
    return OnAllRows(lambda seed: R.GBTRegressor(maxIter=30, seed=seed))


def _linear(net: float, strength: float = 1e-3) -> OnAllRows:
    return OnAllRows(lambda seed: R.LinearRegression(regParam=strength, elasticNetParam=net))


#: What makes an estimator. Keys are those of the task descriptions (fixed values); extra_trees is a forest without resampling, an approximation.
MODELS: dict[str, Callable[[], object]] = {
    "logreg": _logistic,
    "logreg_l1": lambda: _logistic(1.0),
    "logreg_elastic": lambda: _logistic(0.5),
    "ridge_classifier": lambda: OnAllRows(lambda seed: R.LinearRegression(), signed=True, alpha=1.0),
    "decision_tree": lambda: OnAllRows(lambda seed: C.DecisionTreeClassifier(maxDepth=8, seed=seed), classifies=True),
    "random_forest": lambda: OnAllRows(lambda seed: C.RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed), classifies=True),
    "extra_trees": lambda: OnAllRows(lambda seed: C.RandomForestClassifier(numTrees=50, maxDepth=8, subsamplingRate=1.0, bootstrap=False, seed=seed), classifies=True),
    "lgbm_binary": _boosted,
    "lgbm_weighted": lambda: _boosted(weighted=True),
    "lgbm_focal": Boosted,
    "xgboost_focal": Boosted,
    "mlp_tabular": lambda: OnAllRows(lambda seed: C.MultilayerPerceptronClassifier(maxIter=100, seed=seed), classifies=True, scaled=True),
    "naive_bayes": lambda: OnAllRows(lambda seed: C.NaiveBayes(modelType="gaussian"), classifies=True),
    "voting_soft": lambda: Blend(("logreg", "random_forest", "lgbm_binary")),
    "bagging": lambda: Blend(("decision_tree",) * 10, resampled=True),
    "stacked_blend": lambda: Blend(("logreg", "random_forest", "lgbm_binary"), stacked=True),
    "ridge": lambda: OnAllRows(lambda seed: R.LinearRegression(), alpha=1.0),
    "ridge_lagged": lambda: OnAllRows(lambda seed: R.LinearRegression(), alpha=1.0),
    "elasticnet": lambda: _linear(0.5, 1e-2),
    "random_forest_regressor": lambda: OnAllRows(lambda seed: R.RandomForestRegressor(numTrees=50, maxDepth=8, seed=seed)),
    "extra_trees_regressor": lambda: OnAllRows(lambda seed: R.RandomForestRegressor(numTrees=50, maxDepth=8, subsamplingRate=1.0, bootstrap=False, seed=seed)),
    "lgbm_regressor": _boosted_regressor,
    "lgbm_survival": _boosted_regressor,
    "permutation_importance": _boosted_regressor,
    "lgbm_aft": lambda: OnAllRows(lambda seed: _Uncensored()),
    "mlp_tabular_regressor": lambda: OnSample(lambda seed: E.MlpRegressor(seed=seed)),
    "cox_ph": OnRiskSets,
    "isolation_forest": lambda: OnSample(lambda seed: E.IsolationForest(seed)),
    "lof": lambda: OnSample(lambda seed: E.LocalOutlierFactor()),
    "ocsvm": lambda: OnSample(lambda seed: E.OneClassSvm()),
    "autoencoder_anomaly": lambda: OnSample(lambda seed: E.Reconstruction()),
    "naive_seasonal": lambda: OnSeries(E.naive_seasonal),
    "theta": lambda: OnSeries(E.theta),
    "ets": lambda: OnSeries(E.ets),
}
#: Keys that need libraries this engine does without.
UNAVAILABLE = ("xgboost_binary", "xgboost_regressor", "catboost_binary", "catboost_regressor", "ft_transformer", "tabnet", "random_survival_forest", "prophet")


def _Uncensored():
    """An accelerated-failure-time estimator whose events are all observed."""

    class Uncensored(R.AFTSurvivalRegression):
        def _fit(self, df: DataFrame):
            return super()._fit(df.withColumn("__seen", F.lit(1.0)).where(F.col("__y") > 0))

    return Uncensored(censorCol="__seen")


@dataclass
class Task:
    """An estimator with the columns that it is for."""

    estimator: OnAllRows | OnSample | OnSeries | OnRiskSets | Boosted | Blend
    features: list[str]
    target: str

    def fit(self, df: DataFrame, time: str | None = None, key: Sequence[str] = ()) -> Fitted:
        return self.estimator.fit(df, self.features, self.target, time, key)


def build(key: str, features: list[str], target: str, seed: int = 0) -> Task:
    """The estimator of a key for these columns; KeyError for unknown or unavailable keys."""
    if key not in MODELS:
        raise KeyError(f"model {key!r} is {'unavailable' if key in UNAVAILABLE else 'unknown'}")
    estimator = MODELS[key]()
    estimator.seed = seed
    return Task(estimator, features, target)


def available(allowed: Sequence[str]) -> list[str]:
    """Those of the allowed keys that build."""
    return sorted(k for k in allowed if k in MODELS)


def prepared(df: DataFrame, features: list[str], target: str, median: bool = False) -> DataFrame:
    """Numbers as double, unknown and NaN as 0 or as the column's exact median, rows without a target left out."""
    rows = df.where(F.col(target).isNotNull()).withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features} | {target: F.col(target).cast("double")})
    return imputed(rows, features) if median else rows.fillna(0.0, subset=features)


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unknown values as the column's median, of all columns by one count of values; 0 for a column without any."""
    from tarnwell.operators.running import quantiles

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("d")) for c in columns])).alias("v")).select("v.*")
    cells = long.where(F.col("d").isNotNull() & ~F.isnan("d")).groupBy("column", "d").agg(F.count(F.lit(1)).alias("n"))
    middle = {r["column"]: r["quantiles"][0] for r in quantiles(cells, "d", "n", (0.5,), by=["column"]).collect()}
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(middle.get(c, 0.0)))) for c in columns})


def evaluated(rows: DataFrame, names: Sequence[str]) -> dict[str, float | None]:
    """Named metrics of (id, y, p), which are computed once; plain aggregates share a pass, as do those of the best hundredths, and a metric that cannot be computed is None."""
    rows = rows.cache()
    found: dict[str, float | None] = {}
    groups: list[tuple[list[str], Callable[[], dict]]] = []
    if plain := [n for n in names if n in metrics.AGGREGATES]:
        groups.append((plain, lambda: metrics.plain(rows, plain).first().asDict()))
    if top := [n for n in names if n in metrics.TOP]:
        percents = tuple(sorted({metrics.TOP[n][1] for n in top}))
        groups.append((top, lambda: {n: {r["percent"]: r for r in metrics.top_percent(rows, percents).collect()}.get(metrics.TOP[n][1], {metrics.TOP[n][0]: None})[metrics.TOP[n][0]] for n in top}))
    groups += [([n], lambda n=n: {n: metrics.named(n)(rows).first()[0]}) for n in names if n not in (*plain, *top) and metrics.named(n)]
    for of, compute in groups:
        try:
            found |= compute()
        except (ArithmeticError, TypeError, ValueError):
            found |= dict.fromkeys(of)
    rows.unpersist()
    return {n: found.get(n) for n in names}


def population(rows: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """The same metrics over the whole table, each name with _pop; those that cannot be computed are left out."""
    return {f"{n}_pop": float(v) for n, v in evaluated(rows, names).items() if v is not None}


def judged(fit: Fitted, rows: DataFrame, target: str, key: Sequence[str]) -> DataFrame:
    number = F.xxhash64(*(key or rows.columns))
    return fit.scored(rows).select(number.alias("id"), F.col(target).alias("y"), "p")


def cross_validate(df: DataFrame, features: list[str], target: str, key: str, fold: str, names: tuple[str, ...], seed: int = 0, time: str | None = None, row_key: Sequence[str] = ()) -> dict[str, float | None]:
    """Means over folds of the validation metrics; folds without a metric are left out of its mean."""
    df = prepared(df, features, target).cache()
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    found = []
    for k in folds:
        fit = build(key, features, target, seed + int(k)).fit(df.where(F.col(fold) != k), time, row_key)
        found.append(evaluated(judged(fit, df.where(F.col(fold) == k), target, row_key), names))
    df.unpersist()
    return mean_of(found, names)


def mean_of(found: list[dict[str, float | None]], names: Sequence[str]) -> dict[str, float | None]:
    means = {n: [f[n] for f in found if f[n] is not None] for n in names}
    return {n: float(np.mean(v)) if v else None for n, v in means.items()}


@dataclass
class Split:
    """Folds as rows of (key, fold, role)."""

    rows: DataFrame
    key: list[str]
    folds: list[int] = field(default_factory=list)


def train_and_validate(df: DataFrame, split: Split, features: list[str], target: str, key: str, names: Sequence[str], seed: int = 0, time: str | None = None, train_names: Sequence[str] = ()) -> tuple[dict[str, float | None], dict[str, float | None]]:
    """Mean metrics over the folds of a split: of validation rows, and the train_names of the rows fitted on."""
    joined = prepared(df, features, target).join(split.rows, split.key).cache()
    folds = split.folds or sorted(r[0] for r in joined.select("fold").distinct().collect())
    valid, train = [], []
    for k in folds:
        own = joined.where((F.col("fold") == k) & (F.col("role") == "train"))
        fit = build(key, features, target, seed + int(k)).fit(own, time, split.key)
        valid.append(evaluated(judged(fit, joined.where((F.col("fold") == k) & (F.col("role") == "valid")), target, split.key), names))
        if train_names:
            train.append(evaluated(judged(fit, own, target, split.key), train_names))
    joined.unpersist()
    return mean_of(valid, names), mean_of(train, train_names)


def treatment_effect(df: DataFrame, treatment: str, outcome: str, covariates: list[str], resamples: int = 50, seed: int = 0) -> dict[str, float]:
    """Least-squares effect of a treatment given covariates, with a 5 to 95 % interval from Poisson resamples.

    One aggregate gathers the weighted cross products of every resample, so the rows are
    read once and what reaches the driver depends on columns and resamples only.
    """
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in (treatment, *covariates[:8])], F.col(outcome).cast("double")]
    d = len(terms)
    u = lambda i: (F.pmod(F.xxhash64(*df.columns, F.lit(seed * 1000 + i)), F.lit(2**40)) + 0.5) / float(2**40)
    cuts = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1)) or 1) for k in range(8)])
    weights = {f"w{i}": sum(((u(i) > float(c)).cast("double") for c in cuts), F.lit(0.0)) for i in range(1, resamples + 1)} | {"w0": F.lit(1.0)}
    rows = df.dropna(subset=[treatment, outcome, *covariates[:8]]).withColumns(weights)
    sums = rows.agg(*[F.sum(F.col(f"w{w}") * terms[i] * terms[j]).alias(f"s{w}_{i}_{j}") for w in range(resamples + 1) for i in range(d) for j in range(i, d)]).first()
    effects = []
    for w in range(resamples + 1):
        m = np.array([[sums[f"s{w}_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
        effects.append(float(np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0][1]))
    return {"effect": effects[0], "low": float(np.quantile(effects[1:], 0.05)), "high": float(np.quantile(effects[1:], 0.95))}
