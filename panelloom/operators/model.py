"""Meta-model: a logistic regression of meta-labels on features, scored by purged cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.labels import build_features, meta_labels, triple_barrier
from panelloom.scratch import dropped, written

FEATURES = ["momentum", "volatility", "mean_rev"]
#: Bounds of the fit: steps, and the largest change of a coefficient at which it ends.
STEPS, CLOSE = 50, 1e-10


def training_table(panel: DataFrame, lookback: int = 20, span: int = 50, pt_sl: tuple[float, float] = (1.0, 1.0), horizon: int = 5) -> DataFrame:
    """(asset, pos, t0, t1, meta, features): complete cases only."""
    labels = meta_labels(triple_barrier(panel, horizon, pt_sl, span))
    rows = labels.join(build_features(panel, lookback, span).drop("ts"), ["asset", "pos"])
    return rows.na.drop(subset=FEATURES).select("asset", "pos", "t0", "t1", "meta", *FEATURES)


def fold_table(rows: DataFrame, n_splits: int = 5, embargo: float = 0.0) -> DataFrame:
    """Rows of every (asset, fold) with role, purged around the fold's interval, as one plan over all assets.

    A fold's bounds and the asset's span are window aggregates over the rows, so nothing is read twice; what a
    row meets are the bounds of its asset's folds, a handful.
    """
    asset = Window.partitionBy("asset")
    numbered = rows.withColumns({c: F.unix_seconds(F.col(t).cast("timestamp")) for c, t in (("s0", "t0"), ("s1", "t1"))})
    numbered = numbered.withColumns({"fold": F.ntile(n_splits).over(asset.orderBy("pos")) - 1, "e": (F.max("s1").over(asset) - F.min("s0").over(asset)) * embargo})
    bounds = [F.struct(F.lit(k).alias("split"), F.min(F.when(F.col("fold") == k, F.col("s0"))).over(asset).alias("low"), F.max(F.when(F.col("fold") == k, F.col("s1"))).over(asset).alias("high")) for k in range(n_splits)]
    met = numbered.withColumn("all", F.array(*bounds)).withColumn("b", F.explode("all")).drop("all").filter("b.low is not null")
    free = (F.col("s0") > F.col("b.high") + F.col("e")) | (F.col("s1") < F.col("b.low") - F.col("e"))
    role = F.when(F.col("fold") == F.col("b.split"), "test").when(free, "train")
    return met.withColumn("role", role).filter("role is not null").select("asset", F.col("b.split").alias("split"), "role", "pos", "meta", *FEATURES)


def _solved(df: DataFrame, a: list[list[Column]], g: list[Column]) -> DataFrame:
    """Adds x0, x1, ...: the solution of a symmetric positive definite system a x = g in each row, by Cholesky factors."""
    n = len(g)
    for j in range(n):
        for i in range(j, n):
            rest = a[i][j] - sum((F.col(f"c{i}{k}") * F.col(f"c{j}{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"c{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"c{j}{j}"))
    for i in range(n):
        df = df.withColumn(f"z{i}", (g[i] - sum((F.col(f"c{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"c{i}{i}"))
    for i in reversed(range(n)):
        df = df.withColumn(f"x{i}", (F.col(f"z{i}") - sum((F.col(f"c{k}{i}") * F.col(f"x{k}") for k in range(i + 1, n)), F.lit(0.0))) / F.col(f"c{i}{i}"))
    return df


def logistic_fits(rows: DataFrame, keys: list[str], label: str, features: list[str], penalty: float = 1.0) -> DataFrame:
    """(keys, b0, b1, ...): logistic regressions of all keys at once, by Newton's method on sums.

    Each step is one grouping of the rows, which sums the gradient and the weighted products of the features per
    key, aggregated before the shuffle; then a system of as many equations as features is solved per key.
    The penalty is that of half the squared coefficients, the intercept's left out.  The coefficients of a
    step, a row per key, are a written table; the largest change is all that the driver reads.  Fits that have
    settled stay as they are while others go on.
    """
    m = len(features) + 1
    fits = written(rows.select(*keys).distinct().select(*keys, *[F.lit(0.0).alias(f"b{i}") for i in range(m)], F.lit(1.0).alias("moved")), "fits")
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    for _ in range(STEPS):
        open_ = fits.filter(F.col("moved") >= CLOSE).drop("moved")
        df = rows.join(open_, keys)
        z = sum((F.col(f"b{i}") * x[i] for i in range(1, m)), F.col("b0"))
        df = df.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0)))))
        w, off = F.col("p") * (1 - F.col("p")), F.col(label) - F.col("p")
        sums = [F.sum(x[i] * off).alias(f"g{i}") for i in range(m)] + [F.sum(x[i] * x[j] * w).alias(f"h{i}{j}") for i in range(m) for j in range(i + 1)]
        step = df.groupBy(*keys, *[f"b{i}" for i in range(m)]).agg(*sums)
        ridge = lambda i: F.lit(0.0 if i == 0 else penalty)
        a = [[F.col(f"h{max(i, j)}{min(i, j)}") + (ridge(i) + 1e-12 if i == j else F.lit(0.0)) for j in range(m)] for i in range(m)]
        step = _solved(step, a, [F.col(f"g{i}") - ridge(i) * F.col(f"b{i}") for i in range(m)])
        moved = F.greatest(*[F.abs(f"x{i}") for i in range(m)])
        step = step.select(*keys, *[(F.col(f"b{i}") + F.col(f"x{i}")).alias(f"b{i}") for i in range(m)], moved.alias("moved"))
        then = written(step.unionByName(fits.filter(F.col("moved") < CLOSE)), "fits")
        dropped(fits)
        fits = then
        if not fits.filter(F.col("moved") >= CLOSE).limit(1).count():
            break
    return fits.drop("moved")


def meta_model(panel: DataFrame, lookback: int = 20, span: int = 50, pt_sl: tuple[float, float] = (1.0, 1.0), horizon: int = 5, n_splits: int = 5, embargo: float = 0.0) -> DataFrame:
    """Per asset: n_samples, n_positive, n_negative, folds, cv_accuracy_mean, cv_accuracy_std.

    The training rows are written once; all (asset, fold) pairs are fitted together.  Folds with one class are
    skipped; fewer than two samples per fold give NULL accuracies.
    """
    rows = written(training_table(panel, lookback, span, pt_sl, horizon), "training")
    folds = written(fold_table(rows, n_splits, embargo), "folds")
    keys = ["asset", "split"]
    train = folds.filter("role = 'train'")
    scale = train.groupBy(*keys).agg(F.count_distinct("meta").alias("classes"), *[f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("s", F.stddev_pop))]).filter("classes = 2").drop("classes")
    scaled = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in FEATURES}
    ready = written(folds.join(scale, keys).select(*keys, "role", "meta", *[v.alias(c) for c, v in scaled.items()]), "scaled")
    fits = logistic_fits(ready.filter("role = 'train'"), keys, "meta", FEATURES)
    z = sum((F.col(f"b{i + 1}") * F.col(c) for i, c in enumerate(FEATURES)), F.col("b0"))
    tested = ready.filter("role = 'test'").join(fits, keys)
    accuracy = tested.groupBy(*keys).agg(F.avg(((z > 0) == (F.col("meta") == 1)).cast("double")).alias("accuracy"))
    by_asset = accuracy.groupBy("asset").agg(F.count("accuracy").alias("folds"), F.avg("accuracy").alias("m"), F.stddev_pop("accuracy").alias("s"))
    counts = rows.groupBy("asset").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("meta").cast("long").alias("n_positive"))
    enough = F.col("n_samples") >= 2 * n_splits
    return counts.join(by_asset, "asset", "left").select(
        "asset", "n_samples", "n_positive", (F.col("n_samples") - F.col("n_positive")).alias("n_negative"),
        F.coalesce("folds", F.lit(0)).alias("folds"), F.when(enough, F.col("m")).alias("cv_accuracy_mean"), F.when(enough, F.col("s")).alias("cv_accuracy_std"),
    )
