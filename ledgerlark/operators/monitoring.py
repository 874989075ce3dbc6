"""Distribution drift and model quality over long tables.

Samples are frames (feature, value, cur): ``cur`` tells the current sample from the reference. Statistics are sums and windows
a feature; empirical distributions are counted by distinct value before any window, so a feature's window holds its distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.order import quantiles

LEVELS = ("none", "low", "medium", "high")


def level(x: Column, low: float, medium: float, high: float) -> Column:
    return F.when(x < low, "none").when(x < medium, "low").when(x < high, "medium").otherwise("high")


def level_of_p(p: Column) -> Column:
    return F.when(p > 0.05, "none").when(p > 0.01, "low").when(p > 0.001, "medium").otherwise("high")


def rank_of(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), severity) - 1


def _shares(binned: DataFrame) -> DataFrame:
    """ref and cur shares of each (feature, bin) that has rows."""
    n = binned.groupBy("feature", "bin").agg(F.count_if(~F.col("cur")).alias("r"), F.count_if("cur").alias("c"))
    w = Window.partitionBy("feature")
    return n.select("feature", "bin", (F.col("r") / F.sum("r").over(w)).alias("p"), (F.col("c") / F.sum("c").over(w)).alias("q"))


def psi(samples: DataFrame, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index over bins at the quantiles of both samples together, the last closed on the right."""
    edges = quantiles(samples, "feature", "value", [k / bins for k in range(bins + 1)]).select("feature", F.array_distinct("q").alias("edges"))
    x = samples.join(edges, "feature")
    at = F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))), F.size("edges") - 1)
    s = _shares(x.withColumn("bin", at)).withColumn("p", F.col("p") + eps).withColumn("q", F.col("q") + eps)
    out = s.groupBy("feature").agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    return out.withColumn("severity", level(F.col("psi"), 0.1, 0.25, 0.5))


def _steps(samples: DataFrame) -> DataFrame:
    """Both empirical distribution functions at each distinct value, and the step to the next."""
    n = samples.groupBy("feature", "value").agg(F.count_if(~F.col("cur")).alias("r"), F.count_if("cur").alias("c"))
    w = Window.partitionBy("feature").orderBy("value")
    so_far, every = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("feature")
    x = n.withColumn("nr", F.sum("r").over(every)).withColumn("nc", F.sum("c").over(every))
    gap = F.sum("r").over(so_far) / F.col("nr") - F.sum("c").over(so_far) / F.col("nc")
    return x.select("feature", "value", "nr", "nc", gap.alias("gap"), (F.lead("value").over(w) - F.col("value")).alias("step"))


def ks(samples: DataFrame, terms: int = 20) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic, and its asymptotic p-value by the series of ``terms`` terms."""
    x = _steps(samples).groupBy("feature").agg(F.max(F.abs("gap")).alias("ks"), F.max("nr").alias("nr"), F.max("nc").alias("nc"))
    y = -2 * F.col("ks") * F.col("ks") * F.col("nr") * F.col("nc") / (F.col("nr") + F.col("nc"))
    p = F.lit(0.0)
    for k in range(1, terms + 1):
        p = p + (2.0 if k % 2 else -2.0) * F.exp(y * (k * k))
    return x.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))).withColumn("severity", level_of_p(F.col("p_value"))).drop("nr", "nc")


def wasserstein(samples: DataFrame) -> DataFrame:
    """Earth mover's distance, and the same over the reference's deviation."""
    x = _steps(samples).groupBy("feature").agg(F.sum(F.abs("gap") * F.coalesce("step", F.lit(0.0))).alias("distance"))
    s = samples.where(~F.col("cur")).groupBy("feature").agg(F.stddev_pop("value").alias("s"))
    x = x.join(s, "feature").withColumn("normalised", F.when(F.col("s") > 0, F.col("distance") / F.col("s")).otherwise(0.0))
    return x.drop("s").withColumn("severity", level(F.col("normalised"), 0.1, 0.3, 0.5))


def js_distance(samples: DataFrame, bins: int = 20) -> DataFrame:
    """Jensen-Shannon distance (base 2) over equal bins of both samples' range."""
    span = samples.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    s = _shares(samples.join(span, "feature").withColumn("bin", at)).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("m"))).otherwise(0.0)
    x = s.groupBy("feature").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(part("p") + part("q")) / 2)).alias("js"))
    return x.withColumn("severity", level(F.col("js"), 0.02, 0.05, 0.1))


def prediction_drift(samples: DataFrame) -> DataFrame:
    """The worse of PSI and KS, and the shift of the mean in per cent."""
    a = psi(samples).withColumnRenamed("severity", "s1")
    b = ks(samples).withColumnRenamed("severity", "s2")
    m = samples.groupBy("feature").agg(F.avg(F.when(~F.col("cur"), F.col("value"))).alias("r"), F.avg(F.when(F.col("cur"), F.col("value"))).alias("c"))
    x = a.join(b, "feature").join(m, "feature")
    worst = F.element_at(F.array(*map(F.lit, LEVELS)), (F.greatest(rank_of(F.col("s1")), rank_of(F.col("s2"))) + 1).cast("int"))
    return x.select("feature", F.greatest("psi", "ks").alias("statistic"), "p_value", worst.alias("severity"), (F.abs(F.col("c") - F.col("r")) / (F.abs("r") + 1e-10) * 100).alias("mean_shift_pct"))


def classification_metrics(df: DataFrame, key: str, truth: str, guess: str, chance: str | None = None) -> DataFrame:
    """Accuracy, macro precision, recall and F1, weighted F1; with ``chance`` (of class 1) also ROC-AUC by mid-ranks and log loss.

    Confusion counts come first, so classes and not rows meet in the second step; the ranks run over distinct chances.
    """
    n = df.groupBy(key, F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    real = n.groupBy(key, F.col("t").alias("c")).agg(F.sum("n").alias("real"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("hit"))
    said = n.groupBy(key, F.col("g").alias("c")).agg(F.sum("n").alias("said"))
    x = real.join(said, [key, "c"], "full").na.fill(0, ["real", "hit", "said"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    x = x.withColumn("p", ratio(F.col("hit"), F.col("said"))).withColumn("r", ratio(F.col("hit"), F.col("real")))
    x = x.withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    out = x.groupBy(key).agg((F.sum("hit") / F.sum("real")).alias("accuracy"), F.avg("p").alias("precision_macro"), F.avg("r").alias("recall_macro"), F.avg("f").alias("f1_macro"), (F.sum(F.col("f") * F.col("real")) / F.sum("real")).alias("f1_weighted"))
    if chance is None:
        return out
    one = F.col(truth) == 1
    p = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), F.col(chance)))
    loss = df.groupBy(key).agg((-F.avg(F.when(one, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_loss"))
    v = df.groupBy(key, chance).agg(F.count("*").alias("n"), F.count_if(one).alias("pos"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(chance).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("mid", below + (F.col("n") + 1) / 2).groupBy(key).agg(F.sum(F.col("mid") * F.col("pos")).alias("s"), F.sum("pos").alias("n1"), F.sum("n").alias("n"))
    auc = (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / F.nullif(F.col("n1") * (F.col("n") - F.col("n1")), F.lit(0))
    return out.join(loss, key).join(v.select(key, auc.alias("roc_auc")), key)


def regression_metrics(df: DataFrame, key: str, truth: str, guess: str, order: str) -> DataFrame:
    """MAE, MSE, RMSE, R2, explained variance, MAPE (null if a truth is zero), and the share of steps of one direction."""
    w = Window.partitionBy(key).orderBy(order)
    t, e = F.col(truth), F.col(truth) - F.col(guess)
    x = df.withColumn("e", e).withColumn("same", (t - F.lag(truth).over(w)) * (F.col(guess) - F.lag(guess).over(w)) > 0)
    g = x.groupBy(key).agg(F.avg(F.abs("e")).alias("mae"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.var_pop(truth).alias("v"), F.var_pop("e").alias("ve"), F.when(F.count_if(t == 0) == 0, F.avg(F.abs(F.col("e") / t))).alias("mape"), F.avg(F.col("same").cast("double")).alias("directional_accuracy"))
    v = F.nullif("v", F.lit(0.0))
    return g.select(key, "mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.col("mse") / v).alias("r2"), (1 - F.col("ve") / v).alias("explained_variance"), "mape", "directional_accuracy")


# Thresholds of change by the metric's prefix, and whether a fall (-1) or a rise (1) is bad.
ALERTS = [
    ("accuracy", -1, 0.05), ("f1", -1, 0.05), ("precision", -1, 0.05), ("recall", -1, 0.05), ("r2", -1, 0.05), ("directional_accuracy", -1, 0.05), ("roc_auc", -1, 0.05), ("explained_variance", -1, 0.05),
    ("mae", 1, 0.10), ("mse", 1, 0.10), ("rmse", 1, 0.10), ("mape", 1, 0.05), ("log_loss", 1, 0.10),
]


def degradation_alerts(changes: DataFrame) -> DataFrame:
    """Rows of (key columns, metric, change) whose change is past the threshold of a prefix, with that threshold. The table of thresholds is a constant of 13 rows."""
    rules = F.array(*(F.struct(F.lit(p).alias("prefix"), F.lit(s).alias("sign"), F.lit(t).alias("threshold")) for p, s, t in ALERTS))
    x = changes.withColumn("rule", F.explode(rules)).where(F.startswith("metric", F.col("rule.prefix")) & (F.col("change") * F.col("rule.sign") > F.col("rule.threshold")))
    return x.select(*changes.columns, F.col("rule.threshold").alias("threshold"), F.when(F.col("rule.sign") > 0, "increased").otherwise("decreased").alias("direction"))


#: What calls for training a model again.
RETRAINING = {"drift_severity": ("high", "critical"), "performance_drop_pct": 10.0, "days_since_last_retrain": 30, "num_predictions": 10_000}


def retraining_decisions(models: DataFrame, as_of: str) -> DataFrame:
    """Whether each model is to be trained again, and why.

    ``models``: ``drift_severity``, ``performance_drop`` (a share), ``last_retrained`` (a date), ``predictions`` since then. A null is no
    reason; a model that was never trained has -1 days.
    """
    days = F.date_diff(F.lit(as_of).cast("date"), F.col("last_retrained"))
    reasons = F.array_compact(F.array(
        F.when(F.col("drift_severity").isin(*RETRAINING["drift_severity"]), F.concat(F.lit("drift severity: "), F.col("drift_severity"))),
        F.when(F.col("performance_drop") > RETRAINING["performance_drop_pct"] / 100, F.format_string("performance drop: %.1f%%", F.col("performance_drop") * 100)),
        F.when(days > RETRAINING["days_since_last_retrain"], F.concat(F.lit("days since retrain: "), days.cast("string"), F.lit(f" > {RETRAINING['days_since_last_retrain']}"))),
        F.when(F.col("predictions") > RETRAINING["num_predictions"], F.concat(F.lit("predictions since retrain: "), F.col("predictions").cast("string"), F.lit(f" > {RETRAINING['num_predictions']}"))),
    ))
    x = models.withColumn("days_since", F.coalesce(days, F.lit(-1))).withColumn("_why", reasons)
    return x.withColumn("should_retrain", F.size("_why") > 0).withColumn("reason", F.when(F.size("_why") > 0, F.array_join("_why", "; ")).otherwise("No triggers met")).drop("_why")
