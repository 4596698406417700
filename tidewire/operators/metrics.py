"""Metrics of predictions as aggregates, so that any number of models is scored in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, true: str, pred: str, labels: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``by, y_true, y_pred, n`` for every pair of labels, zeros included."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, b) for a in labels for b in labels], "y_true string, y_pred string")
    counts = df.groupBy(*by, F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.select(*by).distinct().crossJoin(F.broadcast(cells)) if by else cells
    return spine.join(counts, [*by, "y_true", "y_pred"], "left").fillna(0, ["n"])


def per_class(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each label from confusion cells; zero where undefined."""
    rows = cells.groupBy(*by, F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    cols = cells.groupBy(*by, F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = rows.join(cols, [*by, "label"])
    zero = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))
    return both.select(*by, "label", zero(F.col("hit"), F.col("predicted")).alias("precision"), zero(F.col("hit"), F.col("support")).alias("recall"), zero(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"), "support", "predicted", "hit")


def classification(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, balanced accuracy over the labels that occur, macro and weighted F1, and kappa."""
    c = per_class(cells, by)
    n = F.sum("support")
    accuracy, expected = F.sum("hit") / n, F.sum(F.col("support") * F.col("predicted")) / (n * n)
    out = [
        accuracy.alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), F.try_divide(accuracy - expected, 1 - expected).alias("kappa"),
    ]
    return c.groupBy(*by).agg(*out)


def regression(df: DataFrame, true: str, pred: str, today: str, by: tuple[str, ...] = ()) -> DataFrame:
    """RMSE, MAE, MAPE in percent and the share of right directions."""
    error = F.col(pred) - F.col(true)
    same = F.signum(F.col(pred) - F.col(today)) == F.signum(F.col(true) - F.col(today))
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (F.avg(F.abs(F.try_divide(error, F.col(true)))) * 100).alias("mape"), F.avg(same.cast("int")).alias("directional_hit"),
    )


def skill(rmse: Column, naive: Column) -> Column:
    return 1 - F.try_divide(rmse, naive)


def mcnemar(better: Column, worse: Column) -> Column:
    """Two-sided exact binomial p of two discordant counts; 1 if there are none."""
    n, k = better + worse, F.least(better, worse)
    # log C(n, i), built up from i = 0; the tail is summed in the same fold.
    start = F.struct(F.lit(0.0).alias("logc"), F.lit(1.0).alias("tail"))
    step = lambda acc, i: F.struct((acc["logc"] + F.ln((n - i + 1) / i)).alias("logc"), (acc["tail"] + F.exp(acc["logc"] + F.ln((n - i + 1) / i))).alias("tail"))
    folded = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), start, step)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * folded["tail"] * F.pow(F.lit(0.5), n)))


def contingency(df: DataFrame, base: str, candidate: str, by: tuple[str, ...] = ()) -> DataFrame:
    """How often a candidate helped, hurt, and both were right or wrong, with the exact test."""
    b, c = F.col(base), F.col(candidate)
    counts = df.groupBy(*by).agg(
        F.count_if(~b & c).alias("helped"), F.count_if(b & ~c).alias("hurt"), F.count_if(b & c).alias("both_right"), F.count_if(~b & ~c).alias("both_wrong")
    )
    return counts.withColumn("p", mcnemar(F.col("helped"), F.col("hurt")))


def guarded_correlation(a: Column, b: Column) -> Column:
    """Pearson over rows where both are given; null for fewer than three or without variance."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    fit = (F.count(x) > 2) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(fit, F.corr(x, y))


def average_rank(value: str, *by: str) -> Column:
    """Rank with equal values sharing their mean rank."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    return both.select(average_rank("a").alias("ra"), average_rank("b").alias("rb")).agg(F.corr("ra", "rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight``: rows over classes times the rows of the class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))


def regimes(df: DataFrame, value: str) -> DataFrame:
    """Adds ``regime``: high from the upper quartile on, low up to the lower one."""
    q = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    high, low = F.col(value) >= F.col("_q")[1], F.col(value) <= F.col("_q")[0]
    return df.crossJoin(F.broadcast(q)).withColumn("regime", F.when(high, "high").when(low, "low").when(F.col(value).isNotNull(), "medium")).drop("_q")


def fusion_grid(df: DataFrame, split: str, true: str, a: tuple[str, ...], b: tuple[str, ...], labels: tuple[str, ...], steps: int = 20) -> DataFrame:
    """Macro F1 of mixing two sets of class probabilities, for every weight of the first in one job: ``split, w, macro_f1``."""
    weights = df.sparkSession.range(steps + 1).select((F.col("id") / steps).alias("w"))
    mixed = df.crossJoin(F.broadcast(weights))
    scores = F.array(*[F.col("w") * F.col(x) + (1 - F.col("w")) * F.col(y) for x, y in zip(a, b, strict=True)])
    best = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(scores, F.array_max(scores)).cast("int"))
    cells = confusion(mixed.withColumn("_pred", best), true, "_pred", labels, (split, "w"))
    return per_class(cells, (split, "w")).groupBy(split, "w").agg(F.avg("f1").alias("macro_f1"))


def regression_grid(df: DataFrame, split: str, true: str, a: str, b: str, steps: int = 20) -> DataFrame:
    """RMSE of mixing two predictions, for every weight of the first in one job: ``split, w, rmse``."""
    weights = df.sparkSession.range(steps + 1).select((F.col("id") / steps).alias("w"))
    error = F.col("w") * F.col(a) + (1 - F.col("w")) * F.col(b) - F.col(true)
    return df.crossJoin(F.broadcast(weights)).groupBy(split, "w").agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def late_fusion(df: DataFrame, split: str, true: str, a: tuple[str, ...], b: tuple[str, ...], value: str, ra: str, rb: str, labels: tuple[str, ...], choose_on: str = "val", steps: int = 20) -> DataFrame:
    """``split, w_clf, w_reg, macro_f1, rmse`` with the weights chosen on one split.

    The weight of the first model with the best macro F1, and the one with the
    least RMSE; of equally good ones the largest. Scores count as equal within
    nine digits.
    """
    clf = fusion_grid(df, split, true, a, b, labels, steps).withColumn("macro_f1", F.round("macro_f1", 9))
    reg = regression_grid(df, split, value, ra, rb, steps).withColumn("rmse", F.round("rmse", 9))
    at = F.col(split) == choose_on
    w_clf = clf.filter(at).agg(F.max_by("w", F.struct("macro_f1", "w")).alias("w_clf"))
    w_reg = reg.filter(at).agg(F.min_by("w", F.struct(F.col("rmse"), (-F.col("w")).alias("v"))).alias("w_reg"))
    best_clf = clf.join(F.broadcast(w_clf), F.col("w") == F.col("w_clf")).select(split, "w_clf", "macro_f1")
    best_reg = reg.join(F.broadcast(w_reg), F.col("w") == F.col("w_reg")).select(split, "w_reg", "rmse")
    return best_clf.join(best_reg, split)


def pivoted(df: DataFrame, row: str, column: str, value: str, columns: tuple[str, ...]) -> DataFrame:
    """One row per ``row``, a column for each of ``columns``."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.max(value))


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """``step, stage, rows, dropped`` of frames that follow each other."""
    counts = None
    for i, (name, df) in enumerate(stages):
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    w = Window.orderBy("step")
    return counts.withColumn("dropped", F.coalesce(F.lag("rows").over(w) - F.col("rows"), F.lit(0).cast("bigint")))
