"""Evaluation.

Confidence bins are assigned by a CASE chain over the bin edges (a
projection, no join), aggregated per bin (map-side combined: at most a few
partial rows per task), and zero-filled by a left join from the full bin
list (a literal array exploded per model group).  The four reference
variants differ in which edges are closed and whether empty bins are shown:

* E1 ``calibration``: 0.5-1.0 by 0.05, right-closed, lowest edge included,
  zero-filled; accuracy and mean confidence in percent, one decimal.
* E2 ``left``: 0-1.0 by 0.1, left-closed, so 1.0 falls out; zero-filled.
* E3 ``top``: 0.5-1.0 by 0.1, right-closed, exactly 0.5 falls out; empty bins hidden.
* E4 ``right``: 0-1.0 by 0.1, right-closed, lowest included, zero-filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN_VARIANTS = {
    # name: (first edge in hundredths, step in hundredths, bins, closed, include_lowest, zero_fill)
    "calibration": (50, 5, 10, "right", True, True),
    "left": (0, 10, 10, "left", True, True),
    "top": (50, 10, 5, "right", False, False),
    "right": (0, 10, 10, "right", True, True),
}


def bin_edges(variant: str) -> list[tuple[int, float, float, str]]:
    """The bin domain: (bin_no, lo, hi, label) with labels like ``55-60%``."""
    start, step, n, *_ = BIN_VARIANTS[variant]
    return [(i, (start + i * step) / 100.0, (start + (i + 1) * step) / 100.0,
             f"{start + i * step}-{start + (i + 1) * step}%") for i in range(n)]


def bin_number(c, variant: str):
    """Bin index of confidence ``c`` (null when it falls outside)."""
    start, step, n, closed, lowest, _ = BIN_VARIANTS[variant]
    c = F.col(c) if isinstance(c, str) else c
    expr = None
    for i in range(n):
        lo, hi = (start + i * step) / 100.0, (start + (i + 1) * step) / 100.0
        if closed == "right":
            cond = (c > F.lit(lo)) & (c <= F.lit(hi))
            if i == 0 and lowest:
                cond = (c >= F.lit(lo)) & (c <= F.lit(hi))
        else:
            cond = (c >= F.lit(lo)) & (c < F.lit(hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def confidence_bins(scored: DataFrame, variant: str, conf: str = "confidence", correct: str = "correct",
                    group_cols=("model",), percent: bool = False) -> DataFrame:
    """Per (group, bin): accuracy, count (and mean confidence in percent for E1)."""
    zero_fill = BIN_VARIANTS[variant][5]
    edges = bin_edges(variant)
    b = scored.withColumn("bin_no", bin_number(conf, variant)).where(F.col("bin_no").isNotNull())
    agg = b.groupBy(*group_cols, "bin_no").agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col(correct).cast("double")).alias("acc"),
        F.avg(conf).alias("conf"))
    if zero_fill:
        # every group gets the full bin list (a literal array, exploded)
        domain = F.array(*[F.lit(i) for i, *_ in edges])
        if group_cols:
            base = scored.select(*group_cols).distinct().select(*group_cols, F.explode(domain).alias("bin_no"))
        else:
            base = scored.sparkSession.range(1).select(F.explode(domain).alias("bin_no"))
        out = base.join(agg, [*group_cols, "bin_no"], "left")
    else:
        out = agg
    labels = F.array(*[F.lit(lab) for *_, lab in edges])
    acc = F.coalesce(F.col("acc"), F.lit(0.0))
    cnf = F.coalesce(F.col("conf"), F.lit(0.0))
    cols = [*group_cols, "bin_no", labels[F.col("bin_no")].alias("bin"),
            F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")]
    if percent:
        cols += [F.bround(acc * 100, 1).alias("accuracy"), F.bround(cnf * 100, 1).alias("expected_accuracy")]
    else:
        cols += [acc.alias("accuracy")]
    return out.select(*cols)


def accuracy(scored: DataFrame, y: str = "true_class", p: str = "predicted_class", group_cols=(), weight: str | None = None) -> DataFrame:
    """E5: share of correct predictions, or of their weight with ``weight``
    (rows without a weight don't count; no weight at all gives null)."""
    right = (F.col(y) == F.col(p)).cast("double")
    share = F.avg(right)
    if weight:
        w = F.col(weight).cast("double")
        share = F.try_divide(F.sum(w * right), F.sum(F.when(right.isNotNull(), w)))
    return scored.groupBy(*group_cols).agg(share.alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion_matrix(scored: DataFrame, y: str = "true_class", p: str = "predicted_class") -> DataFrame:
    """Counts for the full 2 x 2 domain (missing cells are 0)."""
    spark = scored.sparkSession
    cells = F.broadcast(spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)],
                                              "true_class int, predicted_class int"))
    counts = scored.groupBy(F.col(y).cast("int").alias("true_class"),
                            F.col(p).cast("int").alias("predicted_class")).count()
    return (cells.join(counts, ["true_class", "predicted_class"], "left")
            .select("true_class", "predicted_class", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def class_report(scored: DataFrame, y: str = "true_class", p: str = "predicted_class") -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted
    averages (zero division -> 0).  One aggregate pass."""
    yc, pc = F.col(y).cast("int"), F.col(p).cast("int")
    s = scored.agg(*[F.sum(F.when((yc == a) & (pc == b), 1).otherwise(0)).alias(f"c{a}{b}")
                     for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        tp = F.col(f"c{k}{k}")
        pred = F.col(f"c0{k}") + F.col(f"c1{k}")
        sup = F.col(f"c{k}0") + F.col(f"c{k}1")
        prec = F.when(pred > 0, tp / pred).otherwise(F.lit(0.0))
        rec = F.when(sup > 0, tp / sup).otherwise(F.lit(0.0))
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(str(k)).alias("label"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), sup.cast("bigint").alias("support")))
    per = s.select(F.inline(F.array(*rows)))
    tot = per.agg(F.sum("support").alias("n"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    n = F.col("n")
    avgs = tot.select(F.inline(F.array(
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"),
                 F.when(n > 0, F.col("wp") / n).otherwise(0.0).alias("precision"),
                 F.when(n > 0, F.col("wr") / n).otherwise(0.0).alias("recall"),
                 F.when(n > 0, F.col("wf") / n).otherwise(0.0).alias("f1"), n.alias("support")))))
    return per.unionByName(avgs)


def regression_metrics(df: DataFrame, y: str, pred: str, group_cols=("split",)) -> DataFrame:
    """MAE, RMSE, R^2 per group in one aggregate."""
    e = F.col(y).cast("double") - F.col(pred).cast("double")
    agg = df.groupBy(*group_cols).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("ss_res"), F.var_pop(F.col(y).cast("double")).alias("vp"),
        F.count(F.lit(1)).alias("n"))
    ss_tot = F.col("vp") * F.col("n")
    return agg.select(*group_cols, "mae", "rmse",
                      F.when(ss_tot > 0, F.lit(1.0) - F.col("ss_res") / ss_tot).otherwise(F.lit(0.0)).alias("r2"),
                      "n")
