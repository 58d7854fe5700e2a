"""Evaluation: confusion matrix, classification report, macro F1 and the
grid-search pick (D12-D15). One partial aggregate over the scored rows each:
pair counts for the matrix, conditional counts of every class for the report and
the macro F1; the rest is arithmetic on an array of k classes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.labelling import LABELS


def pair_counts(scored: DataFrame, label: str = "label", pred: str = "prediction",
                by: list[str] | None = None) -> DataFrame:
    by = by or []
    return scored.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("prediction")) \
                 .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(scored: DataFrame, labels: list[str] = LABELS, label: str = "label",
                     pred: str = "prediction") -> DataFrame:
    """One row per true label in fixed order, one column per predicted
    label (``pred_<label>``), zeros filled."""
    spark = scored.sparkSession
    dom = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "ord int, label string")
    pc = pair_counts(scored, label, pred).groupBy("label").pivot("prediction", labels).agg(F.sum("n"))
    out = F.broadcast(dom).join(pc, "label", "left")
    return out.select("ord", "label", *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(f"pred_{v}")
                                        for v in labels])


def _cells(labels: list[str], label: str, pred: str) -> Column:
    """An aggregate: ``array<struct<cls,tp,predicted,support>>`` in label order."""
    truth, guess = F.col(label), F.col(pred)
    return F.array(*[F.struct(F.lit(v).alias("cls"), F.count_if((truth == v) & (guess == v)).alias("tp"),
                              F.count_if(guess == v).alias("predicted"), F.count_if(truth == v).alias("support"))
                     for v in labels])


def _rate(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _scores(cells: Column) -> Column:
    """Adds precision, recall and F1 (0 on an empty denominator) to the cells."""
    def one(c: Column) -> Column:
        p, r = _rate(c["tp"], c["predicted"]), _rate(c["tp"], c["support"])
        return F.struct(c["cls"].alias("cls"), c["tp"].alias("tp"), c["predicted"].alias("predicted"),
                        c["support"].alias("support"), p.alias("precision"), r.alias("recall"),
                        _rate(2 * p * r, p + r).alias("f1"))
    return F.transform(cells, one)


def _total(scores: Column, value, start) -> Column:
    return F.aggregate(scores, start, lambda acc, c: acc + value(c))


def class_scores(scored: DataFrame, by: list[str], labels: list[str] = LABELS, label: str = "label",
                 pred: str = "prediction") -> DataFrame:
    """``(*by, scores)``: every class's counts, precision, recall and F1 as one
    array in label order, from one partial aggregate over the scored rows (one
    row in all without ``by``, also for an empty table)."""
    return scored.groupBy(*by).agg(_cells(labels, label, pred).alias("cells")).select(*by, _scores(F.col("cells")).alias("scores"))


def classification_report(scored: DataFrame, labels: list[str] = LABELS, label: str = "label",
                          pred: str = "prediction", digits: int = 6) -> DataFrame:
    """Rows per class, then ``accuracy``, ``macro avg``, ``weighted avg``
    (accuracy row: f1 = accuracy, precision/recall NULL, support = n)."""
    s = F.col("scores")
    zero = F.lit(0.0)

    def row(name, precision, recall, f1, support) -> Column:
        return F.struct(name.alias("name"), precision.cast("double").alias("precision"), recall.cast("double").alias("recall"),
                        f1.cast("double").alias("f1"), support.alias("support"))

    def averaged(name: str, mean) -> Column:
        return row(F.lit(name), mean("precision"), mean("recall"), mean("f1"), F.col("n"))

    one = class_scores(scored, [], labels, label, pred).withColumn(
        "n", _total(s, lambda c: c["support"], F.lit(0).cast("long")))
    classes = F.transform(s, lambda c: row(c["cls"], c["precision"], c["recall"], c["f1"], c["support"]))
    tp = _total(s, lambda c: c["tp"], F.lit(0).cast("long"))
    summary = F.array(
        row(F.lit("accuracy"), F.lit(None), F.lit(None), F.try_divide(tp, F.col("n")), F.col("n")),
        averaged("macro avg", lambda m: _total(s, lambda c: c[m], zero) / F.lit(float(len(labels)))),
        averaged("weighted avg", lambda m: F.try_divide(_total(s, lambda c: c[m] * c["support"], zero), F.col("n"))))
    out = one.select(F.explode(F.concat(classes, summary)).alias("r")).select("r.*")
    return out.select("name", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")


def macro_f1(scored: DataFrame, by: list[str], labels: list[str] = LABELS, label: str = "label",
             pred: str = "prediction") -> DataFrame:
    """Macro F1 per group (e.g. per ``(C, fold)``)."""
    mean = _total(F.col("scores"), lambda c: c["f1"], F.lit(0.0)) / F.lit(float(len(labels)))
    return class_scores(scored, by, labels, label, pred).select(*by, mean.alias("f1_macro"))


def best_param(scores: DataFrame, param: str, param_order: str, score: str = "f1_macro") -> DataFrame:
    """Mean score per parameter over folds; the best is the highest mean,
    ties to the earliest parameter of the grid."""
    m = scores.groupBy(param, param_order).agg(F.avg(score).alias("mean_score"))
    w = Window.orderBy(F.desc("mean_score"), F.col(param_order))
    return m.withColumn("is_best", F.row_number().over(w) == 1)
