"""Regression, classification and ranking metrics over rows (y, p) and, for ranking, (query, relevance, score, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import EmptyDataError, ValidationError
from ..frame import num

CLIP = 1e-15


def regression_columns(y: str = "y", p: str = "p") -> dict[str, Column]:
    """Every regression metric as one aggregate expression."""
    a, b = num(y), num(p)
    e = a - b
    return {
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "r2": 1 - F.sum(e * e) / F.nullif(F.var_pop(a) * F.count(a), F.lit(0.0)),
        "mape": 100 * F.avg(F.when(a != 0, F.abs(e) / F.abs(a))),
        "explained_variance": 1 - F.var_pop(e) / F.nullif(F.var_pop(a), F.lit(0.0)),
    }


def regression(df: DataFrame, *names: str, y: str = "y", p: str = "p") -> DataFrame:
    """One row with the named metrics (all by default); undefined ones are null."""
    every = regression_columns(y, p)
    return df.agg(*[every[n].alias(n) for n in names or every])


def score(df: DataFrame, name: str, y: str = "y", p: str = "p") -> float:
    """The value of one metric; raises where it is undefined."""
    value = regression(df, name, y=y, p=p).first()[0]
    if value is None:
        raise EmptyDataError(f"{name}: undefined: no rows, no spread or only zero targets")
    return float(value)


def accuracy_columns(y: str = "y", p: str = "p") -> dict[str, Column]:
    hit = (num(y) == num(p)).cast("double")
    return {"accuracy": F.avg(hit), "error_rate": 1 - F.avg(hit)}


def log_loss(y: str = "y", p: str = "p") -> Column:
    a, q = num(y), F.least(F.greatest(num(p), F.lit(CLIP)), F.lit(1 - CLIP))
    return F.avg(-(a * F.log(q) + (1 - a) * F.log(1 - q)))


def multiclass_log_loss(y: str, probabilities: list[str]) -> Column:
    """y is the index of the class; its probability, clipped, scaled by the row's sum."""
    whole = sum((num(p) for p in probabilities[1:]), num(probabilities[0]))
    said = F.get(F.array(*[num(p) for p in probabilities]), num(y).cast("int")) / whole
    return F.avg(-F.log(F.least(F.greatest(said, F.lit(CLIP)), F.lit(1 - CLIP))))


def first_column(df: DataFrame, *columns: str, only: bool = False) -> DataFrame:
    """Array columns (rows of a matrix) as their first numbers; with `only`, other widths than one are refused."""
    if only:
        wide = df.where(sum(((F.size(c) != 1).cast("int") for c in columns), F.lit(0)) > 0)
        if not wide.limit(1).isEmpty():
            raise ValidationError(", ".join(columns), "rows must have one column")
    return df.withColumns({c: F.get(F.col(c), F.lit(0)).cast("double") for c in columns})


def check_binary(df: DataFrame, y: str = "y") -> DataFrame:
    if not df.where(~num(y).isin(0.0, 1.0)).limit(1).isEmpty():
        raise ValidationError(y, "labels must be 0 or 1")
    return df


def class_report(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """class, precision, recall, f1, support for the union of observed classes. One scan, one shuffle of class counts."""
    ends = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    sides = ends.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    by = sides.groupBy("class").agg(F.sum("true").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    precision = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    by = by.select("class", precision.alias("precision"), recall.alias("recall"), "support")
    return by.withColumn("f1", _f1(F.col("precision"), F.col("recall"))).select("class", "precision", "recall", "f1", "support")


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def prf(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """precision, recall, f1: of the larger label if there are two classes, else unweighted means (f1 from those means)."""
    r = class_report(df, y, p).agg(F.count("*").alias("k"), F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.max_by("precision", "class").alias("bp"), F.max_by("recall", "class").alias("br"))
    two = F.col("k") == 2
    r = r.select(F.when(two, F.col("bp")).otherwise(F.col("mp")).alias("precision"), F.when(two, F.col("br")).otherwise(F.col("mr")).alias("recall"))
    return r.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def confusion(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """y, p, n: long form, zeros left out; its size is bounded by the square of the classes."""
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def class_union(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.select(F.explode(F.array(y, p)).alias("class")).distinct()


def auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve with ties counted half; 0.5 with one class only.

    Counts for each distinct score come first; positives and negatives below each score are running sums over a range-partitioned
    order, done in two levels (within partitions, then over the partitions' totals), so that no single task sorts everything.
    """
    by = df.groupBy(num(score).alias("s")).agg(F.sum(num(y)).alias("pos"), F.sum(1 - num(y)).alias("neg"))
    by = by.repartitionByRange("s").withColumn("part", F.spark_partition_id())
    below = by.withColumn("within", F.sum("neg").over(W.partitionBy("part").orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("neg"))
    parts = below.groupBy("part").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"), F.sum(F.col("pos") * (F.col("within") + F.col("neg") / 2)).alias("area"))
    # one row for each partition from here on
    run = parts.withColumn("before", F.sum("neg").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("neg"))
    t = run.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(F.col("area") + F.col("pos") * F.col("before")).alias("A"))
    return t.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("A") / F.when(F.col("P") * F.col("N") > 0, F.col("P") * F.col("N"))).otherwise(0.5).alias("auc"))


def _ranked(df: DataFrame, query: str, key: str) -> DataFrame:
    by_score = W.partitionBy(query).orderBy(F.col("score").desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(by_score))


def ndcg(df: DataFrame, query: str = "query", key: str = "key", k: int = -1) -> DataFrame:
    """query, ndcg of rows (query, rel, score, key); k < 0: all ranks; no relevance: 0. Ties go by key."""
    ideal = W.partitionBy(query).orderBy(F.col("rel").desc(), F.col(key))
    r = _ranked(df, query, key).withColumn("best", F.row_number().over(ideal))
    gain = F.pow(F.lit(2.0), num("rel")) - 1
    within = lambda c: F.lit(True) if k < 0 else F.col(c) <= k
    out = r.groupBy(query).agg(F.sum(F.when(within("rank"), gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(within("best"), gain / F.log2(F.col("best") + 1.0)).otherwise(0.0)).alias("idcg"))
    return out.select(query, F.when(F.col("idcg") > 0, F.col("dcg") / F.when(F.col("idcg") > 0, F.col("idcg"))).otherwise(0.0).alias("ndcg"))


def average_precision(df: DataFrame, query: str = "query", key: str = "key") -> DataFrame:
    """query, ap: the mean over hits (rel > 0) of the share of hits up to them; none: 0."""
    r = _ranked(df, query, key).withColumn("hit", (num("rel") > 0).cast("double"))
    r = r.withColumn("hits", F.sum("hit").over(W.partitionBy(query).orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return r.groupBy(query).agg(F.coalesce(F.sum(F.col("hit") * F.col("hits") / F.col("rank")) / F.nullif(F.sum("hit"), F.lit(0.0)), F.lit(0.0)).alias("ap"))
