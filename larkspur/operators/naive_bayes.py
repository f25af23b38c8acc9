"""Multinomial naive Bayes in long form: rows (doc, class) and (doc, token, count)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import ValidationError
from ..frame import written


def ascii_tokens(text: Column) -> Column:
    """Lower-cased (A-Z) space-separated words of ASCII letters."""
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(text, az, az.lower()), " "), lambda w: w.rlike("^[a-z]+$"))


@dataclass(frozen=True)
class CountsModel:
    """class_counts(class, n) and token_counts(class, token, n): additive, so that counts of parts can be summed."""

    class_counts: DataFrame
    token_counts: DataFrame
    alpha: float = 1.0
    uniform_prior: bool = False

    def priors(self) -> DataFrame:
        """class, log_prior. One row for each class from here on."""
        whole = W.partitionBy()
        share = F.lit(1.0) / F.count("*").over(whole) if self.uniform_prior else F.col("n") / F.sum("n").over(whole)
        return self.class_counts.select("class", F.log(share.cast("double")).alias("log_prior"))

    def log_probs(self) -> DataFrame:
        """class, token, log_prob over every class and every token of the vocabulary."""
        vocabulary = self.token_counts.select("token").distinct()
        totals = self.token_counts.groupBy("class").agg(F.sum("n").alias("total"))
        size = vocabulary.agg(F.count("*").alias("size"))
        classes = self.class_counts.select("class").join(totals, "class", "left").crossJoin(F.broadcast(size))  # a row for each class
        dense = vocabulary.join(F.broadcast(classes), how="cross")  # vocabulary x classes: the model's own size
        counted = dense.join(self.token_counts, ["class", "token"], "left")
        p = (F.coalesce("n", F.lit(0)) + F.lit(self.alpha)) / (F.coalesce("total", F.lit(0)) + F.lit(self.alpha) * F.col("size"))
        return counted.select("class", "token", F.log(p.cast("double")).alias("log_prob"))

    def joint(self, tokens: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """doc, class, score = prior + sum of count * log_prob. Tokens outside the vocabulary add nothing.

        The model is written once; Spark broadcasts it where it is small.
        """
        scored = tokens.join(written(self.log_probs(), "log_probs"), "token").groupBy("doc", "class").agg(F.sum(F.col("n") * F.col("log_prob")).alias("s"))
        docs = (docs if docs is not None else tokens).select("doc").distinct()
        every = docs.join(F.broadcast(self.priors()), how="cross")  # a row for each class
        return every.join(scored, ["doc", "class"], "left").select("doc", "class", (F.col("log_prior") + F.coalesce("s", F.lit(0.0))).alias("score"))

    def log_proba(self, tokens: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """doc, class, log_proba, normalised over the classes."""
        w = W.partitionBy("doc")
        j = self.joint(tokens, docs).withColumn("top", F.max("score").over(w))
        return j.select("doc", "class", (F.col("score") - F.col("top") - F.log(F.sum(F.exp(F.col("score") - F.col("top"))).over(w))).alias("log_proba"))

    def predict(self, tokens: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """doc, prediction: the first class with the greatest score."""
        best = self.joint(tokens, docs).groupBy("doc").agg(F.max(F.struct("score", (-F.col("class")).alias("neg"))).alias("x"))
        return best.select("doc", (-F.col("x.neg")).alias("prediction"))

    def merged(self, other: CountsModel) -> CountsModel:
        """The model of the union of two disjoint fits."""
        c = self.class_counts.unionByName(other.class_counts).groupBy("class").agg(F.sum("n").alias("n"))
        t = self.token_counts.unionByName(other.token_counts).groupBy("class", "token").agg(F.sum("n").alias("n"))
        return CountsModel(c, t, self.alpha, self.uniform_prior)


class MultinomialNB:
    def __init__(self, alpha: float = 1.0, uniform_prior: bool = False):
        if alpha <= 0:
            raise ValidationError("alpha", "must be positive", alpha)
        self.alpha, self.uniform_prior = alpha, uniform_prior

    def fit(self, docs: DataFrame, tokens: DataFrame) -> CountsModel:
        """docs(doc, class), tokens(doc, token, n >= 0)."""
        c = docs.groupBy("class").agg(F.count("*").alias("n"))
        t = tokens.join(docs, "doc").groupBy("class", "token").agg(F.sum("n").alias("n"))
        return CountsModel(c, t, self.alpha, self.uniform_prior)


def vocabulary(tokens: DataFrame, size: int) -> DataFrame:
    """The `size` most frequent tokens, ties by token."""
    return tokens.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "token").limit(size).select("token")
