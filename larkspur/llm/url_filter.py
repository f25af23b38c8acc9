"""URL filter: explicit rules, then association rules mined from labelled URLs.

A URL's tokens are the labels of its host, the pairs of its last two host labels, the words of its path and the names of its
query parameters; numbers are left out. A page is bad if the explicit rules block it, or if they say nothing and its row of
labels (doc_id = page_id) has quality 0 or toxic 1; the explicit rules so teach the filter what else looks like the URLs that they
block. FP-growth finds the token combinations of bad pages that have enough support, a share SUPPORT of all pages; their
confidence is counted over all pages. A combination becomes a rule if the lower end of its confidence's Wilson interval reaches
CONFIDENCE, so that few pages prove nothing, and no part of it is as good. Matching uses an inverted index: a rule is filed
under its rarest token, so that a URL looks only at the rules filed under its own tokens. All tokens of a URL are mined and matched.

Tokens that always occur together, over all pages, are mined as one: what a template repeats doesn't multiply the combinations.
The rules that reach the driver are bounded by the support: a combination covers a share SUPPORT of the pages.

Defined results: a null URL or one without :// has empty host and path, fits no rule, has no tokens and is allowed; ids that
repeat in labels count once (bad if any row is), ids that repeat in pages are judged each; null labels are not bad; without
labels only the explicit rules teach; without pages there are no rules; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import appended, mapped, used, written

SUPPORT, CONFIDENCE, Z = 0.003, 0.6, 1.96
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = re.compile(r"[^a-z]+")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _AZ, _AZ.lower()), path


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest (rule, verdict) whose host is the url's or above it and whose path its path starts with. A rule is host/path."""
    longest = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, say in reversed(longest):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(say)).otherwise(verdict)
    return text, verdict


def tokens(url: str | None) -> list[str]:
    """Distinct tokens in order."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return []
    m = re.match(r"([^/?#]*)([^?#]*)\??([^#]*)", rest, re.S)
    labels = [x for x in m[1].lower().split(".") if x]
    out = [f"h:{x}" for x in labels] + ([f"d:{'.'.join(labels[-2:])}"] if len(labels) > 1 else [])
    out += [f"p:{x}" for x in _SPLIT.split(m[2].lower()) if x] + [f"q:{x.partition('=')[0].lower()}" for x in m[3].split("&") if x]
    return list(dict.fromkeys(out))


def wilson(good: int, n: int) -> float:
    """The lower end of the interval of a share at Z standard errors."""
    p = good / n
    return (p + Z * Z / (2 * n) - Z * math.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def baskets(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict (of the explicit rules), tokens, bad (0 or 1)."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__d")).agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("__bad"))
    rows = appended(pages.select("page_id", "url"), ["url"], lambda urls: ([tokens(u) for u in urls],), rows=4096, tokens="array<string>")
    host, path = parsed(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "tokens")
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict")).join(marks, F.col("page_id") == F.col("__d"), "left")
    bad = F.when(F.col("verdict").isNotNull(), (F.col("verdict") == "block").cast("int")).otherwise(F.coalesce("__bad", F.lit(0)))
    return rows.select("page_id", "host", "path", "rule", "verdict", "tokens", bad.alias("bad"))


def mined(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[tuple[str, ...], float]]:
    """rows(tokens, bad), a written table -> rules (tokens, confidence)."""
    n, n_bad = rows.where("size(tokens) > 0").agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    least = next((k for k in range(1, 10_000) if wilson(k, k) >= confidence), 10_000)
    least = max(least, math.ceil(support * n))  # fewer bad pages cannot make a rule
    if n_bad < least:
        return []
    spark = rows.sparkSession
    often = rows.select("bad", F.explode("tokens").alias("token"), F.xxhash64("page_id", "host", "path", F.concat_ws(" ", "tokens")).alias("row"))
    often = often.groupBy("token").agg(F.sum("bad").alias("bad"), F.count("*").alias("all"), F.bit_xor("row").alias("where")).where(F.col("bad") >= least)
    names = often.groupBy("all", "where").agg(F.min("token").alias("token")).select("token")
    names = spark.sparkContext.broadcast(frozenset(r["token"] for r in names.collect()))  # at most n_bad * tokens of a URL / least
    kept = lambda many: ([[t for t in ts if t in names.value] for ts in many],)
    items = appended(rows.where("bad = 1").select("tokens"), ["tokens"], kept, rows=4096, items="array<string>").select("items").where("size(items) > 0")
    items = written(items, "baskets")
    model = FPGrowth(itemsCol="items", minSupport=least / max(1, items.count()), minConfidence=1.0).fit(items)
    found = {frozenset(r["items"]): r["freq"] for r in model.freqItemsets.where(F.col("freq") >= least).collect()}
    used(items)
    index = Index([(tuple(sorted(k)), 0.0) for k in found])
    sent = spark.sparkContext.broadcast(index)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, int] = defaultdict(int)
            for ts in b["tokens"]:
                for _, name in sent.value.fitting(list(ts)):
                    seen[name] += 1
            yield pd.DataFrame({"name": list(seen), "n": list(seen.values())}, columns=["name", "n"])

    every = mapped(rows.select("tokens"), count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    counts = {r["name"]: r["n"] for r in every.collect()}  # a row for each combination
    best: dict[frozenset, float] = {}
    for items_, freq in sorted(found.items(), key=lambda x: (len(x[0]), sorted(x[0]))):
        whole = counts[_named(items_)]
        if wilson(freq, whole) >= confidence and not any(part < items_ and c >= freq / whole for part, c in best.items()):
            best[items_] = freq / whole
    return [(tuple(sorted(k)), v) for k, v in best.items()]


def _named(items) -> str:
    return " ".join(sorted(items))


class Index:
    """Rules filed under the token that the fewest rules have."""

    def __init__(self, rules: list[tuple[tuple[str, ...], float]]):
        uses: dict[str, int] = defaultdict(int)
        for items, _ in rules:
            for t in items:
                uses[t] += 1
        self.filed: dict[str, list[tuple[frozenset, float, str]]] = defaultdict(list)
        for items, c in rules:
            self.filed[min(items, key=lambda t: (uses[t], t))].append((frozenset(items), c, " ".join(items)))

    def fitting(self, have: list[str]) -> list[tuple[float, str]]:
        """(confidence, name) of the rules that hold for a URL's tokens."""
        own = set(have)
        return [(c, name) for t in have for items, c, name in self.filed.get(t, ()) if items <= own]

    def match(self, have: list[str]) -> str | None:
        """The most confident rule that holds, then the first by name."""
        fits = [(-c, name) for c, name in self.fitting(have)]
        return min(fits)[1] if fits else None


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, mined_rule. rules: (host/path, 'allow' or 'block')."""
    rows = written(baskets(pages, labels, rules), "baskets")
    index = pages.sparkSession.sparkContext.broadcast(Index(mined(rows)))
    out = appended(rows, ["tokens"], lambda many: ([index.value.match(t) for t in many],), rows=4096, mined_rule="string")
    own = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "mined_rule")
