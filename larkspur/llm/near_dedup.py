"""MinHash near-duplicate search with an LSH forest.

Every distinct shingle set gets a signature of MinHash values, dealt out to the trees of a forest (see Forest). Each tree is one
sorted order of the sets by its values, cut into range partitions, so that no order, prefix or group of copies has to fit in one
task. A region is a run of sets with the same first `least` values of a tree. Candidates are neighbours in an order, which have
the longest common prefixes. The trees are taken in two turns:

1. In the first ones a crowded region is also cut at every greater depth (so depth adapts to the region), and each cut has a
   leader, found by following the most common value at each depth: this leads to the text that copies were made from, or one
   much like it. Links are confirmed on the full shingle sets and form components.
2. In the others only sets of different components are candidates: all pairs of a sparse region, next neighbours of a crowded one.

Sets that were candidates of a component's members but are not linked to them are then held against the component's centres,
until that links nothing more. What neighbours, leaders and centres miss lies in crowded regions that have more than one
component by then. Their sets are joined exactly by prefix filtering: shingles in order of their frequency (rarest first, by a
sketch, then by hash); a pair that fits shares one of the first shingles of both, at places that leave enough to share, and in
one of the two that is among its first (100 - percent) / (100 + percent). Pairs of one component are not made. Nothing is capped:
the pairs to confirm grow with the square of a group whose members share such shingles and are yet in different components.

Defined results: null or blank text and empty tables give empty sets, linked with nothing; a null doc_id is linked with
nothing and stands for itself (component null, kept); rows that repeat a doc_id count as one document for linking; other
columns are ignored, so their names cannot clash; a percent that MISSED cannot be kept for is refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import appended, components, everything, mapped, parts, settled, used, written

#: Values in a signature, neighbours looked at in an order, rows of an order in one partition (about).
N, NEAR, ROWS = 128, 3, 500_000
#: The greatest chance that a pair of the least similarity shares no region, and that its signatures agree too little.
MISSED = 1e-7
#: Up to so many ids (8 MB) may go to the texts by broadcast, if Spark's own limit allows; longer lists and the texts are dealt out by id.
FEW_IDS = 1_000_000
#: Counters of the frequency sketch. Any order of shingles gives the same pairs; a good one makes few candidates.
SKETCH = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(97))
_A = _RNG.integers(1, 1 << 63, N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 1 << 63, N, dtype=np.uint64)


@dataclass(frozen=True)
class Forest:
    """trees x depth = N values; least: values in common that make a region; agree: values that a pair must share at all.

    All follow from the least similarity: a pair at it shares a region with a chance of 1 - (1 - s ** least) ** trees, and the
    number of its common values is binomial. The deepest regions of the fewest trees that keep to MISSED are taken.
    """

    trees: int
    depth: int
    least: int
    agree: int

    @classmethod
    def of(cls, percent: int) -> Forest:
        s = percent / 100
        if not 0 < s <= 1:
            raise ValueError(f"percent must lie in 1 to 100, not {percent}")
        tail, agree = 0.0, 0
        while agree < N:
            tail += math.comb(N, agree) * s**agree * (1 - s) ** (N - agree)
            if tail > MISSED:
                break
            agree += 1
        for trees in (16, 32, 64, 128):
            for least in range(min(4, N // trees), 0, -1):
                if (1 - s**least) ** trees <= MISSED:
                    return cls(trees, N // trees, least, agree)
        raise ValueError(f"{N} values cannot find pairs at {percent} % with a chance of {1 - MISSED}")


def shingle_sets(texts: list[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; one for all words if there are fewer than k."""
    for _, encoded in textkit.blocks(texts):
        words = textkit.Words(encoded, lower=True)
        h = words.hashes()
        runs = textkit.windows(h, k)
        for a, b in zip(words.first, words.last, strict=True):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                yield textkit.windows(h[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each of the N minima."""
    low = np.full(N, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (np.multiply.outer(s[i : i + 512], _A) + _B).min(axis=0), out=low)
    return (low & np.uint64(0xFFFF)).astype(">u2")


def _sign(k: int):
    def run(texts: list[str | None]) -> tuple[list, list, list]:
        n, key, sig = [], [], []
        for s in shingle_sets(texts, k):
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        return n, key, sig

    return run


def _sets(k: int):
    return lambda texts: ([x.view(np.int64) for x in shingle_sets(texts, k)],)


def _orders(forest: Forest, trees: range):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sig in _signatures(batches):
            big = sig.astype(">u2").reshape(len(part), forest.trees, forest.depth)
            for t in trees:
                yield pd.DataFrame({"tree": t, "prefix": [x.tobytes() for x in big[:, t]], "root": part["root"], "rep": part["rep"]})

    return run


def neighbours(tree: np.ndarray, prefix: np.ndarray, root: np.ndarray, rep: np.ndarray, least: int, leaders: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of different roots in a sorted run. tree, root, rep [m], prefix [m, depth].

    Without leaders, a region of more than NEAR + 1 rows gives next neighbours only.
    """
    m, depth = prefix.shape
    if m < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    equal = np.concatenate((np.ones((m - 1, 1), bool), prefix[1:] == prefix[:-1]), axis=1)
    equal[:, 0] = tree[1:] == tree[:-1]
    common = np.where(equal.all(axis=1), depth + 1, equal.argmin(axis=1)) - 1  # values in common with the row before; -1: another tree
    region = np.concatenate(([0], np.cumsum(common < least)))
    sparse = np.bincount(region)[region] <= NEAR + 1
    a, b = [], []
    for step in range(1, min(NEAR, m - 1) + 1):
        meet = (region[step:] == region[:-step]) & (root[step:] != root[:-step])
        at = np.flatnonzero(meet if leaders or step == 1 else meet & sparse[step:])
        a.append(rep[at])
        b.append(rep[at + step])
    if leaders:
        first = np.flatnonzero(np.concatenate(([True], common < depth)))  # runs that share the whole prefix
        lead, size = first.copy(), np.diff(np.append(first, m))
        run_of_row = np.cumsum(np.concatenate(([True], common < depth))) - 1
        for at_depth in range(depth, least - 1, -1):
            if at_depth < depth:  # a region's leader is that of its largest part
                starts = np.concatenate(([True], common[first[1:] - 1] < at_depth))
                top, of = np.flatnonzero(starts), np.cumsum(starts) - 1
                order = np.lexsort((np.arange(len(size)), -size, of))
                lead, size, first = lead[order[top]], np.add.reduceat(size, top), first[top]
                run_of_row = of[run_of_row]
            far = (size[run_of_row] > 2) & (root != root[lead[run_of_row]])
            a.append(rep[far])
            b.append(rep[lead[run_of_row[far]]])
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)))[:, a != b], axis=1)
    return pairs[0], pairs[1]


def _candidates(depth: int, least: int, leaders: bool):
    """Candidate pairs within a range partition; its first and last rows go out as well, to be joined to their neighbours'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = [b for b in batches if len(b)]
        if not have:
            return
        whole = pd.concat(have, ignore_index=True)  # ROWS, about
        tree, root, rep = (whole[c].to_numpy() for c in ("tree", "root", "rep"))
        prefix = np.frombuffer(b"".join(whole["prefix"]), ">u2").reshape(len(whole), depth)
        a, b = neighbours(tree, prefix, root, rep, least, leaders)
        for i in range(0, len(a), 100_000):
            yield pd.DataFrame({"a": a[i : i + 100_000], "b": b[i : i + 100_000], "tree": None, "prefix": None, "root": None})
        ends = sorted({*range(min(NEAR, len(whole))), *range(max(0, len(whole) - NEAR), len(whole))})
        yield pd.DataFrame({"a": rep[ends], "b": None, "tree": tree[ends], "prefix": whole["prefix"].iloc[ends].tolist(), "root": root[ends]})

    return run


def _agreeing(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), N) for c in ("sig_a", "sig_b"))
                batch["agree"] = (x == y).sum(axis=1)
                yield batch[["a", "b", "agree"]][batch["agree"] >= least]

    return run


def _candidate_pairs(rooted: DataFrame, forest: Forest, trees: range, leaders: bool) -> DataFrame:
    """rooted(rep, sig, root) -> a, b, agree: candidates from some trees whose signatures agree enough."""
    spark = rooted.sparkSession
    orders = mapped(rooted.select("rep", "sig", "root"), _orders(forest, trees), "tree int, prefix binary, root long, rep long")
    # ties go by root and rep, so that equal prefixes give the same neighbours in every tree
    order = ("tree", "prefix", "root", "rep")
    several = max(parts(spark), rooted.count() * len(trees) // ROWS + 1)
    orders = orders.repartitionByRange(several, *order).sortWithinPartitions(*order)
    find, schema = _candidates(forest.depth, forest.least, leaders), "a long, b long, tree int, prefix binary, root long"
    found = written(mapped(orders, find, schema), "candidates")
    ends = found.where("tree is not null").select("tree", "prefix", "root", F.col("a").alias("rep")).distinct()
    ends = mapped(ends.coalesce(1).sortWithinPartitions(*order), find, schema)  # 2 * NEAR rows a partition
    pairs = found.where("tree is null").unionByName(ends.where("tree is null")).select("a", "b").distinct()
    sig_a, sig_b = rooted.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), rooted.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    out = written(mapped(pairs.join(sig_a, "a").join(sig_b, "b"), _agreeing(forest.agree), "a long, b long, agree int"), "pairs")
    used(found)
    return out


def _signatures(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Some rows at a time and their signatures as an array."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            part = batch.iloc[k : k + rows]
            yield part, np.frombuffer(b"".join(part["sig"]), np.uint16).reshape(len(part), N)


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each value stands at each place of the signatures of a component's members."""
    place = np.arange(N, dtype=np.int64) << 16
    for part, sig in _signatures(batches):
        roots, of = np.unique(part["root"].to_numpy(), return_inverse=True)
        keys, votes = np.unique((of.astype(np.int64)[:, None] << 32) | place | sig, return_counts=True)
        yield pd.DataFrame({"root": roots[keys >> 32], "place": (keys >> 16 & 0xFFFF).astype(np.int32), "value": (keys & 0xFFFF).astype(np.int32), "votes": votes})


def _agreement(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part, sig in _signatures(batches):
        typical = np.stack([np.asarray(t, np.uint16) for t in part["typical"]])
        yield pd.DataFrame({"root": part["root"], "rep": part["rep"], "agree": (sig == typical).mean(axis=1)})


def _centres(roots: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """root, centre: of each wanted component the members whose signatures agree best with the most common value at each place.

    The members are dealt into three lots, each of which gives its best. All steps are grouped sums and maxima.
    """
    of = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct().join(wanted, "root", "left_semi")
    members = written(of.join(reps.select(F.col("rep").alias("node"), "sig"), "node").select("root", F.col("node").alias("rep"), "sig"), "members")
    votes = mapped(members.select("root", "sig"), _votes, "root long, place int, value int, votes long")
    common = votes.groupBy("root", "place", "value").agg(F.sum("votes").alias("votes")).groupBy("root", "place").agg(F.max(F.struct("votes", "value")).alias("x"))
    typical = common.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "x.value"))).alias("t")).select("root", F.col("t.value").alias("typical"))
    close = mapped(members.join(typical, "root"), _agreement, "root long, rep long, agree double")
    return close.groupBy("root", F.pmod(F.xxhash64("rep"), F.lit(3)).alias("lot")).agg(F.max_by("rep", F.struct("agree", (-F.col("rep")).alias("r"))).alias("centre")).select("root", "centre")


def _regions(forest: Forest):
    """A key for each tree's region that a set is in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sig in _signatures(batches):
            first = sig.reshape(len(part), forest.trees, forest.depth)[:, :, : forest.least]
            key = np.tile(np.arange(forest.trees, dtype=np.uint64), (len(part), 1))
            for d in range(forest.least):
                key = textkit.mix(key << np.uint64(16) ^ first[:, :, d]) if forest.least > 2 else key << np.uint64(16) | first[:, :, d]
            yield pd.DataFrame({"region": key.ravel().view(np.int64), "rep": np.repeat(part["rep"].to_numpy(), forest.trees), "root": np.repeat(part["root"].to_numpy(), forest.trees)})

    return run


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for s in batch["s"]:
            np.add.at(counts, np.asarray(s).view(np.uint64) % np.uint64(SKETCH), 1)
    at = np.flatnonzero(counts)
    for i in range(0, len(at), 100_000):
        yield pd.DataFrame({"bucket": at[i : i + 100_000], "n": counts[at[i : i + 100_000]]})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"at": [batch["bucket"].to_numpy(np.uint32).tobytes()], "n": [np.minimum(batch["n"], 0xFFFFFFFF).to_numpy(np.uint32).tobytes()]})


def prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in order of frequency, as far as a partner can need them, and which are in the short prefix.

    With n shingles, the one at place i leaves n - i: a partner of m needs (n - i) * (100 + percent) >= percent * (n + m), at best
    with the smallest m, n * percent / 100. Added up for both partners this holds with 2 * percent * n in one of them at least.
    """
    n = len(s)
    s = s[np.lexsort((s, counts[s.view(np.uint64) % np.uint64(SKETCH)]))]
    left = n - np.arange(n)
    s = s[left * 100 >= percent * n]
    return s, left[: len(s)] * (100 + percent) >= 2 * percent * n


def _prefixes(counts, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                out = []
                for rep, root, s in zip(*(batch[c].iloc[k : k + 256] for c in ("rep", "root", "s")), strict=True):
                    g, short = prefix(np.asarray(s), counts.value, percent)
                    out.append(pd.DataFrame({"g": g, "rep": rep, "root": root, "n": len(s), "left": len(s) - np.arange(len(g)), "short": short}))
                yield pd.concat(out, ignore_index=True)

    return run


def _with_texts(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs of the ids, a written table. The texts are never sorted."""
    return docs.join(ids if ids.count() <= FEW_IDS else ids.hint("shuffle_hash"), "doc_id", how)


def _exact(docs: DataFrame, rooted: DataFrame, forest: Forest, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(sets, pairs a, b) of crowded regions' sets in different components that may fit. rooted: rep, sig, root."""
    spark = docs.sparkSession
    regions = written(mapped(rooted, _regions(forest), "region long, rep long, root long"), "regions")
    mixed = regions.groupBy("region").agg(F.count("*").alias("rows"), F.min("root").alias("x"), F.max("root").alias("y")).where(f"rows > {NEAR + 1} and x <> y").select("region")
    crowded = written(regions.join(mixed.hint("merge"), "region").select(F.col("rep").alias("doc_id"), "root").distinct(), "crowd")
    wanted = _with_texts(docs, crowded, "inner")
    sets = written(appended(wanted, ["text"], _sets(k), s="array<long>").select(F.col("doc_id").alias("rep"), "root", "s").where("size(s) > 0"), "crowded")
    used(regions, crowded)
    counts = np.zeros(SKETCH, np.uint32)
    held = mapped(sets.select("s"), _sketched, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in mapped(held, _packed, "at binary, n binary").collect():  # 8 bytes for each of SKETCH counters; an iterator would take a job for each partition
        counts[np.frombuffer(r["at"], np.uint32)] = np.frombuffer(r["n"], np.uint32)
    all_posts = written(mapped(sets, _prefixes(spark.sparkContext.broadcast(counts), percent), "g long, rep long, root long, n int, left int, short boolean"), "posts")
    meet = all_posts.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("short").alias("any")).where("x <> y and any").select("g")
    posts = written(all_posts.join(meet.hint("merge"), "g"), "posts")
    x, y = (posts.toDF("g", *(f"{c}_{side}" for c in posts.columns[1:])) for side in "xy")
    enough = " and ".join(f"left_{side} * {100 + percent}L >= {percent}L * (n_x + n_y)" for side in "xy")
    both = x.where("short_x").join(y.hint("merge"), "g").where(f"root_x <> root_y and (not short_y or rep_x < rep_y) and {enough}")
    pairs = written(both.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct(), "exact")
    used(all_posts, posts)
    return sets.select(F.col("rep").alias("doc_id"), "s"), pairs


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """docs(doc_id long, text string) -> doc_id, n_shingles, component_id, kept.

    Links documents whose k-word shingle sets have 100 * intersection >= percent * union. component_id is the smallest
    doc_id reachable; kept is doc_id = component_id.
    """
    forest = Forest.of(percent)
    docs = docs.select("doc_id", "text")
    signed = written(appended(docs, ["text"], _sign(k), n_shingles="long", skey="binary", sig="binary").drop("text"), "signed")
    real = signed.where("doc_id is not null and n_shingles > 0")
    reps = written(real.groupBy("skey").agg(F.min(F.struct("doc_id", "sig")).alias("x")).select(F.col("x.doc_id").alias("rep"), "skey", F.col("x.sig").alias("sig")), "reps")

    def sets_of(ids: DataFrame) -> DataFrame:
        """doc_id, s for each id."""
        return written(appended(_with_texts(docs, ids, "left_semi"), ["text"], _sets(k), s="array<long>").drop("text").where("size(s) > 0"), "sets")

    def confirmed(some: DataFrame, sets: DataFrame) -> DataFrame:
        # sets are large rows: never broadcast
        x = some.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")).hint("merge"), "a")
        x = x.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")).hint("merge"), "b")
        both = F.size(F.array_intersect("x", "y")).cast("long")
        x = x.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sum"))
        return x.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def rooted(rows: DataFrame, column: str, to: str) -> DataFrame:
        return rows.join(roots.select(F.col("node").alias(column), F.col("root").alias(to)), column, "left").withColumn(to, F.coalesce(to, column))

    def across(rows: DataFrame) -> DataFrame:
        return rooted(rooted(rows.select("a", "b"), "a", "ra"), "b", "rb").where("ra <> rb")

    def linked(more: DataFrame) -> DataFrame:
        """node, root with further links: a root's edges stand for the links that made it."""
        out = written(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "roots")
        settled(out.sparkSession)
        return out

    # The first trees: the best candidate of each set, then all the others that would still join two components.
    few = max(1, forest.trees // 4)
    pairs = _candidate_pairs(reps.withColumn("root", F.col("rep")), forest, range(few), True)
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    sets = sets_of(needed)
    ways = pairs.select(F.col("a").alias("x"), F.struct("agree", F.col("b").alias("y")).alias("to")).unionByName(pairs.select(F.col("b").alias("x"), F.struct("agree", F.col("a").alias("y")).alias("to")))
    best = written(ways.groupBy("x").agg(F.max("to").alias("to")).select(F.least("x", "to.y").alias("a"), F.greatest("x", "to.y").alias("b")).distinct(), "best")
    roots = written(components(confirmed(best, sets)), "roots")
    rest = written(across(pairs).select("a", "b").join(best, ["a", "b"], "left_anti"), "rest")
    roots = linked(confirmed(rest, sets))

    # The other trees: pairs of different components only.
    others = _candidate_pairs(rooted(reps.select("rep", "sig"), "rep", "root"), forest, range(few, forest.trees), False)
    new = written(others.select("a", "b").join(pairs, ["a", "b"], "left_anti"), "new")
    more_ids = new.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(needed, "doc_id", "left_anti")
    sets = sets.unionByName(sets_of(written(more_ids, "needed")))
    roots = linked(confirmed(new, sets))

    # What a component's neighbours missed by a little they may reach from its centre.
    tried, apart = pairs.select("a", "b").unionByName(new), pairs.select("a", "b").unionByName(new)
    while True:
        apart = written(across(apart), "apart")
        sides = F.array(F.struct(F.col("a").alias("x"), F.col("rb").alias("root")), F.struct(F.col("b").alias("x"), F.col("ra").alias("root")))
        several = roots.select("root").distinct()  # a set on its own is its own centre
        near = written(apart.select(F.explode(sides).alias("p")).select("p.*").distinct().join(several, "root"), "near")
        to = near.join(_centres(roots, reps, near.select("root").distinct()), "root").where("x <> centre")
        rest = written(to.select(F.least("x", "centre").alias("a"), F.greatest("x", "centre").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
        more = written(confirmed(rest, sets), "more")
        tried = tried.unionByName(rest)
        if more.isEmpty():
            break
        roots = linked(more)

    crowd, rest = _exact(docs, rooted(reps.select("rep", "sig"), "rep", "root"), forest, percent, k)
    more = written(confirmed(rest.join(tried, ["a", "b"], "left_anti"), crowd), "more")
    if not more.isEmpty():
        roots = linked(more)
    classes = rooted(reps.select("rep", "skey"), "rep", "component_id").select("skey", "component_id")
    # Rows that repeat a doc_id are one document: the smallest component that any of them is in.
    component = real.select("doc_id", "skey").join(classes, "skey").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(component, "doc_id", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """The documents without those that have an earlier near-duplicate in their component; all columns stay."""
    seen = near_duplicates(docs, percent, k).where("not kept").select("doc_id").distinct()
    return docs.join(seen, "doc_id", "left_anti").select(*everything(docs))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * n_both >= 85 * (a.n_shingles + b.n_shingles - n_both)),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u, min(v) AS v FROM r GROUP BY u)
SELECT n.doc_id, n.n_shingles, least(n.doc_id, coalesce(c.v, n.doc_id)) AS component_id,
       n.doc_id = least(n.doc_id, coalesce(c.v, n.doc_id)) AS kept
FROM n LEFT JOIN c ON c.u = n.doc_id
"""
