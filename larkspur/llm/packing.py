"""Variable-capacity best-fit packing.

Pieces of documents go into bins whose capacity is one of several permitted sequence lengths. Each partition is packed as its
rows come, WINDOW pieces at a time, longest first: a piece goes to the open bin with the least room that holds it; if none does,
the permitted length opens whose cost for each token that can be expected in it is least, given what is left to pack. Bins that
stay emptier than FULL go back and are packed again with the next pieces. What a partition has left in the end is dealt out anew,
WINDOW pieces to a task, and packed in a second round, so that many small partitions fill their bins as well as few large ones.
There each bin shrinks to the smallest permitted length that holds its contents. Memory is bounded by WINDOW, only left-over
pieces are shuffled, and a lost task is simply run again.

Texts longer than the greatest length are cut at it; only the last piece of a text can be shorter. Lengths are words unless a
column of counts is named or a counter of texts is given. The counter runs within the packing worker: a plan that counts in Python
and then packs would hold two workers for each task.

Defined results: a null, empty or blank text has no tokens and one row without a bin; repeated rows are packed each; null
doc_ids stay null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, written

SIZES, WINDOW, FULL = (512, 1024, 2048, 4096, 8192), 32_768, 0.995
#: So many texts are counted at a time.
ROWS = 512


def cost(size: int) -> float:
    """Of a sequence: linear in its length, with an attention part that grows with its square, and a fixed part."""
    return 32 + size + size * size / 32_768


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> list[tuple[int, list[int]]]:
    """Bins as (size, indexes of pieces). Every length lies within 1 and the greatest size."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = sum(lengths)
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    capacity: list[int] = []
    for i in order:
        n = lengths[i]
        left -= n
        at = bisect_left(room, (n, -1))
        if at < len(room):
            space, b = room.pop(at)
        else:
            space = min((s for s in sizes if s >= n), key=lambda s: (cost(s) / min(s, n + left), s))
            b = len(bins)
            bins.append([])
            capacity.append(space)
        bins[b].append(i)
        if space > n:
            insort(room, (space - n, b))
    out = []
    for members in bins:
        used = sum(lengths[i] for i in members)
        out.append((min(s for s in sizes if s >= used), members))
    return out


def _packer(sizes: tuple[int, ...], last: bool, counter: Callable[[list], list[int]] | None = None):
    """A round over (doc_id, piece, start, n): bins, and without `last` the left-over pieces (rows that have tokens but no bin).

    With a counter, n comes as a text.
    """
    most = max(sizes)
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("bin_id", pa.string()), ("bin_size", pa.int64()), ("bin_offset", pa.int64())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds.types, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, made, pieces = f"{'ab'[last]}{context.partitionId() if context else 0}", 0, []

        def emit(end: bool) -> pa.RecordBatch:
            nonlocal made, pieces
            rows, back = [], []
            for size, members in pack([p[3] for p in pieces], sizes):
                used = sum(pieces[i][3] for i in members)
                if not (end and last) and used < FULL * size and (end or len(back) + len(members) < WINDOW // 2):
                    back += members
                    continue
                at = 0
                for i in members:
                    rows.append((*pieces[i], f"{name}-{made}", size, at))
                    at += pieces[i][3]
                made += 1
            pieces = [pieces[i] for i in back]
            if end:
                rows += [(*p, None, None, None) for p in pieces]
            return table(rows)

        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)) if counter else batches:
            blank = []
            docs, firsts, begins, counts = (batch.column(i).to_pylist() for i in range(4))
            for doc, first, begin, n in zip(docs, firsts, begins, counter(counts) if counter else counts, strict=True):
                if not n:
                    blank.append((doc, 0, 0, 0, None, None, None))
                for piece, start in enumerate(range(0, n, most)):
                    pieces.append((doc, first + piece, begin + start, min(most, n - start)))
                    if len(pieces) >= WINDOW:
                        yield emit(False)
            if blank:
                yield table(blank)
        if pieces:
            yield emit(True)

    return run


def packed(docs: DataFrame, sizes: tuple[int, ...] = SIZES, count: str | None = None, counter: Callable[[list[str | None]], list[int]] | None = None) -> DataFrame:
    """docs(doc_id, text, or a column of counts) -> doc_id, piece, start, n_tokens, bin_id, bin_size, bin_offset: a row for each piece.

    counter: gives the counts of a list of texts; it is sent to the workers.
    """
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n = F.col(count) if count else F.when(F.col("text").isNull(), 0).otherwise(words)
    zero = F.lit(0).cast("long")
    n = F.col("text") if counter else F.coalesce(n.cast("long"), zero)
    rows = docs.select("doc_id", zero.alias("piece"), zero.alias("start"), n.alias("n"))
    shipped(docs.sparkSession)
    kind, sizes = "doc_id long, piece long, start long, n_tokens long, bin_id string, bin_size long, bin_offset long", tuple(sorted(sizes))
    first = written(rows.mapInArrow(_packer(sizes, False, counter), kind), "packed")
    left = first.where("bin_id is null and n_tokens > 0").select("doc_id", "piece", "start", F.col("n_tokens").alias("n"))
    tasks = -(-left.count() // WINDOW)
    second = left.repartition(max(1, tasks), "doc_id", "piece", "start").mapInArrow(_packer(sizes, True), kind)
    return first.where("bin_id is not null or n_tokens = 0").unionByName(second)
