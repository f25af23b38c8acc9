r"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Lines are the \n-split parts of a text; their words are runs of [^\x20\x09-\x0D] with A-Z in lower case. A line repeats an earlier
one if their words are equal, or if one word inserted, deleted or replaced makes them so and both have SHARE words or more: the edit
bound is one word in SHARE, and one at most. Earlier is by (doc_id, the text's hash, line number); the earliest line stays, each later
one that repeats any earlier line goes, whether or not that earlier line stays itself. Lines without words always stay.

1. Equal lines: a grouped minimum over 128 bits of hashes of the words; the rest works on one line of each class. No text is
   shuffled here.
2. Two lines of m words or fewer that are one word apart share their first or their last m / 2 words. Only lines that share such
   a part (its length rounded down to a power of two) with another line go on; only they are fetched as text. Of those, only
   lines that share the words around one of SHARE blocks with another line go on: the word that differs is in some block.
3. Then each variant with one word left out is a key, and so are all words together. Keys are sums of position-dependent
   word hashes, so that all n + 1 keys of a line come from running sums over its n words. Keys of equal variants meet in
   grouped minima: a line replaces a word of another if both leave out the same position and get the same key; it extends
   another if one's variant is the other's whole key. No pairs within a group are made.
4. Each line is held word by word against the earliest line so found.

Defined results: a null text is empty and stays; a null doc_id comes after all others; rows equal in doc_id and text are one
document and get the same decision; an empty table gives an empty table; other columns pass through keep_lines() unread; a text
without spaces is one word a line, so that of such lines only equal ones go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import everything, fresh, named, used, written

#: One word in so many may differ, one at most.
SHARE = 8
SPACE = r"[\x20\x09-\x0D]+"
_NO_ID = (1 << 63) - 1
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _row_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("d", F.coalesce(F.col("doc_id"), F.lit(_NO_ID))).withColumn("h", F.xxhash64("text"))


def _plain(line: Column) -> Column:
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    spaced = F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line)
    lower = F.when(F.octet_length(spaced) == F.char_length(spaced), F.lower(spaced)).otherwise(F.translate(spaced, _AZ, _AZ.lower()))  # lower() changes A-Z alone in ASCII, and is faster
    return F.trim(lower)


PARTS = ("p1", "p2", "p3", "p4")


def _parts() -> list[Column]:
    """Hashes of the first and the last L words of t, for L the power of two at most n / 2; also for n + 1 where that gives another L."""

    def ends(count: str, when: Column) -> list[Column]:
        size = f"shiftleft(1, length(bin(({count}) div 2)) - 1)"
        return [F.when(when, F.xxhash64(F.lit(seed), F.expr(f"substring_index(t, ' ', cast({sign}{size} as int))"))) for seed, sign in ((2, ""), (3, "-"))]

    crosses = F.expr("((n + 1) & n) = 0")  # n + 1 is a power of two
    fuzzy = F.col("n") >= SHARE
    return [c.alias(p) for c, p in zip([*ends("n", fuzzy), *ends("n + 1", fuzzy & crosses)], PARTS, strict=True)]


def _frames() -> Column:
    """Hashes of the words of t around each of SHARE blocks of q = n / SHARE words: the first j q and the last (SHARE - 1 - j) q of them.

    If lines of n words, or of n and n - 1, share their first p and last s words and p + s >= n - 1, they share the frame of
    j = p / q, since s >= n - (j + 1) q. So a line has the frames for n, and those for n + 1 where q is another.
    """

    def around(count: str) -> Column:
        q = f"(({count}) div {SHARE})"
        cut = "substring_index(t, ' ', cast({} as int))".format
        return F.array(*[F.xxhash64(F.lit(j), F.expr(q), F.expr(cut(f"{j} * {q}")), F.expr(cut(f"{j + 1 - SHARE} * {q}"))) for j in range(SHARE)])

    return F.when(F.expr(f"(n + 1) % {SHARE} = 0"), F.concat(around("n"), around("n + 1"))).otherwise(around("n"))


def _case_key(text: Column) -> Column:
    """A text of ASCII as it is; the bytes of any other as Latin-1, so that lower() folds A-Z there faster than translate() does.

    lower() then also moves lead bytes of UTF-8 from C0-DE to E0-FE. Their continuation bytes still tell how long a character is, so
    texts become equal by it only if they are equal but for A-Z. The result is for hashing, not for reading.
    """
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1"))


def _lines(docs: DataFrame) -> DataFrame:
    """d, h, line, t (the key of its words, a space between), n (words) of the lines that have words.

    What can be done once for a text is done before it is split. Each step is a column of its own: an expression that a later one
    names more than once would be computed as often.
    """
    text = F.col("text")
    odd = F.contains(text, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(c))
    raw = docs.select("d", "h", F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text).alias("text"))
    raw = raw.select("d", "h", F.lower(_case_key(F.col("text"))).alias("text"))
    dotless = F.lit("\u0131")  # what a Turkish JVM makes of I in texts that are not ASCII; Latin-1 has none
    raw = raw.select("d", "h", F.when(F.contains(F.col("text"), dotless), F.replace(F.col("text"), dotless, F.lit("i"))).otherwise(F.col("text")).alias("text"))
    t = raw.select("d", "h", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select("d", "h", "line", F.trim("raw").alias("t")).where("t <> ''")
    n = F.octet_length("t") - F.octet_length(F.replace(F.col("t"), F.lit(" "), F.lit(""))) + 1
    return t.select("*", n.alias("n"))


def _at(position: Column, word: Column, seed: int) -> Column:
    """40 bits of a word at a position, so that sums over millions of words stay within 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(word, position.cast("long"), F.lit(seed)), 24)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> d, h, line: the number (from 0) of each line to drop; d and h name the document (see _row_key)."""
    docs = _row_key(docs.select("doc_id", "text")).where("text is not null").select("d", "h", "text")
    lines = written(_lines(docs).select("d", "h", "line", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(1), "t").alias("k2"), *_parts()), "lines")

    at = F.struct("d", "h", "line")
    classes = written(lines.groupBy("k1", "k2", *PARTS).agg(F.min(at).alias("at"), F.max(at).alias("last")), "classes")
    again = classes.where(F.col("at") < F.col("last")).select("k1", "k2", F.col("at").alias("first"))
    equal = written(lines.select("k1", "k2", at.alias("at")).join(again.hint("merge"), ["k1", "k2"]).where(F.col("first") < F.col("at")).select("at.*"), "equal")
    used(lines)

    # Lines that share a part with another line, fetched as text and numbered in order.
    parts = classes.select("k1", "k2", F.explode(F.array(*PARTS)).alias("part")).where("part is not null")
    shared = parts.groupBy("part").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("part")
    some = parts.join(shared.hint("merge"), "part").select("k1", "k2").distinct()
    wanted = written(classes.select("k1", "k2", "at").join(some.hint("merge"), ["k1", "k2"]).groupBy("at.d", "at.h").agg(F.collect_list("at.line").alias("lines")), "wanted")
    used(classes)
    near = docs.join(wanted.hint("shuffle_hash"), ["d", "h"]).select("d", "h", "lines", F.split("text", "\n").alias("raw"))
    near = near.select("d", "h", "raw", F.explode("lines").alias("line")).select("d", "h", "line", _plain(F.get("raw", F.col("line"))).alias("t"))
    fetched = written(near, "near")
    near = fetched.groupBy("d", "h", "line").agg(F.first("t").alias("t")).orderBy("d", "h", "line").withColumn("ord", F.monotonically_increasing_id())
    near = written(near.withColumn("n", F.size(F.split("t", " "))), "near")
    used(wanted, fetched)

    # Of these, the lines that share the words around one block with another line.
    frames = written(near.select("ord", F.explode(_frames()).alias("frame")), "frames")
    shared = frames.groupBy("frame").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a < b").select("frame")
    some = frames.join(shared.hint("merge"), "frame").select("ord").distinct()

    # The keys of each line: x1, x2 with word i left out (i from 0), or of all words (i = -1).
    close = near.select("ord", "n", "t").join(some.hint("merge"), "ord", "left_semi")
    spread = close.select("ord", "n", F.posexplode(F.split("t", " ")).alias("i", "w"))
    spread = spread.select("ord", "n", "i", *[_at(F.col("i") - back, F.col("w"), s).alias(f"{'pq'[back]}{s}") for s in (1, 2) for back in (0, 1)])
    line = W.partitionBy("ord")
    upto = line.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = spread.select("ord", "i", "n", *[(F.sum(f"p{s}").over(upto) - F.col(f"p{s}") + F.sum(f"q{s}").over(line) - F.sum(f"q{s}").over(upto)).alias(f"x{s}") for s in (1, 2)], *[F.sum(f"p{s}").over(upto).alias(f"y{s}") for s in (1, 2)])
    whole = F.when(F.col("i") == F.col("n") - 1, F.struct(F.lit(-1).alias("i"), F.col("y1").alias("x1"), F.col("y2").alias("x2"), F.col("n").alias("len")))
    this = F.struct("i", "x1", "x2", (F.col("n") - 1).alias("len"))
    keys = sums.select("ord", F.explode(F.array(this, whole)).alias("v")).where("v is not null").select("ord", "v.*")
    keys = written(keys, "keys")
    used(frames)

    # The earliest line with each variant at the same position, and with each whole key.
    meet = keys.groupBy("len", "x1", "x2", "i").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    wholes = meet.where("i = -1").select("len", "x1", "x2", F.col("first").alias("whole"))
    cuts = meet.where("i >= 0").join(wholes.hint("merge"), ["len", "x1", "x2"], "left").where("first < last or whole is not null")
    cuts = written(cuts, "cuts")
    hits = cuts.select("len", "x1", "x2", "i", F.least("first", "whole").alias("first"), "last").where("first < last")
    found = keys.join(hits.drop("last").hint("merge"), ["len", "x1", "x2", "i"]).select("ord", "first")
    found = found.unionByName(cuts.where("first < whole").select(F.col("whole").alias("ord"), "first"))
    found = found.where("first < ord").groupBy("ord").agg(F.min("first").alias("first"))

    # Word by word: the words before the first difference and after the last one must leave at most one word.
    pair = found.join(near.select("ord", "d", "h", "line", F.split("t", " ").alias("w")), "ord").join(near.select(F.col("ord").alias("first"), F.split("t", " ").alias("v")), "first")
    longer, shorter = F.greatest(F.size("w"), F.size("v")), F.least(F.size("w"), F.size("v"))
    position = F.array_position(F.zip_with("w", "v", lambda a, b: ~a.eqNullSafe(b)), True)
    differ = F.coalesce(F.nullif(position, F.lit(0).cast("long")), longer + 1).cast("int")
    rest = [F.slice(x, differ + F.when(F.size(x) == longer, 1).otherwise(0), longer) for x in ("w", "v")]
    near_at = pair.where((longer - shorter <= 1) & (rest[0] == rest[1])).select("d", "h", "line")
    # the other lines of a near line's class are later than it, and go by step 1
    gone = written(equal.unionByName(near_at).distinct(), "repeated")
    used(equal, near, keys, cuts)
    return gone


def keep_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs with text stripped of its repeated lines; two more columns, the last ones: n_lines and n_dropped (long).

    Where docs has columns of these names, the new ones get an underscore.
    """
    d, h, gone, lines, n_lines, n_dropped = fresh(docs, "d__", "h__", "gone__", "lines__", "n_lines", "n_dropped")
    drop = written(repeated_lines(docs).groupBy(F.col("d").alias(d), F.col("h").alias(h)).agg(F.collect_list("line").alias(gone)), "gone")
    keyed = docs.select(*everything(docs), F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).alias(d), F.xxhash64("text").alias(h))
    out = keyed.join(drop.hint("shuffle_hash"), [d, h], "left")
    # a column of its own: inside transform() a text would be split again for each line
    out = out.withColumn(lines, F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)  # by hash, in order
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n"))
    columns = [text.alias(c) if c == "text" else named(c) for c in docs.columns]
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return out.select(*columns, size.alias(n_lines), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(n_dropped))


SQL = r"""
WITH docs AS (SELECT doc_id, text FROM documents),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM docs),
lines AS (SELECT doc_id, line, list_filter(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM raw),
big AS (SELECT doc_id, line, w, len(w) AS n, doc_id * 1000000 + line AS pos FROM lines WHERE len(w) >= 1),
class AS (SELECT w, n, min(pos) AS pos FROM big GROUP BY w, n),
fz AS (SELECT * FROM class WHERE n >= 8),
cuts AS (SELECT pos, n, i, md5(array_to_string(w[1:i-1], ' ') || ' ' || array_to_string(w[i+1:], ' ')) AS k
         FROM (SELECT pos, n, w, unnest(range(1, n + 1)) AS i FROM fz)),
cuts1 AS (SELECT pos, n, i, k FROM cuts),
wholes AS (SELECT pos, n, k FROM (SELECT pos, n, md5(array_to_string(w, ' ')) AS k, w FROM fz)),
trimmed AS (SELECT pos, n, i, md5(array_to_string(list_concat(w[1:i-1], w[i+1:]), ' ')) AS k
         FROM (SELECT pos, n, w, unnest(range(1, n + 1)) AS i FROM fz)),
pairs AS (SELECT a.pos AS x, b.pos AS y FROM cuts1 a JOIN cuts1 b ON a.k = b.k AND a.i = b.i AND a.n = b.n AND a.pos <> b.pos
          UNION SELECT a.pos, b.pos FROM trimmed a JOIN wholes b ON a.k = b.k AND a.n = b.n + 1
          UNION SELECT b.pos, a.pos FROM trimmed a JOIN wholes b ON a.k = b.k AND a.n = b.n + 1),
bad AS (SELECT DISTINCT x AS pos FROM pairs WHERE y < x
        UNION SELECT b.pos FROM big b JOIN class c ON b.w = c.w AND b.pos > c.pos),
marked AS (SELECT r.doc_id, r.line, r.t, b.pos IS NOT NULL AS gone FROM raw r LEFT JOIN bad b ON b.pos = r.doc_id * 1000000 + r.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
