import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur import frame
from larkspur.llm import entries, html_text, line_dedup, linear, media, mixing, near_dedup, packing, quality_rules, textkit, token_counts, toxicity, url_filter

from oracle import check

ODD = "\u1e9e İ Σ ς ΑΣ H\u0331 e\u0301 \u00a0x\u2028y \x85 z\x1cq 'S don't 12½ ²#* <|endoftext|> \U0001f642\U0001f642 \u0378 ''ll"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
DOC = "doc_id long, text string, lang string, source string, n_chars long, p_toxic double, d__ string, n int, `a.b` string"


def docs(spark, rows):
    """Rows (doc_id, text) as documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "d", 1, "x") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def edge(spark):
    big = (1 << 60) + 1
    return docs(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "null id here"), (None, None), (big, LONG), (big + 1, LONG + " tail"), (5, ODD), (6, "a b c d e"), (7, "A B c d e"), (8, "x\n\nx\n\nx")])


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_matches_sql(name, spark, sf_dir):
    check(entries.queries()[name], entries.oracle_sql()[name], spark, sf_dir)


# Near duplicates.


def brute_sets(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = [(i, brute_sets(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i, _ in sets}


def varied(r, words, share):
    return [r.choice(VOCAB) if r.random() < share else w for w in words]


VOCAB = [f"v{i}" for i in range(3000)]


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(8)
    rows = []
    for _ in range(6):  # stars: copies of one text, some too far from each other
        base = [r.choice(VOCAB) for _ in range(r.randrange(150, 400))]
        rows.append(" ".join(base))
        rows += [" ".join(varied(r, base, r.choice([0.003, 0.01, 0.015, 0.02]))) for _ in range(60)]
    passage = [r.choice(VOCAB) for _ in range(120)]
    rows += [" ".join(passage + [r.choice(VOCAB) for _ in range(r.randrange(40, 200))]) for _ in range(150)]
    rows += [rows[0]] * 30
    r.shuffle(rows)
    rows = list(enumerate(rows))
    for percent in (80, 85):
        want = brute_components(rows, percent)
        got = {x["doc_id"]: x for x in near_dedup.near_duplicates(docs(spark, rows).repartition(9), percent).collect()}
        assert {i: got[i]["component_id"] for i in want} == want
        assert all(got[i]["n_shingles"] == len(brute_sets(t)) and got[i]["kept"] == (want[i] == i) for i, t in rows)


@pytest.mark.parametrize("few", [0, 250_000])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    from larkspur.llm import common

    r = np.random.Generator(np.random.PCG64(11))
    path = [(i, i + 1) for i in r.permutation(np.arange(100, 160)).tolist()]
    edges = [*path, *r.integers(1000, 1200, (150, 2)).tolist(), *((5, i) for i in range(6, 40)), (7, 7), (1 << 40, 3), (None, 4)]
    want = {}
    for u, v in ((u, v) for u, v in edges if u is not None and u != v):
        a, b = want.setdefault(u, {u}), want.setdefault(v, {v})
        if a is not b:
            a |= b
            want.update(dict.fromkeys(b, a))
    made = []
    monkeypatch.setattr(common, "FEW_EDGES", few)
    monkeypatch.setattr(common, "written", lambda df, name, f=common.written: made.append(name) or f(df, name))
    got = common.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((n, min(c)) for n, c in want.items() if n != min(c))
    assert few == 0 or len(made) == 1  # a small graph takes no rounds
    assert common.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_duplicates_in_a_crowded_template(spark):
    n, planted, own, same = 2400, 200, 24, 4  # all share a template to just below 80 %; the planted ones repeat some own words of another
    shared = [f"t{i}" for i in range(180)]
    rows = [shared + [f"d{i}x{j}" for j in range(own)] for i in range(n)]
    rows += [w[: 180 + same] + [f"p{i}x{j}" for j in range(own - same)] for i, w in enumerate(rows[:planted])]
    sets = [brute_sets(" ".join(w)) for w in (rows[0], rows[1], rows[n])]
    near, far = (len(sets[0] & x) / len(sets[0] | x) for x in (sets[2], sets[1]))
    assert near >= 0.8 > far
    order = random.Random(5).sample(range(len(rows)), len(rows))  # numbers that do not tell who belongs together
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs(spark, [(order[i], " ".join(w)) for i, w in enumerate(rows)]), 80).collect()}
    want = {i: i for i in order}
    for i in range(planted):
        want[order[i]] = want[order[n + i]] = min(order[i], order[n + i])
    assert {i for i in want if got[i] != want[i]} == set()


def test_near_duplicate_edges(edge):
    got = near_dedup.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [r["n_shingles"] for r in by[1] + by[2] + by[3]] == [0, 0, 0] and by[1][0]["component_id"] == 1
    assert by[7][0]["component_id"] == 6 and not by[7][0]["kept"]
    assert by[(1 << 60) + 2][0]["component_id"] == (1 << 60) + 1
    assert all(r["component_id"] is None and r["kept"] for r in by[None]) and len(by[4]) == 2
    assert near_dedup.near_duplicates(edge.limit(0)).count() == 0
    kept = near_dedup.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 7").count() == 0 and kept.where("doc_id is null").count() == 2


def test_neighbours_find_the_leader():
    depth, r = 8, np.random.Generator(np.random.PCG64(0))
    base = r.integers(0, 1 << 16, depth)
    rows = np.array([np.where(r.random(depth) < 0.12, r.integers(0, 1 << 16, depth), base) for _ in range(400)] + [base])
    order = np.lexsort(rows.T[::-1])
    ids = np.arange(401)[order]
    a, b = near_dedup.neighbours(np.zeros(401, int), rows[order].astype(">u2"), ids, ids, 2, True)
    like_base = {i for i in range(401) if (rows[i] == base).all()}
    partners = defaultdict(set)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        partners[x].add(y)
        partners[y].add(x)
    near = [i for i in range(400) if (rows[i][:2] == base[:2]).all()]
    assert all(partners[i] & like_base for i in near)
    a, b = near_dedup.neighbours(np.zeros(401, int), rows[order].astype(">u2"), ids % 2, ids, 2, False)
    assert len(a) and ((a % 2) != (b % 2)).all()  # only between different components


@pytest.mark.parametrize("percent", [50, 70, 95])
def test_near_duplicates_at_other_thresholds(spark, percent):
    r = random.Random(percent)
    rows = []
    for i in range(300):  # pairs just above the threshold and just below it
        n, own = 200, i % 2
        share = (percent + 1.5 - 3 * own) / 100
        same = round(2 * share * n / (1 + share)) + 4
        base = [f"p{i}x{j}" for j in range(n + 4)]
        rows += [" ".join(base), " ".join(base[:same] + [f"q{i}x{j}" for j in range(n + 4 - same)])]
    base = [r.choice(VOCAB) for _ in range(300)]
    rows += [" ".join(varied(r, base, 0.04 * (100 - percent) / 50)) for _ in range(80)]
    order = r.sample(range(len(rows)), len(rows))
    rows = [(order[i], t) for i, t in enumerate(rows)]
    want = brute_components(rows, percent)
    assert 150 <= sum(i != c for i, c in want.items())
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs(spark, rows).repartition(5), percent).collect()}
    assert got == want


def test_forest_follows_the_threshold():
    for percent in (12, 50, 70, 80, 85, 95, 100):
        f, s = near_dedup.Forest.of(percent), percent / 100
        assert f.trees * f.depth == near_dedup.N and (1 - s**f.least) ** f.trees <= near_dedup.MISSED and f.agree <= s * near_dedup.N
    for percent in (0, 5, 101):
        with pytest.raises(ValueError):
            near_dedup.Forest.of(percent)


# Line dedup.


def brute_lines(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    lines = [(i, n, tuple(x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x)) for i, text in rows for n, t in enumerate((text or "").split("\n"))]
    lines = [x for x in sorted(lines) if x[2]]

    def apart(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    gone = set()
    for k, (i, n, w) in enumerate(lines):
        if any(v == w or (len(w) >= line_dedup.SHARE and len(v) >= line_dedup.SHARE and apart(v, w)) for _, _, v in lines[:k]):
            gone.add((i, n))
    return gone


def test_lines_against_brute_force(spark):
    r = random.Random(3)
    bases = [[r.choice("abcdefgh") for _ in range(r.randrange(2, 20))] for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(0, 8)):
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                w[at : at + r.randrange(2)] = [r.choice("abcdefgh")] * r.randrange(2)
                w = w or ["a"]
            w = [r.choice([x, x, x.upper()]) for x in w]
            lines.append(r.choice([" ", "  ", "\t"]).join(w))
        rows.append((i, "\n".join(lines)))
    want = brute_lines(rows)
    got = {x["doc_id"]: x for x in line_dedup.keep_lines(docs(spark, rows)).collect()}
    for i, t in rows:
        lines = t.split("\n")
        assert got[i]["text"] == "\n".join(x for n, x in enumerate(lines) if (i, n) not in want), i
        assert got[i]["n_dropped"] == sum((i, n) in want for n in range(len(lines))) and got[i]["n_lines"] == len(lines)


def test_lines_in_another_case(spark):
    long = "ALL Rights Reserved by the Owner \u00c9 of this Page"
    rows = [(1, f"{long}\nx\nX\nword"), (2, f"{long.replace('Reserved', 'reserved').replace('ALL', 'all')}\nWORD\n\u00e9\n\u00c9\ny"), (3, long.replace("Page", "Site").lower().replace("\u00e9", "\u00c9"))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.keep_lines(docs(spark, rows)).collect()}
    assert got == {1: f"{long}\nx\nword", 2: "\u00e9\n\u00c9\ny", 3: ""}


def test_lines_in_another_case_beyond_ascii(spark):
    """Lines are told apart by the bytes of their texts in Latin-1; only A-Z may fall together, whatever the locale of the JVM."""
    odd = ["\u00c9", "\u00e9", "\u00c3", "\u00e3", "\u0130", "\u0131", "i", "I", "k", "K", "\u212a", "\u03a3", "\u03c3", "\u03c2", "\u00df", "\u1e9e", "\u00d7", "\u00f7", "\U00010400", "\U00010428", "\u4e00", "\u0400", "\u0450", "\u00a0", "\u0085", "\u2003", "\u20ac"]
    r = random.Random(5)
    long = ["This Is", "a longer LINE of", "nine words or so"]
    lines = [*odd, *[f"{x} In" for x in odd], *[f"{x}{y}" for x in odd for y in ("I", "i")], *[f"{long[0]} {x} {long[1]} {y} {long[2]}" for x in odd[:12] for y in ("I", "\u0131", "i")], "IN", "in", "\tI\x0b in\r", " ", "\r", "i  IN"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [(60 + i, "\n".join(x for x in r.choices(lines, k=6) if x.isascii())) for i in range(20)]
    want = brute_lines(rows)
    locale = spark._jvm.java.util.Locale
    before = locale.getDefault()
    for name in ("en", "tr", "lt"):
        locale.setDefault(locale.forLanguageTag(name))
        try:
            got = {x["doc_id"]: x["text"] for x in line_dedup.keep_lines(docs(spark, rows)).collect()}
        finally:
            locale.setDefault(before)
        assert got == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want) for i, t in rows}, name


def test_lines_one_word_apart_of_each_length(spark):
    """Each length has its own blocks: one word replaced, inserted or left out anywhere is found."""
    rows = []
    for n in (*range(7, 28), 31, 32, 33, 63, 64, 65):
        words = [f"w{n}x{i}" for i in range(n)]
        for at in sorted({0, 1, n // 8, n // 2, n // 2 + 1, n - 2, n - 1}):
            for new in ([], ["new"], ["new", words[at]]):
                base = [f"{x}at{at}{len(new)}" for x in words]
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:at], *([*new[:1], base[at]] if len(new) == 2 else new), *base[at + 1 :]]))]
    kept = {x["doc_id"]: x["text"] for x in line_dedup.keep_lines(docs(spark, rows)).collect()}
    for (i, a), (k, b) in zip(rows[::2], rows[1::2], strict=True):
        found = min(len(a.split(" ")), len(b.split(" "))) >= line_dedup.SHARE
        assert kept[i] == a and kept[k] == ("" if found else b), (a, b)


def test_lines_are_read_once(spark):
    """Case and white space are worked out once for each text, and a text is not split again for each of its lines."""
    some = docs(spark, [(1, "A b\na B\n\u00c9 c"), (2, "a b")])
    plan = line_dedup._lines(line_dedup._row_key(some))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("regexp_replace(") == 1 and plan.count("split(") == 1 and "translate(" not in plan
    plan = line_dedup.keep_lines(some)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" in plan and plan.count("split(") == 1


def test_line_edges(edge):
    out = line_dedup.keep_lines(edge)
    assert out.columns == [*edge.columns, "n_lines", "n_dropped"]
    got = out.collect()
    assert len(got) == edge.count() and next(r for r in got if r["doc_id"] == 1)["text"] is None
    assert next(r for r in got if r["doc_id"] == (1 << 60) + 2)["n_dropped"] == 1  # one word longer than an earlier line
    assert line_dedup.keep_lines(edge.limit(0)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# Token counts.


def test_token_counts_equal_the_library(spark, table, edge):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(entries.token_path())
    for df in (table, edge):
        rows = df.select("doc_id", "text").collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows)
        got = token_counts.token_counts(df, entries.token_path(), 100).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)


def test_token_counts_load_nothing_on_the_driver(table, monkeypatch):
    """What the driver's Python takes for the library it keeps for all stages."""
    monkeypatch.setattr(token_counts.WholeTokens, "__init__", lambda *_: pytest.fail("the driver loads the library"))
    assert token_counts.token_counts(table, entries.token_path()).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_token_counts_keep_little_in_a_worker(monkeypatch):
    """The whole tokenizer is loaded only for a text that needs it, and a long list of words is merged in blocks."""
    counter = token_counts.WholeTokens(token_counts.checked(entries.token_path()))
    texts = [LONG, " ".join(map("".join, itertools.permutations("zqxjv"))), ODD.replace("\u0378", ""), None, ""]
    want, sizes, whole = counter.count(texts), [], counter.merge

    class Watched:
        def encode_batch_fast(self, words, **kind):
            sizes.append(len(words))
            return whole.encode_batch_fast(words, **kind)

    counter.merge = Watched()
    monkeypatch.setattr(token_counts, "WORDS", 7)
    assert counter.count(texts) == want and len(sizes) > 1 and max(sizes) == 7
    assert "library" not in vars(counter)
    assert counter.count([ODD]) == [len(counter.library.encode(ODD, add_special_tokens=False).ids)] and "library" in vars(counter)


def test_token_counts_refuse_other_files():
    import json

    with open(entries.token_path(), encoding="utf-8") as f:
        good = json.load(f)
    token_counts.supported(good)
    for change in ({"normalizer": None}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": good["model"] | {"byte_fallback": True}}, {"model": good["model"] | {"end_of_word_suffix": None}}, {"added_tokens": [good["added_tokens"][0] | {"normalized": True}]}):
        with pytest.raises(ValueError):
            token_counts.supported(good | change)


def test_token_counts_over_code_points():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(entries.token_path())
    counter = token_counts.WholeTokens(token_counts.fit(entries.token_path())[0])
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}b {chr(c)}\u0301! " for c in points[i : i + 16]) for i in range(0, len(points), 16)] + [ODD, "<|startoftext|>x<|endoftext|>" * 3]
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(counter.proven), 500))


# HTML.


def test_html_extraction_held_out():
    r = np.random.Generator(np.random.PCG64(99))
    model, wrong, n = html_text.trained(), 0, 0
    for _ in range(150):
        found = html_text.blocks(html_text._made_page(r))
        y = [("\x02" in t) for t, _ in found]
        if found:
            wrong += int((model.label([html_text.vectors([(t.replace("\x02", "") or "x", p) for t, p in found])])[0] != y).sum())
            n += len(y)
    assert wrong / n < 0.02


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_html_extraction_of_all_pages(spark, sf_dir, sf):
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', sf)}/pages.parquet")
    got = {x["page_id"]: x for x in html_text.main_text(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        want = [" ".join(html_text.entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[p["page_id"]]["text"] == "\n\n".join(w for w in want if w)


def test_html_wording_counts(spark):
    a, b = (html_text.vectors([(f"one {w} three", ("div", "p"))]) for w in ("cookies", "mountain"))
    assert (a != b).any()  # inner words are read
    story = " ".join(f"<p>{' '.join(VOCAB[i * 40 : i * 40 + 40])}.</p>" for i in range(4))
    page = "<body><div><p>{}</p></div><article><h1>A title</h1>" + story + "</article></body>"
    texts = html_text.extract(html_text.labeller(spark), [page.format("We use cookies to improve your experience. Accept all cookies"), page.format("Subscribe to our newsletter")])
    assert all(t.startswith("A title") for t in texts)


def test_html_broken_markup_is_linear():
    import time

    n = 60_000
    for page in ("<a " * n, "<a '" * n, "<a \"" * n + ">", "<a '\"" * n + ">x", "<!-" * n, "</script" * n, "<script>" + "</script" * n, "<b>" * 2000 + "</i>" * n, "<div class='" * n + ">"):
        began = time.monotonic()
        html_text.blocks(page)
        assert time.monotonic() - began < 5, page[:20]
    assert html_text.blocks("a <b c='x>y</b> <p>z") == [("a y", ()), ("z", ("p",))]


def test_html_edges(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, "u", "<p>a <b>b</b>&amp;\n c<br>d<p>e"), (4, "u", "<script>x"), (5, "u", "<!-- x"), (6, "u", "plain & <3"), (1 << 60 | 1, None, "<article><p>" + LONG + "</article>")]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")).collect()}
    assert len(got) == len(pages) and got[1]["text"] == got[2]["text"] == got[4]["text"] == got[5]["text"] == ""
    assert got[1 << 60 | 1]["text"] == LONG and got[1 << 60 | 1]["n_chars"] == len(LONG)
    assert html_text.blocks("<p>a <b>b</b>&amp;\n c<br>d<p>e") == [("a b& c d", ("p",)), ("e", ("p",))]
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_labeller_gradient():
    r = np.random.Generator(np.random.PCG64(4))
    m = html_text.Labeller()
    m.w, m.b, m.v = [w.astype(float) for w in m.w], [b.astype(float) for b in m.b], m.v.astype(float)
    x, mask, y = html_text._padded([(r.normal(size=(n, html_text.INPUT)), r.integers(0, 2, n)) for n in (3, 5)])
    loss = lambda: float((np.where(mask, np.logaddexp(0, z := m.forward(x, mask)) - y * z, 0)).sum() / mask.sum())
    grads = m._gradients(x, mask, y)
    for p, g in ((m.w[0], grads[0]), (m.w[1], grads[1]), (m.b[0], grads[2]), (m.v, grads[4])):
        at = tuple(r.integers(0, s) for s in p.shape)
        p[at] += 1e-3
        up = loss()
        p[at] -= 2e-3
        down = loss()
        p[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(float(g[at]), abs=2e-3)


# URLs.


def test_url_rules_and_parsing(spark):
    urls = [None, "", "no scheme", "HTTP://Www.Example.COM/en/7?x", "http://example.com/en/8", "http://x.net/de/1", "http://a.example.net/de/8#f", "http://example.org/es/", "http://example.org/es", "http://notexample.com", "https://com/en/", "a://b://c/d", "x://h?q#r", "http://H\u00c9.org/\nz"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.judged(pages, labels, entries.URL_RULES).collect()}
    want = [("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/7", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("x.net", "/de/1", "net/de/", "allow"), ("a.example.net", "/de/8", "example.net/de/8", "block"), ("example.org", "/es/", "org/es/", "block"), ("example.org", "/es", None, "allow"), ("notexample.com", "", None, "allow"), ("com", "/en/", "com/en/", "block"), ("b:", "//c/d", None, "allow"), ("h", "", None, "allow"), ("h\u00c9.org", "/\nz", None, "allow")]
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == want


def test_mined_rules_against_counting(spark):
    r = random.Random(2)
    slug = "/".join("abcdefghijklmnop")  # long paths hide nothing
    rows = [(i, f"http://{r.choice(['spam', 'news', 'shop'])}.{r.choice(['x', 'y'])}.com/{slug}/{r.choice(['win', 'read'])}/{i}?ref={i}") for i in range(600)]
    bad = {i: int(("spam" in u and "win" in u) or r.random() < 0.05) for i, u in rows}
    pages = spark.createDataFrame([*rows, (600, None), (601, "http://shop.x.com/block/me")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    table = url_filter.written(url_filter.baskets(pages, labels, [("shop.x.com/block", "block"), ("shop.x.com/", "allow")]), "baskets")
    explicit = {x["page_id"]: (x["verdict"], x["bad"]) for x in table.collect()}
    assert all(explicit[i] == (("allow", 0) if "//shop.x.com" in u else (None, bad[i])) for i, u in rows) and explicit[600] == (None, 0) and explicit[601] == ("block", 1)
    rules = dict(url_filter.mined(table))
    sets = {x["page_id"]: (frozenset(x["tokens"]), x["bad"]) for x in table.collect() if x["tokens"]}
    n, want = len(sets), {}
    alike = defaultdict(list)  # tokens that occur on the same pages are one
    for t in sorted(set().union(*(s for s, _ in sets.values()))):
        alike[frozenset(i for i, (s, _) in sets.items() if t in s)].append(t)
    for size in (1, 2, 3, 4):
        for items in itertools.combinations(sorted(v[0] for v in alike.values()), size):
            have = [b for s, b in sets.values() if s.issuperset(items)]
            if sum(have) >= url_filter.SUPPORT * n and sum(have) and url_filter.wilson(sum(have), len(have)) >= url_filter.CONFIDENCE:
                if not any(set(w) < set(items) and c >= sum(have) / len(have) for w, c in want.items()):
                    want[items] = sum(have) / len(have)
    assert rules.keys() == want.keys() and rules and all(rules[k] == pytest.approx(want[k]) for k in want)
    assert any({"h:spam", "p:win"} <= set(k) for k in rules)
    index = url_filter.Index(list(rules.items()))
    for _, u in rows:
        fits = [k for k in rules if set(k) <= set(url_filter.tokens(u))]
        assert (index.match(url_filter.tokens(u)) is not None) == bool(fits)
    got = {x["page_id"]: x for x in url_filter.judged(pages, labels, [("shop.x.com/", "allow")]).collect()}
    assert all(got[i]["verdict"] == "block" for i, u in rows if "spam" in u and "win" in u) and got[600]["verdict"] == "allow"


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_rules_of_the_given_tables(spark, sf_dir, sf):
    read = lambda t: spark.read.parquet(f"{sf_dir.replace('sf0.001', sf)}/{t}.parquet")
    rules = url_filter.mined(url_filter.written(url_filter.baskets(read("pages"), read("labels"), entries.URL_RULES), "baskets"))
    assert len(rules) >= 3 and all(c >= url_filter.CONFIDENCE for _, c in rules)
    assert any(set(k) == {"d:example.org", "p:es"} or set(k) == {"h:org", "p:es"} for k, _ in rules)


# Media.


def test_media_round_trip(spark, edge):
    got = media.text_media(edge).collect()
    assert len(got) == edge.count()
    texts = defaultdict(list)
    for r in edge.collect():
        texts[r["doc_id"]].append(r["text"])
    for r in got:
        options = []
        for t in texts[r["doc_id"]]:
            raw = (t or "").encode()
            payload = raw + bytes(-len(raw) % 64 if raw else 64)
            options.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media.store(payload)).hexdigest()))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) in options
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= 64 and r["feature"].startswith("audio/wav;")
    assert media.text_media(edge.limit(0)).count() == 0


def png(w=1, h=1):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff!\xf9\x04\x00\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04JF\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00?\x00\xaa\xff\x00\xbb\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
OGG = b"OggS\0\x06" + bytes(8) + b"abcd" + bytes(8) + b"\x01\x03xyz"
OGG = OGG[:22] + struct.pack("<I", media.page_checksum(OGG)) + OGG[26:]
FLAC = b"fLaC\x00\x00\x00\x22" + bytes(34) + b"\x84\x00\x00\x04abcd" + b"\xff\xf8frames"


def test_sniffing_carves_and_corrects(spark):
    files = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "audio/wav": media.store(b"abc"), "audio/ogg": OGG}
    for kind, f in files.items():
        assert media.sniff(f) == [(0, len(f), kind)], kind
        assert media.sniff(f[:-1]) == [], kind
        assert media.sniff(b"xx" + f + b"BM RIFF GIF89a") == [(2, len(f), kind)], kind
    wrong = OGG[:-1] + b"!"
    assert media.sniff(wrong) == [] and media.sniff(OGG + OGG) == [(0, len(OGG), "audio/ogg"), (len(OGG), len(OGG), "audio/ogg")]
    assert media.sniff(FLAC) == [(0, len(FLAC), "audio/flac")]
    assert media.sniff(b"x" + FLAC + OGG + FLAC + GIF) == [(1, len(FLAC), "audio/flac"), (1 + len(FLAC), len(OGG), "audio/ogg"), (1 + len(FLAC + OGG), len(FLAC), "audio/flac"), (1 + len(FLAC + OGG + FLAC), len(GIF), "image/gif")]
    rows = [(1, png(), "text/plain"), (2, b"--" + GIF + b"--" + JPEG, "application/x"), (3, None, "a"), (4, b"", None), (5, media.store(png()), "audio/wav")]
    out = media.sniffed(spark.createDataFrame([(*r, "m") for r in rows], "id long, v binary, t string, corrected string"), "v", "t", carve=True)
    got = {r["id"]: r for r in out.collect()}
    assert (got[1]["media_type"], got[1]["corrected_"]) == ("image/png", True) and got[1]["embedded"] == []
    assert [bytes(e["bytes"]) for e in got[2]["embedded"]] == [GIF, JPEG] and got[2]["media_type"] == "application/x"
    assert got[3]["media_type"] == "a" and got[4]["media_type"] is None and not got[5]["corrected_"]
    r = random.Random(1)
    for n in range(200):
        p = bytes(r.randrange(256) for _ in range(n))
        assert media.payload_of(media.store(p)) == p and media.sniff(media.store(p))[0] == (0, len(media.store(p)), "audio/wav")


# Quality rules.


def brute_base(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_base_counts(edge, table):
    texts = [r["text"] for r in edge.collect()] + [r["text"] for r in table.collect()] + ["a b c a b c", "a b c", "a a a a", "é|é\né|é\n \n "]
    assert [tuple(map(int, r)) for r in quality_rules.base_counts(texts).to_numpy()] == [brute_base(t) for t in texts]


def test_quality_keeps_prose_and_rejects_junk(spark, table, labels, edge):
    got = {r["doc_id"]: r for r in quality_rules.quality(table).collect()}
    for r in labels.collect():
        if r["quality"] == 1 and not got[r["doc_id"]]["base_failed"]:
            assert got[r["doc_id"]]["kept"]
    low = [got[r["doc_id"]] for r in labels.collect() if r["quality"] == 0]
    assert sum(not r["kept"] for r in low) >= 0.9 * len(low)
    out = quality_rules.quality(edge).collect()
    assert len(out) == edge.count() and not any(r["kept"] for r in out if r["n_words"] < 50)
    assert quality_rules.quality(edge.limit(0)).count() == 0


def brute_mcd(x, prior=None, starts=60, seed=0):
    """The least determinant over random starts, each taken to its end by exact concentration steps -> mean, covariance, inverse, log determinant."""
    r, (n, k) = np.random.Generator(np.random.PCG64(seed)), x.shape
    h, best = int(np.ceil(quality_rules.H * n - 1e-9)), None

    def estimate(rows):
        count, s, p = len(rows), rows.sum(axis=0), rows.T @ rows
        if prior:
            count, s, p = count + quality_rules.PRIOR, s + quality_rules.PRIOR * prior[0], p + quality_rules.PRIOR * (prior[1] + np.outer(prior[0], prior[0]))
        m = s / count
        raw = p / count - np.outer(m, m)
        c = raw * quality_rules._CONSISTENT + np.diag(np.square(quality_rules.FLOOR))
        return m, raw, np.linalg.inv(c), np.linalg.slogdet(c)[1]

    for i in range(starts):
        rows, last = x[r.permutation(n)[: h if i == 0 else min(n, k + 1)]], None
        while last is None or now[3] < last - 1e-9:
            last = now[3] if rows is None else np.inf
            now = estimate(x[near] if rows is None else rows)
            d = np.einsum("ij,jk,ik->i", x - now[0], now[2], x - now[0])
            near, rows = np.argsort(d, kind="stable")[:h], None
        now = estimate(x[near])
        if best is None or now[3] < best[3]:
            best = now
    return best


def test_mcd_against_many_starts(spark):
    r = np.random.Generator(np.random.PCG64(2))
    shape = r.normal(size=(5, 5))
    clean = r.normal(size=(2000, 5)) @ shape
    far = clean.copy()
    far[:400] = far[:400] * 0.1 + 30  # a tight group apart
    rows = [(g, *map(float, v)) for g, x in (("clean", clean), ("far", far), ("one", far[:1])) for v in x]
    got = {e["g"]: e for e in quality_rules.estimates(spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double, x4 double")).collect()}
    for g, x in (("clean", clean), ("far", far)):
        m, _, _, det = brute_mcd(x)
        assert got[g]["det"] <= det + 0.1 and np.abs(np.array(got[g]["mean"]) - m).max() < 0.5
    assert np.allclose(got["one"]["mean"], far[0]) and np.abs(np.array(got["far"]["mean"])).max() < 1


def test_quality_against_brute_force(spark, table):
    part = F.col("doc_id") % 5
    some = table.withColumn("lang", F.when(part == 0, None).otherwise(F.col("lang"))).withColumn("source", F.when(part == 1, None).when(part == 2, "a").otherwise("b"))
    texts = {r["doc_id"]: r for r in some.collect()}
    counts = quality_rules._counted([r["text"] for r in texts.values()])
    x, keys = {}, {}
    for i, (words, chars, symbols, dup, repeat, lines) in zip(texts, zip(*counts, strict=True), strict=True):
        n, c = max(words, 1), max(chars, 1)
        if words >= 50 and 100 * repeat <= 50 * words:
            x[i] = np.array([np.log1p(words), np.log(c / n), np.sqrt(symbols / c), np.sqrt(dup / lines), np.sqrt(repeat / n)])
            keys[i] = (texts[i]["lang"], texts[i]["source"])
    every = brute_mcd(np.stack(list(x.values())))
    langs = {g: brute_mcd(np.stack([x[i] for i in x if keys[i][0] == g]), every) for g in {k[0] for k in keys.values()}}
    own = {k: brute_mcd(np.stack([x[i] for i in x if keys[i] == k]), langs[k[0]]) for k in set(keys.values())}
    assert None in langs and any(k[0] is not None and k[1] is None for k in own)
    seen = 0
    for r in quality_rules.quality(some).collect():
        i = r["doc_id"]
        assert r["base_failed"] == (i not in x)
        if i in x:
            m, _, inverse, _ = own[keys[i]]
            d = (x[i] - m) @ inverse @ (x[i] - m)
            if not 0.8 < d / quality_rules.CUT < 1.25:
                seen += 1
                assert r["kept"] == (d <= quality_rules.CUT), (i, d, r["distance"])
    assert seen >= 0.95 * len(x)


def test_chi_square():
    assert quality_rules.chi_square_tail(11.0705, 5) == pytest.approx(0.05, abs=1e-5) and quality_rules.chi_square_tail(14.0671, 7) == pytest.approx(0.05, abs=1e-5)
    assert quality_rules.chi_square_quantile(0.25, 5) == pytest.approx(6.6257, abs=1e-3)


# Classifier chain and mixing.


def test_toxicity_held_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = labels.where("doc_id % 2 = 0")
    out = toxicity.toxicity(table, known).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    toxic = out["toxic"] == 1
    assert out["rejected"][~toxic].mean() < 0.005 and out["rejected"][toxic].mean() > 0.7


def test_chain_against_plain_folds():
    r = np.random.Generator(np.random.PCG64(7))
    x = np.c_[r.normal(size=(400, 3)), np.ones(400)]
    first = (x[:, 0] + r.normal(size=400) > 0).astype(float)
    second = (first + x[:, 1] + r.normal(size=400) > 1).astype(float)
    ids = np.arange(400) * 17
    weights = toxicity.chained(x, ids, [first, second])
    fold = (ids * 2654435761 >> 7) % toxicity.FOLDS
    out = np.array([1 / (1 + np.exp(-(x[i] @ linear.logistic(x[fold != fold[i]], first[fold != fold[i]])))) for i in range(400)])
    seen = np.c_[np.log(np.clip(out, 1e-4, 1 - 1e-4) / (1 - np.clip(out, 1e-4, 1 - 1e-4))) / 4, x]
    assert np.allclose(weights[0], linear.logistic(x, first)) and np.allclose(weights[1], linear.logistic(seen, second), atol=1e-6)


def test_toxicity_edges(spark, edge, labels):
    known = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (known, known.limit(0)):
        out = toxicity.toxicity(edge, marks)
        assert out.count() == edge.count()
        clean = toxicity.without_toxic(edge, marks)
        assert clean.columns == edge.columns
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in edge.collect()}
    assert toxicity.toxicity(edge.limit(0), known).count() == 0


def test_logistic_finds_the_optimum():
    r = np.random.Generator(np.random.PCG64(5))
    x = np.c_[r.normal(size=(300, 4)), np.ones(300)]
    y = (x @ [1, -2, 0, 0.5, 0.3] + r.normal(size=300) > 0).astype(float)
    w = linear.logistic(x, y, 1.0)
    g = x.T @ (linear.sigmoid(x @ w) - y) + np.r_[w[:-1], 1e-6 * w[-1]]
    assert np.abs(g).max() < 1e-3


def dual_newton(n, p, want, natural, mu, budget):
    """The optimum by another way: Newton steps on the K multipliers, rates max(0, budget - p.l / mu)."""
    share, lam = n / n.sum(), np.zeros(p.shape[1])
    loss = lambda v: natural @ v**2 / 2 + want @ v + mu / 2 * (share @ (np.maximum(0, budget - p @ v / mu) ** 2 - budget**2))
    for _ in range(300):
        r = np.maximum(0, budget - p @ lam / mu)
        g = natural * lam + want - (share * r) @ p
        on = r > 0
        move = np.linalg.solve(np.diag(natural) + (p[on] * share[on, None]).T @ p[on] / mu, g)
        scale = 1.0
        while scale > 1e-9 and loss(lam - scale * move) > loss(lam) - 1e-4 * scale * (g @ move):
            scale /= 2
        lam = lam - scale * move
        if np.abs(g).max() < 1e-12:
            break
    return np.maximum(0, budget - p @ lam / mu)


def test_mixing_against_an_independent_solver(spark):
    r = np.random.Generator(np.random.PCG64(6))
    for targets in ({"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 0.005, "b": 0.99, "c": 0.005}, {"a": 0.999, "b": 0.0005, "c": 0.0005}):
        p = r.dirichlet([0.3, 0.3, 0.3], 500)
        if targets["a"] > 0.99:
            p = 0.2 + 0.4 * p  # no rates reach these targets
        n = r.integers(1, 1000, 500)
        df = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(500)], "doc_id long, n_tokens__ long, p__ array<double>")
        fit = mixing.fit_rates(df, list(targets), targets)
        want, share = np.array(list(targets.values())), n / n.sum()
        natural, rate = share @ p, fit.rates(p, 1.0)
        assert rate.min() >= 0 and np.allclose((share * rate) @ p, list(fit.shares.values()), atol=1e-9) and len(fit.steps) < mixing.STEPS
        loss = lambda q: (((share * q) @ p - want) ** 2 / natural).sum() / 2 + mixing.MU / 2 * share @ (q - 1) ** 2  # noqa: B023, E731
        best = dual_newton(n, p, want, natural, mixing.MU, 1.0)
        reached = (np.abs((share * best) @ p - want) <= mixing.NEAR * want).all()
        assert loss(rate) <= loss(best) * 1.05 + 1e-4
        if reached:
            assert (np.abs(np.array(list(fit.shares.values())) - want) <= mixing.NEAR * want).all()
    assert len([1 for t in [targets] if not reached]) == 1  # the last ones are out of reach


def test_mixing_posteriors_are_numbers():
    p = mixing.softmax_of_logistic(np.array([[-2000.0, -1999.0, -3000.0], [900.0, 0.0, -900.0]]))
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1) and p[0, 1] > p[0, 0] > p[0, 2]


def test_mixing_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["rate"] for r in mixing.mixing(edge, none).collect()] == [1.0] * edge.count()
    out = mixing.mixed(edge, none, budget=2.0)
    assert out.columns == edge.columns and out.count() == 2 * edge.count()
    assert mixing.mixed(edge.limit(0), none).count() == 0


# Packing.


def test_packing(spark, table, edge):
    for df in (table, edge):
        rows = packing.packed(df.repartition(3)).collect()
        words = Counter((r["doc_id"], len([x for x in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if x])) for r in df.collect())
        got = Counter()
        bins = defaultdict(list)
        for r in rows:
            got[r["doc_id"]] += r["n_tokens"]
            if r["bin_id"]:
                bins[r["bin_id"]].append(r)
        want = Counter()
        for (i, n), times in words.items():
            want[i] += n * times
        assert got == want
        for members in bins.values():
            size, used = members[0]["bin_size"], sum(m["n_tokens"] for m in members)
            assert {m["bin_size"] for m in members} == {size} and size == min(s for s in packing.SIZES if s >= used)
            at = 0
            for m in sorted(members, key=lambda m: m["bin_offset"]):
                assert m["bin_offset"] == at
                at += m["n_tokens"]
    assert packing.packed(edge.limit(0)).count() == 0


def test_pipeline_packs_with_one_worker_a_task(spark, table, edge, sf_dir, monkeypatch):
    """Two Python steps in one task hold two workers, and their memory is the executor's."""
    plans, write = [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    for df in (table, edge, edge.limit(0)):
        df = df.repartition(3).cache()
        got = corpus_pipeline.pack(spark, df, sf_dir)
        assert plans.pop().count("MapInArrow ") == 1
        counts = token_counts.token_counts(df, entries.token_path())
        place = ("doc_id", "piece", "start", "n_tokens", "bin_size", "bin_offset")
        rows = lambda out: Counter(map(tuple, out.select(*place, F.col("bin_id").isNull()).collect()))
        assert rows(got) == rows(packing.packed(counts, count="n_tokens"))
        plans.clear()
        df.unpersist()


def test_packing_over_small_and_unequal_partitions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    for rows in (d.repartition(1), d.repartition(100), d.repartitionByRange(7, "n_chars")):
        bins = packing.packed(rows).where("bin_id is not null").groupBy("bin_id", "bin_size").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("m"), F.countDistinct("bin_offset").alias("o"))
        size, used, wrong = bins.agg(F.sum("bin_size"), F.sum("n"), F.sum((F.col("m") != F.col("o")).cast("int"))).first()
        assert used / size > 0.985 and wrong == 0 and bins.select("bin_id").distinct().count() == bins.count()


def test_pack_is_best_fit():
    r = random.Random(4)
    lengths = [r.randrange(1, 8193) for _ in range(400)] + [r.randrange(1, 400) for _ in range(4000)]
    bins = packing.pack(lengths)
    assert sorted(i for _, m in bins for i in m) == list(range(len(lengths)))
    fill = sum(lengths) / sum(s for s, _ in bins)
    assert fill > 0.98
    # a plain best fit into the same opened bins, without the sorted index
    order, open_bins = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)), []
    for i in order:
        fits = [b for b in open_bins if b[0] >= lengths[i]]
        if fits:
            b = min(fits, key=lambda b: (b[0], b[2]))
        else:
            left = sum(lengths) - sum(lengths[j] for j in order[: order.index(i) + 1])
            b = [min((s for s in packing.SIZES if s >= lengths[i]), key=lambda s: (packing.cost(s) / min(s, lengths[i] + left), s)), [], len(open_bins)]
            open_bins.append(b)
        b[0] -= lengths[i]
        b[1].append(i)
    assert [m for _, m in bins] == [b[1] for b in open_bins]


# The pipeline.


def test_pipeline_stages(spark, sf_dir, table, labels):
    from larkspur.llm.common import written

    now = table
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, now, sf_dir), name)
        assert out.columns == table.columns
        before, after = {r["doc_id"]: r["text"] for r in now.collect()}, [(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()]
        if name == "line_dedup":
            gone = brute_lines(sorted(before.items()))
            want = {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone) for i, t in before.items()}
            assert {i: t for i, t, _ in after} == {i: t for i, t in want.items() if t == before[i] or t.split()}
            assert all(n == len(t) for _, t, n in after)
        if name == "near_dedup":
            roots = brute_components(sorted(before.items()), 80)
            assert {i for i, _, _ in after} == {i for i, c in roots.items() if i == c or not brute_sets(before[i])}
        if name == "mixing":
            assert {i for i, _, _ in after} <= before.keys()
        now = out
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(entries.token_path())
    assert packed.agg(F.sum("n_tokens")).first()[0] == sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in now.collect())


def test_pipeline_runs_on_edges(spark, edge, sf_dir):
    for rows in (edge, edge.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf_dir)
        assert now.count() >= 0


def test_word_hashes_do_not_depend_on_the_block():
    a = textkit.Words([b"x yy zzz"], False).hashes()
    b = textkit.Words([b"other text", b"  yy\tzzz x"], False).hashes()
    assert a.tolist() == [b[4], b[2], b[3]]


def test_pipeline_stages_send_small_batches(spark, sf_dir, monkeypatch):
    """10,000 rows of long texts at once are held several times over in the JVM and in each worker."""
    rows = docs(spark, [(i, LONG) for i in range(40)]).coalesce(1)  # 4 MB in one partition
    before, most = spark.conf.get(frame.SIZED, None), 2 * frame.BATCH

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    try:
        for own in (None, "3000000"):  # a limit that the session names stays
            for _, stage in corpus_pipeline.STAGES:
                spark.conf.unset(frame.SIZED) if own is None else spark.conf.set(frame.SIZED, own)
                stage(spark, rows.limit(0), sf_dir)
                assert spark.conf.get(frame.SIZED) == (own or str(frame.BATCH))
            got = rows.select("doc_id", "text").mapInArrow(sizes, "n long, size long").agg(F.sum("n"), F.max("size")).first()
            assert got[0] == 40 and (got[1] <= most if own is None else got[1] > most)
    finally:
        spark.conf.unset(frame.SIZED) if before is None else spark.conf.set(frame.SIZED, before)


def test_pipeline_stages_let_executors_collect(spark):
    """An executor's heap holds on to what earlier stages left in it, beside the next stage's workers."""
    full = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if re.search("Old|MarkSweep", b.getName()))
    before = full()
    frame.lean(spark)
    assert full() > before


def test_words_without_features_are_held_once():
    f = linear.Features([])
    f.of_texts(["one two three", "four", None])
    assert len(f._known) == 4 and len({id(x) for x in f._known.values()}) == 1


def test_forest_orders_grow_with_the_sets():
    """A row for each set and tree, whatever the sets have in common."""
    for forest in map(near_dedup.Forest.of, (80, 85)):
        for m in (1, 50, 2500):
            batch = pd.DataFrame({"rep": range(m), "root": 0, "sig": [b"\0\1" * near_dedup.N] * m})
            few = forest.trees // 4
            assert [sum(map(len, near_dedup._orders(forest, t)(iter([batch])))) for t in (range(few), range(few, forest.trees))] == [m * few, m * (forest.trees - few)]
