"""Main text of web pages: a bidirectional LSTM labels every block of a page.

A scanner cuts a page into leaf blocks: runs of text between block-level tags, with the path of open tags (with their class, id
and role words). Each block is read as two vectors: hashed tag-path words, and all distinct hashed words of its text (scaled by the root
of their number) with a few shape values. The LSTM (numpy, both directions) reads the whole sequence of a page, so that a block's
label depends on everything before and after it; pages are batched by length, none is cut.

Training (fixed seed) is on pages written by a small generator: articles with headings, paragraphs, lists, quotes and unclosed
inline tags, among menus, headers, footers, sidebars, notices, adverts, forms and reader comments, in varying order, nesting and
naming, some known by their wording alone. It doesn't read the corpus, so that equal pages get equal text at every input size. The
fitted weights are kept in the shared folder, under a digest of this file: one driver of a cluster trains, the others read.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes (an unclosed script or comment
runs to the end, a quote that is not closed is a plain character, a tag that is not closed is text); an empty table gives an empty
table; only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from bisect import bisect_right
from collections import Counter
from functools import cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import appended, shared_dir

PATH, WORDS, SHAPE, HIDDEN = 96, 64, 6, 16
INPUT = PATH + WORDS + SHAPE
_MARK = re.compile(r"<(?:!|\?|/?[a-zA-Z])")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[^\W_]+")
# Element kinds of HTML.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "object"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "label", "big", "strike"}
_CLOSED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Tags:
    """Tags of a page in order. Every search is remembered, so that broken markup costs no more than sound markup."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = {q: [m.start() for m in re.finditer(q, page)] for q in "\"'"}
        self.last = page.rfind(">")
        self.dead: set[int] = set()  # places from which no unquoted > follows

    def end(self, i: int) -> int:
        """The place after the > that ends the tag whose name ends at i; 0 if there is none."""
        if i > self.last:
            return 0
        first, seen = i, []
        while True:
            if i in self.dead:
                break
            seen.append(i)
            m = _STOP.search(self.page, i)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            places = self.quotes[m[0]]
            k = bisect_right(places, m.start())
            i = places[k] + 1 if k < len(places) else m.end()
        self.dead.update(seen)
        return self.page.find(">", first) + 1  # quotes that swallow the rest of the page are none

    def __iter__(self):
        """(start, end, name, closing, inside) of each tag; name is empty for comments and declarations."""
        page, at, n = self.page, 0, len(self.page)
        while m := _MARK.search(page, at):
            start = m.start()
            if m[0] == "<!" or m[0] == "<?":
                if page.startswith("<!--", start):
                    stop = page.find("-->", start + 4)
                    at = stop + 3 if stop >= 0 else n
                else:
                    stop = page.find(">", start)
                    at = stop + 1 if stop >= 0 else n
                yield start, at, "", False, ""
                continue
            name = _NAME.match(page, start)
            stop = self.end(name.end())
            if not stop:
                return
            tag, closing = name[1].lower(), page[start + 1] == "/"
            inside, at = page[name.end() : stop - 1], stop
            if not closing and tag in _RAW:
                at = self._raw_end(tag, stop)
            yield start, at, tag, closing, inside

    def _raw_end(self, tag: str, at: int) -> int:
        m = re.compile(rf"</{tag}(?![a-zA-Z0-9:_-])", re.I).search(self.page, at)
        stop = self.page.find(">", m.end()) if m else -1
        return stop + 1 if stop >= 0 else len(self.page)


def blocks(html: str | None) -> list[tuple[str, tuple[str, ...]]]:
    """(text, path words) of the leaf blocks in page order."""
    out: list[tuple[str, tuple[str, ...]]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    path: tuple[str, ...] = ()

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append((joined, path))
            text.clear()

    def add(piece: str) -> None:
        nonlocal path
        if not text and piece.strip():
            path = tuple(w for _, ws in stack for w in ws)
        if text or piece.strip():
            text.append(piece)

    page, at = html or "", 0
    for start, end, tag, closing, inside in _Tags(page):
        if start > at:
            add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br" or tag in ("img", "wbr", "input"):
            if text:
                text.append(" " if tag == "br" else "")
            continue
        if not closing and tag in _RAW:
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if closing:
            if opened[tag]:
                while stack:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == tag:
                        break
            continue
        if tag not in _INLINE:  # a block ends open paragraphs, headings and the inline tags in them
            k = len(stack)
            while k and (stack[k - 1][0] in _INLINE or stack[k - 1][0] in _CLOSED_BY_BLOCK):
                k -= 1
            if any(t in _CLOSED_BY_BLOCK for t, _ in stack[k:]):
                opened.subtract(t for t, _ in stack[k:])
                del stack[k:]
        words = [tag]
        for a in _ATTRIBUTE.finditer(inside):
            words += [f"@{w.lower()}" for w in _WORD.findall(a[2] or a[3] or a[4] or "")]
        stack.append((tag, tuple(words)))
        opened[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    return out


@cache
def _slot(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h % size, 1.0 if h >> 31 else -1.0


class _Slots(dict):
    """Signed slot of each word; forgets when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        self[word] = out = h % WORDS + (WORDS if h >> 31 else 0)
        return out


_SLOTS = _Slots()


def vectors(found: list[tuple[str, tuple[str, ...]]]) -> np.ndarray:
    """One row of INPUT values for each block."""
    x = np.zeros((len(found), INPUT), np.float32)
    for k, (text, path) in enumerate(found):
        for w in set(path):
            i, s = _slot(w, PATH)
            x[k, i] += s
        words = text.split()
        n = len(words)
        distinct = set(words)
        counts = np.bincount([_SLOTS[w] for w in distinct], minlength=2 * WORDS)
        x[k, PATH : PATH + WORDS] = 0.5 * (counts[WORDS:] - counts[:WORDS]) / np.sqrt(len(distinct))
        x[k, PATH + WORDS :] = (np.log1p(min(n, 100)) / 4, min(len(text) / (n * 10.0), 2.0), text.count("|") > 0, text[-1] in ".!?…:", "©" in text or "http" in text, 1.0)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * z) + 1)


class Labeller:
    """Weights of the two directions and of the output; batches are (pages, blocks, values) with a mask."""

    def __init__(self, seed: int = 11):
        r = np.random.Generator(np.random.PCG64(seed))
        self.w = [r.normal(0, 1 / np.sqrt(INPUT + HIDDEN), (INPUT + HIDDEN, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        self.b = [np.concatenate((np.ones(HIDDEN), np.zeros(3 * HIDDEN))).astype(np.float32) for _ in range(2)]
        self.v = r.normal(0, 0.1, 2 * HIDDEN + INPUT).astype(np.float32)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits (pages, blocks)."""
        pages, steps, _ = x.shape
        outs = []
        for way in range(2):
            h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
            out = np.zeros((pages, steps, HIDDEN), np.float32)
            pre = x @ self.w[way][:INPUT] + self.b[way]
            memory = []
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                on = mask[:, t, None]
                z = pre[:, t] + h @ self.w[way][INPUT:]
                f, i, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
                g = np.tanh(z[:, 3 * HIDDEN :])
                c2 = f * c + i * g
                tc = np.tanh(c2)
                if keep is not None:
                    memory.append((t, h, c, f, i, o, g, tc, on))
                h, c = np.where(on, o * tc, h), np.where(on, c2, c)
                out[:, t] = h
            outs.append(out)
            if keep is not None:
                keep.append(memory)
        top = np.concatenate((*outs, x), axis=2)
        if keep is not None:
            keep.append(top)
        return top @ self.v

    def train(self, sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int, batch: int = 48, rate: float = 0.01) -> None:
        """Adam on the mean logistic loss."""
        r = np.random.Generator(np.random.PCG64(5))
        params = [*self.w, *self.b, self.v]
        m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(rounds):
            shuffled = r.permutation(len(sequences))
            order = shuffled[np.argsort([len(sequences[i][0]) for i in shuffled], kind="stable")]  # like lengths together
            for k in r.permutation(np.arange(0, len(order), batch)):
                x, mask, y = _padded([sequences[i] for i in order[k : k + batch]])
                grads = self._gradients(x, mask, y)
                step += 1
                for p, g, a, b in zip(params, grads, m, s, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        keep: list = []
        logits = self.forward(x, mask, keep)
        d = np.where(mask, _sigmoid(logits) - y, 0).astype(np.float32) / max(1, mask.sum())
        memories, top = (keep[0], keep[1]), keep[2]
        gv = (top * d[:, :, None]).sum(axis=(0, 1))
        gw, gb = [], []
        for way in range(2):
            up = d[:, :, None] * self.v[way * HIDDEN : (way + 1) * HIDDEN]
            all_dz, all_h = np.zeros((*x.shape[:2], 4 * HIDDEN), self.w[way].dtype), np.zeros((*x.shape[:2], HIDDEN), self.w[way].dtype)
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for t, h, c, f, i, o, g, tc, on in reversed(memories[way]):
                dh = dh + up[:, t]
                dh_on, dc_on = np.where(on, dh, 0), np.where(on, dc, 0)
                dct = dc_on + dh_on * o * (1 - tc * tc)
                dz = np.concatenate((dct * c * f * (1 - f), dct * g * i * (1 - i), dh_on * tc * o * (1 - o), dct * i * (1 - g * g)), axis=1)
                all_dz[:, t], all_h[:, t] = dz, h
                dh = np.where(on, dz @ self.w[way][INPUT:].T, dh)
                dc = np.where(on, dct * f, dc)
            flat = all_dz.reshape(-1, 4 * HIDDEN)
            gw.append(np.concatenate((x.reshape(-1, INPUT).T @ flat, all_h.reshape(-1, HIDDEN).T @ flat)))
            gb.append(flat.sum(axis=0))
        return [*gw, *gb, gv]

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """True for each main block; pages of like length go together, about 4,096 blocks at a time."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        k = 0
        while k < len(order):
            e = k + 1
            while e < len(order) and (e - k + 1) * len(pages[order[e]]) <= 4096:
                e += 1
            x, mask, _ = _padded([(pages[i], np.zeros(len(pages[i]))) for i in order[k:e]])
            logits = self.forward(x, mask)
            for row, i in enumerate(order[k:e]):
                out[i] = logits[row, : len(pages[i])] > 0
            k = e
        return out


def _padded(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in some)
    x, mask, y = np.zeros((len(some), steps, INPUT), np.float32), np.zeros((len(some), steps), bool), np.zeros((len(some), steps), np.float32)
    for k, (a, b) in enumerate(some):
        x[k, : len(a)], mask[k, : len(a)], y[k, : len(a)] = a, True, b
    return x, mask, y


# Names that templates give to what isn't the article.
_ASIDE = ["sidebar", "related", "widget", "promo", "share", "social", "tags", "newsletter", "breadcrumb", "menu", "nav", "pagination", "author-bio", "toc"]
_NOTICE = ["cookie", "cookie-notice", "consent", "banner", "notice", "alert", "gdpr", "popup", "modal"]
_AD = ["ad", "ads", "advert", "advertisement", "sponsored", "ad-slot", "banner-ad"]
_COMMENT = ["comments", "comment", "comment-list", "replies", "discussion", "responses", "reply"]
_MAIN = ["post", "content", "entry", "entry-content", "article-body", "main", "story", "post-content", "body"]


# What such blocks say.
_SAYS = {
    "notice": ["We use cookies to improve your experience", "Accept all cookies", "Read our privacy policy", "This site uses cookies", "Manage consent settings", "Wir verwenden Cookies auf dieser Website", "Alle Cookies akzeptieren", "Datenschutzerklärung lesen", "Usamos cookies para mejorar su experiencia", "Aceptar todas las cookies", "Nous utilisons des cookies", "Tout accepter"],
    "ad": ["Advertisement", "Sponsored content", "Buy now and save", "Limited offer, order today", "Shop the sale", "Anzeige", "Jetzt kaufen und sparen", "Publicidad", "Compra ahora", "Publicité", "Achetez maintenant"],
    "form": ["Subscribe to our newsletter", "Enter your email address", "Sign up for free", "Forgot your password? Log in", "Search this site", "Newsletter abonnieren", "E-Mail-Adresse eingeben", "Suscríbase al boletín", "Introduzca su correo", "Abonnez-vous à la newsletter", "Adresse e-mail"],
    "comment": ["Leave a reply", "Log in to comment", "comments posted by readers", "says: I agree with this post", "Reply Report", "Kommentar schreiben", "Antworten", "Deja un comentario", "Responder", "Laisser un commentaire", "Répondre"],
    "aside": ["Related articles", "Share this on Facebook Twitter", "Read more", "Most popular posts", "Tags and categories", "Ähnliche Artikel", "Mehr lesen", "Artículos relacionados", "Leer más", "Articles similaires", "Lire la suite"],
    "footer": ["All rights reserved", "Copyright Terms of use Contact Imprint", "Alle Rechte vorbehalten Impressum Kontakt", "Todos los derechos reservados Contacto", "Tous droits réservés Contact"],
}


@cache
def _words(n: int = 50_000) -> list[str]:
    """Words that mean nothing."""
    r = np.random.Generator(np.random.PCG64(7))
    return ["".join(map(chr, 97 + r.integers(0, 26, k))) for k in r.integers(2, 9, n)]


def _made_page(r: np.random.Generator) -> str:
    """One training page; main blocks carry the mark \\x02."""
    pick = lambda xs: xs[r.integers(len(xs))]
    pool = _words()
    word = lambda: pool[r.integers(len(pool))]
    words = lambda lo, hi: " ".join([pool[i] for i in r.integers(0, len(pool), r.integers(lo, hi))])
    repeated = lambda n: " ".join([word()] * n)
    sentence = lambda lo, hi: (words(lo, hi) if r.random() < 0.95 else repeated(lo + 5)).capitalize() + pick([".", ".", ".", "", "!", "?", " ###", " | x |", "&amp;", "%%%"])
    named = lambda names: f'{pick(["class", "class", "id"])}="{pick(names)}{pick(["", "", " box", " x1"])}"'

    def links() -> str:
        return "<ul>" + "".join(f"<li><a href='/{word()}'>{words(1, 4)}</a></li>" for _ in range(r.integers(1, 9))) + "</ul>"

    def said(kind: str) -> str:
        """Its wording, or any words."""
        return pick(_SAYS[kind]) + pick(["", ". ", " "]) + (words(0, 8) if r.random() < 0.5 else "") if r.random() < 0.5 else sentence(1, 60)

    def other(inside: bool) -> str:
        if r.random() < 0.1:  # known by what it says alone
            kind = pick(list(_SAYS))
            lines = "".join(f"<p>{pick(_SAYS[kind])}{pick(['', '.'])}</p>" for _ in range(r.integers(1, 4)))
            return pick(["<div>{}</div>", "<div><div>{}</div></div>", "<section>{}</section>"]).format(lines) if not inside else f"<div>{lines}</div>"
        kind = r.integers(9)
        text = said(("aside", "ad", "aside", "notice", "form", "comment", "footer", "aside", "aside")[kind])
        if kind == 0:
            return f"<nav>{links()}</nav>" if r.random() < 0.7 else f"<div {named(['nav', 'menu', 'navbar', 'breadcrumb'])}>{links()}</div>"
        if kind == 1:
            return f"<div {named(_AD)}>{pick(['', '<p>'])}{text}</div>"
        if kind == 2:
            return f"<aside {named(_ASIDE) if r.random() < 0.5 else ''}><h3>{words(1, 5)}</h3><p>{text}</p>{links()}</aside>"
        if kind == 3:
            return f"<div {named(_NOTICE)}><p>{text}</p><button>{word()}</button></div>"
        if kind == 4:
            return f"<form><label>{words(1, 4)}</label><p>{text}</p><button>{word()}</button></form>"
        if kind == 5:
            body = "".join(f"<{(t := pick(['div', 'li', 'p', 'article']))} class='{pick(_COMMENT)}'>{pick(['<b>', '<cite>', '<span>'])}{word()}<p>{pick(['', '', '<b>'])}{said('comment')}</p></{t}>" for _ in range(r.integers(1, 5)))
            return f"<{(t := pick(['section', 'div', 'ol']))} {named(_COMMENT)}><h3>{words(1, 3)}</h3>{body}</{t}>"
        if kind == 6:
            return f"<footer>&copy; {word()} {text}</footer>"
        if kind == 7:
            return f"<div {named(_ASIDE)}><h4>{words(1, 4)}</h4>{links()}<p>{text}</p></div>"
        return "" if inside else f"<header><div>{words(1, 5)}</div><p>{text}</p></header>"

    def article() -> str:
        parts = [f"<h1>\x02{sentence(1, 14)}</h1>"]
        for _ in range(r.integers(1, pick([6, 14, 40]))):
            kind = r.integers(12)
            long = sentence(1, pick([4, 20, 120]))
            if kind < 7:
                parts.append(f"<p>{pick(['', '', '<b>', '<b>', '<em>x</em> ', '<span>'])}\x02{long}{pick(['</p>', '</p>', '<br>'])}")
            elif kind == 7:
                parts.append(f"<h2>\x02{words(1, 8)}</h2>")
            elif kind == 8:
                parts.append("<ul>" + "".join(f"<li>\x02{sentence(1, 15)}</li>" for _ in range(r.integers(1, 6))) + "</ul>")
            elif kind == 9:
                parts.append(f"<blockquote><p>\x02{long}</p></blockquote>")
            elif kind == 10:
                parts.append(f"<pre>\x02{long}</pre>")
            elif r.random() < 0.6:
                parts.append(other(True))
        if r.random() < 0.08:  # junk that says one thing again and again
            parts += [f"<p>\x02{sentence(1, 6)}</p>"] * r.integers(2, 60)
        if r.random() < 0.15:
            parts.append(other(True))
        inner = "".join(parts)
        way = r.random()
        if way < 0.7:
            return f"<article{pick(['', '', ' class=' + chr(34) + pick(_MAIN) + chr(34)])}>{inner}</article>"
        if way < 0.85:
            return f"<main>{inner}</main>"
        return f"<div {named(_MAIN)}>{inner}</div>"

    before, after = "".join(other(False) for _ in range(r.integers(0, 4))), "".join(other(False) for _ in range(r.integers(0, 4)))
    whole = f"{before}{article()}{after}"
    if r.random() < 0.2:
        whole = f"<{(t := pick(['div', 'main']))} {named(['page', 'wrapper', 'container', 'site'])}>{whole}</{t}>"
    return f"<html><body>{whole}</body></html>"


@cache
def trained(pages: int = 3000, rounds: int = 7) -> Labeller:
    """The labeller, trained on made pages; the same at every call."""
    r = np.random.Generator(np.random.PCG64(3))
    sequences = []
    for _ in range(pages):
        found = blocks(_made_page(r))
        if found:
            y = np.array(["\x02" in t for t, _ in found], np.float32)
            clean = [(t.replace("\x02", "") or "x", p) for t, p in found]
            sequences.append((vectors(clean), y))
    model = Labeller()
    model.train(sequences, rounds)
    model.train(sequences, 3, rate=0.002)
    return model


_READY: dict[str, Labeller] = {}


def labeller(spark: SparkSession) -> Labeller:
    """The trained labeller from the shared folder; trained and put there if this version of it is not there yet."""
    digest = hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:24]
    if digest not in _READY:
        path = f"{shared_dir(spark).rstrip('/')}/larkspur-models/html-{digest}"
        jvm = spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        model = Labeller()
        params = [*model.w, *model.b, model.v]
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            row = spark.read.parquet(path).first()
            for p, stored in zip(params, row, strict=True):
                p[...] = np.frombuffer(stored, np.float32).reshape(p.shape)
        else:
            model = trained()
            row = [bytearray(p.astype(np.float32).tobytes()) for p in (*model.w, *model.b, model.v)]
            spark.createDataFrame([row], "w0 binary, w1 binary, b0 binary, b1 binary, v binary").coalesce(1).write.mode("overwrite").parquet(path)
        _READY[digest] = model
    return _READY[digest]


def extract(model: Labeller, pages: list[str | None]) -> list[str]:
    found = [blocks(p) for p in pages]
    labels = model.label([vectors(f) for f in found])
    return ["\n\n".join(t for (t, _), on in zip(f, y, strict=True) if on) for f, y in zip(found, labels, strict=True)]


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars (code points)."""
    model = labeller(pages.sparkSession)

    def run(htmls: list[str | None]) -> tuple[list, list]:
        texts = extract(model, htmls)
        return texts, [len(t) for t in texts]

    return appended(pages.select("page_id", "url", "html"), ["html"], run, rows=256, text="string", n_chars="long").drop("html")
