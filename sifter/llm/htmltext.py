"""Main-text extraction: a bidirectional LSTM labels every leaf block of a page.

A page is cut at its block tags into a sequence of leaf blocks.  A block's input vector is a hashed bag of its
tag path (names, classes, ids and roles of its ancestors), a hashed bag of its words, and a few numbers
(length, share of linked text, place).  The network (numpy) reads the sequence in both directions, so every
decision sees the whole document; blocks it labels content are joined.

Training: a bounded sample of pages (``TRAIN_PAGES``, chosen by hash).  Their silver labels come from the
document structure (inside the article and in none of the boilerplate containers, by tag or by class); copies
of the sample with boilerplate and content containers of other names, listed below, teach the forms the
sample lacks.  A page without article or main has no label: copies of a generated article stand for it.  The fitted network is a fixed-size array, broadcast to one pass over all pages; no shuffle.

Defined cases: null or empty html and pages without blocks give an empty text; unclosed, misnested and
unknown tags are tolerated; an unclosed comment, script or style hides the rest of the page; very long pages
are read whole, in one sequence; repeated rows are extracted alike; null page_ids and urls are carried; an
empty table gives an empty result (the network is then untrained and unused); extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import drawn, prepare, table

PATH_DIMS, WORD_DIMS, NUMBERS = 256, 32, 4
INPUT = PATH_DIMS + WORD_DIMS + NUMBERS
HIDDEN = 16
TRAIN_PAGES = 240
EPOCHS = 12
BATCH_STEPS = 1 << 14        # blocks a forward pass holds at once

# HTML's inline, void and raw-text elements, and the containers and the forms of an article's blocks that training pages are varied with.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|svg|textarea|select"
BOILERPLATE = (
    '<header>', '<header class="site-header">', '<div class="header">', '<div id="header">', '<nav>', '<nav class="menu">', '<div class="navigation" role="navigation">',
    '<ul class="menu">', '<aside>', '<aside class="sidebar">', '<div class="sidebar">', '<div id="sidebar">', '<div class="ad">', '<div class="ads banner">',
    '<div class="advert">', '<section class="advertisement">', '<div class="sponsored promo">', '<form>', '<form class="newsletter signup">', '<div class="cookie-notice">',
    '<div class="notice">', '<div class="cookie-banner consent">', '<div class="popup modal">', '<section class="comments">', '<div id="comments">', '<div class="comment">',
    '<ol class="comment-list">', '<div class="related">', '<div class="share social">', '<div class="breadcrumb">', '<footer>', '<div class="footer">', '<div id="footer" class="copyright">',
    '<div class="widget">', '<div class="subscribe">', '<div class="disclaimer">', '<div class="login">', '<div class="search">', '<div class="author-bio">',
)
CONTENT = ('<article>', '<main>', '<main><article>', '<div class="content">', '<div class="article-body">', '<div class="post-content">', '<div id="content">',
           '<section class="entry-content">', '<div class="main-text">', '<article class="post">', '<div class="story">')
FORMS = ("<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li><li>{}</li></ul>", "<ol><li>{}</li><li>{}</li><li>{}</li></ol>", "<blockquote>{}</blockquote>",
         "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<table><tr><th>{}</th><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>",
         "<figure><figcaption>{}</figcaption></figure>", "<dl><dt>{}</dt><dd>{}</dd></dl>", "<div>{}</div>", "<section><h2>{}</h2><p>{}</p></section>")
SILVER_SKIP = re.compile(r"^(?:header|nav|aside|footer|form|title|head|button)$")

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^\W_]+")
_HASHES: dict[str, int] = {}


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int = 0
    parts: list[str] = field(default_factory=list, repr=False)
    boxes: tuple[tuple[str, ...], ...] = field(default=(), repr=False)      # the path by element: name, then words


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order: text with references decoded and white space joined, and the tag path."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    in_link = linked = at = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(t for _, own in stack for t in own), linked, boxes=tuple(own for _, own in stack)))
        parts, linked = [], 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        elif name in INLINE:
            if name == "a":
                in_link = 0 if m["close"] else 1
        elif m["close"]:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            flush()
            in_link = 0
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()
            if name not in VOID and not m["attrs"].endswith("/"):
                stack.append((name, (name, *_own(m["attrs"]))))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _own(attrs: str) -> list[str]:
    """Words of an element's class, id and role."""
    return [w for m in _ATTR.finditer(attrs) for w in re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower()) if w] if "=" in attrs else []


BOILERPLATE_WORDS = {w.rstrip("s") for tag in BOILERPLATE for w in _own(tag)} - {"site", "list", "author"}


def _hash(word: str) -> int:
    h = _HASHES.get(word)
    if h is None:
        if len(_HASHES) > 200_000:
            _HASHES.clear()
        h = _HASHES[word] = crc32(word.encode())
    return h


def vectors(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), INPUT), np.float32)
    for i, b in enumerate(page):
        for t in b.path:
            x[i, _hash(t.rstrip("s") or t) % PATH_DIMS] = 1.0         # ads as ad, comments as comment
        words = b.text.lower().split()
        counts = np.bincount(np.fromiter((_hash(w) for w in words), np.int64, len(words)) % WORD_DIMS, minlength=WORD_DIMS)
        x[i, PATH_DIMS:PATH_DIMS + WORD_DIMS] = np.log1p(counts) / 4
        x[i, -NUMBERS:] = (np.log1p(len(b.text)) / 8, min(1.0, b.linked / (len(b.text) + 1)), i / len(page), np.log1p(len(page)) / 6)
    return x


class Labeller:
    """Bidirectional LSTM with a logistic output per step."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        wide = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.p = {}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1.0                       # forget gates start open
            self.p |= {f"wx{d}": wide(INPUT, 4 * HIDDEN), f"wh{d}": wide(HIDDEN, 4 * HIDDEN), f"b{d}": bias}
        self.p |= {"wo": wide(2 * HIDDEN, 1), "bo": np.zeros(1, np.float32)}

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x (T, B, INPUT) in reading order; padded steps carry the state through."""
        steps, n = x.shape[:2]
        z_in = x.reshape(steps * n, -1) @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        z_in = z_in.reshape(steps, n, -1)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        hs, tape = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = z_in[t] + h @ self.p[f"wh{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            new_c = f * c + i * g
            tc = np.tanh(new_c)
            m = mask[t][:, None]
            if keep:
                tape.append((h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * new_c + (1 - m) * c
            hs[t] = h
        return hs, tape

    def margins(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """(T, B) margins of a padded batch, and the tapes for training."""
        forward, tf = self._direction(x, mask, "f", keep)
        back, tb = self._direction(x[::-1], mask[::-1], "b", keep)
        both = np.concatenate([forward, back[::-1]], axis=2)
        return (both @ self.p["wo"])[:, :, 0] + self.p["bo"][0], both, tf, tb

    def _gradient(self, x: np.ndarray, tape: list, dh_all: np.ndarray, d: str, grads: dict) -> None:
        dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        dwh = np.zeros_like(self.p[f"wh{d}"])
        for t in range(len(tape) - 1, -1, -1):
            h, c, i, f, o, g, tc, m = tape[t]
            dh = dh + dh_all[t]
            dn, dcn = m * dh, m * dc
            dcell = dcn + dn * o * (1 - tc * tc)
            dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dn * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            dwh += h.T @ dz
            dh = dz @ self.p[f"wh{d}"].T + (1 - m) * dh
            dc = dcell * f + (1 - m) * dc
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"wx{d}"] = x.reshape(-1, INPUT).T @ flat
        grads[f"wh{d}"], grads[f"b{d}"] = dwh, flat.sum(axis=0)

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 16, seed: int = 11) -> Labeller:
        """Adam on the mean logistic loss over blocks."""
        rng = np.random.default_rng(seed)
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        order = np.argsort([len(p) for p in pages], kind="stable")
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        for _ in range(epochs):
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[j] for j in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for col, j in enumerate(groups[k]):
                    y[:len(labels[j]), col] = labels[j]
                z, both, tf, tb = self.margins(x, mask, keep=True)
                dz = ((_sigmoid(z) - y) * mask / max(1.0, mask.sum())).astype(np.float32)
                grads = {"wo": both.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1), "bo": dz.sum(keepdims=True).reshape(1)}
                dboth = dz[:, :, None] * self.p["wo"][:, 0]
                self._gradient(x, tf, dboth[:, :, :HIDDEN], "f", grads)
                self._gradient(x[::-1], tb, dboth[::-1, :, HIDDEN:], "b", grads)
                step += 1
                for name, g in grads.items():
                    m1[name] += 0.1 * (g - m1[name])
                    m2[name] += 0.001 * (g * g - m2[name])
                    self.p[name] -= (rate * (m1[name] / (1 - 0.9 ** step)) / (np.sqrt(m2[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def content(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Per page, which blocks are content; pages of like length share a batch of bounded size."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at + 1) * len(pages[order[stop]]) <= BATCH_STEPS:
                stop += 1
            x, mask = padded([pages[i] for i in order[at:stop]])
            z = self.margins(x, mask)[0]
            for col, i in enumerate(order[at:stop]):
                out[i] = z[:len(pages[i]), col] > 0
            at = stop
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * z) + 1)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(len(p) for p in pages), len(pages), INPUT), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for i, p in enumerate(pages):
        x[:len(p), i], mask[:len(p), i] = p, 1
    return x, mask


def silver(page: list[Block], opening: tuple[str, ...] = ()) -> np.ndarray:
    """Structural labels: inside an article or main, outside boilerplate; ``opening`` marks blocks by container tags."""
    def one(b: Block) -> bool:
        if "boilerplate0" in b.path or any(SILVER_SKIP.match(t) for t in b.path):
            return False
        inside = next((i for i, own in enumerate(b.boxes) if own[0] in ("article", "main") or "content0" in own), None)
        return inside is not None and not any(w.rstrip("s") in BOILERPLATE_WORDS for own in b.boxes[inside + 1:] for w in own[1:])
    return np.array([one(b) for b in page], np.float32)


def _closing(tags: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", tags)))


def varied(page: str, rng: np.random.Generator, texts: list[str]) -> str:
    """A copy of a page: its article in some content container and with more forms of blocks, boilerplate around and inside it."""
    def box() -> str:
        tag = BOILERPLATE[rng.integers(len(BOILERPLATE))]
        lines = [texts[rng.integers(len(texts))] for _ in range(rng.integers(1, 4))]
        inner = "".join(f"<li><a href='#'>{t}</a></li>" if rng.random() < 0.3 else f"<p>{t}</p>" if rng.random() < 0.6 else t for t in lines)
        return f'<div role="boilerplate0">{tag}{inner}{_closing(tag)}</div>'
    def block() -> str:
        form = FORMS[rng.integers(len(FORMS))]
        return form.format(*[texts[rng.integers(len(texts))][:rng.integers(10, 300)] for _ in range(form.count("{}"))])
    wrap = CONTENT[rng.integers(len(CONTENT))]
    for name in ("article", "main"):
        start = re.search(rf"<{name}(?=[\s>])[^>]*>", page, re.I)
        ends = [m for m in re.finditer(rf"</{name}\s*>", page, re.I)]
        if start and ends and ends[-1].start() >= start.end():
            break
    else:
        return page
    end = ends[-1].start()
    pieces = re.split(r"(?=<p>)", page[start.end():end])            # a block form or a boilerplate box may stand before any paragraph
    spot = rng.integers(len(pieces))
    body = ""
    for i, piece in enumerate(pieces):
        body += piece
        if rng.random() < 0.25:
            body += block()
        if i == spot and rng.random() < 0.6:
            body += box()
    return (page[:start.start()] + "".join(box() for _ in range(rng.integers(0, 3))) + f'<div role="content0">{wrap}' + body + _closing(wrap) + "</div>"
            + "".join(box() for _ in range(rng.integers(0, 3))) + page[ends[-1].end():])


def generated(rng: np.random.Generator, prose: list[str]) -> str:
    """A page with an article of the corpus's longer texts."""
    body = "".join(f"<p>{prose[rng.integers(len(prose))]}</p>" for _ in range(rng.integers(2, 9)))
    return f"<html><body><article><h1>{prose[rng.integers(len(prose))][:60]}</h1>{body}</article></body></html>"


def training_set(pages: list[str], seed: int = 5) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Vectors and silver labels of the pages and of three varied copies of each; the marks of the copies are hidden.

    A page without any labelled block is left out, and the copies are those of a generated article."""
    rng = np.random.default_rng(seed)
    texts = [entities.escape(b.text[:300]) for p in pages for b in blocks(p)] or ["text"]
    prose = sorted(texts, key=len)[len(texts) // 2:]
    xs, ys = [], []
    for p in pages:
        known = silver(blocks(p)).any()
        base = p if known else generated(rng, prose)
        for version in (*[p] * bool(known), *(varied(base, rng, texts) for _ in range(3))):
            found = blocks(version)
            if found:
                ys.append(silver(found))
                for b in found:
                    b.path = tuple(t for t in b.path if t not in ("boilerplate0", "content0"))
                xs.append(vectors(found))
    return xs, ys


def fit(pages: DataFrame, sample: int = TRAIN_PAGES) -> Labeller:
    """The labeller, fitted on about ``sample`` pages chosen by a hash of id and html."""
    n = pages.where("html is not null").count()
    picked = pages.where("html is not null").where(drawn("htmltext", ["page_id", "html"], sample / max(1, n))).select("html").distinct()
    rows = sorted(r["html"] for r in picked.toLocalIterator())                     # the bounded sample
    if n and not rows:
        raise RuntimeError(f"no page of {n} was drawn for training; raise sample ({sample})")
    xs, ys = training_set(rows)
    return Labeller().fit(xs, ys) if xs else Labeller()


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 512):
                b = big.slice(s, 512)
                found = [blocks(h.as_py()) for h in b.column("html")]
                marks = shared.value.content([vectors(p) for p in found])
                texts = ["\n".join(x.text for x, ok in zip(p, m) if ok) for p, m in zip(found, marks)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
