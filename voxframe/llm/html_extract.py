"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks, each with the path of the open elements above it and its
words. A bidirectional LSTM in numpy reads the whole sequence and labels every block as main text or
not. It is trained here, on pages made up by ``made_up_page``, where each block's label is known.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxframe.llm import common

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>""", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
HINT = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SPLIT = re.compile(r"[^a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
PATH_SLOTS, WORD_SLOTS, PATH_DIM, WORD_DIM, FACTS, HIDDEN = 1024, 512, 16, 4, 4, 16
SPACE = re.compile(r"\s+")


@lru_cache(maxsize=65536)
def _slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode()) % slots


@lru_cache(maxsize=4096)
def _element(tag: str) -> tuple[str, tuple[int, ...]]:
    """An opening tag's name and the slots of its name and of the words of its class, id and role."""
    name = NAME.match(tag)[1].lower()
    words = [f"<{name}>"]
    for found in HINT.findall(tag):
        words += [w for w in SPLIT.split("".join(found).lower()) if w]
    return name, tuple(_slot(w, PATH_SLOTS) for w in dict.fromkeys(words))


def blocks_of(page: str) -> list[tuple[str, tuple[int, ...], int]]:
    """(text, slots of the path, characters inside links) of each leaf block that has text, in page order.

    Character references are decoded, white space becomes one space. Contents of scripts, styles,
    titles and the like are no text.
    """
    out: list[tuple[str, tuple[int, ...], int]] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    pieces: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append((text, tuple(dict.fromkeys(s for _, slots in stack for s in slots)), linked))
            pieces.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        tag = m[0]
        if tag[1] in "!?" or m[1]:
            if m[1] and m[1].lower() in ("title", "textarea"):
                flush()
            continue
        name = NAME.match(tag)[1].lower()
        if name in INLINE:
            in_link = max(0, in_link + (-1 if tag[1] == "/" else 1)) if name == "a" else in_link
            continue
        if name == "br":
            pieces.append(" ")
            continue
        flush()
        in_link = 0
        if tag[1] == "/":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p" or name in ("li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            stack.pop()
        if name not in VOID and not tag.endswith("/>"):
            stack.append(_element(tag))
    pieces.append(page[at:])
    flush()
    return out


class Labeller:
    """Embeddings, two LSTM directions and a logistic output."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        wide = PATH_DIM + WORD_DIM + FACTS
        norm = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.w = {"path": rng.normal(0, 0.3, (PATH_SLOTS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_SLOTS, WORD_DIM)), "out": norm(2 * HIDDEN + wide, 1), "bias": np.zeros(1)}
        for d in "fb":
            self.w |= {f"x{d}": norm(wide, 4 * HIDDEN), f"h{d}": norm(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}

    def inputs(self, page: list[tuple[str, tuple[int, ...], int]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Vectors of a page's blocks: summed path embeddings, the mean embedding of all words and a few facts."""
        paths = [np.array(p or (0,)) for _, p, _ in page]
        words = [np.array([zlib.crc32(w) % WORD_SLOTS for w in t.encode().split(b" ")]) for t, _, _ in page]
        facts = np.array([(np.log1p(len(t)) / 8, min(1.0, linked / max(1, len(t))), t[-1] in ".!?", 1.0) for t, _, linked in page])
        return np.concatenate([np.array([self.w["path"][p].sum(axis=0) for p in paths]), np.array([np.bincount(w, minlength=WORD_SLOTS) @ self.w["word"] / w.size if w.size > WORD_SLOTS else self.w["word"][w].mean(axis=0) for w in words]), facts], axis=1), paths, words

    def run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """One direction over x (steps x pages x inputs); masked steps leave the state as it is."""
        h = c = np.zeros((x.shape[1], HIDDEN))
        seen, kept = np.zeros((*x.shape[:2], HIDDEN)), [None] * len(x)
        given = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = given[t] + h @ self.w[f"h{d}"]
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            m = mask[t][:, None]
            kept[t] = (h, c, i, f, o, g, new)
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(new), h)
            seen[t] = h
        return seen, kept

    def back(self, x: np.ndarray, mask: np.ndarray, d: str, kept: list, grad: np.ndarray, out: dict[str, np.ndarray]) -> np.ndarray:
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
        dh = dc = np.zeros((x.shape[1], HIDDEN))
        for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
            h, c, i, f, o, g, new = kept[t]
            m = mask[t][:, None]
            gh = dh + grad[t]
            s = np.tanh(new)
            gc = dc + gh * o * (1 - s * s)
            dz = np.concatenate([gc * g * i * (1 - i), gc * c * f * (1 - f), gh * s * o * (1 - o), gc * i * (1 - g * g)], axis=1) * m
            dz_all[t] = dz
            out[f"h{d}"] += h.T @ dz
            dh = np.where(m, dz @ self.w[f"h{d}"].T, gh)
            dc = np.where(m, gc * f, dc)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        out[f"x{d}"] += x.reshape(-1, x.shape[2]).T @ flat
        out[f"c{d}"] += flat.sum(axis=0)
        return dz_all @ self.w[f"x{d}"].T

    def packed(self, pages: list[list]) -> tuple[np.ndarray, np.ndarray, list, list]:
        found = [self.inputs(p) for p in pages]
        steps = max(len(p) for p in pages)
        x, mask = np.zeros((steps, len(pages), PATH_DIM + WORD_DIM + FACTS)), np.zeros((steps, len(pages)), bool)
        for k, (own, _, _) in enumerate(found):
            x[: len(own), k], mask[: len(own), k] = own, True
        return x, mask, [f[1] for f in found], [f[2] for f in found]

    def scores(self, pages: list[list]) -> list[np.ndarray]:
        """Per page the log odds of each block being main text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        for lo in range(0, len(order), 64):
            own = order[lo : lo + 64]
            x, mask, _, _ = self.packed([pages[k] for k in own])
            both = np.concatenate([self.run(x, mask, "f")[0], self.run(x, mask, "b")[0], x], axis=2)
            z = (both @ self.w["out"])[:, :, 0] + self.w["bias"][0]
            for j, k in enumerate(own):
                out[k] = z[: len(pages[k]), j]
        return out

    def step(self, pages: list[list], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        x, mask, paths, words = self.packed(pages)
        hf, kf = self.run(x, mask, "f")
        hb, kb = self.run(x, mask, "b")
        both = np.concatenate([hf, hb, x], axis=2)
        z = (both @ self.w["out"])[:, :, 0] + self.w["bias"][0]
        y = np.zeros_like(z)
        for k, own in enumerate(labels):
            y[: len(own), k] = own
        n = mask.sum()
        gz = np.where(mask, 1 / (1 + np.exp(-z)) - y, 0) / n
        loss = float((np.where(mask, np.logaddexp(0, z) - y * z, 0)).sum() / n)
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["out"] = (both.reshape(-1, both.shape[2]).T @ gz.reshape(-1))[:, None]
        grads["bias"][0] = gz.sum()
        gb = gz[:, :, None] * self.w["out"][:, 0]
        gx = gb[:, :, 2 * HIDDEN :] + self.back(x, mask, "f", kf, gb[:, :, :HIDDEN], grads) + self.back(x, mask, "b", kb, gb[:, :, HIDDEN : 2 * HIDDEN], grads)
        for k in range(len(pages)):
            for t, (p, w) in enumerate(zip(paths[k], words[k], strict=True)):
                np.add.at(grads["path"], p, gx[t, k, :PATH_DIM])
                if w.size:
                    np.add.at(grads["word"], w, gx[t, k, PATH_DIM : PATH_DIM + WORD_DIM] / w.size)
        return loss, grads


MAIN_HINTS = ["", "content", "post", "entry", "article-body", "story", "main", "post-content", "entry-content", "page", "wrapper", "container", "text", "body"]
SIDE = {
    "nav": ["", "menu", "navbar", "main-nav", "breadcrumb", "navigation", "site-nav"],
    "header": ["", "site-header", "masthead", "top", "banner", "branding"],
    "footer": ["", "site-footer", "bottom", "copyright", "foot"],
    "aside": ["", "sidebar", "related", "widget", "trending", "recommended"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "sponsor"],
    "notice": ["notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "warning", "message"],
    "form": ["", "search", "login", "signup", "contact", "newsletter"],
    "comments": ["comments", "comment-list", "discussion", "responses", "replies", "reader-comments", "disqus"],
    "share": ["share", "social", "tags", "meta", "byline", "author-bio", "pagination", "toolbar"],
}


def made_up_page(rng: np.random.Generator) -> tuple[str, str]:
    """A page and its main text. Words are random in both, so that only the structure tells them apart."""
    parts = ["an", "er", "th", "in", "ou", "sch", "que", "la", "é", "tion", "ß", "de", "ver", "ca", "os", "re"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    pick = lambda x: x[rng.integers(len(x))]
    line = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b))) + pick([".", ".", "", "!", "?"])
    kept: list[str] = []

    def attribute(hint: str) -> str:
        if not hint or rng.random() < 0.05:
            return ""
        return f' {pick(["class", "class", "id"])}="{hint}"'

    def side(kind: str) -> str:
        tag = {"nav": pick(["nav", "nav", "div", "ul"]), "header": pick(["header", "header", "div"]), "footer": pick(["footer", "footer", "div"]), "aside": pick(["aside", "aside", "div"]), "form": "form", "comments": pick(["section", "div", "ol", "ul"])}.get(kind, pick(["div", "div", "section", "p", "aside"]))
        hint = pick(SIDE[kind])
        if tag in ("div", "section", "p", "ol", "ul") and not hint:
            hint = pick([h for h in SIDE[kind] if h] or ["menu"])
        own = f' class="{hint}"' if tag in ("div", "section", "p", "ol", "ul") else attribute(hint)
        if kind == "comments":
            inner = "".join(pick([f'<li class="comment"><b>{word()}</b> {line(3, 20)}</li>', f'<div class="comment"><p>{line(3, 30)}</p></div>', f"<article class=\"comment\"><p>{line(3, 30)}</p></article>", f"<p>{line(3, 30)}</p>"]) for _ in range(rng.integers(1, 5)))
            inner = pick(["", f"<h3>{line(1, 4)}</h3>"]) + inner
        elif kind == "form":
            inner = f'<label>{line(1, 4)}</label><input type="text"><button>{word()}</button><select><option>{word()}</option></select>' + pick(["", f"<p>{line(2, 9)}</p>"])
        elif kind in ("nav", "aside", "share") and rng.random() < 0.7:
            links = "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(rng.integers(1, 8)))
            inner = links if tag == "ul" else f"<ul>{links}</ul>"
        else:
            inner = pick([line(1, 30), f"<p>{line(2, 40)}</p>", f"<p>{line(2, 20)}</p><p>{line(2, 20)}</p>", f'<a href="#">{line(1, 5)}</a> {line(1, 12)}', f"<h2>{line(1, 5)}</h2><p>{line(3, 25)}</p>", f"<h1>{line(1, 4)}</h1>"])
            inner = inner if tag != "p" else line(2, 30)
        return f"<{tag}{own}>{inner}</{tag}>"

    def body() -> str:
        out = []
        for _ in range(rng.integers(1, pick([6, 12, 50]))):
            kind = rng.random()
            text = line(1, pick([3, 8, 60, 60]))
            kept_text = text
            if kind < 0.55:
                block = f"<p>{text}" + pick(["</p>", "</p>", ""])
            elif kind < 0.65:
                first = word()
                block, kept_text = f"<p><b>{first}<br>{text}<p>", f"{first} {text}"
            elif kind < 0.75:
                block = f"<h2>{text}</h2>"
            elif kind < 0.85:
                block = f"<ul><li>{text}</li></ul>"
            elif kind < 0.9:
                block = f"<blockquote>{text}</blockquote>"
            elif kind < 0.95:
                block = f"<table><tr><td>{text}</td></tr></table>"
            else:
                block = f"<pre>{text}</pre>"
            out.append(block)
            kept.append(kept_text)
            if rng.random() < 0.08:
                out.append(side(pick(["ad", "aside", "notice", "share", "form"])))
        return "".join(out)

    top = "".join(side(k) for k in rng.permutation(["nav", "header", "ad", "notice", "form", "aside"])[: rng.integers(0, 5)])
    end = "".join(side(k) for k in rng.permutation(["footer", "aside", "comments", "notice", "form", "share", "ad", "nav"])[: rng.integers(0, 5)])
    tag = pick(["article", "article", "main", "div", "section"])
    hint = pick(MAIN_HINTS[1:]) if tag in ("div", "section") else pick(MAIN_HINTS)
    head = ""
    if rng.random() < 0.8:
        title = line(1, 12)
        kept.append(title)
        head = f"<h1>{title}</h1>"
    inner = head + body() + (side(pick(["comments", "share"])) if rng.random() < 0.2 else "")
    middle = f"<{tag}{attribute(hint) if tag in ('article', 'main') else f' class={chr(34)}{hint}{chr(34)}'}>{inner}</{tag}>"
    if rng.random() < 0.3:
        middle = pick([f'<div class="{pick(MAIN_HINTS[1:])}">{middle}</div>', f"<main>{middle}</main>", f"<div>{middle}</div>"])
    page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{top}{middle}{end}</body></html>"
    return page, " ".join(SPACE.sub(" ", k).strip() for k in kept)


def labelled(page: str, text: str) -> tuple[list, np.ndarray]:
    """The blocks of a made-up page and which of them are its main text, matched in order."""
    found, at, labels = blocks_of(page), 0, []
    for block, _, _ in found:
        hit = text.startswith(block, at)
        labels.append(hit)
        at += (len(block) + 1) * hit
    return found, np.array(labels, float)


@lru_cache(maxsize=2)
def trained(pages: int = 700, passes: int = 5, seed: int = 11) -> Labeller:
    """A labeller fitted by Adam to ``pages`` made-up pages; the same every time."""
    rng = np.random.default_rng(seed)
    data = [labelled(*made_up_page(rng)) for _ in range(pages)]
    data = [d for d in data if d[0]]
    model = Labeller()
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    t = 0
    for epoch in range(passes):
        order = sorted(range(len(data)), key=lambda k: (len(data[k][0]) // 8, rng.random()))
        batches = [order[k : k + 32] for k in range(0, len(order), 32)]
        for b in rng.permutation(len(batches)):
            own = [data[k] for k in batches[b]]
            _, grads = model.step([d[0] for d in own], [d[1] for d in own])
            t += 1
            rate = 0.01 * 0.6**epoch
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of (page_id, url, html).

    Blocks labelled as main text are joined in page order by one space. A null or empty page, or one
    without main text, has the empty text. Repeated rows each get a row; an empty table gives an empty one;
    other columns are ignored.
    """
    weights = (model or trained()).w

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.w = weights
        for block in common.blocks(batches, "html", limit=4 << 20):
            found = [blocks_of(h) for h in common.texts_of(block, "html")]
            texts = [" ".join(b[0] for b, z in zip(page, score, strict=True) if z > 0) for page, score in zip(found, own.scores(found), strict=True)]
            yield pa.record_batch([block.column("page_id"), block.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return common.map_arrow(pages.selectExpr("CAST(page_id AS long) AS page_id", "url", "html"), read, "page_id long, url string, text string, n_chars long")
