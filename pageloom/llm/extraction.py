"""HTML extraction: a linear-chain conditional random field over leaf blocks, trained on labelled pages, decoded by Viterbi."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.blocks import Block, leaf_blocks

TRAINING_PAGES = 600  # labelled pages that training reads at most
STEPS = 250
RIDGE = 0.02
NOTICE = re.compile(r"©|\(c\)|copyright|all rights|cookie|subscribe|sign in|log in|newsletter|advert|sponsored|privacy|terms of", re.I)


@dataclass(frozen=True)
class Model:
    """Weight of each feature for the state "main text" against "other", and of starts, moves and ends; states in that order other, main."""

    weights: dict[str, float]
    start: tuple[float, float]
    move: tuple[tuple[float, float], tuple[float, float]]
    end: tuple[float, float]


@lru_cache(maxsize=20_000)
def _path_features(tag: str, path: tuple[str, ...]) -> tuple[str, ...]:
    """Ancestors count once each, however deep; the words of a name count with their tag and without."""
    words = {f"name={p.split('.', 1)[1]}" for p in path if "." in p}
    return tuple(sorted({f"in={p}" for p in path} | words | {f"tag={tag}", f"under={'/'.join([p for p in path if '.' not in p][-2:])}"}))


def text_features(block: Block) -> tuple[str, ...]:
    text, n = block.text, len(block.text)
    return _text_features(min(6, n.bit_length() // 2), min(5, text.count(" ").bit_length()), int(block.linked * 3),
                          text[-1] in ".!?…。:\"'”»", n < 300 and NOTICE.search(text) is not None)


@lru_cache(maxsize=None)
def _text_features(size: int, words: int, linked: int, ends: bool, notice: bool) -> tuple[str, ...]:
    return (f"long={size}", f"words={words}", f"linked={linked}", "ends" if ends else "open", *(["notice"] if notice else []))


def log_sums(scores: np.ndarray, sizes: np.ndarray, start: np.ndarray, move: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log sums of pages side by side (page, block, state), and each page's log of all labellings' sum."""
    pages, longest = scores.shape[:2]
    forward, backward = np.zeros((pages, longest, 2)), np.zeros((pages, longest, 2))
    forward[:, 0] = start + scores[:, 0]
    for k in range(1, longest):
        forward[:, k] = np.logaddexp(forward[:, k - 1, :1] + move[0], forward[:, k - 1, 1:] + move[1]) + scores[:, k]
    backward[np.arange(pages), sizes - 1] = end
    for k in range(longest - 2, -1, -1):
        after = backward[:, k + 1] + scores[:, k + 1]
        step = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
        backward[:, k] = np.where((k < sizes - 1)[:, None], step, backward[:, k])
    last = forward[np.arange(pages), sizes - 1] + end
    return forward, backward, np.logaddexp(last[:, 0], last[:, 1])


def trained(pages: Sequence[tuple[list[Block], list[int]]], steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Weights that maximise the conditional likelihood of the labels, by gradient steps of adaptive size."""
    pages = [(b, y) for b, y in pages if b]
    names: dict[str, int] = {}
    sizes = np.array([len(b) for b, _ in pages], int)
    rows, columns = [], []
    for p, (blocks, _) in enumerate(pages):
        for k, block in enumerate(blocks):
            found = (*_path_features(block.tag, block.path), *text_features(block))
            rows += [p * sizes.max() + k] * len(found)
            columns += [names.setdefault(f, len(names)) for f in found]
    if not names:
        return Model({}, (0.0, 0.0), ((0.0, 0.0), (0.0, 0.0)), (0.0, 0.0))
    rows, columns, size, shape = np.array(rows), np.array(columns), len(names), (len(pages), int(sizes.max()))
    labels = np.zeros(shape, int)
    for p, (_, y) in enumerate(pages):
        labels[p, : len(y)] = y
    real = np.arange(shape[1]) < sizes[:, None]
    steps_real = real[:, 1:]
    ends = labels[np.arange(len(pages)), sizes - 1]
    seen = np.concatenate([np.bincount(columns, labels.ravel()[rows], size), np.bincount(labels[:, 0], minlength=2),
                           np.bincount((2 * labels[:, :-1] + labels[:, 1:])[steps_real], minlength=4), np.bincount(ends, minlength=2)])
    theta = np.zeros(size + 8)  # features, start 2, move 4, end 2
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        start, move, end = theta[size : size + 2], theta[size + 2 : size + 6].reshape(2, 2), theta[size + 6 :]
        scores = np.zeros((*shape, 2))
        scores[..., 1] = np.bincount(rows, theta[columns], shape[0] * shape[1]).reshape(shape)
        forward, backward, total = log_sums(scores, sizes, start, move, end)
        states = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * real[..., None]
        pairs = forward[:, :-1, :, None] + move + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pairs = np.exp(np.minimum(pairs, 0)) * steps_real[..., None, None]
        expected = np.concatenate([np.bincount(columns, states[..., 1].ravel()[rows], size), states[:, 0].sum(0), pairs.sum((0, 1)).ravel(),
                                   states[np.arange(len(pages)), sizes - 1].sum(0)])
        gradient = (seen - expected) / len(pages) - ridge * theta / 10
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    start, move, end = theta[size : size + 2], theta[size + 2 : size + 6].reshape(2, 2), theta[size + 6 :]
    return Model({f: float(theta[k]) for f, k in names.items()}, tuple(map(float, start)), tuple(tuple(map(float, r)) for r in move), tuple(map(float, end)))


def decoded(scores: Sequence[float], model: Model) -> list[int]:
    """The most likely labelling (Viterbi), each score that of "main" against "other"; ties go to "other"."""
    if not len(scores):
        return []
    (a, b), (c, d) = model.move
    other, main = model.start[0], model.start[1] + scores[0]
    back = []
    for score in scores[1:]:
        from_main = main + c > other + a
        to_main = main + d > other + b
        back.append((from_main, to_main))
        other, main = max(other + a, main + c), max(other + b, main + d) + score
    state = int(main + model.end[1] > other + model.end[0])
    out = [state]
    for step in reversed(back):
        state = int(step[state])
        out.append(state)
    return out[::-1]


class Scorer:
    """Block scores of a model, each set of features added up once."""

    def __init__(self, model: Model):
        self.model = model
        self.path = lru_cache(maxsize=100_000)(lambda tag, path: self._sum(_path_features(tag, path)))
        self.text = lru_cache(maxsize=None)(self._sum)

    def _sum(self, features: tuple[str, ...]) -> float:
        return sum(self.model.weights.get(f, 0.0) for f in features)

    def extracted(self, html: str | None) -> str:
        """Main text of a page: the blocks that the field labels so, in page order, joined by newlines."""
        blocks = list(leaf_blocks(html, hidden=True))
        scores = [self.path(b.tag, b.path) + self.text(text_features(b)) for b in blocks]
        return "\n".join(b.text for b, keep in zip(blocks, decoded(scores, self.model), strict=True) if keep)


def labelled(pages: Iterable[tuple[str, str]]) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of (html, main text): a block is main where the text has its line, taken in order."""
    out = []
    for html, text in pages:
        lines, at, labels = text.split("\n"), 0, []
        blocks = list(leaf_blocks(html, hidden=True))
        for block in blocks:
            hit = block.text in lines[at:]
            at += lines[at:].index(block.text) + 1 if hit else 0
            labels.append(int(hit))
        out.append((blocks, labels))
    return out


def main_texts(pages: DataFrame, training: Iterable[tuple[str, str]] | None = None, most: int = TRAINING_PAGES) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page, from its whole html; n_chars counts code points.

    ``training`` holds labelled pages (html, main text), of which at most ``most`` are read; without it, pages laid out by
    the rules of ``sample_pages``. Null, empty and blank pages, and pages without main text, have an empty text; rows that
    repeat give a result each; broken markup is read as far as it goes.
    """
    rows = sample_pages(most) if training is None else [p for _, p in zip(range(most), training, strict=False)]
    model = trained(labelled(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = [scorer.extracted(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def sample_pages(count: int, seed: int = 5) -> list[tuple[str, str]]:
    """Labelled pages laid out by rule: invented words in the usual parts of news pages, journals, shops and forums.

    Every part that is not article occurs in marked-up and in merely named form, inside the article and around it, so that
    no single tag decides. Hidden parts and hidden lines of the article occur too, the latter less often.
    """
    dice, veil = random.Random(seed), random.Random(f"{seed} hidden")
    letters = "aeioulnrstdmcé"

    def words(low: int, high: int) -> str:
        return " ".join("".join(dice.choices(letters, k=dice.randint(2, 9))) for _ in range(dice.randint(low, high)))

    def sentence(low: int = 6, high: int = 30) -> str:
        return words(low, high).capitalize() + dice.choice("...!?")

    def wrapped(tag: str, name: str, body: str) -> str:
        return f'<{tag} {dice.choice(("class", "id"))}="{name}">{body}</{tag}>' if name else f"<{tag}>{body}</{tag}>"

    def veiled(html: str, share: float) -> str:
        if veil.random() >= share:
            return html
        at = re.match(r"<\w+", html).end()
        return html[:at] + veil.choice([" hidden", ' style="display:none"', ' style="color: red; display: none"']) + html[at:]

    def link(low: int = 1, high: int = 4) -> str:
        return f'<a href="/{words(1, 1)}">{words(low, high)}</a>'

    def links() -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(dice.randint(3, 8))) + "</ul>"

    def prose(n: int) -> str:
        return "".join(f"<p>{' '.join(sentence() for _ in range(dice.randint(1, 3)))}</p>" for _ in range(n))

    def menu() -> str:
        return dice.choice([f"<nav>{links()}</nav>", wrapped("div", dice.choice(["menu", "navbar", "nav", "breadcrumbs", "navigation"]), links())])

    def banner() -> str:
        body = dice.choice([f"<h1>{words(1, 4)}</h1>", f"<div>{words(1, 5)}</div>", f"<p>{sentence(3, 9)}</p>"]) + dice.choice(["", menu()])
        return dice.choice([f"<header>{body}</header>", wrapped("div", dice.choice(["header", "masthead", "banner", "topbar"]), body)])

    def footer() -> str:
        body = dice.choice([f"&copy; {words(1, 3)} &middot; {sentence(4, 25)}", f"<p>{sentence(4, 20)}</p>{links()}", f"Copyright {words(2, 6)}. {link()}"])
        return dice.choice([f"<footer>{body}</footer>", wrapped("div", dice.choice(["footer", "bottom", "site-footer", "copyright"]), body)])

    def side() -> str:
        body = dice.choice([links(), f"<h3>{words(1, 3)}</h3>{links()}", f"<h2>{words(1, 3)}</h2><p>{sentence()}</p>", prose(1)])
        return dice.choice([f"<aside>{body}</aside>", wrapped("div", dice.choice(["sidebar", "related", "widget", "share", "social", "recommended", "promo-box"]), body)])

    def notice() -> str:
        body = dice.choice([f"<p>{sentence(5, 25)}</p>", sentence(5, 20), f"<p>{sentence(3, 12)} <button>{words(1, 2)}</button></p>"])
        return wrapped(dice.choice(["div", "section"]), dice.choice(["cookie-notice", "notice", "alert", "consent", "popup", "modal", "gdpr"]), body)

    def advert() -> str:
        body = dice.choice([sentence(3, 15), f"<p>{sentence(3, 15)}</p>", link(2, 7), prose(1)])
        return dice.choice([wrapped(dice.choice(["div", "section", "p"] if "<p>" not in body else ["div", "section"]), dice.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo"]), body)] * 3 + [f'<ins class="ad">{body}</ins>'])

    def form() -> str:
        return f'<form action="/{words(1, 1)}"><label>{words(1, 3)}</label><input name="q"><p>{sentence(3, 12)}</p><select><option>{words(1, 1)}<option>{words(1, 1)}</select><button>{words(1, 2)}</button></form>'

    def comments() -> str:
        body = f"<h3>{words(1, 2)}</h3>" + "".join(wrapped("div", "comment", f"<b>{words(1, 2)}</b>{prose(dice.randint(1, 2))}") for _ in range(dice.randint(1, 4)))
        return wrapped(dice.choice(["div", "section"]), dice.choice(["comments", "comment-list", "discussion", "responses"]), body + dice.choice(["", form()]))

    def code() -> str:
        return dice.choice(["<script>var t='</p>';</script>", "<style>p{margin:0}</style>", "<!-- x -->", "<noscript><p>js</p></noscript>", ""])

    def article() -> tuple[str, list[str]]:
        parts, lines = [], []

        def put(html: str, *own: str) -> None:
            parts.append(html)
            lines.extend(own)

        title = words(2, 12).capitalize() + dice.choice(["", "."])
        heading = f"<h1>{title}</h1>"
        put(dice.choice([heading, heading, f"<header>{heading}</header>", f"<h2>{title}</h2>"]), title)
        for k in range(dice.randint(1, 9)):
            line = " ".join(sentence() for _ in range(dice.randint(1, 6)))
            shape = dice.random()
            if shape < 0.55 or k == 0:
                put(veiled(dice.choice([f"<p>{line}</p>", f"<p>{line}", f"<p><b>{line}<br>", f"<div>{line}</div>", f"<p><em>{line}</em></p>"]), 0.01), line)
            elif shape < 0.62:
                items = [sentence(2, 12) for _ in range(dice.randint(2, 5))]
                put("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", *items)
            elif shape < 0.68:
                put(f"<h2>{line[:40].strip()}</h2>", " ".join(line[:40].split()))
            elif shape < 0.74:
                put(f"<blockquote>{line}</blockquote>", line)
            elif shape < 0.79:
                cells = [words(1, 3) for _ in range(4)]
                put(f"<table><tr><td>{cells[0]}</td><td>{cells[1]}</td></tr><tr><td>{cells[2]}</td><td>{cells[3]}</td></tr></table>", *cells)
            elif shape < 0.88:  # short lines and legal ones occur in articles too
                short = dice.choice([words(1, 1), words(1, 3).capitalize(), f"{words(1, 2)} | {words(1, 2)} |", "All rights reserved.", f"Copyright {words(1, 3)}", f"Privacy and cookies: {words(1, 4)}."])
                put(f"<p>{short}</p>", short)
            elif shape < 0.92:
                put(f"<p>{line} <a href='/x'>{line[:12].strip()}</a></p>", " ".join(f"{line} {line[:12].strip()}".split()))
            else:
                put(dice.choice([advert, side, notice, form, code])())
        tag, name = dice.choice([("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post-content"),
                                 ("section", "story"), ("div", "entry"), ("div", "main"), ("td", "content"), ("article", ""), ("main", "content")])
        body = "".join(parts)
        return (f"<table><tr><td>{links()}</td>{wrapped(tag, name, body)}</tr></table>" if tag == "td" else wrapped(tag, name, body)), lines

    out = []
    for k in range(count):
        body, lines = ("", []) if k % 25 == 24 else article()
        front = [f() for f in dice.sample([menu, banner, advert, notice, side, code], dice.randint(0, 4))]
        back = [f() for f in dice.sample([side, comments, advert, form, notice, footer], dice.randint(0, 4))] + dice.choice([[footer()], []])
        front, back = ([veiled(x, 0.1) if re.match(r"<\w", x) else x for x in parts] for parts in (front, back))
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title>{code()}</head><body>{''.join(front)}{body}{''.join(back)}</body></html>"
        out.append((page, "\n".join(lines)))
    return out
