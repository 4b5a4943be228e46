"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks, runs of text between block-level tags. Each
block has two hashed vectors, of its tag path (element names, and the words of
their class, id and role) and of its words, and a few numbers (length, share of
linked text, marks). A bidirectional LSTM in numpy reads the whole sequence of
a page, so every block is labelled in the context of all others; blocks with
probability ``THRESHOLD`` or more make up the text, in page order.

The labeller is trained here on ``TRAINING_PAGES`` pages that ``training_page``
composes by rule (menus, headers, sidebars, notices, adverts, forms, comments
and footers around an article, under varying element and class names) and on
at most ``SAMPLE_PAGES`` pages of the table whose markup names an article element
outright; both bounds are parameters and training repeats exactly.

Scripts, styles, templates, comments and markup are no text. Character
references are decoded, white space in a block becomes one space, and blocks
are joined by one space.

Defined cases: a null or empty page has the empty text; unclosed and stray tags
are read as a browser would read them where that matters here (a new paragraph
ends the one before); a page without tags is one block; very long pages are
read whole; equal pages get equal texts.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, split_words, text_slices

# fixed values: HTML element names by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg iframe object textarea button select option datalist canvas audio video math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small "
                   "span strike strong sub sup time tt u var wbr img input".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                           "main menu nav ol p pre section table ul".split())

PATH_DIMS, WORD_DIMS, NUMBERS = 192, 128, 6
HIDDEN_UNITS = 12
EMBEDDED = 14
TRAINING_PAGES = 500
SAMPLE_PAGES = 200
EPOCHS = 10
THRESHOLD = 0.5
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
                    # elements whose content is no markup go as a whole
                    r"<(?P<raw>script|style|textarea|title|noscript|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S | re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_INVISIBLE = re.compile(r"display\s*:\s*none|^(?:[^\"']|\"[^\"]*\"|'[^']*')*?\shidden(?=[\s=/]|$)", re.I)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int
    gold: bool | None = None


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order."""
    stack: list[tuple[str, ...]] = []
    blocks: list[Block] = []
    parts: list[str] = []
    path: tuple[str, ...] | None = ()
    linked = at = 0
    anchor = False
    hidden = 0  # depth of the hidden element that is open, counted in the stack

    def close() -> None:
        nonlocal linked, path
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            parts.clear()
            if text:
                if path is None:
                    path = tuple(name for names in stack for name in names)
                blocks.append(Block(text, path, linked))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if anchor:
            linked += len(raw)

    for found in _TOKEN.finditer(page):
        start = found.start()
        if start > at and not hidden:
            add(page[at:start])
        at = found.end()
        ending, tag, rest = found.group(2, 3, 4)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                anchor = not ending
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if not hidden:
            close()
        if ending:
            open_ = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if open_ is not None:
                del stack[open_:]
                path, anchor = None, False
                if len(stack) < hidden:
                    hidden = 0
            continue
        if tag in VOID or rest.endswith("/") and tag in HIDDEN:
            continue
        if tag == "body":  # it ends a head that was left open
            stack[:] = [names for names in stack if names[0] != "head"]
            hidden = min(hidden, len(stack))
        if tag in ENDS_PARAGRAPH:
            open_ = next((i for i, names in enumerate(stack) if names[0] == "p"), None)
            if open_ is not None and not hidden:
                del stack[open_:]
        elif tag in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
            stack.pop()
        if rest:
            stack.append((tag, *[w.lower() for m in _NAMES.finditer(rest)
                                 for w in _WORDS.findall(m.group(1) or m.group(2) or m.group(3) or "")]))
        else:
            stack.append((tag,))
        path = None
        if not hidden and (tag in HIDDEN or len(rest) > 6 and _INVISIBLE.search(rest)):
            hidden = len(stack)
    if at < len(page) and not hidden:
        add(page[at:])
    if not hidden:
        close()
    return blocks


def _slots(names: list[str], dims: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(name, dims) % dims for name in names]


def page_features(pages: list[list[Block]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Path, word and number vectors of the blocks of every page."""
    blocks = [b for page in pages for b in page]
    n = len(blocks)
    if not n:
        return [(np.zeros((0, PATH_DIMS), np.float32), np.zeros((0, WORD_DIMS), np.float32), np.zeros((0, NUMBERS), np.float32))
                for _ in pages]
    kinds: dict[tuple[str, ...], int] = {}
    kind_of = [kinds.setdefault(b.path, len(kinds)) for b in blocks]
    path_rows = np.zeros((len(kinds), PATH_DIMS), np.float32)
    for path, i in kinds.items():
        path_rows[i, _slots([*path, *(["leaf " + path[-1]] if path else [])], PATH_DIMS)] = 1
    texts = pa.array([b.text for b in blocks], pa.string())
    found, codes, bounds = split_words(pc.utf8_lower(texts))
    slots = (hash_words(pc.utf8_trim(found, ".,;:!?()")) % np.uint64(WORD_DIMS)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    words = np.bincount(owner * WORD_DIMS + slots[codes], minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    words = (words / np.maximum(np.diff(bounds), 1)[:, None]).astype(np.float32)
    chars = np.fromiter((len(b.text) for b in blocks), np.float64, n)
    sizes = [len(page) for page in pages]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(n) - np.repeat(cuts[:-1], sizes)

    def count(*marks: str) -> np.ndarray:
        return sum(pc.count_substring(texts, m).to_numpy(zero_copy_only=False) for m in marks)

    last = pc.match_substring_regex(texts, "[.!?]$").to_numpy(zero_copy_only=False)
    numbers = np.stack((np.log1p(chars) / 8, np.minimum(1, np.fromiter((b.linked for b in blocks), np.float64, n) / chars),
                        np.minimum(1, count(".", ",", ";") / 20), place / np.maximum(np.repeat(sizes, sizes) - 1, 1), last,
                        count("\u00a9", "|") > 0), axis=1).astype(np.float32)
    paths = path_rows[kind_of]
    return [(paths[lo:hi], words[lo:hi], numbers[lo:hi]) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Labeller:
    """Bidirectional LSTM over block sequences, with its gradient and Adam steps."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        x, h = 2 * EMBEDDED + NUMBERS, HIDDEN_UNITS

        def start(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"path": start(PATH_DIMS, EMBEDDED) * 4, "word": start(WORD_DIMS, EMBEDDED), "out": start(2 * h + x, 1),
                  "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p[f"x{d}"], self.p[f"h{d}"] = start(x, 4 * h), start(h, 4 * h)
            self.p[f"c{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), h)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        """Hidden states (time, pages, units) of one direction; masked steps keep the state."""
        steps, pages = mask.shape
        h = c = np.zeros((pages, HIDDEN_UNITS), np.float32)
        out = np.zeros((steps, pages, HIDDEN_UNITS), np.float32)
        gates_x = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = gates_x[t] + h @ self.p[f"h{d}"]
            i, f, o = (1 / (1 + np.exp(-g)) for g in np.split(gates[:, :3 * HIDDEN_UNITS], 3, axis=1))
            g = np.tanh(gates[:, 3 * HIDDEN_UNITS:])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tanh_c = np.tanh(c_new)
            if tape is not None:
                tape.append((t, i, f, o, g, c, tanh_c, h, m))
            h, c = m * o * tanh_c + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        return out

    def _inputs(self, paths: np.ndarray, words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return np.concatenate((np.tanh(paths @ self.p["path"]), np.tanh(words @ self.p["word"]), numbers), axis=2)

    def probabilities(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Probability of main text of every block of every page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][0])), key=lambda i: len(pages[i][0]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and end - start < 256 and len(pages[order[end]][0]) * (end + 1 - start) <= 16_384:
                end += 1
            group = order[start:end]
            stacked, mask = _pad([pages[i] for i in group])
            x = self._inputs(*stacked)
            joined = np.concatenate((self._run(x, mask, "f", None), self._run(x, mask, "b", None), x), axis=2)
            p = 1 / (1 + np.exp(-(joined @ self.p["out"] + self.p["bias"])[:, :, 0]))
            for k, i in enumerate(group):
                out[i] = p[:len(pages[i][0]), k]
            start = end
        return out

    def gradient(self, batch: list, gold: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        paths, words, numbers = batch
        x = self._inputs(paths, words, numbers)
        tapes: dict[str, list] = {"f": [], "b": []}
        hf, hb = self._run(x, mask, "f", tapes["f"]), self._run(x, mask, "b", tapes["b"])
        joined = np.concatenate((hf, hb, x), axis=2)
        p = 1 / (1 + np.exp(-(joined @ self.p["out"] + self.p["bias"])[:, :, 0]))
        slope = ((p - gold) * mask / max(mask.sum(), 1))[:, :, None].astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"] = np.tensordot(joined, slope, axes=((0, 1), (0, 1)))
        grad["bias"] = slope.sum(axis=(0, 1))
        back = slope @ self.p["out"].T
        dx = back[:, :, 2 * HIDDEN_UNITS:].copy()
        for n, d in enumerate("fb"):
            dh_out = back[:, :, n * HIDDEN_UNITS:(n + 1) * HIDDEN_UNITS]
            dh = dc = np.zeros_like(dh_out[0])
            for t, i, f, o, g, c, tanh_c, h, m in reversed(tapes[d]):
                dh = dh + dh_out[t]
                inner = m * dh
                dcell = m * dc + inner * o * (1 - tanh_c ** 2)
                gates = np.concatenate((dcell * g * i * (1 - i), dcell * c * f * (1 - f), inner * tanh_c * o * (1 - o),
                                        dcell * i * (1 - g ** 2)), axis=1)
                grad[f"x{d}"] += x[t].T @ gates
                grad[f"h{d}"] += h.T @ gates
                grad[f"c{d}"] += gates.sum(axis=0)
                dx[t] += gates @ self.p[f"x{d}"].T
                dh = (1 - m) * dh + gates @ self.p[f"h{d}"].T
                dc = (1 - m) * dc + dcell * f
        for name, source, lo in (("path", paths, 0), ("word", words, EMBEDDED)):
            inner = dx[:, :, lo:lo + EMBEDDED] * (1 - x[:, :, lo:lo + EMBEDDED] ** 2)
            grad[name] = np.tensordot(source, inner, axes=((0, 1), (0, 1)))
        return grad


def _pad(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    steps = max(len(p[0]) for p in pages)
    stacked = [np.zeros((steps, len(pages), p.shape[1]), np.float32) for p in pages[0]]
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, page in enumerate(pages):
        for whole, part in zip(stacked, page, strict=True):
            whole[:len(part), k] = part
        mask[:len(page[0]), k] = 1
    return stacked, mask


# fixed values: names that training pages draw from
_MAIN = ["article", "main", "div content", "div post body", "div entry content", "div article text", "section story",
         "div main content", "div post", "td content", "div story body", "div page content", "div text", "div id main"]
_OTHER = {
    "nav": ["nav", "ul menu", "div nav", "div navigation bar", "div breadcrumbs", "div menu top", "ul nav links"],
    "header": ["header", "div header", "div masthead", "div top banner", "div site header"],
    "sidebar": ["aside", "div sidebar", "div related", "div widget", "aside sidebar right", "div recommended posts", "div popular"],
    "notice": ["div cookie notice", "div notice", "div consent banner", "div alert", "div gdpr", "div popup newsletter", "div subscribe"],
    "advert": ["div ad", "div ads", "div advert", "div sponsored", "aside ad", "div banner ad", "div promo", "section advertisement"],
    "form": ["form", "form search", "form login", "form subscribe", "div form contact"],
    "comments": ["section comments", "div comments", "ol comment list", "div comment thread", "div disqus replies", "ul responses"],
    "footer": ["footer", "div footer", "div copyright", "footer site", "div bottom links", "div legal"],
    "share": ["div share", "div social links", "div author bio", "div tags", "div byline meta"],
}


def training_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A composed page and, for each of its leaf blocks, whether it is main text."""
    out, gold = [], []

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("aeioubcdfghlmnprstvwéöñ") for _ in range(rng.randint(1, 9))) for _ in range(max(1, n)))

    def sentence() -> str:
        return words(rng.randint(2, 18)).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def leaf(tag: str, text: str, main: bool) -> None:
        out.append(f"<{tag}>{text}" + (f"</{tag}>" if rng.random() < 0.9 else ""))
        gold.append(main)

    def open_(name: str) -> str:
        tag, *names = name.split()
        key = rng.choice(["class", "class", "class", "id"])
        out.append(f'<{tag}{f""" {key}="{rng.choice(["-", " ", "_"]).join(names)}" """.rstrip() if names else ""}>')
        return tag

    def fill(kind: str) -> None:
        tag = open_(rng.choice(_OTHER[kind]))
        list_ = tag in ("ul", "ol")
        n = rng.randint(1, 8 if kind in ("nav", "sidebar", "footer", "comments") else 2)
        for _ in range(n):
            if kind == "comments":
                text = " ".join(sentence() for _ in range(rng.randint(1, 4)))
            elif kind in ("nav", "sidebar", "share") or rng.random() < 0.4:
                text = f'<a href="/{rng.randint(1, 999)}">{words(rng.randint(1, 6))}</a>'
            else:
                text = sentence()
            if kind == "footer" and rng.random() < 0.6:
                text = "&copy; " + text
            leaf("li" if list_ else rng.choice(["p", "div", "li", "h3", "p"]), text, False)
        out.append(f"</{tag}>")

    if rng.random() < 0.9:
        out.append(f"<html><head><title>{words(4)}</title><script>var a='</p>';</script></head><body>")
    for kind in rng.sample(["nav", "header", "notice", "advert", "form", "sidebar"], rng.randint(0, 5)):
        fill(kind)
    wrapped = open_(rng.choice(["div wrapper", "div container", "div page", "main"])) if rng.random() < 0.4 else None
    main = open_(rng.choice(_MAIN))
    if rng.random() < 0.8:
        leaf(rng.choice(["h1", "h1", "h2"]), words(rng.randint(1, 9)), True)
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
        kind = rng.random()
        if kind < 0.08:
            leaf(rng.choice(["h2", "h3"]), words(rng.randint(1, 6)), True)
        elif kind < 0.16:
            leaf(rng.choice(["li", "blockquote", "pre"]), sentence(), True)
        else:
            text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8])))
            if rng.random() < 0.2:
                text = f'{text} <a href="#">{words(2)}</a> {sentence()}'
            if rng.random() < 0.1:
                text = " | ".join(text.split())
            leaf("p", rng.choice(["", "", "<b>"]) + text + rng.choice(["", "<br>"]), True)
        if rng.random() < 0.08:
            fill(rng.choice(["advert", "share", "sidebar", "notice"]))
    out.append(f"</{main}>")
    for kind in rng.sample(["share", "comments", "sidebar", "advert", "form", "nav", "notice"], rng.randint(0, 4)):
        fill(kind)
    if wrapped:
        out.append(f"</{wrapped}>")
    if rng.random() < 0.85:
        fill("footer")
    return "".join(out) + rng.choice(["</body></html>", ""]), gold


_INSIDE = frozenset(("nav", "aside", "footer", "form", "header"))


def _named(blocks: list[Block]) -> list[bool] | None:
    """Labels of a page whose markup has one article element; None if it names none."""
    inside = ["article" in b.path for b in blocks]
    if not any(inside) or all(inside):
        return None
    return [i and not _INSIDE & set(b.path[b.path.index("article"):]) for i, b in zip(inside, blocks, strict=True)]


def fit_labeller(pages: DataFrame | None = None, column: str = "html", key: str = "page_id",
                 sample_pages: int = SAMPLE_PAGES, training_pages: int = TRAINING_PAGES, epochs: int = EPOCHS) -> Labeller:
    """Train on composed pages and on a bounded sample of the table's own pages that name their article."""
    rng = random.Random(11)
    examples = []
    for _ in range(training_pages):
        page, gold = training_page(rng)
        blocks = leaf_blocks(page)
        if len(blocks) == len(gold):
            examples.append((blocks, np.array(gold, np.float32)))
    if pages is not None:
        rows = pages.where(F.col(column).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(key).alias("k"))
        chosen = rows.orderBy("h", "k").limit(sample_pages).select("k").distinct()
        sample = (pages.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), column).join(F.broadcast(chosen), "k")
                  .groupBy("k").agg(F.min(column).alias(column)).orderBy("k").collect())
        for row in sample:
            blocks = leaf_blocks(row[column])
            gold = _named(blocks) if blocks else None
            if gold is not None:
                examples.append((blocks, np.array(gold, np.float32)))
    examples = list(zip(page_features([b for b, _ in examples]), [g for _, g in examples], strict=True))
    model = Labeller()
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(range(len(examples)), key=lambda i: (len(examples[i][1]) // 6, rng.random()))
        batches = [order[i:i + 32] for i in range(0, len(order), 32)]
        rng.shuffle(batches)
        for chosen in batches:
            stacked, mask = _pad([examples[i][0] for i in chosen])
            gold = np.zeros_like(mask)
            for k, i in enumerate(chosen):
                gold[:len(examples[i][1]), k] = examples[i][1]
            step += 1
            rate = 0.02 * 0.8 ** epoch
            for name, g in model.gradient(stacked, gold, mask).items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                model.p[name] = (model.p[name] - rate * (first[name] / (1 - 0.9 ** step))
                                 / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return model


def extract(pages: list[str | None], model: Labeller) -> list[tuple[str, list[int]]]:
    """Text of every page, and the numbers of its chosen blocks."""
    blocks = [leaf_blocks(p) if p else [] for p in pages]
    chances = model.probabilities(page_features(blocks))
    out = []
    for own, chance in zip(blocks, chances, strict=True):
        chosen = np.flatnonzero(chance >= THRESHOLD).tolist()
        out.append((" ".join(own[i].text for i in chosen), chosen))
    return out


def extract_pages(df: DataFrame, model: Labeller, column: str = "html", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Append ``text``, ``n_chars`` (code points) and ``blocks``, the numbers of the blocks in the text."""
    keep = tuple(df.columns) if keep is None else keep
    if clash := {"text", "n_chars", "blocks"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are taken; choose others with keep")
    sent = df.sparkSession.sparkContext.broadcast(model.p)
    source = df.select(*keep, F.col(column).alias("__html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]),
                        "text string, n_chars bigint, blocks array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.p = sent.value
        for part in text_slices(batches, "__html", 2 << 20):
            found = extract(part.column("__html").to_pylist(), labeller)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()),
                 pa.array([b for _, b in found], pa.list_(pa.int32()))], names=[*part.schema.names[:-1], "text", "n_chars", "blocks"])

    return source.mapInArrow(run, schema)
