"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a chain of leaf blocks: runs of text between block-level tags, with white space made single and character references decoded.
A block's features are its ancestors' tags, the words of their class, id and role, and its text's length, link share, ending and
place. The field knows two states, main and other; Viterbi decoding labels all blocks of a page together, and the
main ones are joined by line ends.

It is trained on labelled pages: a bounded sample of the pages themselves, labelled by their article element, and the same
blocks laid out again in other ways (other containers, menus, side bars, notices, forms, adverts and reader comments at
other places), where every block's label is known from the layout. Training is numpy, decoding runs inside tasks.

Null and empty pages, and pages without a main block, give an empty text. Without training pages nothing is main. Equal pages give
equal texts, of any length; extra columns are not read.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import sampled, table, text_or_empty
from furrow.llm.pieces import grouped

#: Pages that a fit may use, layouts drawn for each, the blocks that it takes of a page in how many runs, and the length to which their texts are cut for layouts.
SAMPLE_PAGES, LAYOUTS, PAGE_BLOCKS, RUNS, BLOCK_CHARS = 300, 4, 200, 4, 1000
#: Least characters of a block that counts as main on a page without labels.
LIKELY_CHARS = 80
#: A character for private use that marks main text while a layout is made.
MARK = "\ue000"
DIMENSIONS = 1 << 13

#: Fixed values of the HTML standard: elements whose text is never shown as page text, elements without an end tag, inline elements, and elements that
#: a start tag of the same group ends.
#: Of the hidden ones, those of RAW hold all up to their end tag or the page's end; without an end tag the others hide nothing.
HIDDEN = "script style noscript template svg iframe object textarea select button title".split()
RAW = frozenset("script style noscript iframe textarea title".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("article aside blockquote body div dl footer form header main nav ol section table ul".split())
#: Words in class, id and role attributes that say what an element is for.
OTHER_WORDS = re.compile(r"(^|[^a-z])(ad|ads)([^a-z]|$)|advert|sponsor|promo|banner|comment|discuss|reply|sidebar|nav|menu|footer|masthead|header|cookie|consent|notice|alert|breadcrumb|share|social|related|recommend|subscribe|newsletter|widget|popup|modal|login|search|form|copyright|legal|tag|meta|pager|skip")
MAIN_WORDS = re.compile(r"article|content|post|entry|main|story|text|body|prose")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+>?",
    re.S,
)
_END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in HIDDEN}
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


@dataclass
class Block:
    text: str
    above: tuple[int, ...]  # features of all ancestors
    link_chars: int
    tags: frozenset[str]  # of all ancestors
    scope: str  # the innermost sectioning element, and what its attributes say
    inside: str  # the innermost element that is not inline


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIMENSIONS


def _of_element(tag: str, attributes: str) -> tuple[int, ...]:
    names = [f"tag {tag}"]
    for value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        names += [f"word {w}" for w in re.findall(r"[a-z]+", value)]
        names += ["other word"] * bool(OTHER_WORDS.search(value)) + ["main word"] * bool(MAIN_WORDS.search(value))
    return tuple(dict.fromkeys(map(_number, names)))


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], str, frozenset[str], str]] = [("", (), "", frozenset(), "")]
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
    scopes = [0]  # places of the open sectioning elements
    seen: dict[tuple[str, str], tuple[int, ...]] = {}
    known: dict[tuple[str, str], frozenset[int]] = {}
    parts: list[str] = []
    unclosed: set[str] = set()  # hidden elements that have no further end tag
    link_chars = at = links = 0

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1][1], link_chars, stack[-1][3], stack[-1][2], stack[-1][4]))
            parts, link_chars = [], 0

    def leave(k: int) -> None:
        """End the open elements from place ``k`` on; every element is ended once."""
        nonlocal links
        while len(stack) > k:
            tag = stack.pop()[0]
            places[tag].pop()
            links -= tag == "a"
            if tag in SCOPES:
                scopes.pop()

    def close(names: set[str] | frozenset[str]) -> None:
        """End the innermost of the named elements that its scope holds."""
        k = max((places[t][-1] for t in names if places.get(t)), default=0)
        if k and k >= scopes[-1]:
            leave(k)

    def leave_head() -> None:
        if stack[-1][0] == "head":
            flush()
            leave(len(stack) - 1)

    def hidden_until(tag: str, start: int) -> int:
        """Where the hidden element ends whose start tag ends at ``start``; -1 if it hides nothing."""
        m = None if tag in unclosed else _END_OF[tag].search(page, start)
        if m:
            return m.end()
        unclosed.add(tag)
        return len(page) if tag in RAW else -1

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = html.unescape(page[at : m.start()])
            if not piece.isspace():
                leave_head()
            parts.append(piece)
            link_chars += len(piece) * (links > 0)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if not m["end"] and tag not in HEAD:
            leave_head()
        if tag in _END_OF and not m["end"]:
            if tag == "svg" and m["attributes"].endswith("/"):  # closes itself
                continue
            if (end := hidden_until(tag, at)) >= 0:
                at = end
                if tag not in ("svg", "button"):
                    flush()
                continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m["end"]:
            if places.get(tag):
                leave(places[tag][-1])
            continue
        if tag in EMPTY:
            continue
        if tag in ENDS or tag in SCOPES or re.fullmatch("h[1-6]", tag):
            close(ENDS.get(tag, {"p"}))
        key = tag, m["attributes"]
        if key not in seen:
            seen[key] = _of_element(*key)
            known[key] = frozenset(seen[key])
        links += tag == "a"
        said = " ".join(_ATTRIBUTE.findall(m["attributes"])).lower() if m["attributes"] else ""
        scope = f"{tag} {bool(OTHER_WORDS.search(said)):d}{bool(MAIN_WORDS.search(said)):d}" if tag in SCOPES else stack[-1][2]
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        _, above, _, tags, inside = stack[-1]
        if not known[key] <= set(above):  # else the element adds nothing, and shares what its parent has
            above = tuple(dict.fromkeys(above + seen[key]))
        stack.append((tag, above, scope, tags if tag in tags else tags | {tag}, inside if tag in INLINE else tag))
    if at < len(page):
        piece = html.unescape(page[at:])
        if not piece.isspace():
            leave_head()
        parts.append(piece)
    flush()
    return out


def own_features(chain: list[Block]) -> list[tuple[int, ...]]:
    """What the texts say, apart from the ancestors."""
    out = []
    for k, b in enumerate(chain):
        n = len(b.text)
        names = [
            f"length {min(9, n.bit_length())}",
            f"words {min(6, (b.text.count(' ') + 1).bit_length())}",
            f"links {min(4, 5 * b.link_chars // max(n, 1))}",
            f"ends {b.text[-1] if b.text[-1] in '.!?:;,|' else 'else'}",
            f"place {min(4, 5 * k // len(chain))}",
            f"scope {b.scope}",
            f"inside {b.inside}",
        ]
        if "©" in b.text:
            names.append("copyright")
        out.append(tuple(map(_number, names)))
    return out


@dataclass
class Field:
    """Weights of (feature, state), of state changes, and of the first state. State 1 is main."""

    weights: np.ndarray
    change: np.ndarray
    first: np.ndarray

    def emissions(self, chain: list[Block]) -> np.ndarray:
        return np.array([self.weights[list(b.above + own)].sum(0) for b, own in zip(chain, own_features(chain), strict=True)])

    def viterbi(self, chain: list[Block]) -> list[int]:
        """The most probable labels of all blocks together."""
        if not chain:
            return []
        known: dict[tuple[int, ...], np.ndarray] = {}
        rows = []
        for b, own in zip(chain, own_features(chain), strict=True):
            if b.above not in known:
                known[b.above] = self.weights[list(b.above)].sum(0)
            rows.append(known[b.above] + self.weights[list(own)].sum(0))
        (t00, t01), (t10, t11) = self.change.tolist()
        rows = np.array(rows).tolist()
        s0, s1 = rows[0][0] + self.first[0], rows[0][1] + self.first[1]
        back = []
        for e0, e1 in rows[1:]:
            from0, from1 = (0 if s0 + t00 >= s1 + t10 else 1), (0 if s0 + t01 > s1 + t11 else 1)
            back.append((from0, from1))
            s0, s1 = e0 + (s1 + t10 if from0 else s0 + t00), e1 + (s1 + t11 if from1 else s0 + t01)
        state = int(s1 > s0)
        out = [state]
        for pair in reversed(back):
            state = pair[state]
            out.append(state)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def rows_of(chain: list[Block]) -> list[list[int]]:
    """The features of each block, in all."""
    return [[*b.above, *own] for b, own in zip(chain, own_features(chain), strict=True)]


def train(runs: list[tuple[list[list[int]], list[int], bool]], epochs: int = 10, rate: float = 0.3, shrink: float = 1e-4, seed: int = 3) -> Field:
    """Conditional likelihood by AdaGrad, a run of blocks a step; marginals from the forward-backward recursions.

    A run has features, labels, and whether it begins its page: only then it has a first state.
    """
    field = Field(np.zeros((DIMENSIONS, 2)), np.zeros((2, 2)), np.zeros(2))
    sums = Field(np.full((DIMENSIONS, 2), 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6))
    ready = [([np.array(r) for r in rows], np.array(y), begins) for rows, y, begins in runs if rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(ready)):
            rows, y, begins = ready[k]
            n = len(y)
            e = np.array([field.weights[r].sum(0) for r in rows])
            a, b = np.empty((n, 2)), np.zeros((n, 2))
            a[0] = e[0] + field.first * begins
            for t in range(1, n):
                a[t] = e[t] + _log_sum(a[t - 1][:, None] + field.change, 0)
            for t in range(n - 2, -1, -1):
                b[t] = _log_sum(field.change + (e[t + 1] + b[t + 1])[None, :], 1)
            total = _log_sum(a[-1], 0)
            slope = np.exp(a + b - total)
            slope[np.arange(n), y] -= 1
            change = np.zeros((2, 2))
            if n > 1:
                change = np.exp(a[:-1, :, None] + field.change + (e[1:] + b[1:])[:, None, :] - total).sum(0)
                np.add.at(change, (y[:-1], y[1:]), -1)
            at = np.concatenate(rows)
            g = np.zeros((len(at), 2))
            g[:] = np.repeat(slope, [len(r) for r in rows], axis=0)
            used, where = np.unique(at, return_inverse=True)
            gw = np.zeros((len(used), 2))
            np.add.at(gw, where, g)
            gw += shrink * field.weights[used]
            sums.weights[used] += gw**2
            field.weights[used] -= rate * gw / np.sqrt(sums.weights[used])
            for weights, squares, gradient in ((field.change, sums.change, change), (field.first, sums.first, slope[0] * begins)):
                squares += gradient**2
                weights -= rate * gradient / np.sqrt(squares)
    return field


# -- labelled pages ---------------------------------------------------------------------------


def labels_by_markup(chain: list[Block]) -> list[int]:
    """Main is what stands in an article and in no menu, header, footer, side element or form of it."""
    return [int("article" in b.tags and not {"nav", "aside", "footer", "form", "header"} & b.tags) for b in chain]


def laid_out(main: list[str], other: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """The same blocks in another page, and their labels there."""
    main, other = [t.replace(MARK, "") for t in main], [t.replace(MARK, "") for t in other]
    line = lambda: html.escape(rng.choice(other or ["More"]))
    short = lambda: html.escape(" ".join(rng.choice(main + other or ["more"]).split()[: rng.randint(1, 4)]))
    menu = lambda: "".join(f"<li><a href='/x'>{short()}</a></li>" for _ in range(rng.randint(2, 8)))
    said = lambda: html.escape(rng.choice(main or ["Well said."]))
    comments = rng.choice(["<div class='comments'>{}</div>", "<section id='comments' class='reader-comments'>{}</section>", "<ol class='comment-list'>{}</ol>"])
    notes = [
        lambda: f"<nav><ul>{menu()}</ul></nav>",
        lambda: f"<ul class='menu'>{menu()}</ul>",
        lambda: "<nav>" + rng.choice([" | ", " ", " &gt; "]).join(f"<a href='/x'>{short()}</a>" for _ in range(rng.randint(1, 6))) + "</nav>",
        lambda: f"<header><h1>{short()}</h1><a href='/'>{short()}</a></header>",
        lambda: f"<header class='site-header'><p>{line()}</p></header>",
        lambda: f"<aside class='sidebar'><h3>{short()}</h3><p>{said()}</p><ul>{menu()}</ul></aside>",
        lambda: f"<div class='{rng.choice(['cookie-notice', 'notice', 'alert banner', 'consent'])}'><p>{line()}</p></div>",
        lambda: f"<div class='{rng.choice(['ad', 'advert', 'ads sponsored', 'promo'])}'>{rng.choice([line, said])()}</div>",
        lambda: f"<form action='/s'><p>{line()}</p><label>{short()}</label><input name='q'></form>",
        lambda: f"<div class='{rng.choice(['related', 'share social', 'newsletter subscribe', 'widget'])}'><p>{said()}</p><a href='/y'>{short()}</a></div>",
        lambda: comments.format("".join(f"<{t}><p class='comment'>{said()}</p></{t}>" for t in ["div"] * rng.randint(1, 4))),
        lambda: f"<footer>&copy; {line()}</footer>",
        lambda: f"<div id='footer'><p>{line()}</p></div>",
    ]
    some = lambda most: "".join(rng.choice(notes)() for _ in range(rng.randint(0, most)))
    body = [rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>"] if rng.random() < 0.2 else ["<p>{}</p>"]).format(MARK + html.escape(t)) for t in main]
    for _ in range(rng.randint(0, 2)):
        body.insert(rng.randint(0, len(body)), rng.choice(notes)())
    tag, attributes = rng.choice([("article", ""), ("article", " class='post'"), ("main", ""), ("div", " class='content'"), ("div", " id='main-content'"), ("section", " class='entry-content'"), ("div", " class='story-body'")])
    page = f"<html><body>{some(4)}<{tag}{attributes}>{''.join(body)}</{tag}>{some(4)}</body></html>"
    chain = blocks(page)
    return [replace(b, text=b.text.replace(MARK, "")) for b in chain], [int(MARK in b.text) for b in chain]


def runs_of(y: list[int], key: int) -> list[tuple[int, int]]:
    """Places of the page's blocks to learn from: all, or of more than PAGE_BLOCKS the first, the last, those around a hashed change of labels and those at a hashed place."""
    n, each = len(y), PAGE_BLOCKS // RUNS
    if n <= PAGE_BLOCKS:
        return [(0, n)]
    changes = [k for k in range(1, n) if y[k] != y[k - 1]] or [n // 2]
    begins = sorted({0, n - each, max(0, min(changes[key % len(changes)] - each // 2, n - each)), key // 7 % (n - each + 1)})
    out: list[tuple[int, int]] = []
    for begin in begins:
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], begin + each
        else:
            out.append((begin, begin + each))
    return out


def likely(chain: list[Block]) -> list[int]:
    """Of a page without labels: long blocks with few links count as main. Only layouts made of their texts are learned from."""
    return [int(len(b.text) >= LIKELY_CHARS and 4 * b.link_chars <= len(b.text)) for b in chain]


def training_part(page: str, key: int) -> list | None:
    """Runs of a page's blocks: whether the page is labelled, features, labels within the whole page, beginnings and texts."""
    chain = blocks(page)
    if not chain:
        return None
    labelled = any("article" in b.tags for b in chain)
    y, rows = labels_by_markup(chain) if labelled else likely(chain), rows_of(chain)
    runs = runs_of(y, key)
    short = lambda t: t if len(t) <= BLOCK_CHARS else t[: BLOCK_CHARS // 2] + t[-BLOCK_CHARS // 2 :]
    return [labelled, [rows[a:b] for a, b in runs], [y[a:b] for a, b in runs], [a == 0 for a, _ in runs], [[short(x.text) for x in chain[a:b]] for a, b in runs]]


def fit(pages: DataFrame) -> Field:
    """Train on a hashed sample of at most SAMPLE_PAGES distinct pages of ``pages`` (html), of any length.

    A page without an article element carries no label: such pages are left out. Where no page is labelled, the field learns from
    layouts that are made of the pages' texts.
    """
    usable = pages.where(F.length("html") > 0).select("html")
    schema = "labelled boolean, features array<array<array<int>>>, labels array<array<int>>, begins array<boolean>, texts array<array<string>>"
    marked = usable.where(F.lower("html").contains("<article"))
    found = [p for p in sampled(marked, SAMPLE_PAGES, training_part, schema) if p["labelled"]]
    found = found or sampled(usable, SAMPLE_PAGES, training_part, schema)
    rng = random.Random(11)
    out = []
    for page in found:
        if page["labelled"]:
            out += list(zip(page["features"], page["labels"], page["begins"], strict=True)) * 2
        said = [(t, v) for texts, y in zip(page["texts"], page["labels"], strict=True) for t, v in zip(texts, y, strict=True)]
        main, other = [t for t, v in said if v], [t for t, v in said if not v]
        for _ in range(LAYOUTS if page["labelled"] else 3 * LAYOUTS):
            chain, y = laid_out(main[:25], other, rng)
            out.append((rows_of(chain), y, True))
    return train(out)


def extract(pages: DataFrame, field: Field, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, the page's main ``text`` and its number of characters."""
    kept = pages.select(*keep, text_or_empty("html").alias("_html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "text string, n_chars long"])
    sent = pages.sparkSession.sparkContext.broadcast(field)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in grouped(pc.binary_length(whole.column(len(keep))).to_pylist()):
                batch = whole.slice(s.start, s.stop - s.start)
                texts = []
                for page in batch.column(len(keep)).to_pylist():
                    chain = blocks(page)
                    texts.append("\n".join(b.text for b, state in zip(chain, sent.value.viterbi(chain), strict=True) if state))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts), pa.array(map(len, texts), pa.int64())], [*batch.schema.names[: len(keep)], "text", "n_chars"])

    return kept.mapInArrow(run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
