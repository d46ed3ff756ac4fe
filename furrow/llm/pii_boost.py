"""Personal data by candidate gradient boosting.

Strict base patterns find emails, IP addresses, cards and phone numbers that check out; these are always taken. Loose
generators propose further, overlapping spans in the ways people disguise such data (spelled-out at signs, bracketed dots, numbers
without country code or in odd groups). Boosted trees score every candidate by its format and its context, and a threshold for each kind, calibrated on
held-out candidates, selects the ones to redact: the best first, none that overlaps a taken one.

The trees learn from a bounded sample of documents: base matches, the same data written in disguises, and numbers that are none
(versions, dates, amounts, times, sections, hexadecimal strings) in the same contexts, beside the documents' own loose candidates.

Null and empty texts have no spans. Offsets count code points. Equal texts have equal spans; texts of any length are read whole. Extra columns
are not read. Without documents to learn from only base spans are taken.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow.llm.common import sampled, table, text_or_empty
from furrow.llm.pieces import grouped

KINDS = ("email", "ip", "card", "phone")
#: Documents that a fit may use, and the length of the passage that it takes of a longer one.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000
ROUNDS, DEPTH, RATE, BINS = 80, 3, 0.2, 16
#: Disguised copies wanted of each kind, and made of one base match at most: a kind that is rare in the sample is learned as well.
COPIES, COPIES_MOST = 400, 60
#: Share of true spans that calibration asks of what a threshold lets through.
PRECISION = 0.995
CONTEXT = 30

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where a run of digits does: the run before it is taken whole. So nothing is tried twice, however long a run is.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every text with a candidate has: the email generator asks for an at sign or one of these words, the others for digits.
_HAS = re.compile(r"[0-9@]|\sat\s|[\[({<]\s?at\s?[\])}>]", re.I)

#: Loose generators: whatever may be meant as such data. Of numbers, what may stand between two groups of digits.
LOOSE_EMAIL = re.compile(r"[\w.%+-]{1,64}\s?(?:@|[\[({<]\s?(?:at|@)\s?[\])}>]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({<]\s?(?:dot|\.)\s?[\])}>]|\sdot\s)\s?[A-Za-z0-9-]{2,24}){1,4}", re.I)
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = {
    1: re.compile(r"\s?[\[({]?\s?(?:\.|dot|,)\s?[\])}]?\s?", re.I),
    2: re.compile(r"[\x20./_-]{1,2}"),
    3: re.compile(r"[\x20()./-]{1,2}"),
}
#: Least and most digits of the spans of groups that are proposed.
_DIGITS = {2: (13, 19), 3: (7, 15)}
CUES = {
    "email": r"e-?mail|mail|contact|write|courriel|correo|@",
    "ip": r"\bip\b|server|host|address|adresse|login",
    "card": r"card|visa|master|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|call|tel|mobile|fax|anruf|appel|llama|handy",
}
_CUES = {k: re.compile(v, re.I) for k, v in CUES.items()}
_NUMBERED = re.compile(r"version|licen[sc]e|section|chapter|isbn|token|key|hash|order|no\.|nr\.|page|v$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict matches, leftmost and without overlap in each kind, failing ones dropped."""
    out: list[tuple[int, int, int]] = []
    end = 0
    at = text.find("@")
    while at >= 0:  # only what stands around an at sign can match
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """All loose proposals; they may overlap one another and the base spans.

    Of numbers, every admissible run of whole digit groups is proposed: any start, and any end that the kind's number of digits allows.
    """
    out = [(0, m.start(), m.end()) for m in LOOSE_EMAIL.finditer(text)]
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text)]
    for kind, between in _BETWEEN.items():
        joined_on = [after - end <= 9 and bool(between.fullmatch(text, end, after)) for (_, end), (after, _) in zip(groups, groups[1:])] + [False]
        for i, (start, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                size = groups[j][1] - groups[j][0]
                n += size
                if kind == 1:
                    if size > 3:
                        break
                    if j - i == 3:
                        out.append((1, start, groups[j][1]))
                        break
                else:
                    low, high = _DIGITS[kind]
                    if n > high:
                        break
                    if n >= low:
                        out.append((kind, _with_sign(text, start) if kind == 3 else start, groups[j][1]))
                if not joined_on[j]:
                    break
    return out


def _with_sign(text: str, start: int) -> int:
    """Where a phone number begins: a plus sign or bracket in front belongs to it."""
    return start - 1 if text[start - 1 : start] in ("+", "(") else start


FEATURES = 26
#: Frequent ends of a domain.
TOPS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk", "ch", "at")


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 10]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    left, right = text[start - 1 : start], text[end : end + 1]
    around = before + " " + after
    return [
        float(kind), float(len(s)), float(len(d)), float(len(groups)), float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0),
        float(max(map(len, groups), default=0)), float(luhn(d)) if d else 0.0, float("+" in s), float("(" in s or "[" in s or "{" in s), float("@" in s),
        float(bool(re.search(r"\bat\b", s, re.I))), float(bool(re.search(r"\bdot\b", s, re.I))), float(s.count(".")), float(s.count("-")), float(s.count(" ")), float(s.count("/") + s.count(",") + s.count("_")),
        float(left.isalnum()), float(right.isalnum() or right in (".", "-") and text[end + 1 : end + 2].isdigit()), float(all(len(g) < 4 and int(g) <= 255 for g in groups) and len(groups) == 4),
        float(bool(_CUES[KINDS[kind]].search(before))), float(bool(_NUMBERED.search(around))), float(len(set(d))), float(s[:1] == "0"),
        float(re.search(r"[A-Za-z]*\Z", s)[0].lower() in TOPS), float(len(re.search(r"[^\W\d]*\Z", s)[0])),
    ]


# -- boosted trees ----------------------------------------------------------------------------


@dataclass
class Trees:
    """Regression trees on binned features, each a list of (feature, bin, left, right, value), and a threshold for each kind."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, int, int, float]]] = field(default_factory=list)
    base: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def add(self, tree: list, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), np.int64)
        f, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
        for _ in range(DEPTH):
            go = f[at] >= 0
            low = b[np.arange(len(b)), np.maximum(f[at], 0)] <= cut[at]
            at = np.where(go, np.where(low, left[at], right[at]), at)
        return value[at]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(x))
        b = self.bins(x)
        z = self.base + sum(self.add(t, b) for t in self.trees)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list:
    tree: list = []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(tree)
        tree.append((-1, 0, 0, 0, RATE * -g[rows].sum() / (h[rows].sum() + 1)))
        if depth == DEPTH or len(rows) < 10:
            return me
        gs = np.stack([np.bincount(b[rows, f], g[rows], BINS + 1) for f in range(b.shape[1])]).cumsum(1)
        hs = np.stack([np.bincount(b[rows, f], h[rows], BINS + 1) for f in range(b.shape[1])]).cumsum(1)
        gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
        f, cut = np.unravel_index(gain.argmax(), gain.shape)
        low = b[rows, f] <= cut
        if gain[f, cut] < 1e-6 or low.all() or not low.any():
            return me
        left, right = node(rows[low], depth + 1), node(rows[~low], depth + 1)
        tree[me] = (int(f), int(cut), left, right, 0.0)
        return me

    node(np.arange(len(b)), 0)
    return tree


def train(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, seed: int = 5) -> Trees:
    """Boost on three quarters of the rows; on the rest find each kind's lowest threshold of the wanted precision."""
    model = Trees()
    rng = np.random.default_rng(seed)
    fit = rng.random(len(y)) < 0.75
    if not fit.any() or y[fit].min() == y[fit].max():
        return model
    model.edges = [np.unique(np.quantile(x[fit, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    share = y[fit].mean()
    model.base = float(np.log(share / (1 - share)))
    b, t, z = model.bins(x[fit]), y[fit], np.full(fit.sum(), model.base)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(b, p - t, p * (1 - p))
        model.trees.append(tree)
        z += model.add(tree, b)
    p = model.scores(x[~fit])
    for k in range(len(KINDS)):
        own = kinds[~fit] == k
        order = np.argsort(-p[own])
        hits, at = y[~fit][own][order].cumsum() / np.arange(1, own.sum() + 1), p[own][order]
        good = np.flatnonzero(hits >= PRECISION)
        model.thresholds[k] = max(0.5, float(at[good[-1]])) if len(good) else 2.0
    return model


def disguised(kind: int, s: str, rng: random.Random) -> str:
    """A base match in a form that its base pattern misses."""
    if kind == 0:
        name, _, domain = s.partition("@")
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[.]"), (" @ ", ".")])
        return name + at + domain.replace(".", dot)
    if kind == 1:
        return s.replace(".", rng.choice(["[.]", " . ", "(.)", " dot ", "[dot]"]))
    d = _digits(s)
    if kind == 2:
        return rng.choice([".", "  ", "/", "_"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:]
    return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}){}-{}"]).format(d[:3], d[3:6], d[6:])


def made_up(kind: int, rng: random.Random) -> str:
    """Data of a kind that is nobody's but looks like somebody's: documents of one origin write theirs much alike."""
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda low, high: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", weights=[8, 2, 3, 4, 12, 2, 2, 6, 7, 1, 1, 4, 2, 7, 8, 2, 1, 6, 6, 9, 3, 1, 2, 1, 2, 1], k=rng.randint(low, high)))
    if kind == 0:
        name = rng.choice(["", "", word(1, 8) + rng.choice("._-")]) + word(2, 9) + rng.choice(["", "", "", n(rng.randint(1, 4))])
        labels = [word(3, 10) + rng.choice(["", "", "", n(1), n(2)]) for _ in range(rng.choice([1, 1, 1, 2]))]
        return f"{name}@{'.'.join([*labels, rng.choice(TOPS)])}"
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        d = n(15)
        return d + next(c for c in "0123456789" if luhn(d + c))
    return f"+{rng.randint(1, 99)}{rng.randint(2, 9)}{n(9)}"


def no_data(rng: random.Random) -> str:
    """A number that is nobody's."""
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    return rng.choice([
        lambda: f"version {rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 999)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1, 999)},{n(3)},{n(3)}.{n(2)}", lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{n(2)}",
        lambda: f"section {rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([16, 18, 32, 40]))),
        lambda: f"isbn 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", lambda: f"order {n(rng.randint(7, 20))}", lambda: f"{n(rng.randint(7, 25))}", lambda: f"{rng.randint(1, 9)}, {rng.randint(1, 9)}, {rng.randint(10, 99)}, {rng.randint(100, 999)}", lambda: f"look at home {n(2)}. Dot com",
        lambda: f"AKIA{n(2)}HKU{n(1)}VBL{n(4)}",
    ])()


def labelled(texts: list[str], seed: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of candidates in documents and in copies with disguised data and with other numbers."""
    rng, x, y, kinds = random.Random(seed), [], [], []

    def take(text: str, true: list[tuple[int, int, int]], near: tuple[int, int] | None = None) -> None:
        for k, a, b in candidates(text):
            if near and not (a < near[1] and near[0] < b):
                continue
            x.append(features(text, k, a, b))
            # a candidate counts as true if it has the span and hardly more
            y.append(float(any(k == kk and a <= aa and bb <= b and b - a <= bb - aa + 2 for kk, aa, bb in true)))
            kinds.append(k)

    found = [(text, base_spans(text)) for text in texts]
    seen = [sum(k == kind for _, base in found for k, _, _ in base) for kind in range(len(KINDS))]
    copies = [min(COPIES_MOST, max(2, -(-COPIES // max(1, n)))) for n in seen]
    for text, base in found:
        take(text, base)
        for k, a, b in base:
            before, after = text[max(0, a - 200) : a], text[b : b + 200]  # wider than any candidate's context
            for _ in range(copies[k]):
                cue = rng.choice(["", "", rng.choice(re.sub(r"[^a-z|]", "", CUES[KINDS[k]]).split("|")) + " "])
                new = cue + disguised(k, text[a:b] if rng.random() < 0.3 else made_up(k, rng), rng)
                at = (len(before), len(before) + len(new))
                take(before + new + after, [(k, at[0] + len(cue), at[1])], at)
                new = no_data(rng)
                take(before + new + after, [], (len(before), len(before) + len(new)))
    return np.array(x).reshape(-1, FEATURES), np.array(y), np.array(kinds, np.int64)


def passage(text: str, key: int) -> str:
    """At most SAMPLE_CHARS characters of ``text`` around a hashed base match, or else around a hashed digit or at sign; whole words."""
    if len(text) <= SAMPLE_CHARS:
        return text
    places = [a for _, a, _ in base_spans(text)] or [m.start() for m in re.finditer("[0-9@]", text)]
    begin = max(0, min(places[key % len(places)] - SAMPLE_CHARS // 2, len(text) - SAMPLE_CHARS))
    end = begin + SAMPLE_CHARS
    cut = text[begin:end]
    if end < len(text):
        cut = re.sub(r"\s\S{0,100}\Z", "", cut)
    return re.sub(r"\A\S{0,100}\s", "", cut) if begin else cut


def fit(docs: DataFrame) -> Trees:
    """Train on a hashed sample of at most SAMPLE_ROWS distinct documents of any length that have a digit or an at sign."""
    usable = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    texts = [r["text"] for r in sampled(usable, SAMPLE_ROWS, lambda text, key: [passage(text, key)], "text string")]
    return train(*labelled(sorted(texts))) if texts else Trees()


def select(text: str, model: Trees) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and the further spans that the trees choose."""
    if not _HAS.search(text):
        return [], []
    base = base_spans(text)
    free = Taken()
    for _, a, b in base:
        free.add(a, b)
    found = [c for c in candidates(text) if free.free(c[1], c[2])] if model.trees else []
    if not found:
        return base, []
    more: list[tuple[int, int, int]] = []
    p = np.concatenate([model.scores(np.array([features(text, *c) for c in found[i : i + 4096]])) for i in range(0, len(found), 4096)])
    for i in np.argsort(-p, kind="stable"):
        if p[i] >= model.thresholds[found[i][0]] and free.free(*found[i][1:]):
            free.add(*found[i][1:])
            more.append(found[i])
    return base, sorted(more)


class Taken:
    """Spans that are taken, as sorted disjoint intervals."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        """Whether nothing taken overlaps the span."""
        i = bisect_right(self.ends, a)
        return i == len(self.starts) or self.starts[i] >= b

    def add(self, a: int, b: int) -> None:
        i, j = bisect_left(self.ends, a), bisect_right(self.starts, b)
        if i < j:  # what it meets becomes one interval with it
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """The kept columns, counts of base spans, their digest and all spans; with ``redacted`` also the text without them."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text"))
    made = StructType.fromDDL(", ".join([*(f"n_{k} long" for k in KINDS), "base_sha256 string, spans string", *["redacted string"] * redacted]))
    schema = StructType([*kept.schema.fields[:-1], *made.fields])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in grouped(pc.fill_null(pc.binary_length(whole.column(len(keep))), 0).to_pylist()):
                batch = whole.slice(s.start, s.stop - s.start)
                counts, digests, spans, texts = [[] for _ in KINDS], [], [], []
                for text in batch.column(len(keep)).to_pylist():
                    base, more = select(text or "", sent.value)
                    for k, column in enumerate(counts):
                        column.append(sum(x[0] == k for x in base))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(base + more))
                    texts.append(redact(text, base + more) if redacted and text else text)
                out = [*batch.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans)]
                names = [*batch.schema.names[: len(keep)], *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
                if redacted:
                    out, names = [*out, pa.array(texts, pa.string())], [*names, "redacted"]
                yield pa.RecordBatch.from_arrays(out, names)

    return kept.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars``, if there, counted anew."""
    others = [c for c in docs.columns if c != "text"]
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row") if others else F.struct(F.lit(0).alias("_")).alias("_row"), F.col("text"))
    out = find(numbered, model, keep=("_row",), redacted=True)
    columns = {c: F.col("_row").getField(c) for c in others} | {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
