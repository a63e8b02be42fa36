"""Personal data by patterns and a skip-chain conditional random field.

Patterns give base spans: emails, ip addresses, card numbers, phone numbers. They fix the labels of the
words they cover. The field then labels each other word that has a digit or an @; all further words are
fixed to "outside", so they only part the chains. Its potentials are

- of a word: shape (digits, letters, signs) and the digits of its run of numbers;
- of the chain: the labels of two such words with one blank between;
- of a skip edge: words of one document, however far apart, that are the same but for case and
  punctuation, that end a number of the same last seven digits, or that have the
  same name before an @, or are it. Equal words form a star around the first with a base span (else around the first of all), so a
  word repeated n times has n - 1 edges.

Loopy sum-product passes messages along both kinds of edges for a fixed number of rounds, the graphs of a batch
of documents at once; a document's result does not depend on its batch. Free words with a label that is likelier
than all others together become added spans: the same number or name in a writing that no pattern knows. Base
spans stay as they are.

The potentials are fitted by pseudo-likelihood on the driver, on at most SAMPLE distinct texts of at most
MAX_CHARS characters, drawn by hash. Each of their base spans is written once more in a form that no pattern
matches, and next to it a made-up number or name in the same form is added as "outside"; so a form alone
says nothing and the weights of the edges have to carry the label. Texts of the sample without base spans are practice, too: all their
words are "outside". Without any base span in the sample nothing is added.

Defined results: null text is empty, without spans; equal texts get equal spans, repeated rows one result
each; a null doc_id is kept; an empty table gives an empty result; extra columns, whatever their names, are
ignored by private_data() and kept by redact(). The field runs over every text, with or without base spans. Scanning is linear in a text's length; a very long text
is one graph, whose memory follows the number of its words with a digit or an @.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import ship

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
SAMPLE, MAX_CHARS = 3_000, 20_000
ROUNDS, DAMPING, SURE = 30, 0.5, 0.5
LABELS, SKIPS = 1 + len(KINDS), 3
SAME, NUMBER, NAME = range(SKIPS)

# ---- base spans
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_AT = re.compile(r"@|\(at\)|\[at\]")
_HAS_ANY = re.compile("[0-9@]")


def digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def luhn(number: str) -> bool:
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (c > "4")) for i, c in enumerate(reversed(number))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out, last = [], 0
    for m in _AFTER_AT.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            last = m.end()
            out.append((0, a, last))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


# ---- the field
class Graph:
    """Words of some documents with their shapes, chain and skip edges."""

    def __init__(self):
        self.start, self.end, self.doc, self.shape = [], [], [], []
        self.edges: list[tuple[int, int, int]] = []  # from, to, 0 for the chain and 1 + the skip's kind
        self.label: list[int] = []  # of words with a base span; -1 for the others

    def add(self, text: str, doc: int, base: list[tuple[int, int, int]]) -> None:
        spans = _words(text)
        if not spans:
            return
        first, words = len(self.start), [text[a:b] for a, b in spans]
        label = [-1] * len(spans)
        starts = [a for a, _ in spans]
        for kind, a, b in reversed(base):
            k = max(int(np.searchsorted(starts, a, "right")) - 1, 0)
            while k < len(spans) and spans[k][0] < b:
                if spans[k][1] > a:
                    label[k] = 1 + kind
                k += 1
        plain = [not any(c.isalpha() or c == "@" for c in w) for w in words]
        joined = [False, *(b + 1 == c for (_, b), (c, _) in pairwise(spans))]
        own, before = [digits(w) for w in words], [""] * len(spans)
        whole = [0] * len(spans)
        for i in range(len(spans)):
            if i and plain[i] and plain[i - 1] and joined[i]:
                before[i] = (before[i - 1] + own[i - 1])[-7:]
                whole[i] = whole[i - 1] + len(own[i])
            else:
                whole[i] = len(own[i])
        ends = whole[:]
        for i in range(len(spans) - 2, -1, -1):
            if plain[i] and plain[i + 1] and joined[i + 1]:
                ends[i] = ends[i + 1]
        groups: tuple[dict, ...] = ({}, {}, {})
        for i, w in enumerate(words):
            bare = w.strip(".,;:!?\"'()[]<>{}").lower()
            if len(bare) >= 4:
                groups[SAME].setdefault(bare, []).append(i)
                groups[NAME].setdefault(_AT.split(bare, maxsplit=1)[0], []).append(i)
            tail = (before[i] + own[i])[-7:]
            if plain[i] and len(tail) == 7:
                groups[NUMBER].setdefault(tail, []).append(i)
            self.shape.append(_shape(w, plain[i], len(own[i]), ends[i], joined[i], i + 1 < len(words) and joined[i + 1]))
        for kind, group in enumerate(groups):
            for key, members in group.items():
                if len(members) > 1 and (kind != NAME or len(key) >= 4 and any("@" in words[i] for i in members)):
                    hub = next((i for i in members if label[i] > 0), members[0])
                    self.edges += [(first + hub, first + i, 1 + kind) for i in members if i != hub]
        self.edges += [(first + i - 1, first + i, 0) for i in range(1, len(spans)) if joined[i]]
        self.start += starts
        self.end += [b for _, b in spans]
        self.doc += [doc] * len(spans)
        self.label += label


def _words(text: str) -> list[tuple[int, int]]:
    """Words that hold a digit or an @."""
    if not _HAS_ANY.search(text):
        return []
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = np.flatnonzero((c == 32) | ((c >= 9) & (c <= 13)))
    at = np.searchsorted(blank, np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64)))
    edge = np.r_[-1, blank, len(c)]
    at = np.unique(at)
    return list(zip((edge[at] + 1).tolist(), edge[at + 1].tolist()))


_SIZES = (0, 2, 3, 4, 6, 8, 11, 15, 19)
_SHAPES = 12 + 2 * (len(_SIZES) + 1)


def _shape(w: str, plain: bool, n: int, run: int, after: bool, before: bool) -> list[int]:
    """Numbers of the features that a word has."""
    size = lambda k: int(np.searchsorted(_SIZES, k))
    flags = (True, "@" in w, "." in w.partition("@")[2], not plain, w[0] == "+", "(" in w, w.count(".") == 3, "." in w, "-" in w, "=" in w or '"' in w, after, before)
    return [*(i for i, x in enumerate(flags) if x), 12 + size(n), 12 + len(_SIZES) + 1 + size(run)]


def _dense(shapes: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(shapes), _SHAPES))
    for i, s in enumerate(shapes):
        x[i, s] = 1
    return x


class Field:
    """Potentials: of shapes, of the chain (row: label before), and of each kind of skip edge, by the label shared."""

    def __init__(self, unary: np.ndarray, potentials: np.ndarray):
        self.unary, self.potentials = unary, potentials  # shapes x labels; 1 + kinds of skips, labels x labels

    def beliefs(self, g: Graph) -> np.ndarray:
        """Marginals of all words by loopy sum-product; those of base spans stay what they are."""
        u = _dense(g.shape) @ self.unary
        fixed = np.array(g.label)
        known = np.flatnonzero(fixed >= 0)
        u[known] = -1e3
        u[known, fixed[known]] = 0
        b = u
        if g.edges:
            i, j, kind = np.array(g.edges).T
            psi = self.potentials[kind]
            to_j, to_i = np.zeros((len(i), LABELS)), np.zeros((len(i), LABELS))
            for _ in range(ROUNDS):
                b = u.copy()
                np.add.at(b, j, to_j)
                np.add.at(b, i, to_i)
                new_j = _log_sum((b[i] - to_i)[:, :, None] + psi, 1)
                new_i = _log_sum((b[j] - to_j)[:, None, :] + psi, 2)
                to_j = (1 - DAMPING) * new_j + DAMPING * to_j
                to_i = (1 - DAMPING) * new_i + DAMPING * to_i
            b = u.copy()
            np.add.at(b, j, to_j)
            np.add.at(b, i, to_i)
        p = np.exp(b - b.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    out = np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))
    return out - out.max(axis=1, keepdims=True)


def all_spans(batch_texts: list[str], field: Field | None) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    g, out = Graph(), []
    for k, text in enumerate(batch_texts):
        base = base_spans(text)
        out.append((base, []))
        if field is not None:
            g.add(text, k, base)
    if not g.start:
        return out
    p = field.beliefs(g)
    label = np.where(p.max(axis=1) > SURE, p.argmax(axis=1), 0)
    label[np.array(g.label) >= 0] = 0
    chained = {j for _, j, kind in g.edges if kind == 0}
    i = 0
    while i < len(label):
        k = i + 1
        if label[i]:
            while k < len(label) and label[k] == label[i] and k in chained:
                k += 1
            text, a, b = batch_texts[g.doc[i]], g.start[i], g.end[k - 1]
            while a < b and text[a] in ".,;:!?\"')[]<>{}":
                a += 1
            while a < b and text[b - 1] in ".,;:!?\"'([]<>{}" or (a < b and text[b - 1] == ")" and "(" not in text[a:b]):
                b -= 1
            if a < b:
                out[g.doc[i]][1].append((int(label[i]) - 1, a, b))
        i = k
    for _, added in out:
        added.sort()
    return out


# ---- fitting
def _rewritten(kind: int, value: str, rng: np.random.Generator) -> str:
    """The same number or name as no pattern knows it."""
    d = digits(value)
    if kind == 0:
        name, _, host = value.partition("@")
        return (f"{name}@{host.split('.')[0]}", f"{name}(at){host}", name)[rng.integers(3)]
    if kind == 1:
        return value.replace(".", ("-", "_", " ", "/")[rng.integers(4)])
    if kind == 2:
        return (".", "/", "_")[rng.integers(3)].join(d[k : k + 4] for k in range(0, len(d), 4))
    d = d[-10:]
    return (d, f"({d[:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[:-7]}.{d[-7:-4]}.{d[-4:]}", f"{d[:-7]} {d[-7:-4]} {d[-4:]}")[rng.integers(5)]


def _other(value: str, rng: np.random.Generator) -> str:
    """A value of the same form, with other digits and letters."""
    pick = lambda c: str(rng.integers(10)) if c.isdigit() else chr(97 + rng.integers(26)) if c.isalpha() else c
    return "".join(map(pick, value))


def practice(text: str) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The text with its base spans written once more, and some made-up values; its base spans; the rewritten ones."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(text.encode()))
    base, more, out = base_spans(text), [], [text]
    at = len(text)
    for kind, a, b in base:
        for value, real in ((text[a:b], True), (_other(text[a:b], rng), False)):
            written = _rewritten(kind, value, rng)
            if base_spans(written):
                continue
            out.append(f"\nso {written} so")
            if real:
                more.append((kind, at + 4, at + 4 + len(written)))
            at += len(out[-1])
    return "".join(out), base, more


def fit(sample: list[str], steps: int = 400, rate: float = 0.1, prior: float = 0.05) -> Field | None:
    """Potentials of the largest pseudo-likelihood on the practice texts; None where no text has a base span."""
    g, y, bases = Graph(), [], 0
    for k, text in enumerate(sorted(sample)):
        text, base, more = practice(text)
        bases += len(base)
        first = len(g.start)
        g.add(text, k, base)
        y += [0] * (len(g.start) - first)
        starts = g.start[first:]
        for kind, a, b in more:
            for i in range(int(np.searchsorted(starts, a)), int(np.searchsorted(starts, b))):
                y[first + i] = 1 + kind
    if not bases:
        return None
    fixed = np.array(g.label)
    y = np.where(fixed >= 0, fixed, y)
    free = (fixed < 0).astype(float)[:, None]
    x, one = _dense(g.shape), np.eye(LABELS)[y]
    i, j, kind = np.array(g.edges, np.int64).reshape(-1, 3).T
    w, t, s = np.zeros((_SHAPES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((SKIPS, LABELS))
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, t, s)]
    n = max(1.0, free.sum())
    for step in range(1, steps + 1):
        psi = np.concatenate([t[None], np.stack([np.diag(v) for v in s])])
        b = x @ w
        np.add.at(b, i, psi[kind, :, y[j]])
        np.add.at(b, j, psi[kind, y[i], :])
        p = np.exp(b - b.max(axis=1, keepdims=True))
        r = (one - p / p.sum(axis=1, keepdims=True)) * free
        slope_t, slope_s = np.zeros_like(t), np.zeros_like(s)
        c = kind == 0
        slope_t += r[i[c]].T @ one[j[c]] + one[i[c]].T @ r[j[c]]
        for k in range(SKIPS):
            c = kind == 1 + k
            slope_s[k] = (r[i[c]] * one[j[c]] + one[i[c]] * r[j[c]]).sum(axis=0)
        for value, slope, (m, v) in zip((w, t, s), (x.T @ r, slope_t, slope_s), moments):
            slope = slope - prior * value
            m += 0.1 * (slope / n - m)
            v += 0.01 * ((slope / n) ** 2 - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(w, np.concatenate([t[None], np.stack([np.diag(v) for v in s])]))


def sample_texts(docs: DataFrame, most: int = SAMPLE, max_chars: int = MAX_CHARS) -> list[str]:
    """At most so many distinct texts that may hold personal data, those of least hash."""
    total = docs.count()
    share = min(1.0, 4 * most / max(total, 1))
    t = docs.where((F.length("text") <= max_chars) & F.col("text").rlike("@|[0-9]")).select("text", F.xxhash64("text").alias("h"))
    t = t.where((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < share)
    one = t.groupBy("h").agg(F.first("text").alias("text"))  # copies meet map-side
    return [r.text for r in one.orderBy("h").limit(most).collect()]


# ---- on documents
def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _digests(field: Field | None):
    def run(batches):
        for batch in batches:
            found = all_spans([x or "" for x in batch.column("text").to_pylist()], field)
            cols = {"doc_id": batch.column("doc_id")}
            for k, kind in enumerate(KINDS):
                cols[f"n_{kind}"] = pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64())
            cols["base_sha256"] = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            cols["spans"] = pa.array([_joined(sorted(base + added)) for base, added in found], pa.string())
            cols["n_added"] = pa.array([len(added) for _, added in found], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    return run


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each stretch covered by spans becomes the kind of its first one, in brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redacted(field: Field | None):
    def run(batches):
        for batch in batches:
            whole = batch.column("text").to_pylist()
            found = all_spans([x or "" for x in whole], field)
            clean = [x and redacted(x, base + added) for x, (base, added) in zip(whole, found)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(clean, pa.string())], names=["row", "text"])

    return run


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs with personal data in ``text`` replaced by its kind; null stays null and all other columns stay."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select((F.struct(*others) if others else F.lit(None).cast("struct<none: int>")).alias("row"), "text")
    clean = rows.mapInArrow(_redacted(field), rows.schema)
    return clean.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def private_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Of each document: counts and digest of base spans, all spans, and the number of those that the field added."""
    field = field or fit(sample_texts(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(_digests(field), f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")
