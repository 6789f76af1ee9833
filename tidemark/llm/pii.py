"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from fixed patterns for e-mail, IP, card and phone and always stay. Mentions that look alike
but miss the pattern (an address without a full domain, a digit string of 7 or more digits) are the other
nodes of each document's field. Consecutive mentions at most NEAR characters apart share a chain potential;
mentions with the same key (last 7 digits, or the part before @), however far apart, share a skip potential:
each with every base node of its key (these are observed, so they count as votes for their kinds) and with the
nearest earlier mention that isn't one. Loopy sum-product messages run over all documents of a piece at once,
each document until no message of its own moves by TOLERANCE; another mention becomes a span where a kind's
marginal reaches 0.5. So a number that is a proven card or phone in one place is found in its other spellings
too, and a digit string without such a companion is left alone.

Weights are learned from at most TRAIN_DOCS documents (smallest doc_id hash): unary ones by multinomial
logistic regression of the base kinds and of unmatched mentions on their shape; chain and skip potentials
from smoothed counts of agreeing neighbours. Null and empty texts have no spans. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, sampled, texts, texts_of

KINDS = ("email", "ip", "card", "phone")
NEAR, TOLERANCE, TRAIN_DOCS = 40, 1e-6, 3000

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_LOOSE_AT = re.compile(r"@[A-Za-z0-9-]+")
_LOOSE_DIGITS = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")

Span = tuple[int, int, int]  # kind, start, end


def _before(text: str, at: int, floor: int) -> int:
    """Where the run of local-part characters that ends at `at` begins, not before floor."""
    width = 64
    while True:
        low = max(floor, at - width)
        begin = low + _LOCAL.search(text[low:at]).start()
        if begin > low or low == floor:
            return begin
        width *= 4


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            begin = _before(text, m.start(), end)
            if begin < m.start():
                end = m.end()
                out.append((0, begin, end))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


def mentions(text: str, base: list[Span]) -> list[Span]:
    """Other places that look like personal data; kind -1."""
    found = []
    if "@" in text:
        for m in _LOOSE_AT.finditer(text):
            begin = _before(text, m.start(), 0)
            if begin < m.start():
                found.append((-1, begin, m.end()))
    found += [(-1, *m.span()) for m in _LOOSE_DIGITS.finditer(text)] if _DIGIT.search(text) else []
    out, taken = [], sorted((s, e) for _, s, e in base)
    for n in sorted(found, key=lambda x: x[1:]):
        if all(n[2] <= s or n[1] >= e for s, e in taken) if len(taken) < 8 else _free(taken, n):
            out.append(n)
    return out


def _free(taken: list[tuple[int, int]], n: Span) -> bool:
    ends = np.maximum.accumulate([e for _, e in taken])
    i = int(np.searchsorted([s for s, _ in taken], n[2], "left"))
    return i == 0 or ends[i - 1] <= n[1]


def _key(piece: str) -> str:
    if "@" in piece:
        return piece.split("@")[0].lower()
    return _NO_DIGIT.sub("", piece)[-7:]


def _shape(piece: str) -> list[float]:
    digits = len(_NO_DIGIT.sub("", piece))
    return [1, "@" in piece, piece[0] == "+", piece.count(".") == 3, "." in piece, " " in piece or "-" in piece, digits in range(7, 11), digits in range(11, 16), digits in range(16, 20), digits > 19]


def field(many: list[str]) -> tuple[list[list[Span]], list[list[Span]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base spans and nodes of each text (base first), the shapes of all nodes, chain and skip edges, and text and key of all nodes as numbers."""
    base = [base_spans(t) for t in many]
    nodes = [sorted(b + mentions(t, b), key=lambda x: x[1:]) for t, b in zip(many, base, strict=True)]
    shapes, chain, skip, of, n, keys = [], [], [], [], 0, 0
    for d, (t, own) in enumerate(zip(many, nodes, strict=True)):
        last: dict[str, int] = {}
        unproven: dict[str, int] = {}
        number: dict[str, int] = {}
        for i, (kind, start, end) in enumerate(own):
            piece = t[start:end]
            shapes.append(_shape(piece))
            if i and start - own[i - 1][2] <= NEAR:
                chain.append((n + i - 1, n + i))
            if (k := _key(piece)) in last:
                skip.append((last[k], n + i))
            if kind < 0:
                if unproven.get(k, last.get(k)) != last.get(k):
                    skip.append((unproven[k], n + i))
                unproven[k] = n + i
            last[k] = n + i
            of.append((d, keys + number.setdefault(k, len(number))))
        n, keys = n + len(own), keys + len(number)
    return base, nodes, np.array(shapes, float).reshape(-1, 10), np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 2), np.array(of, int).reshape(-1, 2)


class Model:
    """Unary weights (shape by label; label 0 is none, then KINDS) and the two pair potentials for equal labels."""

    def __init__(self, unary: np.ndarray, chain: float, skip: float):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, shapes: np.ndarray, observed: np.ndarray, chain: np.ndarray, skip: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Loopy belief propagation; observed: the label of base nodes, -1 for others; of: text and key of each node."""
        own, proven = shapes @ self.unary, observed >= 0
        votes = np.zeros((of[:, 1].max() + 1, own.shape[1]))
        np.add.at(votes, (of[proven, 1], observed[proven]), 1)
        own += self.skip * votes[of[:, 1]]  # what the skip edges to all base nodes of the key say
        own[proven] = -40.0
        own[np.flatnonzero(proven), observed[proven]] = 0.0
        skip = skip[~proven[skip].any(1)]
        pairs = np.concatenate([chain, skip])
        a, b = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        back = np.roll(np.arange(len(a)), len(pairs))
        gain = np.expm1(np.tile(np.repeat([self.chain, self.skip], [len(chain), len(skip)]), 2))[:, None]
        message, belief = np.zeros((len(a), own.shape[1])), own.copy()
        text = of[a, 0]
        # Far more rounds than a text has edges are only needed if its messages swing; then its steps get smaller.
        many = 100 + np.bincount(text, minlength=of[:, 0].max() + 1)[text]
        on, done = np.arange(len(a)), 0
        while len(on):
            out = belief[a[on]] - message[back[on]]
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            # The sum over the sender's labels, up to a constant.
            move = 0.5 ** (1 + done // many[on])[:, None] * (np.log1p(gain[on] * p) - message[on])
            message[on] += move
            to, at = np.unique(b[on], return_inverse=True)  # all edges of a text are on, or none
            belief[to] = own[to] + np.stack([np.bincount(at, message[on, k], len(to)) for k in range(own.shape[1])], 1)
            moving = np.zeros(of[:, 0].max() + 1, bool)
            moving[text[on][np.abs(move).max(1) >= TOLERANCE]] = True
            on, done = on[moving[text[on]]], done + 1
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def spans(self, many: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and all spans of each text, by kind and start."""
        base, nodes, shapes, chain, skip, of = field(many)
        if not len(shapes):
            return [([], []) for _ in many]
        flat = [x for own in nodes for x in own]
        p = self.marginals(shapes, np.array([k + 1 if k >= 0 else -1 for k, _, _ in flat]), chain, skip, of)
        best, out, at = np.where(p[:, 1:].max(1) >= 0.5, p[:, 1:].argmax(1), -1), [], 0
        for b, own in zip(base, nodes, strict=True):
            added = [(int(k), s, e) for (kind, s, e), k in zip(own, best[at : at + len(own)], strict=True) if kind < 0 and k >= 0]
            out.append((sorted(b), sorted(b + added)))
            at += len(own)
        return out


def train(many: list[str]) -> Model:
    _, nodes, shapes, chain, skip, _ = field(many)
    label = np.array([k + 1 for own in nodes for k, _, _ in own], int)
    w = np.zeros((10, len(KINDS) + 1))
    for _ in range(300 if len(label) else 0):
        z = shapes @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        w -= 0.5 * (shapes.T @ p / len(label) + 1e-3 * w)

    def pair(edges: np.ndarray, prior: float) -> float:
        """Log odds of equal labels among neighbours that are both base, smoothed towards the prior."""
        known = edges[(label[edges] > 0).all(1)] if len(edges) else edges
        same = int((label[known[:, 0]] == label[known[:, 1]]).sum()) if len(known) else 0
        return float(np.clip(np.log((same + 5 * np.exp(prior)) / (len(known) - same + 5)), 0, 8))

    return Model(w, min(pair(chain, 0.0), 1.0), pair(skip, 6.0))


def fit(docs: DataFrame) -> Model:
    """From the documents of smallest doc_id hash, TRAIN_DOCS at most; of a repeated doc_id the least text."""
    rows = texts_of(docs, sampled(docs, TRAIN_DOCS)).collect()
    return train([r.text or "" for r in sorted(rows, key=lambda r: (r.doc_id, r.text or ""))])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = model.spans(texts(b))
            counts = [pa.array([sum(k == i for k, _, _ in base) for base, _ in found], pa.int64()) for i in range(4)]
            sha = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array([listed(x) for _, x in found], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, found: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping ones the first, then the longest, names the whole."""
    out, at = [], 0
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs, spans replaced in text, and n_chars, where there is one, of the new text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            at = b.schema.get_field_index("text")
            old = b.column(at).to_pylist()
            found = model.spans([t or "" for t in old])
            yield b.set_column(at, "text", pa.array([t if t is None else redact(t, x) for t, (_, x) in zip(old, found, strict=True)], b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
