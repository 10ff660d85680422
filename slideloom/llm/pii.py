"""Personal data by weak supervision.

Base spans follow fixed patterns.  Further candidates (obfuscated addresses, numbers that miss a checksum,
secrets behind a key word) are judged by four labelers: the strict pattern, a gazetteer, the words around and
the shape.  Their votes over the whole corpus are counted, expectation-maximisation estimates how reliable
each labeler is for each kind, and a logistic span classifier is trained on the resulting weights.  Only
candidates that it accepts become spans; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import require
from ._words import frugal, slices

#: Base kinds, in the order of digests, then the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "hidden_email", "number", "secret")
LABELERS = ("pattern", "gazetteer", "context", "shape")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r" ?(?:\(at\)|\[at\]| at ) ?")
_BEHIND_AT = re.compile(r"[A-Za-z0-9-]+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}\b")
_SECRET = re.compile(r"(?i)\b(token|secret|api[_-]?key|password|passwd|pwd|access[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_=.-]{6,})")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

#: Gazetteers: endings of mail domains, first digits of payment cards, country calling codes.
TOP_DOMAINS = frozenset("com org net edu gov io info biz eu de fr es uk us it nl ch at pl ru jp cn br in".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "6011", "65", "35")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
SECRET_WORDS = frozenset("token secret password passwd pwd apikey".split())
CONTEXT = {
    "email": frozenset("mail email contact write address".split()),
    "hidden_email": frozenset("mail email contact write reach address".split()),
    "ip": frozenset("ip host server address login from".split()),
    "card": frozenset("card visa credit payment pay account".split()),
    "number": frozenset("card visa credit payment pay account iban".split()),
    "phone": frozenset("phone tel call fax mobile telephone".split()),
    "secret": frozenset("token secret key password auth login".split()),
}
AGAINST = frozenset("version isbn order page chapter figure table total sum id serial part no".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            past = m.end()
            yield m.span()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns: by kind, then by place."""
    found = [("email", *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


def _hidden_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a written-out at and dot, from each at outwards."""
    past = 0
    for at in _AT.finditer(text):
        start = at.start()
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _BEHIND_AT.match(text, at.end()) if start < at.start() else None
        if m:
            past = m.end()
            yield start, past


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _beside(start: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a span outside ``covered`` (:func:`_merged`)."""
    out = []
    for i in range(max(0, bisect_right(covered, (start, start)) - 1), len(covered)):
        s, e = covered[i]
        if s >= end:
            break
        if e > start:
            if start < s:
                out.append((start, s))
            start = e
    if start < end:
        out.append((start, end))
    return out


def extra_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that do not touch a base span; a secret may hold base spans but also something beside them."""
    secrets, others = [], []
    covered = _merged(base)
    if "=" in text or ":" in text:
        secrets = [("secret", *m.span(2)) for m in _SECRET.finditer(text) if _beside(*m.span(2), covered)]
    if " at " in text or "(at)" in text or "[at]" in text:
        others += [("hidden_email", *span) for span in _hidden_emails(text)]
    if _DIGIT.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= sum(c.isdigit() for c in m.group()) <= 19:
                others.append(("number", *m.span()))
    if not secrets and not others:
        return []
    covered, past, out = _merged(base + secrets), 0, secrets
    for kind, s, e in sorted(others, key=lambda x: x[1]):
        if s >= past and _beside(s, e, covered) == [(s, e)]:
            out.append((kind, s, e))
            past = e
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Votes of the labelers on one span: 1 for, 0 against, -1 abstains."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    before, after = text[max(0, start - 60) : start], text[end : end + 40]
    if kind == "secret":
        pattern = 1 if len(span) >= 20 and re.fullmatch(r"[0-9a-fA-F]{20,}|[A-Za-z0-9+/_=.-]{24,}", span) else -1
        key = _WORD.findall(before.lower())
        gazetteer = 1 if key and key[-1] in SECRET_WORDS else -1
        shape = 1 if digits and len(set(span)) >= 8 else 0
    elif kind in ("email", "hidden_email"):
        pattern = 1 if kind == "email" else -1
        gazetteer = 1 if re.split(r"[^A-Za-z]+", span.lower())[-1] in TOP_DOMAINS else 0
        shape = 0 if len(span) < 7 else 1
    elif kind == "ip":
        pattern = 1
        gazetteer = 0 if span.startswith(("0.", "127.", "255.")) else 1
        shape = 1 if len(span) >= 8 else -1
    elif kind in ("card", "number"):
        pattern = 1 if luhn(digits) else 0
        gazetteer = 1 if digits.startswith(CARD_PREFIXES) else 0
        shape = 1 if len(digits) in (15, 16) and len(set(digits)) > 4 else 0
    else:
        pattern = 1
        gazetteer = 1 if digits.startswith(CALLING_CODES) else 0
        shape = 1 if len(digits) >= 10 else -1
    near = set(_WORD.findall(before.lower())[-5:]) | set(_WORD.findall(after.lower())[:3])
    context = 1 if near & CONTEXT[kind] else 0 if near & AGAINST else -1
    return pattern, gazetteer, context, shape


def _features(text: str, start: int, end: int) -> int:
    """Bits of the span and its neighbours beside the votes."""
    span = text[start:end]
    return (
        (len(span) >= 16)
        | (sum(c.isdigit() for c in span) * 2 > len(span)) << 1
        | (text[start - 1 : start].isalnum()) << 2
        | (text[end : end + 1].isalnum()) << 3
    )


def vote_counts(docs: DataFrame) -> DataFrame:
    """(kind, votes, features, n): how often each pattern of votes occurs; at most 7 * 81 * 16 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    for kind, s, e in base + extra_candidates(text, base):
                        seen[kind, votes(text, kind, s, e), _features(text, s, e)] += 1
        rows = [(k, list(v), f, n) for (k, v, f), n in seen.items()]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
            pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()),
        ], ["kind", "votes", "features", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "kind string, votes array<int>, features int, n bigint")
    return counted.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


def reliabilities(kinds: np.ndarray, votes_: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: (chance that each pattern is personal data, accuracy of each kind's labelers)."""
    chance = np.zeros(len(n))
    accuracy = np.full((len(KINDS), len(LABELERS)), 0.8)
    for k in range(len(KINDS)):
        at = kinds == k
        if not at.any():
            continue
        v, w = votes_[at], n[at].astype(float)
        right, prior = np.full((2, len(LABELERS)), 0.8), 0.5  # for a true span, for a false one
        for _ in range(rounds):
            yes = np.where(v == 1, right[0], np.where(v == 0, 1 - right[0], 1.0)).prod(axis=1) * prior
            no = np.where(v == 0, right[1], np.where(v == 1, 1 - right[1], 1.0)).prod(axis=1) * (1 - prior)
            p = yes / (yes + no)
            # pseudo-counts keep labelers better than chance and away from certainty
            for truth, weight, vote in ((0, p * w, 1), (1, (1 - p) * w, 0)):
                said = (v >= 0) * weight[:, None]
                right[truth] = np.clip((((v == vote) * weight[:, None]).sum(axis=0) + 8) / (said.sum(axis=0) + 10), 0.55, 0.98)
            prior = float(np.clip(((p * w).sum() + 1) / (w.sum() + 2), 0.05, 0.95))
        chance[at], accuracy[k] = p, right.mean(axis=0)
    return chance, accuracy


def _design(kind: np.ndarray, votes_: np.ndarray, features: np.ndarray) -> np.ndarray:
    one_hot = np.eye(len(KINDS))[kind]
    bits = (features[:, None] >> np.arange(4)) & 1
    return np.concatenate([np.ones((len(kind), 1)), one_hot, votes_ == 1, votes_ == 0, bits], axis=1).astype(float)


def train_classifier(counts: DataFrame, rounds: int = 300) -> np.ndarray:
    """Weights of the logistic span classifier, from the counted vote patterns (a table of bounded size)."""
    rows = counts.collect()  # at most 7 kinds * 3 ** 4 votes * 16 features
    width = 1 + len(KINDS) + 2 * len(LABELERS) + 4
    if not rows:
        return np.zeros(width)
    rows.sort(key=lambda r: (r["kind"], r["votes"], r["features"]))
    kind = np.array([KINDS.index(r["kind"]) for r in rows])
    v = np.array([r["votes"] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    x = _design(kind, v, np.array([r["features"] for r in rows]))
    target, _ = reliabilities(kind, v, n)
    w, weight = np.zeros(width), n / n.sum()
    for _ in range(rounds):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame) -> np.ndarray:
    return train_classifier(vote_counts(docs))


def find_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, accepted further spans) of one text; of an accepted secret the stretches outside base spans."""
    base = base_spans(text)
    extra = extra_candidates(text, base)
    if extra:
        x = _design(
            np.array([KINDS.index(k) for k, _, _ in extra]), np.array([votes(text, *c) for c in extra]), np.array([_features(text, s, e) for _, s, e in extra])
        )
        extra = [c for c, score in zip(extra, x @ weights, strict=True) if score > 0]
        covered = _merged(base)
        extra = [(k, *part) for k, s, e in extra for part in _beside(s, e, covered)]
    return base, extra


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def detect_pii(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``docs`` without text, with n_email, n_ip, n_card, n_phone, base_sha256 and spans, row by row.

    spans are kind:start:end in code points, the end exclusive, by kind and place.  Null and empty texts have no
    spans; repeated rows are read each; existing columns of the added names are replaced; an empty table gives an
    empty table; a text of any length is read whole, in time in proportion to its length.
    """
    require(docs, ["text"])
    if weights is None:
        weights = train(docs)
    counts = [f"n_{k}" for k in BASE_KINDS]
    docs = docs.drop(*counts, "base_sha256", "spans")
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, *[T.StructField(c, T.LongType()) for c in counts], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [find_spans(t, weights) if t else ([], []) for t in batch.column("text").to_pylist()]
            tally = [Counter(k for k, _, _ in base) for base, _ in found]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(f.name) for f in rest], *[pa.array([t[k] for t in tally], pa.int64()) for k in BASE_KINDS],
                pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([_joined(b + e) for b, e in found], pa.string()),
            ], schema.fieldNames())

    return docs.select(*[F.col(f"`{f.name}`") for f in rest], F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the earlier, longer one."""
    out, past = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= past:
            out += [text[past:s], f"[{kind.upper()}]"]
        past = max(past, e)
    return "".join([*out, text[past:]])


def redact_pii(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``docs`` with personal data in text replaced, and n_chars, if it is a column, set to the new length.

    Null and empty texts stay as they are; repeated rows are redacted each; other columns, of any name, are not
    touched; an empty table gives an empty table.
    """
    require(docs, ["text"])
    if weights is None:
        weights = train(docs)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t if not t else redact(t, sum(find_spans(t, weights), [])) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    out = docs.mapInArrow(frugal(run), schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out
