"""License detection by patience alignment.

A text and a license template are aligned on words that each has exactly once: the longest increasing
subsequence of these anchors is kept, and the gaps between anchors are aligned in the same way.  The share
of the template's words that are aligned is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import license_texts
from ._shared import require
from ._words import frugal, slices

_WORD = re.compile(r"[A-Za-z0-9]+(?:[.'-][A-Za-z0-9]+)*")

TEMPLATES: dict[str, str] = license_texts.TEXTS | license_texts.NOTICES
#: A template counts as present from this share of its words.
MIN_COVERAGE = 0.8
#: A template of fewer words counts only as a whole, its words in order with one other between at most: some of a few common words are met anywhere.
WHOLE_WORDS = 10


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words of a text with their character positions."""
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first number) whose second numbers increase."""
    tails: list[int] = []
    tail_at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        place = bisect_left(tails, b)
        back.append(tail_at[place - 1] if place else -1)
        if place == len(tails):
            tails.append(b)
            tail_at.append(i)
        else:
            tails[place], tail_at[place] = b, i
    out, i = [], tail_at[-1] if tail_at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), both increasing."""
    found: list[tuple[int, int]] = []
    stack = [(0, len(text), 0, len(template))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = Counter(template[c:d]), Counter(w for w in text[a:b])
        place = {w: j for j, w in enumerate(template[c:d], c) if ours[w] == 1 and theirs[w] == 1}
        anchors = _longest_increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place])
        if not anchors:
            continue
        edge_a, edge_c = a, c
        for i, j in anchors:
            found.append((i, j))
            stack.append((edge_a, i, edge_c, j))
            edge_a, edge_c = i + 1, j + 1
        stack.append((edge_a, b, edge_c, d))
    return sorted(found)


def _worth(aligned: list[tuple[int, int]]) -> int:
    """How well an alignment fits, among those of one template: aligned words against the words of the text that it skips."""
    return 3 * len(aligned) - (aligned[-1][0] - aligned[0][0])


def _around(words: list[str], template: list[str], i: int, p: int, low: int, high: int, need: float) -> list[tuple[int, int]]:
    """The best alignment within words[low:high] in which word ``i`` is the template's word ``p``; empty if none has ``need`` words.

    Narrow stretches come first: a copy of the template beside this one makes its words ambiguous.
    """
    size = len(template)
    best: list[tuple[int, int]] = []
    for slack in dict.fromkeys((0, size // 4 + 1, size, 2 * size)):
        a, b = max(low, i - min(p + slack, 2 * size)), min(high, i + 1 + min(size - 1 - p + slack, 2 * size))
        near = set(words[a:b])
        if sum(w in near for w in template) < need:
            continue
        left = patience(words[a:i], template[:p])
        right = patience(words[i + 1 : b], template[p + 1 :])
        aligned = [(a + x, y) for x, y in left] + [(i, p)] + [(i + 1 + x, p + 1 + y) for x, y in right]
        aligned = _dense(aligned, size + 1 if size < WHOLE_WORDS else 2 * size)  # aligned words far from the rest are chance
        if len(aligned) >= need and (not best or _worth(aligned) > _worth(best)):
            best = aligned
            if len(best) == size:
                break
    return best


def _copies(words: list[str], template: list[str], rare: set[str], min_coverage: float) -> list[tuple[int, int, int]]:
    """(first word, last word, aligned words) of all separate occurrences of a template.

    Any occurrence has one of the rare words aligned, so it is looked for around each place of these.  Of finds that
    overlap the one that fits best stays, and the words on both sides of it are searched again.
    """
    places: dict[str, list[int]] = {}
    for p, w in enumerate(template):
        if w in rare:
            places.setdefault(w, []).append(p)
    hits = [i for i, w in enumerate(words) if w in places]
    need = (len(template) if len(template) < WHOLE_WORDS else min_coverage * len(template)) - 1e-9
    out = []
    parts = [(0, len(words))]
    while parts:
        low, high = parts.pop()
        found = set()
        for i in hits[bisect_left(hits, low) : bisect_left(hits, high)]:
            for p in places[words[i]]:
                aligned = _around(words, template, i, p, low, high, need)
                if aligned:
                    found.add((-_worth(aligned), aligned[0][0], aligned[-1][0], len(aligned)))
        taken: list[tuple[int, int]] = []
        again = False
        for _, first, last, size in sorted(found):
            if _free(taken, first, last + 1):
                insort(taken, (first, last + 1))
                out.append((first, last, size))
            else:
                again = True
        if again:  # what overlapped may hold a copy of its own
            edges = [low, *[x for t in taken for x in t], high]
            parts += [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= need]
    return out


def _free(taken: list[tuple[int, int]], first: int, past: int) -> bool:
    """Whether a stretch touches none of ``taken``, which are in order and apart."""
    at = bisect_left(taken, (first, past))
    return (not at or taken[at - 1][1] <= first) and (at == len(taken) or taken[at][0] >= past)


def scan_text(text: str, templates: dict[str, list[str]], rare: dict[str, set[str]], every: set[str], min_coverage: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first character, character past the last) of each occurrence of a template, in order."""
    low = text.lower()
    if not any(w in low for w in every):
        return []
    words = words_of(text)
    plain = [w for w, _, _ in words]
    present = every.intersection(plain)
    found = []
    for name, template in templates.items() if present else ():
        if rare[name] & present:
            for first, last, n in _copies(plain, template, rare[name], min_coverage):
                # aligned words against the template's words that are missing and the text's that are too many
                worth = n - (len(template) - n) - (last + 1 - first - n)
                found.append((name, n / len(template), words[first][1], words[last][2], worth))
    # of overlapping finds the one that fits best stays
    found.sort(key=lambda x: (-x[4], -x[1], x[2], x[0]))
    kept: list[tuple[str, float, int, int]] = []
    taken: list[tuple[int, int]] = []
    for x in found:
        if _free(taken, x[2], x[3]):
            insort(taken, (x[2], x[3]))
            kept.append(x[:4])
    return sorted(kept, key=lambda x: x[2])


def _dense(aligned: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The part of an alignment with most words within ``reach`` words of text."""
    best, a = (0, 0), 0
    for b in range(len(aligned)):
        while aligned[b][0] - aligned[a][0] >= reach:
            a += 1
        if b + 1 - a > best[1] - best[0]:
            best = (a, b + 1)
    return aligned[best[0] : best[1]]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``docs`` without text, with licenses: array<struct<license, coverage, first, past>> in text order (code points).

    Row by row and with no shuffle.  A find has ``min_coverage`` of the template's words, or all of them if it has fewer than WHOLE_WORDS,
    within twice the template's length: a copy with more words put in than that is found only in the parts that
    fit.  Null and empty texts have no licenses; an existing licenses column is replaced; repeated rows get equal
    results; templates without words never match; a text of any length is read whole, in time in proportion to its
    places of rare words.
    """
    require(docs, ["text"])
    docs = docs.drop("licenses")
    split = {name: [w for w, _, _ in words_of(t)] for name, t in (templates or TEMPLATES).items()}
    split = {name: t for name, t in split.items() if t}
    # a template is looked for around the words that fewest templates have
    spread = Counter(w for t in split.values() for w in set(t))
    # coverage needs some of any group of words larger than what may be missing
    rare = {name: set(sorted(set(t), key=lambda w: (-len(w), spread[w], w))[: int(len(t) * (1 - min_coverage) + 1e-9) + 1]) for name, t in split.items()}
    every = set().union(*rare.values()) if rare else set()
    rest = [f for f in docs.schema.fields if f.name != "text"]
    item = T.StructType([
        T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("first", T.LongType()), T.StructField("past", T.LongType()),
    ])
    schema = T.StructType([*rest, T.StructField("licenses", T.ArrayType(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("past", pa.int64())]))
        for batch in slices(batches):
            found = [
                [dict(zip(("license", "coverage", "first", "past"), x, strict=True)) for x in scan_text(t, split, rare, every, min_coverage)] if t else []
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], pa.array(found, kind)], schema.fieldNames())

    return docs.select(*[F.col(f"`{f.name}`") for f in rest], F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), schema)
