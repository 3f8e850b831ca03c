"""Cutting oversized Markdown items at natural boundaries, chosen by lexical cohesion.

The JVM finds the oversized items; only those reach Python. There a text becomes units (headings,
paragraph sentences, fences), the similarity of the word blocks before and after each unit boundary
is a curve whose valleys mark topic changes, and in each size window the deepest valley is the cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, MAX_CHARS, OVERLAP = 512, 3500, 200
PIECES = "piece_index int, start int, length int, overlap int, tokens int, piece string"

WORD = re.compile(r"\S+")
TERM = re.compile(r"[^\W\d_]{3,}|[぀-ヿ㐀-鿿]{2}")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
# how natural a boundary is, by what starts there
HEADING, FENCE, PARAGRAPH, LINE, INNER = 1.0, 0.8, 0.6, 0.3, 0.1


def n_words(text: str | Column) -> Column:
    """Words parted by any Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def oversized(text: str | Column, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS) -> Column:
    """More than max_tokens (words / 0.75, rounded down) or max_chars code points. Null is not."""
    least = int((max_tokens + 1) * 0.75)  # fewer words than this can't be too many tokens
    text = F.col(text) if isinstance(text, str) else text
    many = F.floor(n_words(text) / 0.75) > max_tokens
    return F.coalesce((F.length(text) > max_chars) | ((F.length(text) >= 2 * least - 1) & many), F.lit(False))


def tokens(text: str) -> int:
    return int(len(text.split()) / 0.75)


def fits(text: str, start: int, end: int, max_tokens: int, max_chars: int) -> bool:
    return end - start <= max_chars and tokens(text[start:end]) <= max_tokens


def units(text: str, max_tokens: int, max_chars: int) -> list[tuple[int, int, float]]:
    """Consecutive (start, end, naturalness of the boundary at start); none exceeds the limits."""
    found: list[tuple[int, int, float]] = []
    at, fence, block, kind, blank = 0, "", None, LINE, True

    def close(end: int) -> None:
        nonlocal block
        if block is None:
            return
        start, strength, fenced = block
        block = None
        if fenced and fits(text, start, end, max_tokens, max_chars):
            found.append((start, end, strength))
            return
        cuts = [start]
        if fenced:
            cuts += [m.end() for m in re.compile(r"\n").finditer(text, start, end) if m.end() < end]
        else:
            cuts += [m.end() for m in SENTENCE.finditer(text, start, end) if start < m.end() < end]
        for i, a in enumerate(cuts):
            b = cuts[i + 1] if i + 1 < len(cuts) else end
            s = strength if i == 0 else (INNER if fenced else LINE * 0.8)
            while not fits(text, a, b, max_tokens, max_chars):  # one sentence or line beyond the limit
                c = min(b, a + max_chars)
                words = list(WORD.finditer(text, a, c))
                most = max(1, int(max_tokens * 0.75))  # a token is a word
                if len(words) > most:
                    c = words[most].start()
                elif c < b and words and words[-1].end() == c and words[-1].start() > a:
                    c = words[-1].start()
                if c <= a:
                    c = min(b, a + max_chars)
                found.append((a, c, s))
                a, s = c, 0.0
            found.append((a, b, s))

    for line in text.splitlines(keepends=True):
        bare = line.strip()
        end = at + len(line)
        mark = re.match(r"(`{3,}|~{3,})", bare)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and bare.strip(fence[0]) == "":
                fence = ""
                close(end)
                blank = True
        elif mark:
            close(at)
            fence, block = mark[1], (at, FENCE, True)
        elif not bare:
            if block is None:
                block = (at, LINE, False)
            blank = True
        else:
            heading = re.match(r"#{1,6}\s", bare) or re.match(r"\*\*(User|Assistant):\*\*", bare)
            if heading or blank or block is None or re.match(r"([-*+]|\d+\.|\|)\s", bare):
                close(at)
                block = (at, HEADING if heading else PARAGRAPH if blank else LINE, False)
            blank = False
        at = end
    close(at)
    return found


def depths(text: str, parts: list[tuple[int, int, float]], width: int = 4) -> np.ndarray:
    """Depth of the similarity valley at each unit's start (0 at the first)."""
    bags = [Counter(t.lower() for t in TERM.findall(text, a, b)) for a, b, _ in parts]
    n = len(parts)
    curve = np.ones(n)
    for i in range(1, n):
        left, right = Counter(), Counter()
        for bag in bags[max(0, i - width) : i]:
            left.update(bag)
        for bag in bags[i : i + width]:
            right.update(bag)
        norm = sum(v * v for v in left.values()) * sum(v * v for v in right.values())
        curve[i] = sum(v * right[t] for t, v in left.items() if t in right) / norm**0.5 if norm else 0.0
    out = np.zeros(n)
    for i in range(1, n):
        a = i
        while a > 1 and curve[a - 1] >= curve[a]:
            a -= 1
        b = i
        while b < n - 1 and curve[b + 1] >= curve[b]:
            b += 1
        out[i] = (curve[a] - curve[i]) + (curve[b] - curve[i])
    return out


def overlap_start(text: str, start: int, floor: int, overlap: int) -> int:
    """Where the overlap before start begins: a sentence or word start at most overlap characters back."""
    low = max(floor, start - overlap)
    if low >= start:
        return start
    marks = [m.end() for m in SENTENCE.finditer(text, low, start) if m.end() < start]
    if marks:
        return marks[0]
    marks = [m.start() for m in WORD.finditer(text, low, start)]
    if low > floor and marks and marks[0] == low and not text[low - 1].isspace():
        marks = marks[1:]
    return marks[0] if marks else start


def pieces(text: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of each piece; every piece, with its overlap, is within both limits.

    Without their overlaps the pieces are the text, end to end. A text within the limits is one piece.
    """
    if fits(text, 0, len(text), max_tokens, max_chars):
        return [(0, len(text), 0)]
    overlap = min(overlap, max_chars // 2)
    # words that an overlap may hold, so that the rest of a piece leaves room for it
    room = min(max_tokens // 4, overlap)
    body_tokens, body_chars = max(1, max_tokens - room - 2), max_chars - overlap
    parts = units(text, body_tokens, body_chars)
    words = np.array([len(text[a:b].split()) for a, b, _ in parts])
    strength = np.array([s for _, _, s in parts])
    score = depths(text, parts) + strength
    made: list[tuple[int, int, int]] = []
    first, before = 0, 0
    while first < len(parts):
        start = parts[first][0]
        last, total = first, 0
        while last < len(parts):
            total += words[last]
            if last > first and (int(total / 0.75) > body_tokens or parts[last][1] - start > body_chars):
                break
            last += 1
        if last < len(parts):  # the window holds the cuts from half the size on
            half = start + (parts[last - 1][1] - start) // 2
            low = next((i for i in range(first + 1, last + 1) if parts[i][0] >= half), last)
            window = score[low : last + 1]
            last = low + int(len(window) - 1 - np.argmax(window[::-1]))
        end = parts[last - 1][1]
        begin = start
        if made:
            begin = overlap_start(text, start, before, overlap)
            while begin < start and not fits(text, begin, end, max_tokens, max_chars):
                step = next((m.start() for m in WORD.finditer(text, begin + 1, start) if text[m.start() - 1].isspace()), start)
                begin = step
        made.append((begin, end, start - begin))
        first, before = last, start
    return made


def split_oversized(
    items: DataFrame, keys: list[str], text: str = "content", max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces of every oversized item: the keys, piece_index, start, length, overlap, tokens, piece.

    Items within the limits, null and empty texts have no rows. Rows of equal keys and text are one
    item. Other columns, whatever their names, are ignored.
    """
    names = [f"key_{i}" for i in range(len(keys))]
    large = (
        items.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("body"))
        .where(oversized("body", max_tokens, max_chars))
        .dropDuplicates([*names, "body"])
    )
    kinds = ", ".join(f"{n} {large.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                body = row[-1]
                for i, (a, b, back) in enumerate(pieces(body, max_tokens, max_chars, overlap)):
                    rows.append((*row[:-1], i, a, b - a, back, tokens(body[a:b]), body[a:b]))
            yield pd.DataFrame(rows, columns=[*names, "piece_index", "start", "length", "overlap", "tokens", "piece"])

    cut = large.mapInPandas(run, f"{kinds}, {PIECES}")
    return cut.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "piece_index", "start", "length", "overlap", "tokens", "piece")
