"""Evaluation texts leaking into training text.

Of each window of ``run`` consecutive item words the word n-gram rarest among those in the corpus is the
seed; a document that holds the window holds its seed, however frequent that is, so no window is lost and
frequent n-grams still only seed where a window has nothing rarer. Beside these, a document that holds an
eighth of an item's n-grams is seeded, so that an edited copy does not depend on which n-grams other
documents hold: with one word in six changed a sixth of the 5-grams is left. Seeded documents are aligned
word by word with their items (Smith-Waterman); the alignment decides which of them are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollary.session import cut

RUN, GRAM = 13, 5
# a document with this share of an item's different n-grams is aligned, whether or not it holds a seed
SHARE = 0.125
# alignment scores in fifths of a word: a word matched, changed, left out or put in
WORD, MATCH, MISMATCH, GAP = 5, 5, -3, -3
# a document is an edited copy of an item from this alignment score, a share of the item's words
EDITED = 0.5


def words(text: str | Column) -> Column:
    """Runs of letters and digits, in lower case. Null has no words."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def grams(of: Column, n: int = GRAM) -> Column:
    """Hashes of the n-grams at each position. Equal hashes of different n-grams only cost an alignment."""
    last = F.size(of) - n
    at = F.sequence(F.lit(0), last)
    return F.when(last >= 0, F.transform(at, lambda i: F.xxhash64(*[F.get(of, i + k) for k in range(n)])))


def seeds(item_grams: DataFrame, frequency: DataFrame, run: int = RUN, n: int = GRAM) -> DataFrame:
    """item_id, gram: the rarest n-gram of every window of run words. Items shorter than run are one window."""
    known = item_grams.join(frequency, "gram", "left").withColumn("found", F.coalesce("n_docs", F.lit(0)))
    per_window = run - n + 1
    # a window starts at p and holds the grams p .. p + per_window - 1; a gram lies in as many windows
    window = F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - (per_window - 1)), F.greatest(F.lit(0), F.least(F.col("p"), F.col("n_grams") - per_window))))
    placed = known.select("item_id", "gram", "found", "p", window.alias("w"))
    # the whole window stands in no document without its rarest gram, so what holds it holds the seed;
    # grams in no document don't count, else an edited copy would get no seed where its edits are
    best = placed.where("found > 0").groupBy("item_id", "w").agg(F.min(F.struct("found", "p", "gram")).alias("b"))
    return best.select("item_id", "b.gram").distinct()


def align(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score (in fifths of a word) and longest common run of each pair of word number
    sequences. Pairs of like lengths go through the recurrence together, about cells places at a time."""
    best, longest = np.zeros(len(pairs), dtype=np.int32), np.zeros(len(pairs), dtype=np.int32)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]) // 16, len(pairs[i][1])))
    at = 0
    while at < len(order):
        size = max(1, cells // max(1, len(pairs[order[min(at + 255, len(order) - 1)]][1])))
        some = order[at : at + min(size, 256)]
        at += len(some)
        a = np.full((len(some), max(len(pairs[i][0]) for i in some)), -2, dtype=np.int32)
        b = np.full((len(some), max(len(pairs[i][1]) for i in some)), -1, dtype=np.int32)
        for row, i in enumerate(some):
            a[row, : len(pairs[i][0])], b[row, : len(pairs[i][1])] = pairs[i]
        slope = -GAP * np.arange(b.shape[1] + 1, dtype=np.int32)
        score = np.zeros((len(some), b.shape[1] + 1), dtype=np.int32)
        run = np.zeros_like(score)
        top, most = np.zeros(len(some), dtype=np.int32), np.zeros(len(some), dtype=np.int32)
        for k in range(a.shape[1]):
            same = b == a[:, k : k + 1]
            fresh = np.zeros_like(score)
            np.maximum(score[:, 1:] + GAP, score[:, :-1] + np.where(same, MATCH, MISMATCH), out=fresh[:, 1:])
            np.maximum(fresh, 0, out=fresh)
            # gaps along b: the best of all earlier cells less their distance
            score = np.maximum.accumulate(fresh + slope, axis=1) - slope
            run[:, 1:] = (run[:, :-1] + 1) * same
            np.maximum(top, score.max(axis=1), out=top)
            np.maximum(most, run.max(axis=1), out=most)
        best[some], longest[some] = top, most
    return best, longest


def stretches(b: np.ndarray) -> list[tuple[int, int, int]]:
    """(bound, start, end), best first, of the parts of b that alignments can lie in; b is -1 at words the
    item lacks. No alignment gains more than MATCH at one of its words or loses less than GAP at another, so
    the reflected sum bounds the score at each place, and no alignment crosses a place where it is 0."""
    walk = np.cumsum(np.where(b >= 0, MATCH, max(MISMATCH, GAP)))
    bound = walk - np.minimum(np.minimum.accumulate(walk), 0)
    edge = np.diff(np.concatenate(([0], (bound > 0).astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return []
    most = np.maximum.reduceat(bound, starts)
    found = [(int(m), int(i), int(i + np.flatnonzero(b[i:j] >= 0)[-1] + 1)) for m, i, j in zip(most, starts, ends)]
    return sorted(found, key=lambda s: (-s[0], s[1]))


def align_within(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """As align, for long second sequences that share few words with the first: stretches are aligned as long
    as they can still win. A run of n words scores n of them, so what can't hold a longer run can't score more."""
    best, longest = np.zeros(len(pairs), dtype=np.int32), np.zeros(len(pairs), dtype=np.int32)
    left = [stretches(b) for _, b in pairs]
    turn = 0
    while True:
        live = [i for i, parts in enumerate(left) if turn < len(parts) and parts[turn][0] > WORD * longest[i]]
        if not live:
            return best, longest
        score, run = align([(pairs[i][0], pairs[i][1][left[i][turn][1] : left[i][turn][2]]) for i in live])
        best[live], longest[live] = np.maximum(best[live], score), np.maximum(longest[live], run)
        turn += 1


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, n: int = GRAM, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, aligned (alignment score in words), score (its share of the item's words, 0 to 1),
    longest_run of each seeded pair.

    longest_run is exact: at least run if and only if the document holds run consecutive item words. An
    edited copy has a row if it keeps SHARE of the item's different n-grams, whatever else the corpus holds.
    A text of fewer than n words has no seed. Null and empty texts match nothing; equal texts under other
    ids are reported each; an id given twice with one text counts once. The items of one document meet in
    one row: as many as there are held-out items at most.
    """
    if not 1 <= n <= run:
        raise ValueError("n must be from 1 to run")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("doc_text"))
    held = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).dropDuplicates(["item_id"])
    item_words = held.select("item_id", words("item_text").alias("item_words"))
    item_grams = cut(
        item_words.select("item_id", grams(F.col("item_words"), n).alias("g"))
        .where("g is not null")
        .select("item_id", F.size("g").alias("n_grams"), F.posexplode("g").alias("p", "gram"))
    )
    wanted = item_grams.select("gram").distinct()
    # documents stream past the wanted n-grams; only the n-grams they share with items go on
    # (a column of its own: inside the lambda the words would be extracted for every position)
    listed = docs.select("doc_id", words("doc_text").alias("doc_words"))
    shared = listed.select("doc_id", F.explode(F.array_distinct(grams(F.col("doc_words"), n))).alias("gram")).join(wanted, "gram", "left_semi")
    shared = cut(shared)
    frequency = shared.groupBy("gram").agg(F.count("*").alias("n_docs"))
    held_grams = item_grams.select("item_id", "gram").distinct()
    sizes = held_grams.groupBy("item_id").agg(F.count("*").alias("different"))
    marked = held_grams.join(seeds(item_grams, frequency, run, n).withColumn("seed", F.lit(1)), ["item_id", "gram"], "left")
    together = shared.join(marked, "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("both"), F.max("seed").alias("seed"))
    pairs = together.join(sizes, "item_id").where((F.col("seed") == 1) | (F.col("both") >= F.col("different") * SHARE)).select("doc_id", "item_id")

    # a document is sent to its items once, however many they are
    asked = pairs.join(item_words, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item_words")).alias("asked"))
    paired = asked.join(docs, "doc_id").select("doc_id", "asked", words("doc_text").alias("doc_words"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            named, pairs = [], []
            for doc, asked, doc_words in zip(batch["doc_id"], batch["asked"], batch["doc_words"]):
                for one in asked:
                    numbers = {w: i for i, w in enumerate(dict.fromkeys(one["item_words"]))}
                    named.append((doc, one["item_id"]))
                    pairs.append((np.array([numbers[w] for w in one["item_words"]]), np.array([numbers.get(w, -1) for w in doc_words])))
            best, longest = align_within(pairs)
            of = np.array([len(a) for a, _ in pairs])
            aligned = best / WORD
            yield pd.DataFrame({"doc_id": [d for d, _ in named], "item_id": [i for _, i in named], "aligned": aligned, "score": np.minimum(1.0, aligned / of).round(6), "longest_run": longest})

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {held.schema['item_id'].dataType.simpleString()}"
    return paired.mapInPandas(score, f"{kinds}, aligned double, score double, longest_run int").distinct()


def copies(found: DataFrame, run: int = RUN, edited: float = EDITED) -> DataFrame:
    """The rows of leaks that are copies by their alignment: adds verbatim, whether run item words stand in a
    row, and edited, whether the score reaches edited; rows that are neither are left out.

    A run of n words aligns with a score of n at least, so the alignment decides first and the count of the
    run after it.
    """
    judged = found.withColumns({"verbatim": (F.col("aligned") >= run) & (F.col("longest_run") >= run), "edited": F.col("score") >= edited})
    return judged.where("verbatim or edited")
