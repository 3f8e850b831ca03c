"""Packing documents into fixed containers by vector best fit.

A container has three capacities: tokens, documents and attention cost (the sum of squared lengths).
Items are spread at random over shards of bounded size; in each shard they are placed longest first
into the open container that scores best. Texts never travel: only ids and sizes are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, SHARD = 4096, 10_000


def byte_cuts(text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, bytes) in code points of pieces of at most capacity UTF-8 bytes, as full as can be."""
    sizes = np.ones(len(text), dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for least in (0x80, 0x800, 0x10000):
        sizes += points >= least
    ends = np.cumsum(sizes)
    made, start, base = [], 0, 0
    while start < len(text):
        end = max(int(np.searchsorted(ends, base + capacity, "right")), start + 1)
        made.append((start, end, int(ends[end - 1] - base)))
        start, base = end, int(ends[end - 1])
    return made


def tokenizer_cuts(encode: Callable[[str], list[int]]) -> Callable[[str, int], list[tuple[int, int, int]]]:
    """The same for a tokenizer: halves a text until each piece has at most capacity tokens."""

    def cuts(text: str, capacity: int) -> list[tuple[int, int, int]]:
        todo, made = [(0, len(text))], []
        while todo:
            a, b = todo.pop()
            n = len(encode(text[a:b]))
            if n <= capacity or b - a == 1:
                made.append((a, b, n))
            else:
                middle = (a + b) // 2
                space = text.rfind(" ", a + 1, middle)
                todo += [(space if space > a else middle, b), (a, space if space > a else middle)]
        return made

    return cuts


def best_fit(tokens: np.ndarray, capacity: int, max_docs: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm") -> np.ndarray:
    """Container of each item. Longest items first; among the open containers with room for the item in
    all three capacities, the one of smallest weighted residual norm after placing it (rule "norm") or
    of greatest weighted dot product of item and residual (rule "dot") takes it; ties: the oldest. An item
    that alone exceeds max_cost fills that capacity, so that no other of any cost joins it."""
    n = len(tokens)
    order = np.lexsort((np.arange(n), -tokens))
    left = np.zeros((n, 3))
    open_ids = np.zeros(n, dtype=np.int64)
    n_open = n_bins = 0
    scale = np.array([capacity, max_docs, max_cost], dtype=float)
    w = np.array(weights)
    place = np.empty(n, dtype=np.int64)
    smallest = tokens.min() if n else 0
    for item in order:
        need = np.array([tokens[item], 1.0, min(float(tokens[item]) ** 2, max_cost)])
        rest = left[:n_open] - need
        fits = np.flatnonzero((rest >= 0).all(axis=1))
        if len(fits):
            if rule == "norm":
                score = -(((rest[fits] / scale) ** 2) @ w)
            else:
                score = (left[fits] / scale) @ (w * need / scale)
            k = fits[int(np.argmax(score))]
            left[k] -= need
            place[item] = open_ids[k]
        else:
            k = n_open
            left[k], open_ids[k], place[item] = scale - need, n_bins, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        if left[k, 0] < smallest or left[k, 1] < 1:  # nothing will fit any more: close it
            n_open -= 1
            left[k : n_open], open_ids[k : n_open] = left[k + 1 : n_open + 1].copy(), open_ids[k + 1 : n_open + 1].copy()
    return place


def pack(
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    max_docs: int = 4096,
    max_cost: float | None = None,
    shard: int = SHARD,
    cuts: Callable[[str, int], list[tuple[int, int, int]]] | None = None,
    rule: str = "norm",
) -> DataFrame:
    """The key, n_pieces, piece, start, length (code points), tokens, container of every item or piece.

    Sizes are UTF-8 bytes unless cuts (see tokenizer_cuts) counts otherwise. Items beyond the capacity are
    cut into pieces, no other is. Empty texts take no room; null texts count as empty. Equal keys are
    separate items. max_docs bounds the items of a container, max_cost the sum of their squared sizes; at the
    defaults neither binds before the tokens do. About shard items or pieces go to one task, spread by hash;
    containers of different shards never mix.
    """
    kind = items.schema[key].dataType.simpleString()
    sized = items.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    if cuts is None:
        counted = sized.withColumn("n", F.octet_length("body"))
        small = counted.where(F.col("n") <= capacity).select("key", F.lit(1).alias("n_pieces"), F.lit(0).alias("piece"), F.lit(0).alias("start"), F.length("body").alias("length"), F.col("n").cast("long").alias("tokens"))
        large = counted.where(F.col("n") > capacity).select("key", "body")
        cutter = byte_cuts
    else:
        small, large, cutter = None, sized, cuts

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row_key, body in zip(batch["key"], batch["body"]):
                found = cutter(body, capacity) or [(0, 0, 0)]
                rows += [(row_key, len(found), i, a, b - a, n) for i, (a, b, n) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["key", "n_pieces", "piece", "start", "length", "tokens"])

    pieces = large.mapInPandas(cut, f"key {kind}, n_pieces int, piece int, start int, length int, tokens long")
    if small is not None:
        pieces = small.unionByName(pieces)
    # the number of shards follows the number of pieces, which no text has more of than its bytes make (a
    # piece ends at most three bytes short of full); one sum, and no text leaves its task
    most = F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length("body") / max(1, capacity - 3))))
    shards = max(1, -(-(sized.agg(most).first()[0] or 0) // shard))
    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("key", "piece", "start", "tokens"), F.lit(shards)))
    limit = float(capacity) ** 2 if max_cost is None else float(max_cost)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "piece"], kind="stable")
        bins = best_fit(pdf["tokens"].to_numpy(), capacity, max_docs, limit, rule=rule)
        pdf["container"] = pdf.pop("shard").astype(str) + "-" + pd.Series(bins, index=pdf.index).astype(str)
        return pdf

    schema = f"key {kind}, n_pieces int, piece int, start int, length int, tokens long, container string"
    return spread.groupBy("shard").applyInPandas(place, schema).withColumnRenamed("key", key)


def packing_report(packed: DataFrame, capacity: int = CAPACITY, max_docs: int = 4096, max_cost: float | None = None) -> DataFrame:
    """One row over all containers: containers, items, tokens, fill (share of the token capacity in use), and how
    many containers come near each limit (over 99 % of the tokens, all max_docs, over 99 % of max_cost) or
    break one (more than any limit, but for an item alone). An empty table has no containers and a null fill."""
    limit = float(capacity) ** 2 if max_cost is None else float(max_cost)
    size = F.col("tokens").cast("double")
    bins = packed.groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.sum(size * size).alias("cost"))
    over = (F.col("tokens") > capacity) | (F.col("items") > max_docs) | ((F.col("cost") > limit) & (F.col("items") > 1))
    return bins.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        (F.sum("tokens") / (F.count("*") * capacity)).alias("fill"),
        F.count_if(F.col("tokens") > 0.99 * capacity).alias("full_of_tokens"),
        F.count_if(F.col("items") >= max_docs).alias("full_of_items"),
        F.count_if(F.col("cost") > 0.99 * limit).alias("full_of_cost"),
        F.count_if(over).alias("broken"),
    )
