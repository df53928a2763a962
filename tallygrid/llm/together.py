"""Items that appear together: a blocked Gram matrix over baskets.

Baskets become binary sparse columns, and records are taken in blocks of a bounded number of entries. For each block the
items are numbered from the commonest: the block of common items is a dense transpose product, in slices of records; the
blocks of rare items are sparse ones, in which each entry of a rare item meets the entries of its record up to itself, a
bounded number of meetings at a time. Counts of record blocks are combined before the shuffle and summed. The diagonal
holds the marginals, by which the counts are measured against chance.

Edge cases, as tested: items repeated within a basket count once; null items are none; null and empty baskets count as
records without items; a weight stands for so many equal records (null weight: none); empty tables give no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.cluster import cut


#: Records in a slice of the dense product, and meetings in a slice of a sparse one: some 32 MB each.
DENSE_ROWS, MEETINGS = 8192, 1 << 21


def _summed(codes: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sum at each."""
    code, amount = np.concatenate(codes), np.concatenate(sums)
    order = np.argsort(code, kind="stable")
    code, amount = code[order], amount[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, dtype=np.int64)
    return code[starts], np.add.reduceat(amount, starts) if len(starts) else amount


def gram(record: np.ndarray, item: np.ndarray, weight: np.ndarray, n_items: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nonzero cells (i, j, sum of weights) with i <= j of the Gram matrix; entries are distinct and items numbered from the commonest."""
    order = np.lexsort((item, record))
    record, item = record[order], item[order]
    head = min(block, n_items)
    common = item < head
    if common.any():
        dense = np.zeros((head, head))
        rows, local = np.unique(record[common], return_inverse=True)
        columns = item[common]
        for low in range(0, len(rows), DENSE_ROWS):
            p, q = np.searchsorted(local, [low, low + DENSE_ROWS])
            x = np.zeros((min(DENSE_ROWS, len(rows) - low), head))
            x[local[p:q] - low, columns[p:q]] = 1.0
            dense += x.T @ (x * weight[rows[low : low + DENSE_ROWS]][:, None])
        i, j = np.nonzero(np.triu(dense))
        yield i, j, dense[i, j]
    # an entry of a rare item meets the entries of its record before it, and itself
    at = np.flatnonzero(~common)
    first = np.searchsorted(record, record[at])
    meets = at - first + 1
    ends = np.cumsum(meets)
    codes, sums, low, held = [], [], 0, 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MEETINGS, "right")))
        each = meets[low:high]
        right = np.repeat(at[low:high], each)
        left = np.arange(len(right)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[low:high], each)
        code, amount = _summed([item[left] * n_items + item[right]], [weight[record[right]]])
        codes.append(code)
        sums.append(amount)
        held += len(code)
        low = high
        if held > 4 * MEETINGS:
            code, amount = _summed(codes, sums)
            codes, sums, held = [code], [amount], len(code)
            if held > 2 * MEETINGS:  # hardly anything is found again: sent on
                yield code // n_items, code % n_items, amount
                codes, sums, held = [], [], 0
    if codes:
        code, amount = _summed(codes, sums)
        at = amount != 0
        yield code[at] // n_items, code[at] % n_items, amount[at]


def pair_counts(baskets: DataFrame, items: str = "items", weight: str | None = None, block: int = 512, entries: int = 1 << 21) -> DataFrame:
    """``item_a, item_b, n``: records with both, ``item_a`` <= ``item_b``; equal items give the marginals, nulls all records.

    ``block`` common items make the dense part; a block of records has about ``entries`` entries, or is a single record.
    """
    w = F.lit(1).cast("bigint") if weight is None else F.coalesce(F.col(f"`{weight}`").cast("bigint"), F.lit(0))
    source = baskets.select(F.array_distinct(F.coalesce(F.array_compact(F.col(f"`{items}`")).cast("array<string>"), F.array().cast("array<string>"))).alias("items"), w.alias("w"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            lists, weights = table.column("items").combine_chunks(), table.column("w").to_numpy()
            if isinstance(lists, pa.ChunkedArray):
                lists = pa.concat_arrays(lists.chunks)
            record = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            coded = lists.flatten().dictionary_encode()
            names, code = np.asarray(coded.dictionary.to_pylist(), dtype=object), coded.indices.to_numpy(zero_copy_only=False)
            place = np.empty(len(names), dtype=np.int64)
            place[np.argsort(-np.bincount(code, minlength=len(names)), kind="stable")] = np.arange(len(names))
            named = np.empty(len(names), dtype=object)
            named[place] = names
            yield pa.RecordBatch.from_pydict({"item_a": pa.array([None], pa.string()), "item_b": pa.array([None], pa.string()), "n": pa.array([int(weights.sum())], pa.int64())})
            for i, j, n in gram(record, place[code], weights.astype(float), len(names), block):
                a, b = named[i], named[j]
                swap = a > b
                yield pa.RecordBatch.from_pydict({"item_a": pa.array(np.where(swap, b, a), pa.string()), "item_b": pa.array(np.where(swap, a, b), pa.string()), "n": pa.array(np.rint(n).astype(np.int64))})
            held.clear()

        for batch in batches:
            lengths = batch.column("items").value_lengths().to_numpy(zero_copy_only=False)
            ends, low = np.cumsum(lengths + 1), 0
            while low < len(batch):
                room = entries - size + (ends[low - 1] if low else 0)
                high = max(low + (not held), int(np.searchsorted(ends, room, "right")))
                if high > low:
                    held.append(batch.slice(low, high - low))
                    size += int(ends[high - 1] - (ends[low - 1] if low else 0))
                if high < len(batch):
                    yield from done()
                    size = 0
                low = high
        if held:
            yield from done()

    return source.mapInArrow(product, "item_a string, item_b string, n bigint").groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))


def associations(baskets: DataFrame, items: str = "items", weight: str | None = None, least: int = 1) -> DataFrame:
    """``item_a, item_b, n, n_a, n_b, n_all, lift`` of every pair found together in ``least`` records or more; lift is n * n_all / (n_a * n_b)."""
    counts = cut(pair_counts(baskets, items, weight))
    total = counts.filter(F.col("item_a").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    alone = counts.filter(F.col("item_a") == F.col("item_b"))
    a, b = alone.select("item_a", F.col("n").alias("n_a")), alone.select("item_b", F.col("n").alias("n_b"))
    pairs = counts.filter((F.col("item_a") < F.col("item_b")) & (F.col("n") >= least)).join(a, "item_a").join(b, "item_b")
    chance = F.col("n_a").cast("double") * F.col("n_b") / F.lit(float(total))
    return pairs.select("item_a", "item_b", "n", "n_a", "n_b", F.lit(total).cast("bigint").alias("n_all"), (F.col("n") / chance).alias("lift"))
