"""Percentiles with bounded rank error, from relative-rank compactors that merge.

A sketch is a stack of compactors. A full one sorts its values and sends every other one of its unprotected end, at
double weight, to the compactor above; how far the compaction reaches towards the protected tail follows the trailing
ones of a counter, so values near that tail are hardly ever merged (Cormode, Karnin, Liberty, Thaler and Vesely, 2021).
At rank fraction q of n values the standard error of the rank is at most ``min(0.084, 0.13 * distance to the protected
end) / k * n``. Sketches of partitions, days or files are merged level by level, with the same error. A group that
doesn't fill one compactor travels as its bare values, without the head that a sketch has.

Edge cases, as tested: nulls and NaN are no values; infinite values are; a sketch that never compacted is exact; empty
groups and tables give no row; -0 counts as 0; ties are kept as they are.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.cluster import cut

#: Standard error of a rank as a fraction of n is at most the first over k, and the second times the distance to the tail over k.
FIXED_ERROR, RELATIVE_ERROR = 0.084, 0.13
#: Where a bracket stands for a certain one: so many standard errors.
SURE = 6.0
FIRST_SECTIONS, LEAST_SECTION = 3, 4
HEAD, MARK = struct.Struct("<4siqi"), b"req1"
#: Rows that are grouped at a time, and bytes or groups held before what is there is sent on.
ROWS_AT_ONCE, MOST_HELD, MOST_GROUPS = 1 << 18, 64 << 20, 200_000
#: Brackets up to this number, about 10 MB, are broadcast.
MOST_SENT = 100_000


class Compactor:
    """One level: values, their counter of compactions, and the split of the buffer into sections."""

    def __init__(self, k: int) -> None:
        self.width, self.sections, self.state = float(k), FIRST_SECTIONS, 0
        self.values: list[np.ndarray] = []
        self.size = 0

    @property
    def section(self) -> int:
        return max(LEAST_SECTION, 2 * round(self.width / 2))

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self.section

    def add(self, values: np.ndarray) -> None:
        self.values.append(values)
        self.size += len(values)

    def compact(self, rng: np.random.Generator) -> np.ndarray:
        """Takes the lower end out and returns every other value of it."""
        ordered = np.sort(np.concatenate(self.values))
        ones = (self.state ^ (self.state + 1)).bit_length()  # trailing ones of the counter, and one more
        kept = self.capacity // 2 + (self.sections - min(ones, self.sections)) * self.section
        end = len(ordered) - kept
        end -= end % 2
        out = ordered[int(rng.integers(2)) : end : 2]
        self.values, self.size = [ordered[end:]], len(ordered) - end
        self.state += 1
        if self.state >= 1 << (self.sections - 1) and self.width / math.sqrt(2) >= LEAST_SECTION:
            self.width /= math.sqrt(2)
            self.sections *= 2
        return out

    def take(self, other: "Compactor") -> None:
        self.state |= other.state
        self.width, self.sections = min((self.width, self.sections), (other.width, other.sections))
        self.values += other.values
        self.size += other.size


class Sketch:
    """Protects the high tail; feed negated values to protect the low one."""

    def __init__(self, k: int = 64, seed: int = 0) -> None:
        self.k, self.n, self.levels = k, 0, [Compactor(k)]
        self.rng = np.random.default_rng(seed)

    def update(self, values: np.ndarray) -> None:
        self.n += len(values)
        at = 0
        while at < len(values):
            room = max(1, self.levels[0].capacity - self.levels[0].size)
            self.levels[0].add(values[at : at + room])
            at += room
            self._settle()

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            if level.size >= level.capacity:
                if h + 1 == len(self.levels):
                    self.levels.append(Compactor(self.k))
                self.levels[h + 1].add(level.compact(self.rng))
            h += 1

    def merge(self, other: "Sketch") -> None:
        self.n += other.n
        while len(self.levels) < len(other.levels):
            self.levels.append(Compactor(self.k))
        for mine, theirs in zip(self.levels, other.levels, strict=False):
            mine.take(theirs)
        while any(x.size >= x.capacity for x in self.levels):
            self._settle()

    @property
    def exact(self) -> bool:
        return len(self.levels) == 1

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Values in order and the cumulative weight at each."""
        values = [np.concatenate([*x.values, np.empty(0)]) for x in self.levels]
        weights = np.concatenate([np.full(len(v), 1 << h, dtype=np.int64) for h, v in enumerate(values)])
        flat = np.concatenate(values)
        order = np.argsort(flat, kind="stable")
        return flat[order], np.cumsum(weights[order])

    def error(self, rank: float) -> float:
        """One standard error of a rank."""
        if self.exact:
            return 0.0
        return min(FIXED_ERROR * self.n, RELATIVE_ERROR * (self.n - rank + 1)) / self.k

    def dumps(self) -> bytes:
        out = [HEAD.pack(MARK, self.k, self.n, len(self.levels))]
        for x in self.levels:
            v = np.concatenate([*x.values, np.empty(0)])
            out += [struct.pack("<diqi", x.width, x.sections, x.state, len(v)), v.astype("<f8").tobytes()]
        return b"".join(out)

    @classmethod
    def loads(cls, data: bytes, seed: int = 0, k: int = 64) -> "Sketch":
        """From its dump, or from bare values, which are told by their length: a dump's isn't a multiple of eight."""
        if len(data) % 8 == 0:
            s = cls(k, seed)
            s.update(np.frombuffer(data, "<f8"))
            return s
        _, k, n, levels = HEAD.unpack_from(data)
        at, s = HEAD.size, cls(k, seed)
        s.n, s.levels = n, []
        for _ in range(levels):
            c = Compactor(k)
            c.width, c.sections, c.state, size = struct.unpack_from("<diqi", data, at)
            at += struct.calcsize("<diqi")
            c.add(np.frombuffer(data, "<f8", size, at))
            at += 8 * size
            s.levels.append(c)
        return s


def joined(pieces: list[bytes], k: int, seed: int) -> bytes:
    """One piece from several, bare while it doesn't fill a compactor."""
    bare = b"".join(x for x in pieces if len(x) % 8 == 0)
    dumped = [x for x in pieces if len(x) % 8]
    if not dumped and len(bare) < 8 * Compactor(k).capacity:
        return bare
    one = Sketch(k, seed)
    one.update(np.frombuffer(bare, "<f8"))
    for x in dumped:
        one.merge(Sketch.loads(x))
    return one.dumps()


def size_of(piece: bytes) -> int:
    """The number of values that a piece stands for."""
    return HEAD.unpack_from(piece)[2] if len(piece) % 8 else len(piece) // 8


def target_rank(n: int, p: float) -> int:
    """Rank, from 1, of the smallest value with at least p percent of n values at or below it."""
    return max(1, -(-int(p) * n // 100) if float(p).is_integer() else math.ceil(p * n / 100))


class _Held:
    """Pieces by group, sent on when they are many or large."""

    def __init__(self, names: list[str], k: int, seed: int) -> None:
        self.names, self.k, self.seed = names, k, seed
        self.pieces: dict[tuple, list[bytes]] = {}
        self.bytes = 0

    def add(self, key: tuple, piece: bytes) -> None:
        own = self.pieces.setdefault(key, [])
        own.append(piece)
        self.bytes += len(piece)
        if len(own) >= 64:  # many pieces of one group become one, so a hot group stays small
            self.bytes -= sum(map(len, own))
            own[:] = [joined(own, self.k, self.seed)]
            self.bytes += len(own[0])

    @property
    def full(self) -> bool:
        return self.bytes > MOST_HELD or len(self.pieces) > MOST_GROUPS

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.pieces:
            columns = list(zip(*self.pieces, strict=True))
            data = [x[0] if len(x) == 1 else joined(x, self.k, self.seed) for x in self.pieces.values()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], pa.array([size_of(x) for x in data], pa.int64()), pa.array(data, pa.binary())], names=[*self.names, "metric", "n", "sketch"])
        self.pieces, self.bytes = {}, 0


def _schema(names: list[str]) -> str:
    return ", ".join([*[f"`{n}` string" for n in names], "metric string", "n bigint", "sketch binary"])


def partial(df: DataFrame, groups: dict[str, Column], metrics: dict[str, Column], k: int = 64) -> DataFrame:
    """The group columns, ``metric, n, sketch``: at least one row for each group and metric of every partition. Narrow."""
    names, listed = list(groups), list(metrics)
    flat = df.select(*[c.cast("string").alias(f"g{i}") for i, c in enumerate(groups.values())], *[c.cast("double").alias(f"m{i}") for i, c in enumerate(metrics.values())])
    capacity = Compactor(k).capacity

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        large = _Held(names, k, TaskContext.get().partitionId())

        def grouped(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            code, words = np.zeros(len(table), dtype=np.int64), []
            for i in range(len(names)):
                one = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode")
                one = one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one
                words.append(one.dictionary)
                code = code * max(1, len(one.dictionary)) + one.indices.to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1] if i + 1 < len(names) and code.max(initial=0) > 1 << 40 else code
            for m, metric in enumerate(listed):
                values = table.column(f"m{m}").to_numpy()
                ok = np.flatnonzero(~np.isnan(values))
                if not len(ok):
                    continue
                at = ok[np.argsort(code[ok], kind="stable")]
                starts = np.flatnonzero(np.r_[True, np.diff(code[at]) != 0])
                sizes = np.diff(np.r_[starts, len(at)])
                ordered, row = values[at] + 0.0, at[starts]
                small = sizes < capacity
                for j in np.flatnonzero(~small):
                    key = tuple(table.column(i)[int(row[j])].as_py() for i in range(len(names)))
                    one = Sketch(k, large.seed)
                    one.update(ordered[starts[j] : starts[j] + sizes[j]])
                    large.add((*key, metric), one.dumps())
                if small.any():
                    kept = np.repeat(small, sizes)
                    ends = np.r_[0, np.cumsum(sizes[small])].astype(np.int32) * 8
                    data = pa.Array.from_buffers(pa.binary(), int(small.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(ordered[kept], dtype="<f8").tobytes())])
                    keys = [table.column(i).take(pa.array(row[small])).combine_chunks() for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([metric] * int(small.sum()), pa.string()), pa.array(sizes[small], pa.int64()), data], names=[*names, "metric", "n", "sketch"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                yield from grouped(held)
                held, rows = [], 0
                if large.full:
                    yield from large.send()
        if held:
            yield from grouped(held)
        yield from large.send()

    return flat.mapInArrow(build, _schema(names))


def sketches(df: DataFrame, groups: dict[str, Column], metrics: dict[str, Column], k: int = 64, salts: int = 1) -> DataFrame:
    """The group columns, ``metric``, ``n`` and ``sketch``, one row for each group and metric; values don't move."""
    return merged(partial(df, groups, metrics, k), list(groups), k, salts)


def merged(parts: DataFrame, names: list[str], k: int = 64, salts: int = 1) -> DataFrame:
    """Sketches of days, files or partitions into one for each group and metric.

    They are combined within each task, then shuffled and merged one after the other, so a task holds one sketch at a
    time. With ``salts`` above 1 (for inputs of very many tasks) partitions are merged in so many bundles first.
    """
    keys = [*names, "metric"]
    columns = [F.col(f"`{c}`") for c in keys]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = _Held(names, k, TaskContext.get().partitionId())
        for batch in batches:
            for *key, data in zip(*(batch.column(c).to_pylist() for c in range(len(keys))), batch.column(len(keys)).to_pylist(), strict=True):
                held.add(tuple(key), data)
            if held.full:
                yield from held.send()
        yield from held.send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, done = None, [], _Held(names, k, 0)
        for batch in batches:
            for *key, data in zip(*(batch.column(c).to_pylist() for c in range(len(keys))), batch.column(len(keys)).to_pylist(), strict=True):
                if key != now:
                    if pieces:
                        done.add(tuple(now), joined(pieces, k, len(done.pieces)))
                        if done.full:
                            yield from done.send()
                    now, pieces = key, []
                pieces.append(data)
                if len(pieces) >= 64:
                    pieces = [joined(pieces, k, len(done.pieces))]
        if pieces:
            done.add(tuple(now), joined(pieces, k, len(done.pieces)))
        yield from done.send()

    def brought_together(df: DataFrame, *more: Column) -> DataFrame:
        return df.repartition(*columns, *more).sortWithinPartitions(*columns, "sketch").select(*columns, "sketch").mapInArrow(merge, _schema(names))

    combined = parts.select(*columns, "sketch").mapInArrow(combine, _schema(names))
    if salts > 1:
        # whatever lies in a partition goes to one bundle of the group
        combined = brought_together(combined.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(salts))), F.col("_part"))
    return brought_together(combined)


def percentiles(sketched: DataFrame, names: list[str], ps: dict[str, list[float]]) -> DataFrame:
    """The group columns, ``metric, p, n, target, value, low, high``: estimates, and brackets that hold the percentile.

    The brackets reach ``SURE`` standard errors to either side of the rank ``target``.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # names may be no identifiers, so fields go by place
        for frame in frames:
            rows = []
            for *key, metric, sketch in frame.itertuples(index=False, name=None):
                s = Sketch.loads(sketch)
                values, up_to = s.weighted()
                at = lambda r, v=values, u=up_to: float(v[min(len(v) - 1, np.searchsorted(u, r))])
                for p in ps.get(metric, []):
                    r = target_rank(s.n, p)
                    e = SURE * s.error(r)
                    low = at(r - e) if r - e > 1 or not e else -math.inf
                    high = at(r + e) if r + e < s.n or not e else math.inf
                    rows.append((*key, metric, float(p), s.n, r, at(r), low, high))
            yield pd.DataFrame(rows, columns=[*names, "metric", "p", "n", "target", "value", "low", "high"])

    keys = ", ".join(f"`{n}` string" for n in names)
    return sketched.select(*[f"`{n}`" for n in names], "metric", "sketch").mapInPandas(read, f"{keys}, metric string, p double, n bigint, target bigint, value double, low double, high double")


def exact(values: DataFrame, brackets: DataFrame, names: list[str], bins: int = 4096, rounds: int = 3) -> DataFrame:
    """Exact percentiles by counting: of ``values`` (group columns, ``metric``, ``value``), those that ``brackets`` ask for.

    Values below a bracket are only counted, those within are counted by value, and the search then narrows in equal
    bins; nothing is sorted beyond the bins of one round.
    """
    keys = [*names, "metric", "p"]
    asked = cut(brackets.select(*keys, "target", "low", "high"))
    # so few are sent to the values; more are joined by shuffle, where Spark splits what is skewed
    held = values.join(F.broadcast(asked) if asked.count() <= MOST_SENT else asked, [*names, "metric"])
    below = F.col("value") < F.col("low")
    tally = cut(held.filter(F.col("value") <= F.col("high")).groupBy(*keys, "target", below.alias("below"), F.when(~below, F.col("value")).alias("value")).agg(F.count("*").alias("c")))
    left = tally.filter("below").groupBy(*keys).agg(F.sum("c").alias("passed"))
    inside = tally.filter("not below").join(left, keys, "left").select(*keys, "value", "c", (F.col("target") - F.coalesce("passed", F.lit(0))).alias("target"))
    for last in [False] * rounds + [True]:
        if last:
            running = inside.withColumn("up", F.sum("c").over(Window.partitionBy(*keys).orderBy("value")))
            return running.filter(F.col("up") >= F.col("target")).groupBy(*keys).agg(F.min("value").alias("value"))
        ends = inside.groupBy(*keys).agg(F.min("value").alias("a"), F.max("value").alias("b"))
        share = (F.col("value") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))
        binned = inside.join(ends, keys).withColumn("bin", F.coalesce(F.when(share < 1, F.floor(share * bins)), F.when(F.col("value") > F.col("a"), F.lit(bins)), F.lit(0)).cast("int"))
        counts = binned.groupBy(*keys, "target", "bin").agg(F.sum("c").alias("c"))
        up = counts.withColumn("up", F.sum("c").over(Window.partitionBy(*keys).orderBy("bin")))
        hit = up.filter((F.col("up") >= F.col("target")) & (F.col("up") - F.col("c") < F.col("target"))).select(*keys, "bin", (F.col("up") - F.col("c")).alias("passed"))
        inside = binned.join(hit, [*keys, "bin"]).select(*keys, "value", "c", (F.col("target") - F.col("passed")).alias("target"))
    raise AssertionError
