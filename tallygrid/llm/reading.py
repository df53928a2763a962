"""Reading level of documents, by a Rasch-style latent model of levels and word difficulties.

Documents have a level t and words a difficulty b on one scale. The log-odds of one word's occurrence against another's
change with the product of level and difference of difficulty, so hard words grow common as levels rise:
``P(word | t) = p * exp(b * t) / Z(t)`` within a language, with a standard normal prior on levels and a normal one on
difficulties. Both sides are estimated in turn. Given difficulties, each document's level is found by itself, in a pass
that also sums levels by word; given those sums and the histogram of levels, each word's difficulty is a problem in one
variable, and words are spread over tasks. What goes to the driver and back has a fixed size: one number for each of
``BINS`` hashed words of each of at most ``LANGUAGES`` languages. All words of all documents count; words that share a bin share a difficulty.

The scale is set out by word length at the start (longer is harder; in scripts without spaces, more ideographs) and brought to grades 1 to 5 by a rating-scale fit
on graded documents: a sample of at most ``max_labels`` of them, chosen by hash.

Edge cases, as tested: null, empty and blank texts and texts without letters or digits have no level; a null language
is a language of its own, rare ones beyond the cap share a model; texts of any length are read whole; repeated rows
each get a level; without labels the grade is null; empty tables give an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.cluster import cut

BINS, LANGUAGES = 1 << 16, 64
GRID = np.linspace(-4, 4, 81)
RAISED = 5.0
#: Words of scripts with spaces, runs of scripts without (taken by pairs of characters), and numbers (all alike).
TERMS = r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}ー]+|[[\p{L}\p{M}'’]--[\p{Han}\p{Hiragana}\p{Katakana}ー]]+|\p{N}+"
#: Ideographs count as the width of a pair of characters, since they mark the harder words where there are no spaces.
HAN = "[\u3400-\u4dbf\u4e00-\u9fff]"
FEATURES = "ident {kind}, lang string, n_letters bigint, n_words bigint, n_sentences bigint, terms array<int>, widths array<tinyint>"


def _tools():
    import regex

    return regex.compile(TERMS).findall, regex.compile(r"[^\p{L}\p{Nd}]+").findall, regex.compile(r"[.!?]+(?=\s|\Z)").findall, regex.compile(r"[\p{L}\p{Nd}]").search


def features(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of each text, and its words as bins; written once, since every pass of the fit reads it."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of, others_of, ends_of, has_letter = _tools()
        known: dict[str, tuple[int, int]] = {}
        words_known: dict[str, tuple[int, int]] = {}
        han = re.compile(HAN)

        def coded(term: str, paired: bool = False) -> tuple[int, int]:
            got = known.get(term)
            if got is None:
                bare = term.strip("'’").lower()
                plain = "0" if bare[:1].isnumeric() else bare
                if len(known) > 500_000:
                    known.clear()
                got = known[term] = (zlib.crc32(plain.encode()) % BINS, 1 + len(han.findall(plain)) if paired else min(len(plain), 127))
            return got

        for batch in batches:
            letters, words, ends, lists = [], [], [], []
            for t in batch.column("text").to_pylist():
                t = t or ""
                letters.append(len(t) - sum(map(len, others_of(t))))
                words.append(sum(1 for w in t.split() if w[0].isalpha() or has_letter(w)))
                ends.append(max(1, len(ends_of(t))))
                own = []
                for term in terms_of(t):
                    if (got := words_known.get(term)) is not None:
                        own.append(got)
                    elif "⺀" <= term[0] and term[0] > "　" and not term[0].isnumeric():
                        own += [coded(term[i : i + 2], True) for i in range(max(1, len(term) - 1))]
                    elif term.strip("'’"):
                        own.append(words_known.setdefault(term, coded(term)))
                if len(words_known) > 500_000:
                    words_known.clear()
                lists.append(own)
            stops = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
            flat = list(chain.from_iterable(lists))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ident"), batch.column("lang"), pa.array(letters, pa.int64()), pa.array(words, pa.int64()), pa.array(ends, pa.int64()), pa.ListArray.from_arrays(stops, pa.array([x for x, _ in flat], pa.int32())), pa.ListArray.from_arrays(stops, pa.array([x for _, x in flat], pa.int8()))],
                names=["ident", "lang", "n_letters", "n_words", "n_sentences", "terms", "widths"],
            )

    rows = docs.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    return cut(rows.mapInArrow(run, FEATURES.format(kind=kind)))


@dataclass
class Model:
    """Difficulty of each bin of each language, the normaliser of each language on the grid, and the grades' thresholds."""

    languages: list[str | None]
    difficulty: np.ndarray
    log_z: np.ndarray
    count: np.ndarray | None = None
    slope: float = 1.0
    cuts: tuple[float, ...] = ()

    def language(self, names: list[str | None]) -> np.ndarray:
        place = {x: i for i, x in enumerate(self.languages)}
        return np.array([place.get(x, len(self.languages)) for x in names], dtype=np.int64)

    def levels(self, index: np.ndarray, sizes: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Places on the grid; ``index`` has the words of all documents in a row."""
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0.0], np.cumsum(self.difficulty[index])])
        total = sums[ends] - sums[ends - sizes]
        return (total[:, None] * GRID - sizes[:, None] * self.log_z[lang] - GRID**2 / 2).argmax(axis=1)

    def grade(self, level: np.ndarray) -> np.ndarray:
        """Expected grade."""
        if not self.cuts:
            return np.full(len(level), np.nan)
        return 1 + sum(1 / (1 + np.exp(-(self.slope * level - c))) for c in self.cuts)


def _words(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lang = model.language(batch.column("lang").to_pylist())
    lists = batch.column("terms")
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(lang, sizes) * BINS + lists.flatten().to_numpy(zero_copy_only=False), sizes, lang


def _summed(made: DataFrame, n: int, columns: list[str]) -> list[np.ndarray]:
    """Sums by index, of which there are at most n."""
    got = made.groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    out = []
    for c in columns:
        dense = np.zeros(n)
        dense[got["i"].to_numpy(dtype=np.int64)] = got[c]
        out.append(dense)
    return out


def _emit(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    at = np.flatnonzero(np.any([c != 0 for c in columns.values()], axis=0))
    return pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), **{k: pa.array(c[at], pa.float64()) for k, c in columns.items()}})


def fit(feats: DataFrame, rounds: int = 6, prior: float = 1.0) -> Model:
    """Alternating estimation over all documents; each round is one pass, one shuffle of sums, and one task's share of the words each."""
    found = feats.groupBy("lang").agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.asc_nulls_first("lang")).limit(LANGUAGES - 1).collect()
    model = Model([r["lang"] for r in found], np.zeros(0), np.zeros(0))
    n_lang = len(model.languages) + 1
    n = n_lang * BINS
    spark = feats.sparkSession

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, width = np.zeros(n), np.zeros(n)
        for batch in batches:
            index, _, _ = _words(batch, model)
            count += np.bincount(index, minlength=n)
            width += np.bincount(index, weights=batch.column("widths").flatten().to_numpy(zero_copy_only=False), minlength=n)
        yield _emit({"c": count, "w": width})

    count, width = _summed(feats.select("lang", "terms", "widths").mapInArrow(tally, "i bigint, c double, w double"), n, ["c", "w"])
    by_lang = count.reshape(n_lang, BINS)
    share = by_lang / np.maximum(by_lang.sum(axis=1, keepdims=True), 1)
    mean_width = (width / np.maximum(count, 1)).reshape(n_lang, BINS)
    centre = (share * mean_width).sum(axis=1, keepdims=True)
    spread = np.sqrt((share * (mean_width - centre) ** 2).sum(axis=1, keepdims=True))
    b = np.where(by_lang > 0, np.clip((mean_width - centre) / np.maximum(spread, 1e-9), -3, 3), 0.0) * 0.5

    def normaliser(b: np.ndarray, p: np.ndarray) -> np.ndarray:
        z = np.empty((n_lang, len(GRID)))
        for i in range(n_lang):
            at = np.flatnonzero(by_lang[i])
            z[i] = np.log(np.maximum(np.exp(np.outer(GRID, b[i, at])) @ p[i, at], 1e-300)) if len(at) else 0.0
        return z

    model.difficulty, model.log_z, model.count = b.ravel(), normaliser(b, share), count
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now = sent.value
            sums, seen = np.zeros(n), np.zeros(n)
            for batch in batches:
                index, sizes, lang = _words(batch, now)
                at = now.levels(index, sizes, lang)
                # levels are raised above 0, so that the sum of a word that occurs is never 0
                sums += np.bincount(index, weights=np.repeat(GRID[at] + RAISED, sizes), minlength=n)
                # the histogram of levels, by words, in the first places of each language
                seen += np.bincount(lang * BINS + at, weights=sizes, minlength=n)
            yield _emit({"t": sums, "h": seen})

        made = feats.select("lang", "terms").mapInArrow(step, "i bigint, t double, h double")
        summed = cut(made.groupBy("i").agg(*[F.sum(x).alias(x) for x in "th"]))
        weight = np.zeros((n_lang, len(GRID)))
        for i, h in summed.filter("h > 0").select("i", "h").toPandas().itertuples(index=False):
            weight[i // BINS, i % BINS] = h
        base = np.log(np.maximum(weight, 1e-300)) - model.log_z
        # each word is a problem by itself, so words are spread over tasks: few bytes, much work
        words = summed.filter("t > 0").repartition(tasks, F.xxhash64("i")).select("i", "t")
        got = words.mapInArrow(_solver(sent, base, prior), "i bigint, b double").groupBy("i").agg(F.sum("b").alias("b")).toPandas()
        i, value = got["i"].to_numpy(dtype=np.int64), got["b"].to_numpy(dtype=float)
        b = np.zeros(n)
        b[i[i >= 0]] = value[i >= 0]
        # below 0: for each language the sum of its words' shares, and of their tilted shares at each level
        totals = np.zeros(n_lang * (len(GRID) + 1))
        totals[-1 - i[i < 0]] = value[i < 0]
        totals = totals.reshape(n_lang, -1)
        log_z = np.log(np.maximum(totals[:, 1:], 1e-300)) - np.log(np.maximum(totals[:, :1], 1e-300))
        model = Model(model.languages, b, np.where(totals[:, :1] > 0, log_z, 0.0), count)
        sent.destroy()
    model.count = None  # the fit alone needs it
    return model


def _solver(sent, base: np.ndarray, prior: float):
    """For each word (``i, t``: place, sum of raised levels) its difficulty, by Newton steps in one variable."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, width = sent.value.difficulty, len(GRID) + 1
        totals = np.zeros(len(base) * width)
        for batch in batches:
            i, t = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for low in range(0, len(i), 20_000):
                at = i[low : low + 20_000]
                count = sent.value.count[at]
                sums = t[low : low + 20_000] - RAISED * count
                own, lang = old[at].copy(), at // BINS
                ground = base[lang]
                for _ in range(8):
                    tilt = np.outer(own, GRID) + ground
                    tilt = np.exp(tilt - tilt.max(axis=1, keepdims=True))
                    tilt /= tilt.sum(axis=1, keepdims=True)
                    mean = tilt @ GRID
                    var = np.maximum(tilt @ GRID**2 - mean**2, 1e-9)
                    own = own + np.clip((sums - count * mean - own / prior) / (count * var + 1 / prior), -0.5, 0.5)
                own = np.clip(own, -5, 5)
                power = np.outer(own, GRID)
                share = count / np.maximum(np.exp(power + ground).sum(axis=1), 1e-300)
                tilted = np.exp(power) * share[:, None]
                for x in np.unique(lang):
                    on = lang == x
                    totals[x * width] += share[on].sum()
                    totals[x * width + 1 : (x + 1) * width] += tilted[on].sum(axis=0)
                yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "b": pa.array(own, pa.float64())})
        on = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"i": pa.array(-1 - on, pa.int64()), "b": pa.array(totals[on], pa.float64())})

    return solve


def calibrate(model: Model, level: np.ndarray, grade: np.ndarray) -> None:
    """Rating-scale thresholds for grades 1 to 5 on graded documents: one slope for all steps, by Newton steps."""
    ok = ~np.isnan(level) & ~np.isnan(grade)
    level, grade = level[ok], grade[ok]
    if not len(level):
        return
    steps = np.arange(2, 6) - 0.5
    y = (grade[:, None] > steps).astype(float)
    w = np.concatenate([[1.0], -np.log((1 - y.mean(axis=0) + 1e-3) / (y.mean(axis=0) + 1e-3)) * -1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(w[0] * level[:, None] - w[1:])))
        r, v = y - p, np.maximum(p * (1 - p), 1e-9)
        grad = np.concatenate([[(r * level[:, None]).sum()], -r.sum(axis=0)]) - 1e-3 * w
        h = np.diag(np.concatenate([[(v * level[:, None] ** 2).sum()], v.sum(axis=0)])) + 1e-3 * np.eye(5)
        h[0, 1:] = h[1:, 0] = -(v * level[:, None]).sum(axis=0)
        step = np.linalg.solve(h, grad)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.cuts = float(w[0]), tuple(float(x) for x in w[1:])


def apply(feats: DataFrame, model: Model, ident: str = "doc_id") -> DataFrame:
    """``ident, lang, level, grade, n_letters, n_words, n_sentences, ari`` of every document."""
    kind = feats.schema["ident"].dataType.simpleString()
    sent = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        for batch in batches:
            index, sizes, lang = _words(batch, now)
            level = GRID[now.levels(index, sizes, lang)]
            none = sizes == 0
            grade = now.grade(level)
            yield pa.RecordBatch.from_arrays([batch.column("ident"), batch.column("lang"), pa.array(level, mask=none), pa.array(grade, mask=none | np.isnan(grade)), *[batch.column(c) for c in ("n_letters", "n_words", "n_sentences")]], names=["ident", "lang", "level", "grade", "n_letters", "n_words", "n_sentences"])

    made = feats.select("ident", "lang", "terms", "n_letters", "n_words", "n_sentences").mapInArrow(run, f"ident {kind}, lang string, level double, grade double, n_letters bigint, n_words bigint, n_sentences bigint")
    words = F.nullif(F.col("n_words"), F.lit(0))
    ari = F.lit(4.71) * F.col("n_letters") / words + F.lit(0.5) * F.col("n_words") / F.col("n_sentences") - F.lit(21.43)
    return made.withColumn("ari", ari).withColumnRenamed("ident", ident)


def reading_levels(docs: DataFrame, labels: DataFrame | None = None, ident: str = "doc_id", rounds: int = 6, max_labels: int = 20_000) -> DataFrame:
    """Levels of all documents; with ``labels`` (``ident, grader, reading_level``) also grades."""
    feats = features(docs, ident)
    model = fit(feats, rounds)
    if labels is not None:
        graded = labels.select(ident, "grader", "reading_level").distinct().filter("reading_level IS NOT NULL").groupBy(ident).agg(F.avg("reading_level").alias("given"))
        known = apply(feats, model, ident).select(ident, "level").join(graded, ident).orderBy(F.xxhash64(ident), ident).limit(max_labels).toPandas()
        calibrate(model, known["level"].to_numpy(dtype=float), known["given"].to_numpy(dtype=float))
    return apply(feats, model, ident)


def agreement(levels: DataFrame, labels: DataFrame, ident: str = "doc_id") -> tuple[int, float, float]:
    """Graded documents that have a level, and the rank correlation of their mean grade with the level and with the index.

    Ranks are of at most as many documents as are graded by hand; equal values share their mean rank.
    """
    given = labels.select(ident, "grader", "reading_level").distinct().filter("reading_level IS NOT NULL").groupBy(ident).agg(F.avg("reading_level").alias("given"))
    both = levels.filter("level IS NOT NULL").select(ident, "level", "ari").join(given, ident).select("level", "ari", "given").toPandas()
    if len(both) < 2:
        return len(both), float("nan"), float("nan")
    ranks = both.rank()
    return len(both), float(ranks["level"].corr(ranks["given"])), float(ranks["ari"].corr(ranks["given"]))
