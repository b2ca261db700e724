"""Quality rules: base statistics of whole texts, and robust multivariate outliers.

Base rules reject short and repetitive texts. The others are judged by the
minimum-covariance-determinant estimate of their language and source: from
several starts, the mean and covariance of the share of rows that lie nearest
are taken until the determinant falls no more (concentration steps), and the
start of the least determinant counts. Its usual rows give the final estimate. A vector of transformed statistics whose
squared Mahalanobis distance lies beyond the chi-squared quantile is an outlier.

The statistics are counts of a text, so those of a short text vary by chance
(``counting_noise``): that variance, of the document itself, is added to the
covariance it is judged by. A few words tell little, a long text is held to the
spread of its group.

Each step is an aggregate over all rows of narrow statistics, combined before
the shuffle, so a source with a third of the rows is a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.store import map_batches, stored, tuned
from pagelake.llm.textbatch import U64, mix, slices, span_hashes, spans, windows

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Share of a group that the estimate rests on.
SUPPORT = 0.75
#: Concentration steps end when no logarithm of a determinant falls by more than this, or after MAX_STEPS.
CONVERGED = 1e-3
MAX_STEPS = 50
#: Rows below which a source's rows are judged with the other small sources of their language, and then with all.
MIN_GROUP = 200
#: Quantile up to which a row counts in the last estimate of its group.
USUAL = 0.975
#: Probability that a normal vector is rejected.
REJECT_PROBABILITY = 1e-3
PERCENTILE_ACCURACY = 10_000
#: Share of the corpus's own spread that is added to each group's, so that its matrix can be inverted.
FLOOR = 0.1
DIMENSIONS = ("log_words", "log_word_length", "root_symbols", "root_dup_lines", "root_repeats")
STARTS = ("deviations", "all", "signs")

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _salted(values: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Hashes that are equal only inside one document."""
    return mix(values ^ mix(document.astype(U64) + U64(1)))


def text_counts(part) -> dict[str, np.ndarray]:
    """``COUNTS`` of each document of a slice."""
    n = len(part)
    starts, ends, document = part.words()
    first_bytes = (part.data & 0xC0) != 0x80
    inside = np.zeros(len(part.data) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(starts) else np.zeros(len(part.data), dtype=bool)
    if len(starts) > 1:  # a word that begins where the last one ends, at a document's limit
        inside[starts] = True

    line_starts, line_ends = spans(part.data != 0x0A, part.offsets)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_document = np.searchsorted(part.offsets, line_starts, side="right") - 1
    lines = _salted(span_hashes(part.data, line_starts, line_ends), line_document)
    _, first = np.unique(lines, return_index=True)
    n_lines = np.bincount(line_document, minlength=n)

    found, at = windows(span_hashes(part.data, starts, ends), document, WINDOW)
    _, each, often = np.unique(_salted(found, document[at]), return_inverse=True, return_counts=True)
    again = at[often[each] > 1]
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": np.bincount(document, minlength=n),
        "word_chars": _per_document(inside & first_bytes, part.offsets),
        "n_symbols": _per_document(_IS_SYMBOL[part.data], part.offsets),
        "n_dup_lines": n_lines - np.bincount(line_document[first], minlength=n),
        "n_repeat_words": np.bincount(document[covered], minlength=n),
        "n_lines": n_lines,
    }


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [text_counts(part) for part in slices(batch.column(batch.num_columns - 1))]
        columns = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)) for c in COUNTS]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *COUNTS])


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the base counts, n_lines, base_failed) of each row; no shuffle."""
    tuned(docs.sparkSession)
    kept = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    counted = map_batches(kept, count_batches, f"{head}, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def statistic_vector() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "log_words": F.log(words),
        "log_word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "root_symbols": F.sqrt(F.col("n_symbols") / words),
        "root_dup_lines": F.sqrt(F.col("n_dup_lines") / lines),
        "root_repeats": F.sqrt(F.col("n_repeat_words") / words),
    }


def counting_noise() -> dict[str, Column]:
    """Variance of each statistic if its count is a Poisson one; repeated words come in two windows at least."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "log_words": 1 / words,
        "log_word_length": 1 / F.greatest(F.col("word_chars"), F.lit(1)),
        "root_symbols": 1 / (4 * words),
        "root_dup_lines": 1 / (4 * lines),
        "root_repeats": 2 * WINDOW / (4 * words),
    }


def chi_squared(p: float, k: int) -> float:
    """Quantile by the cube-root approximation."""
    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3


def _distance(center: str, precision: str) -> Column:
    k = len(DIMENSIONS)
    away = [F.col(c) - F.col(center)[i] for i, c in enumerate(DIMENSIONS)]
    rows = [reduce(lambda a, b: a + b, [F.col(precision)[i * k + j] * away[j] for j in range(k)]) for i in range(k)]
    return reduce(lambda a, b: a + b, [away[i] * rows[i] for i in range(k)])


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(c) for c in DIMENSIONS]).alias("total"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a in DIMENSIONS for b in DIMENSIONS]).alias("cross"),
    ]


_ESTIMATE = "cell string, start string, center array<double>, covariance array<double>, precision array<double>, logdet double"


def _estimated(sums: DataFrame, floor: list[float]) -> DataFrame:
    """Estimates from the sums (cell, start, n, total, cross) of a group's rows; ``floor`` is a variance for each dimension."""
    k = len(DIMENSIONS)
    least = np.diag(floor)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for cell, start, n, total, cross in zip(*[frame[c] for c in ("cell", "start", "n", "total", "cross")], strict=True):
                mean = np.asarray(total, dtype=float) / n
                covariance = np.asarray(cross, dtype=float).reshape(k, k) / n - np.outer(mean, mean) + least
                inverse = np.linalg.inv(covariance)
                found.append((cell, start, mean.tolist(), covariance.ravel().tolist(), inverse.ravel().tolist(), np.linalg.slogdet(covariance)[1]))
            yield pd.DataFrame(found, columns=["cell", "start", "center", "covariance", "precision", "logdet"])

    return sums.select("cell", "start", "n", "total", "cross").mapInPandas(run, _ESTIMATE)


def _concentrate(rows: DataFrame, estimates: DataFrame, floor: list[float]) -> DataFrame:
    """Estimates from the nearest rows of each group under the given ones."""
    measured = rows.join(estimates, "cell").withColumn("distance", _distance("center", "precision"))
    near = measured.groupBy("cell", "start").agg(F.percentile_approx("distance", SUPPORT, PERCENTILE_ACCURACY).alias("radius"))
    measured = measured.join(near, ["cell", "start"]).filter("distance <= radius")
    return _estimated(measured.groupBy("cell", "start").agg(*_sums()), floor)


def _starts(rows: DataFrame, middle: DataFrame, floor: list[float]) -> DataFrame:
    """The estimates to begin with: absolute deviations, the covariance of all rows, and that of the directions from the median."""
    k = len(DIMENSIONS)
    away = [F.col(c) - F.col("middle")[i] for i, c in enumerate(DIMENSIONS)]
    spread = [1.4826 * F.percentile_approx(F.abs(a), 0.5, PERCENTILE_ACCURACY) for a in away]
    scale = [F.sqrt(F.col("spread")[i] * F.col("spread")[i] + F.lit(floor[i])) for i in range(k)]
    spreads = rows.join(middle, "cell").groupBy("cell").agg(F.array(*spread).alias("spread"))
    scales = stored(middle.join(spreads, "cell").select("cell", "middle", F.array(*scale).alias("scale")), "quality-scales")
    zero, one = F.lit(0.0), F.lit(1)

    def moments(start: str, n: Column, second: list[Column]) -> DataFrame:
        """As sums of n rows around the median."""
        m = [F.col("middle")[i] for i in range(k)]
        cross = [n * (second[i * k + j] + m[i] * m[j]) for i in range(k) for j in range(k)]
        return scales.select("cell", F.lit(start).alias("start"), n.alias("n"), F.array(*[n * x for x in m]).alias("total"), F.array(*cross).alias("cross"))

    own = [F.col("scale")[i] * F.col("scale")[i] if i == j else zero for i in range(k) for j in range(k)]
    by_deviations = moments("deviations", one, own)
    by_all = rows.groupBy("cell").agg(*_sums()).select("cell", F.lit("all").alias("start"), "n", "total", "cross")
    # each row counts by its direction alone, at the length of a usual one
    unit = rows.join(scales, "cell").withColumn("z", F.array(*[a / F.col("scale")[i] for i, a in enumerate(away)]))
    unit = unit.withColumn("length", reduce(lambda a, b: a + b, [F.col("z")[i] * F.col("z")[i] for i in range(k)])).filter("length > 0")
    turned = [k * F.avg(F.col("z")[i] * F.col("z")[j] / F.col("length")) for i in range(k) for j in range(k)]
    signs = unit.groupBy("cell").agg(F.array(*turned).alias("sign"))
    scales = stored(scales.join(signs, "cell"), "quality-signs")
    by_signs = moments("signs", one, [F.col("sign")[i * k + j] * F.col("scale")[i] * F.col("scale")[j] for i in range(k) for j in range(k)])
    columns = ["cell", "start", F.col("n").cast("long").alias("n"), "total", "cross"]
    return _estimated(by_deviations.select(columns).union(by_all.select(columns)).union(by_signs.select(columns)), floor)


def _least_determinants(rows: DataFrame, estimates: DataFrame, floor: list[float]) -> DataFrame:
    """(cell, center, covariance, precision) after the last step of the best start of each group."""
    moving, done = stored(estimates.withColumn("logdet", F.lit(None).cast("double")), "quality-start"), []
    for _ in range(MAX_STEPS):
        before = moving.select("cell", "start", F.col("logdet").alias("before"))
        after = stored(_concentrate(rows, moving, floor).join(before, ["cell", "start"]), "quality-estimates")
        falls = F.col("before").isNull() | (F.col("before") - F.col("logdet") > CONVERGED)
        done.append(after.filter(~falls).drop("before"))
        moving = after.filter(falls).drop("before")
        if not moving.limit(1).count():
            break
    found = reduce(DataFrame.union, [*done, moving])
    best = found.groupBy("cell").agg(F.min_by(F.struct("center", "covariance", "precision"), F.struct("logdet", "start")).alias("best"))
    return stored(best.select("cell", "best.*"), "quality-best")


def _scaled(rows: DataFrame, estimates: DataFrame, name: str) -> DataFrame:
    """Estimates whose covariance is wide enough for the nearest rows' share to lie inside its quantile."""
    measured = rows.join(estimates, "cell").withColumn("d", _distance("center", "precision"))
    factor = F.greatest(F.lit(1.0), F.percentile_approx("d", SUPPORT, PERCENTILE_ACCURACY) / chi_squared(SUPPORT, len(DIMENSIONS)))
    factors = measured.groupBy("cell").agg(factor.alias("factor"))
    wide = {"covariance": F.transform("covariance", lambda x: x * F.col("factor")), "precision": F.transform("precision", lambda x: x / F.col("factor"))}
    return stored(estimates.join(factors, "cell").withColumns(wide).select("cell", "center", *wide), name)


def _distances(rows: DataFrame, limit: float) -> DataFrame:
    """Adds ``distance``, over the limit, with the document's ``noise`` in its covariance; NULL without ``vector``. Drops what it read."""
    read = ("vector", "noise", "center", "covariance")
    kept = [c for c in rows.columns if c not in read]
    k = len(DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = pa.compute.is_valid(batch.column("vector"))
            used = batch.filter(here)
            vector, noise, center, covariance = (used.column(c).flatten().to_numpy(zero_copy_only=False) for c in read)
            away = (vector - center).reshape(-1, k, 1)
            matrix = covariance.reshape(-1, k, k) + noise.reshape(-1, k, 1) * np.eye(k)
            distance = np.zeros(batch.num_rows)
            mask = here.to_numpy(zero_copy_only=False)
            distance[mask] = (away * np.linalg.solve(matrix, away)).sum(axis=(1, 2)) / limit
            column = pa.array(distance, mask=~mask)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], column], [*kept, "distance"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    return map_batches(rows.select(*kept, *read), run, f"{head}, distance double")


def _cells(rows: DataFrame) -> DataFrame:
    """Groups with enough rows: language and source, else language, else all. One row a group."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    rest = sizes.filter(F.col("n") < MIN_GROUP).groupBy("lang").agg(F.sum("n").alias("rest")).withColumnRenamed("lang", "rest_lang")
    sizes = sizes.join(rest, F.col("lang").eqNullSafe(F.col("rest_lang")), "left")
    own = F.concat(F.lit("source:"), F.to_json(F.struct(F.isnull("lang"), lang, F.isnull("source"), source)))
    wider = F.concat(F.lit("lang:"), F.to_json(F.struct(F.isnull("lang"), lang)))
    cell = F.when(F.col("n") >= MIN_GROUP, own).when(F.col("rest") >= MIN_GROUP, wider).otherwise(F.lit("all"))
    return sizes.select(F.col("lang").alias("cell_lang"), F.col("source").alias("cell_source"), cell.alias("cell"))


def _floor(rows: DataFrame, middle: DataFrame) -> list[float] | None:
    """Least variance of each dimension: FLOOR of the median deviation in the corpus or, if that is less, of the median noise."""
    spread = [F.percentile_approx(F.abs(F.col(c) - F.col("middle")[i]), 0.5, PERCENTILE_ACCURACY) for i, c in enumerate(DIMENSIONS)]
    noise = [F.percentile_approx(F.col("noise")[i], 0.5, PERCENTILE_ACCURACY) for i in range(len(DIMENSIONS))]
    found = rows.join(middle, "cell").agg(F.array(*spread).alias("spread"), F.array(*noise).alias("noise")).first()
    if found["noise"][0] is None:
        return None
    return [FLOOR**2 * max((1.4826 * s) ** 2, n) for s, n in zip(found["spread"], found["noise"], strict=True)]


def quality_rules(docs: DataFrame, reject_probability: float = REJECT_PROBABILITY) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of each row.

    ``docs`` has doc_id, text, lang and source; other columns are not read. NULL
    and empty texts have no words and fail the base rules. Rows with NULL
    language or source are groups of their own. Repeated rows are judged one by
    one, and alike. ``distance`` is the squared distance over its rejection
    limit, NULL where the base rules failed.
    """
    statistics = stored(base_statistics(docs), "quality-statistics")
    passed = statistics.filter("not base_failed").withColumns(statistic_vector())
    cells = stored(_cells(statistics.filter("not base_failed")), "quality-cells")
    in_cell = F.col("lang").eqNullSafe(F.col("cell_lang")) & F.col("source").eqNullSafe(F.col("cell_source"))
    rows = passed.join(cells, in_cell)

    rows = stored(rows.select("cell", *DIMENSIONS, F.array(*counting_noise().values()).alias("noise")), "quality-vectors")

    middle = rows.groupBy("cell").agg(F.array(*[F.percentile_approx(c, 0.5, PERCENTILE_ACCURACY) for c in DIMENSIONS]).alias("middle"))
    middle = stored(middle, "quality-medians")
    floor = _floor(rows, middle)
    if floor is None:  # no row passed the base rules
        empty = statistics.withColumns({"kept": F.lit(False), "distance": F.lit(None).cast("double")})
        return empty.select("doc_id", *COUNTS[:5], "base_failed", "kept", "distance")
    rows = rows.drop("noise")
    estimates = _least_determinants(rows, _starts(rows, middle, floor), floor)

    # the nearest rows say too little of the others: the estimate is taken once more, from all rows that are usual under it
    measured = rows.join(_scaled(rows, estimates, "quality-scaled"), "cell").filter(_distance("center", "precision") <= chi_squared(USUAL, len(DIMENSIONS)))
    estimates = stored(_estimated(measured.groupBy("cell").agg(F.lit("usual").alias("start"), *_sums()), floor), "quality-usual")
    estimates = _scaled(rows, estimates, "quality-final").select("cell", "center", "covariance").join(cells, "cell")

    judged = statistics.withColumns(statistic_vector()).join(estimates, in_cell, "left")
    judged = judged.select(
        "doc_id", *COUNTS[:5], "base_failed", "center", "covariance",
        F.when(~F.col("base_failed"), F.array(*DIMENSIONS)).alias("vector"), F.array(*counting_noise().values()).alias("noise"),
    )
    judged = _distances(judged, chi_squared(1 - reject_probability, len(DIMENSIONS)))
    return judged.select(
        "doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("distance") <= 1)).alias("kept"), "distance"
    )
