"""Language assignment from trigram rank profiles (Cavnar and Trenkle 1994)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.fixed import LANGUAGE_CODES, MIN_LANGUAGE_BYTES, MIN_LANGUAGE_CONFIDENCE
from pagelake.functions.text import compute_once, utrim

PROFILE_SIZE = 300
CHARS_PER_COUNT = 1_000_000


def letters(text: Column | str) -> Column:
    """Lower-case letters with one blank between and around words."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


def language_code(code3: Column | str) -> Column:
    """Two-letter code of a three-letter one; other codes lower-cased as they are."""
    name = F.lower(F.col(code3) if isinstance(code3, str) else code3)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def _grams(plain: str) -> np.ndarray:
    """Trigrams of a text as numbers (three 21-bit code points), which sort like the trigrams."""
    points = np.frombuffer(plain.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    return (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]


def _gram_text(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def trigram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts per language of some rows (lang, plain) at a time; a map-side combine."""
    for rows in batches:
        for lang, texts in rows.groupby("lang")["plain"]:
            ends = texts.str.len().cumsum() // CHARS_PER_COUNT
            for _, part in texts.groupby(ends):
                codes, counts = np.unique(np.concatenate([_grams(t) for t in part]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": [_gram_text(int(c)) for c in codes], "n": counts})


def language_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """(lang, gram, rank): the most frequent trigrams per language, ties by trigram.

    Trigrams are counted inside each Arrow batch first, so the shuffle carries
    distinct trigrams per batch and not one row per character.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), letters(text).alias("plain"))
    counted = rows.mapInPandas(trigram_counts, "lang string, gram string, n bigint")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = totals.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)
    return ranked.select("lang", "gram", F.col("rank").cast("bigint").alias("rank"))


def _ranked_grams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, rank) of the ``size`` most frequent trigrams of each text; ties stay in trigram order."""
    grams = [_grams(t) for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    codes = np.concatenate([*grams, np.zeros(0, dtype=np.uint64)])
    order = np.lexsort((codes, text))
    text, codes = text[order], codes[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (codes[1:] != codes[:-1])])) if len(text) else text
    counts = np.diff(np.append(first, len(text)))
    text, codes = text[first], codes[first]
    order = np.lexsort((codes, -counts, text))
    text, codes = text[order], codes[order]
    rank = np.arange(len(text)) - np.searchsorted(text, text) + 1
    keep = rank <= size
    return text[keep], codes[keep], rank[keep]


def _scorer(profiles: dict[str, dict[str, int]], size: int):
    """Column function: the nearest language and the similarity of the two nearest."""
    tables = []
    for lang in sorted(profiles):
        ranked = sorted((int(_grams(gram)[0]), rank) for gram, rank in profiles[lang].items())
        codes, ranks = np.array(ranked, dtype=np.uint64).T
        tables.append((lang, codes, ranks.astype(np.int64)))
    names = np.array([lang for lang, _, _ in tables] or [None], dtype=object)

    def nearest(texts: list[str]) -> pd.DataFrame:
        text, codes, own = _ranked_grams(texts, size)
        found = np.zeros((max(1, len(tables)), len(texts)), dtype=np.int64)
        for i, (_, known, ranks) in enumerate(tables):
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            near = np.where(known[at] == codes, size - np.abs(ranks[at] - own), 0)
            found[i] = np.bincount(text, weights=near, minlength=len(texts))
        best = found.argmax(axis=0)  # the first in alphabetical order of equals
        ordered = np.sort(found, axis=0)
        second = ordered[-2] if len(found) > 1 else np.zeros(len(texts), dtype=np.int64)
        return pd.DataFrame({"lang": names[best], "best": ordered[-1], "second": second})

    @F.pandas_udf("lang string, best bigint, second bigint")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a bounded number of letters at a time, or one longer text
            plain = batch.fillna("").tolist()
            group = np.cumsum([len(t) for t in plain]) // CHARS_PER_COUNT
            parts = [nearest([plain[i] for i in np.flatnonzero(group == g)]) for g in np.unique(group)]
            yield pd.concat(parts, ignore_index=True) if parts else nearest([])

    return score


def assign_language(
    df: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE_SIZE, out: str = "language", max_languages: int = 200
) -> DataFrame:
    """Add the nearest profile's language and its confidence; NULL language for short or unclear texts.

    Every trigram of a text that a profile knows adds ``size`` minus its rank
    difference to the similarity (the out-of-place measure, counted from its
    worst value). Confidence is the lead over the second language,
    1 - second / best. Without profiles every language is NULL. The profiles (at most ``size`` rows per language) go to
    the tasks inside the function; documents are not shuffled.
    """
    rows = profiles.limit(size * max_languages + 1).collect()
    if len(rows) > size * max_languages:
        raise ValueError(f"more than {max_languages} language profiles")
    table: dict[str, dict[str, int]] = {}
    for lang, gram, rank in rows:
        table.setdefault(lang, {})[gram] = rank
    long_enough = F.octet_length(utrim(text)) >= MIN_LANGUAGE_BYTES
    plain = compute_once(df, {"_plain": F.when(long_enough, letters(text))})
    scored = plain.withColumn("_score", _scorer(table, size)("_plain")).drop("_plain")
    lead = F.lit(1.0) - F.try_divide(F.col("_score.second").cast("double"), F.col("_score.best").cast("double"))
    scored = scored.withColumn("confidence", F.coalesce(F.round(lead, 6), F.lit(0.0)))
    clear = F.col("confidence") >= MIN_LANGUAGE_CONFIDENCE
    return scored.withColumn(out, F.when(clear, F.col("_score.lang"))).drop("_score")
