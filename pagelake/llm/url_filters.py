"""URL filters: rules by host and path, and a model of segmented names for the rest.

Concatenated names in hosts and paths are split into words by the most probable
segmentation under unigram counts of the words on the pages themselves. A
multinomial naive Bayes model of the words of host and path judges the URLs that
no rule decides. It is fitted on all URLs of the table; a URL counts as unwanted
there if a word of its host is one of ``SEED_WORDS``.

Every distinct run of letters is split once. The words that can lie in it come
from a join on its substrings, so no word list is held in a task, and the model's
counts are summed by run of letters before they are summed by word.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.store import stored, tuned

ALLOW, BLOCK = "allow", "block"
#: (host, path prefix, verdict)
RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)
#: Longest word of a segmentation; a longer run of letters is split into shorter ones.
WORD_LETTERS = 20
#: Words by which each class is drawn towards all URLs.
SMOOTHING = 100.0
#: Words that name unwanted hosts, for the fit.
SEED_WORDS = (
    "ads", "adserver", "adult", "banner", "bet", "betting", "bingo", "casino", "cheap", "click", "clickbait", "crack", "doorway", "escort",
    "farm", "jackpot", "keygen", "loan", "lottery", "payday", "pharmacy", "pills", "poker", "popup", "porn", "replica", "sex", "slots",
    "spam", "track", "tracker", "viagra", "warez", "win", "xxx",
)
#: Runs of letters or digits of a URL.
RUN_PATTERN = r"\p{L}+|\p{N}+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A to Z) and path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (
        F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")),
        F.coalesce(path, F.lit("")),
    )


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or NULLs."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, decision in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def word_counts(texts: Column, frame: DataFrame) -> DataFrame:
    """(word, n) of the visible text of pages, in lower case; all pages count."""
    plain = F.lower(F.regexp_replace(texts, r"(?s)<[^>]*>", " "))
    words = frame.select(F.explode(F.regexp_extract_all(plain, F.lit(rf"\b\p{{L}}{{2,{WORD_LETTERS}}}\b"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def runs_of(text: Column) -> Column:
    """Runs of letters, in lower case, and of digits; runs of digits are alike by their length."""
    found = F.regexp_extract_all(F.lower(text), F.lit(RUN_PATTERN), F.lit(0))
    return F.transform(found, lambda r: F.when(r.rlike(r"^\p{N}"), F.concat(F.lit("#"), F.length(r).cast("string"))).otherwise(r))


def best_split(name: str, pieces: list[tuple[int, int, float]], unknown: float) -> list[str]:
    """Most probable words of a run of letters; ``pieces`` has (start, length, log-probability).

    A letter that no word covers costs ``unknown``; neighbouring such letters
    are one word. Of equally probable splits the one with the longest last word wins.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, length, value in pieces:
        ending.setdefault(start + length, []).append((length, value))
    best = [0.0] + [-math.inf] * len(name)
    taken = [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        best[end], taken[end] = best[end - 1] + unknown, -1
        for length, value in sorted(ending.get(end, [])):
            if best[end - length] + value >= best[end]:
                best[end], taken[end] = best[end - length] + value, length
    words, end, loose = [], len(name), ""
    while end:
        if taken[end] < 0:
            loose, end = name[end - 1] + loose, end - 1
            continue
        if loose:
            words.append(loose)
            loose = ""
        words.append(name[end - taken[end] : end])
        end -= taken[end]
    if loose:
        words.append(loose)
    return words[::-1]


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words) of distinct runs."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    unknown = -math.log(total + 1) - 3.0  # dearer than a word that was seen once
    logs = words.select("word", F.log(F.col("n") / F.lit(float(max(total, 1)))).alias("value"))
    spans = F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("run")),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(WORD_LETTERS), F.length("run") - i + 1)), lambda n: F.struct(i.alias("start"), n.alias("size"))),
    ))
    letters = runs.filter(~F.col("run").startswith("#"))
    parts = letters.select("run", F.explode(spans).alias("s")).select("run", "s.start", "s.size", F.substring(F.col("run"), F.col("s.start"), F.col("s.size")).alias("word"))
    found = parts.filter("size > 1").join(logs, "word").groupBy("run").agg(F.collect_list(F.struct("start", "size", "value")).alias("pieces"))
    rows = runs.join(found, "run", "left")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            result = []
            for run, pieces in zip(frame["run"], frame["pieces"], strict=True):
                if run.startswith("#"):
                    result.append([run])
                    continue
                known = [] if pieces is None else [(p["start"] - 1, p["size"], p["value"]) for p in pieces]
                result.append(best_split(run, known, unknown))
            yield pd.DataFrame({"run": frame["run"], "words": result})

    return rows.mapInPandas(split, "run string, words array<string>")


def url_filters(
    pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, seed_words: tuple[str, ...] = SEED_WORDS
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of ``pages`` (page_id, url, html).

    The longest rule that fits a URL decides; otherwise a positive ``score``
    (log-odds of block) blocks. NULL URLs and ones without :// have an empty host
    and path. A URL without a run of letters or digits, and all URLs when one of
    the classes has none, have score 0 and are allowed. NULL or empty html gives
    no words. Repeated rows and NULL ids stay and get the same
    verdict; other columns are not read.
    """
    tuned(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = stored(parsed.withColumns({"rule": rule, "ruled": verdict}), "url-rules")

    places = parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.first("ruled").alias("ruled"))
    places = stored(places.withColumns({"host_runs": runs_of(F.col("host")), "path_runs": runs_of(F.col("path"))}), "url-places")
    in_host = places.select("host", F.explode(F.array_distinct("host_runs")).alias("run")).distinct()
    runs = places.select(F.explode(F.concat("host_runs", "path_runs")).alias("run")).distinct()
    seeds = F.array(*map(F.lit, seed_words))
    words = word_counts(F.col("html"), pages).unionByName(pages.sparkSession.createDataFrame([(w, 1) for w in seed_words], "word string, n long"))
    words = stored(words.groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    split = segmented(runs, words).withColumn("seed", F.arrays_overlap("words", seeds))
    split = stored(split, "url-segments")

    # URLs of either class by run of letters, then by word
    unwanted = in_host.join(split.filter("seed").select("run"), "run").select("host").distinct().withColumn("unwanted", F.lit(1))
    labelled = places.join(unwanted, "host", "left").withColumn("unwanted", F.coalesce("unwanted", F.lit(0)))
    labelled = stored(labelled, "url-labels")
    by_run = labelled.select("n", "unwanted", F.explode(F.concat("host_runs", "path_runs")).alias("run")).groupBy("run").agg(
        F.sum(F.col("n") * F.col("unwanted")).alias("block"), F.sum(F.col("n") * (1 - F.col("unwanted"))).alias("allow")
    )
    by_word = by_run.join(split, "run").select("block", "allow", F.explode("words").alias("word"))
    by_word = stored(by_word.groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "url-word-counts")
    total = by_word.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    n = {row["unwanted"]: row["n"] for row in labelled.groupBy("unwanted").agg(F.sum("n").alias("n")).collect()}  # two rows at most
    if not n.get(1) or not n.get(0) or not total["block"] or not total["allow"]:
        score = parsed.withColumn("score", F.lit(0.0))
    else:
        common = (F.col("block") + F.col("allow")) / F.lit(float(total["block"] + total["allow"]))
        share = lambda c: (F.col(c) + SMOOTHING * common) / F.lit(total[c] + SMOOTHING)
        weights = by_word.select("word", F.log(share("block") / share("allow")).alias("weight"))
        run_scores = split.select("run", F.explode("words").alias("word")).join(weights, "word").groupBy("run").agg(F.sum("weight").alias("weight"))
        open_ = labelled.filter("ruled is null").select("host", "path", F.explode(F.concat("host_runs", "path_runs")).alias("run"))
        scores = open_.join(run_scores, "run").groupBy("host", "path")
        scores = scores.agg(F.round(F.sum("weight") + math.log(n[1] / n[0]), 6).alias("score"))
        score = parsed.join(scores, ["host", "path"], "left")
    judged = F.coalesce("ruled", F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW))
    return score.select("page_id", "host", "path", "rule", judged.alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))
