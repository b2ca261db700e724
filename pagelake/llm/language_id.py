"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word in a language is the sum over all ways to cut the word
into pieces, found by the forward algorithm; a text's languages are compared by
the sum of the logarithms over its words. The piece probabilities are fitted by
expectation and maximisation on a bounded sample of labelled rows; every whole
text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.store import map_batches, stored, tuned
from pagelake.llm.textbatch import U64, mix, slices, value_hashes

#: Labelled rows of each language that the fit reads.
SAMPLE_ROWS = 1000
#: Different words of each language, the most frequent of the sample, that the fit rests on.
SAMPLE_WORDS = 20_000
ROUNDS = 2
#: Letters of a word that are scored together; longer ones are cut into stretches of this length.
WORD_LETTERS = 32
#: Letters up to which a longer piece has a higher probability before the fit.
START_LETTERS = 8
#: Share of a language's probability that all pieces have alike.
SMOOTHING = 1e-3
#: Bytes of text that are scored together; a byte needs some dozens of bytes of work arrays.
MODEL_BYTES = 2 << 20
#: Words whose probabilities a worker remembers.
CACHED_WORDS = 300_000
WORD_MARK = "▁"
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and its lower case where that is one code point."""
    lower = np.arange(0x110000, dtype=np.uint32)
    is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    for i in np.flatnonzero(is_letter):
        small = chr(i).lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return is_letter, lower


class Vocabulary:
    """Pieces of letters in an open-addressing table of their hashes, for many substrings at once."""

    MULTIPLIER = U64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.bits = max(4, (len(pieces) * 4).bit_length())
        keys = np.array([self.key(p) for p in pieces], dtype=U64)
        self.keys = np.zeros(1 << self.bits, dtype=U64)  # 0: free
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        left, value = keys, np.arange(len(pieces), dtype=np.int32)
        at = self.slot(left)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = left[free]
            placed = self.keys[at] == left
            self.values[at[placed]] = value[placed]
            left, value, at = left[~placed], value[~placed], (at[~placed] + 1) & (len(self.keys) - 1)

    @classmethod
    def key(cls, piece: str) -> int:
        key = 0
        for c in piece:
            key = (key * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * self.MULTIPLIER) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these keys, -1 where there is none."""
        at = self.slot(key)
        found = self.keys[at]
        result = np.where(found == key, self.values[at], -1)
        open_ = np.flatnonzero((found != key) & (found != 0))
        at, key = at[open_], key[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == key
            result[open_[hit]] = self.values[at[hit]]
            rest = ~hit & (found != 0)
            open_, at, key = open_[rest], at[rest], key[rest]
        return result


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Lower-case pieces of letters of a sentencepiece model file, with or without the mark of a word's begin."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        core = piece.removeprefix(WORD_MARK)
        if (core == "" or core.isalpha()) and core == core.lower():
            found.add(piece)
    return Vocabulary(sorted(found))


class Words:
    """Different words as rows of code points, the mark of the begin first, longest words first."""

    def __init__(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order] + 1
        width = int(self.lengths[0]) if len(lengths) else 0
        self.points = np.zeros((width, len(lengths)), dtype=np.uint32)  # position first: a step reads one row
        self.points[:1] = ord(WORD_MARK)
        self.active = np.searchsorted(-self.lengths, -np.arange(width), side="left")  # words that have this position
        for j in range(1, width):
            n = self.active[j]
            self.points[j, :n] = points[starts[self.order[:n]] + j - 1]

    def pieces(self, known: Vocabulary, end: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, piece numbers) of the substrings that end at a position, for the words that have it."""
        n = self.active[end]
        key = np.zeros(n, dtype=U64)
        for length in range(1, min(known.longest, end + 1) + 1):
            power = U64(pow(0x100000001B3, length - 1, 1 << 64))
            key = key + (self.points[end - length + 1, :n].astype(U64) + U64(1)) * power
            yield length, known.find(key)


def forward(words: Words, known: Vocabulary, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Forward probabilities by position, and the probability of each word (in the order of ``words``) by language.

    ``table`` has a row for each piece and one more for a letter that is no
    piece, and a column for each language. No scaling is needed: a word has at
    most WORD_LETTERS letters and no probability is below SMOOTHING's share.
    """
    total = np.zeros((len(words.order), table.shape[1]))
    alpha = [np.ones_like(total)]
    for end, m in enumerate(words.active):
        here = np.zeros((m, table.shape[1]))
        for length, piece in words.pieces(known, end):
            if length == 1:
                here += alpha[end][:m] * table[piece]  # -1 is the last row
            else:
                hit = np.flatnonzero(piece >= 0)
                here[hit] += alpha[end + 1 - length][hit] * table[piece[hit]]
        alpha.append(here)
        done = words.lengths[:m] == end + 1
        total[:m][done] = here[done]
    return alpha, total


def fit(words: list[str], counts: np.ndarray, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (pieces + 1, languages) from word counts (words, languages) by expectation and maximisation."""
    known = vocabulary(path)
    points = np.array([ord(c) for w in words for c in w], dtype=np.uint32)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    chart = Words(points, np.cumsum(lengths) - lengths, lengths)
    counts = counts[chart.order]
    size, languages = len(known.pieces) + 1, counts.shape[1]
    # at first all languages are alike, and a piece is worth about its letters
    start = np.array([30.0 ** (min(len(p), START_LETTERS) - 1) for p in known.pieces] + [1.0])
    table = np.repeat(((1 - SMOOTHING) * start / start.sum() + SMOOTHING / size)[:, None], languages, axis=1)
    for _ in range(rounds):
        alpha, total = forward(chart, known, table)
        share = counts / total
        # probability of what follows a position, for the words that have it
        beta = [np.zeros_like(total), *[np.zeros((m, languages)) for m in chart.active]]
        expected = np.zeros_like(table)
        for end in range(len(chart.active), 0, -1):
            m = chart.active[end - 1]
            beta[end][:m][chart.lengths[:m] == end] = 1.0
            for length, piece in chart.pieces(known, end - 1):
                hit = np.arange(m) if length == 1 else np.flatnonzero(piece >= 0)
                step = table[piece[hit]] * beta[end][hit]
                np.add.at(expected, piece[hit], alpha[end - length][hit] * step * share[hit])
                beta[end - length][hit] += step
        mass = expected.sum(axis=0)
        table = (1 - SMOOTHING) * expected / np.where(mass > 0, mass, 1.0) + SMOOTHING / size
    return table


def batch_words(part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a slice in lower case; start, length and document of each stretch of letters."""
    is_letter, lower = letters()
    points = np.frombuffer(part.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    begins = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    offsets = begins[part.offsets]
    inside = is_letter[points]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    limits = offsets[1:-1]
    limits = limits[(limits > 0) & (limits < len(points))]
    first[limits] = inside[limits]
    last[limits - 1] = inside[limits - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    pieces = -(-(ends - starts) // WORD_LETTERS)  # stretches of a very long run of letters
    if len(pieces) and pieces.max() > 1:
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, ends = np.repeat(starts, pieces) + within * WORD_LETTERS, np.repeat(ends, pieces)
        ends = np.minimum(ends, starts + WORD_LETTERS)
    document = np.searchsorted(offsets, starts, side="right") - 1
    return lower[points], starts, ends - starts, document


class LanguageModel:
    """Languages and their piece probabilities; of the size of the vocabulary times the languages.

    A worker's copy remembers the probabilities of the last words it met in a
    partition, at most CACHED_WORDS of them; that saves work and changes no result.
    """

    def __init__(self, languages: list[str], table: np.ndarray, path: str):
        self.languages, self.table, self.path = languages, table, path
        self.forget()

    def forget(self) -> None:
        self.seen, self.logs = np.zeros(0, dtype=U64), np.zeros((0, len(self.languages)))

    def word_logs(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probabilities by language of different words, in ascending order of their hashes."""
        at = np.searchsorted(self.seen, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = at < len(self.seen)
        new[inside] = self.seen[at[inside]] != hashes[inside]
        result = np.empty((len(hashes), len(self.languages)))
        result[~new] = self.logs[at[~new]]
        words = Words(points, starts[new], lengths[new])
        fresh = np.empty((len(words.order), len(self.languages)))
        fresh[words.order] = np.log(forward(words, vocabulary(self.path), self.table)[1])
        result[new] = fresh
        if len(self.seen) + len(fresh) > CACHED_WORDS:
            self.forget()
            at = np.zeros(len(at), dtype=np.int64)
        if len(fresh) <= CACHED_WORDS:
            self.seen = np.insert(self.seen, at[new], hashes[new])
            self.logs = np.insert(self.logs, at[new], fresh, axis=0)
        return result

    def score(self, part) -> tuple[np.ndarray, np.ndarray]:
        """Per document of a slice the sum of its words' log-probabilities by language, and the number of words."""
        points, starts, lengths, document = batch_words(part)
        n = len(part)
        if not len(starts):
            return np.zeros((n, len(self.languages))), np.zeros(n, dtype=np.int64)
        hashes = value_hashes(points, lambda stretch: mix(stretch.astype(U64) + U64(1)), starts, starts + lengths)
        hashes, first, each = np.unique(hashes, return_index=True, return_inverse=True)
        logs = self.word_logs(hashes, points, starts[first], lengths[first])
        total = np.stack([np.bincount(document, weights=logs[each, i], minlength=n) for i in range(len(self.languages))], axis=1)
        return total, np.bincount(document, minlength=n)


def sample_words(labelled: DataFrame, sample_rows: int, sample_words: int) -> DataFrame:
    """(lang, word, n): the most frequent words of at most ``sample_rows`` rows of each language, chosen by hash."""
    # twice the rows that are needed, by hash, so that no language's rows stand in one task
    place = F.col("place") / F.lit(float(1 << 32))
    ids = labelled.select("doc_id", "lang", F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary")).alias("place"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("lang", "_lang")
    near = ids.join(F.broadcast(sizes), F.col("lang") == F.col("_lang")).filter(place * F.col("rows") < 2 * sample_rows)  # one row a language
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample_rows)
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    # at most ``sample_rows`` ids of each language
    rows = labelled.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    found = F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{1,{WORD_LETTERS}}}"), F.lit(0))
    counted = rows.select("lang", F.explode(found).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return counted.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= sample_words).drop("_n")


def fit_languages(labelled: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS) -> LanguageModel:
    """Model of the languages of ``labelled`` (doc_id, text, lang).

    A bounded sample: ``sample_rows`` rows and ``words`` words of each language.
    Rows without text, language or doc_id are left out.
    """
    usable = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null and doc_id is not null")
    rows = stored(sample_words(usable, sample_rows, words), "language-words").orderBy("lang", "word").collect()
    languages = sorted({r["lang"] for r in rows})
    names = sorted({r["word"] for r in rows})
    place, column = {w: i for i, w in enumerate(names)}, {c: i for i, c in enumerate(languages)}
    counts = np.zeros((len(names), len(languages)))
    for r in rows:
        counts[place[r["word"]], column[r["lang"]]] = r["n"]
    return LanguageModel(languages, fit(names, counts, path) if names else np.zeros((1, 0)), path)


def identify(docs: DataFrame, model: LanguageModel, extra: dict[str, Column] | None = None) -> DataFrame:
    """``docs``' columns doc_id and ``extra``, with lang_pred and score.

    ``score`` is the language's share of the probability when all languages are
    alike beforehand. NULL texts and texts without a letter, and all texts when
    the model has no language, get 'und' and 0. Ties go to the first language in
    alphabetical order. Each row is judged by its text alone, without a shuffle.
    """
    tuned(docs.sparkSession)
    extra = extra or {}
    chosen = docs.select("doc_id", *[c.alias(n) for n, c in extra.items()], F.col("text").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = model.languages
        names = np.array([*languages, UNDETERMINED], dtype=object)
        for batch in batches:
            best = np.full(batch.num_rows, len(languages), dtype=np.int64)
            score = np.zeros(batch.num_rows)
            for part in slices(batch.column(batch.num_columns - 1), MODEL_BYTES) if languages else ():
                logs, words = model.score(part)
                top = logs.max(axis=1)
                share = 1 / np.exp(logs - top[:, None]).sum(axis=1)
                rows = slice(part.first, part.first + len(part))
                best[rows] = np.where(words > 0, logs.argmax(axis=1), len(languages))
                score[rows] = np.where(words > 0, share, 0.0)
            columns = [*batch.columns[:-1], pa.array(names[best], type=pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])
        model.forget()

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_batches(chosen, run, f"{head}, lang_pred string, score double")
