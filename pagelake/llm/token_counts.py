"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each node has a failure link and the number
of pieces that are finished when the link is followed, so one pass over a
word's bytes gives the length of its greedy longest-match segmentation without
building a piece. Words are cut at ASCII white space; a word is matched with a
leading space, so that only pieces with a leading space can begin it, and pieces
without one continue it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.store import map_batches, tuned
from pagelake.llm.textbatch import U64, gather, slices, span_hashes


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file that can occur in a word, as bytes."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"] for t in content.get("added_tokens", [])}
    alphabet = byte_alphabet()
    found = [bytes(alphabet[c] for c in piece) for piece in content["model"]["vocab"] if piece not in special]
    blank = set(b" \t\n\v\f\r")
    return [p for p in found if p and not blank & set(p[1:]) and (p[0] == 0x20 or p[0] not in blank)]


class LongestMatch:
    """Trie with failure links and the counts of pieces that they finish."""

    ROOT = 0

    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                following = children[node].get(byte)
                if following is None:
                    following = children[node][byte] = len(children)
                    children.append({})
                    ends.append(False)
                node = following
            ends[node] = True
        link, pops, over = [-1] * len(children), [0] * len(children), [0] * len(children)
        level = [0]
        while level:
            deeper = []
            for node in level:
                for byte, child in children[node].items():
                    deeper.append(child)
                    if ends[child]:
                        link[child], pops[child] = 0, 1
                    else:  # finish pieces of what was read until the byte fits again
                        at, done = link[node], pops[node]
                        while at >= 0 and byte not in children[at]:
                            done += pops[at]
                            at = link[at]
                        # no piece covers this byte: the byte itself is one unknown token
                        link[child], pops[child] = (children[at][byte], done) if at >= 0 else (0, done + 1)
                    over[child] = pops[child] + over[link[child]]
            level = deeper
        self.link = np.array(link, dtype=np.int64)
        self.pops = np.array(pops, dtype=np.int64)
        self.over = np.array(over, dtype=np.int64)  # pieces when the word ends here
        self._index({node << 8 | byte: child for node, edges in enumerate(children) for byte, child in edges.items()})

    def _index(self, edges: dict[int, int]) -> None:
        """Edges in an open-addressing table, looked up for many states at once."""
        self.bits = max(4, (len(edges) * 2).bit_length())
        size = 1 << self.bits
        keys, values = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        left, target = np.array(list(edges), dtype=np.int64), np.array(list(edges.values()), dtype=np.int64)
        at = self._slot(left)
        while len(left):
            free = keys[at] < 0
            keys[at[free]] = left[free]  # of several for a slot the last stays
            placed = keys[at] == left
            values[at[placed]] = target[placed]
            left, target, at = left[~placed], target[~placed], (at[~placed] + 1) & (size - 1)
        self.keys, self.values = keys, values

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next state over a byte, -1 where there is no edge."""
        key = state << 8 | byte
        at = self._slot(key)
        found = self.keys[at]
        result = np.where(found == key, self.values[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        at, key = at[open_], key[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == key
            result[open_[hit]] = self.values[at[hit]]
            rest = ~hit & (found >= 0)
            open_, at, key = open_[rest], at[rest], key[rest]
        return result

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Pieces of each word, all words in step."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state = np.zeros(len(order), dtype=np.int64)
        done = np.zeros(len(order), dtype=np.int64)
        self._advance(state, done, np.full(len(order), 0x20, dtype=np.int64))
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # words longer than each position
        for position, n in enumerate(active):
            self._advance(state[:n], done[:n], data[starts[:n] + position].astype(np.int64))
        result = np.empty(len(order), dtype=np.int64)
        result[order] = done + self.over[state]
        return result

    def _advance(self, state: np.ndarray, done: np.ndarray, byte: np.ndarray) -> None:
        following = self.step(state, byte)
        fits = following >= 0
        left = np.flatnonzero(~fits)
        state[fits] = following[fits]
        while len(left):
            stuck = state[left] == self.ROOT
            done[left[stuck]] += 1  # a byte outside the vocabulary
            left = left[~stuck]
            done[left] += self.pops[state[left]]
            state[left] = self.link[state[left]]
            following = self.step(state[left], byte[left])
            fits = following >= 0
            state[left[fits]] = following[fits]
            left = left[~fits]


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    """Built once for each Python worker."""
    return LongestMatch(read_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens) of each row of ``docs``.

    ``vocabulary`` is the path of a byte-level vocabulary file on every machine.
    A NULL or empty text has 0 words and 0 tokens. Repeated rows and NULL keys
    stay as they are, one result for each row. A byte that no piece covers
    counts as one token. Other columns, whatever their names, are not read.
    No shuffle.
    """
    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton(vocabulary)
        for batch in batches:
            words, tokens = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for part in slices(batch.column(1)):
                starts, ends, document = part.words()
                _, first, each = np.unique(span_hashes(part.data, starts, ends), return_index=True, return_inverse=True)
                # the distinct words only, together, for the processor's cache
                lengths = (ends - starts)[first]
                content = gather(part.data, starts[first], lengths)
                counts = match.count(content, np.cumsum(lengths) - lengths, lengths)[each]
                rows = slice(part.first, part.first + len(part))
                words[rows] = np.bincount(document, minlength=len(part))
                tokens[rows] = np.bincount(document, weights=counts, minlength=len(part)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], ["k", "n_words", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    counted = map_batches(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, n_words long, n_tokens long")
    return counted.withColumnRenamed("k", key)
