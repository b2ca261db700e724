"""Token ids of whole texts by the tokenizers library, each different word encoded once by a worker.

A text is cut where no token of the library can span: before each run of ASCII
white space, or around it for a vocabulary that drops white space. The stretches
go to the library in batches and their ids are remembered, so a corpus costs one
encoding for each different word and worker, and the ids are those of the
library on the whole text.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pagelake.llm.textbatch import IS_SEPARATOR, LOWER, U64, Slice, slices, span_hashes, spans

#: Parts of words that a worker remembers.
CACHED_PARTS = 1_000_000
#: Bits of the number of places of the table that finds usual parts without a search.
PLACE_BITS = 19
#: Parts that are encoded in one call.
CALL = 20_000
#: Bytes of text that are encoded together.
TEXT_BYTES = 2 << 20

#: Kinds of bytes: runs of letters, of digits and of symbols never share a token.
LETTER, DIGIT, SYMBOL, OTHER = 1, 2, 3, 4
_KIND = np.full(256, OTHER, dtype=np.uint8)
_KIND[0x21:0x7F] = SYMBOL
_KIND[ord("'")] = OTHER  # it can join letters
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = LETTER
_KIND[IS_SEPARATOR] = 0


def kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte. The letters À to ÿ are letters, as no normal form changes them; further characters are OTHER."""
    found = _KIND[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < len(data)]
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    found[lead] = found[lead + 1] = LETTER
    bar = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    found[bar] = OTHER  # may begin a special token
    return found


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z and À to Þ in lower case."""
    small = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    small[lead] += 0x20
    return small


def parts(part: Slice, drops_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and start, end and document of the parts that the library encodes alike alone.

    A word whose characters leave a doubt is one part, with the white space
    before it if that counts.
    """
    data, blank = part.data, IS_SEPARATOR[part.data]
    word_starts, word_ends = spans(~blank, part.offsets)
    kind = kinds(data)
    others = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(kind == OTHER, out=others[1:])
    whole = others[word_ends] > others[word_starts]
    edges = np.zeros(len(data) + 1, dtype=np.int8)
    edges[word_starts[whole]] += 1
    np.subtract.at(edges, word_ends[whole], 1)
    in_whole = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = (kind[1:] != kind[:-1]) & ~in_whole[1:] & ~blank[1:]
    begins[word_starts] = True
    if drops_space:
        starts = np.flatnonzero(begins)
        after = np.append(starts[1:], len(data))[: len(starts)]
        leads = np.zeros(len(data), dtype=bool)
        leads[word_starts] = True
        word = np.cumsum(leads[starts]) - 1
        ends = np.minimum(after, word_ends[word]) if len(starts) else starts
        data = np.where(in_whole, data, lowered(data))
    else:
        filled = part.offsets[:-1] < part.offsets[1:]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[part.offsets[:-1][filled]] = True
        run = blank.copy()
        run[1:] &= ~blank[:-1] | first[1:-1]
        begins |= run | first[:-1]
        # the last blank before a word: a space belongs to the word, another one is a part of its own
        led = word_starts[(word_starts > 0) & ~first[word_starts]]
        led = led[blank[led - 1]]
        own = ~in_whole[led]
        begins[led[~own]] = False
        begins[led[own] - 1] = True
        begins[led[own & (data[led - 1] == 0x20)]] = False
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))[: len(starts)]
    return data, starts, ends, part.documents(starts)


def other_spaces(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII, which the library's patterns treat as white space."""
    at = np.flatnonzero(np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3)))
    at = at[at + 1 < len(data)]
    first, second = data[at], data[at + 1]
    third = data[np.minimum(at + 2, len(data) - 1)]
    found = (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
    found |= (first == 0xE1) & (second == 0x9A) & (third == 0x80)
    found |= (first == 0xE2) & (second == 0x80) & ((third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF)))
    found |= (first == 0xE2) & (second == 0x81) & (third == 0x9F)
    found |= (first == 0xE3) & (second == 0x80) & (third == 0x80)
    return at[found]


class WordTokens:
    """Ids of parts of words, kept between batches; parts are told apart by 64-bit hashes of their bytes.

    ``drops_space``: the vocabulary lower-cases and ignores white space; else it
    is byte-level, and a blank belongs to the word that follows.
    """

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        # calls are short and every core has a worker of its own: the library's threads would only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self._forget()

    def _forget(self) -> None:
        self.seen, self.codes = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int32)
        self.flat, self.starts = array("I"), array("Q", [0])
        self.placed, self.placed_codes = np.zeros(1 << PLACE_BITS, dtype=U64), np.zeros(1 << PLACE_BITS, dtype=np.int32)

    def _call(self, texts: list[str]) -> list[list[int]]:
        found = []
        for at in range(0, len(texts), CALL):
            encoded = self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)
            found.extend(e.ids for e in encoded)
        return found

    def _learn(self, texts: list[str]) -> np.ndarray:
        """Codes of parts that are not known yet."""
        first = len(self.starts) - 1
        for ids in self._call(texts):
            self.flat.extend(ids)
            self.starts.append(len(self.flat))
        return np.arange(first, first + len(texts), dtype=np.int32)

    def _search(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Codes of parts by all that is remembered; new ones are learned."""
        hashes, first, each = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.seen, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.seen)
        known[inside] = self.seen[at[inside]] == hashes[inside]
        codes = np.empty(len(hashes), dtype=np.int32)
        codes[known] = self.codes[at[known]]
        if not known.all():
            raw, new = data.tobytes(), first[~known]
            codes[~known] = self._learn([raw[a:b].decode("utf-8") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            self.seen = np.insert(self.seen, at[~known], hashes[~known])
            self.codes = np.insert(self.codes, at[~known], codes[~known])
        return codes[each]

    def _encode_slice(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        if len(self.seen) > CACHED_PARTS:
            self._forget()
        data, starts, ends, document = parts(part, self.drops_space)
        hashes = span_hashes(data, starts, ends)
        place = (hashes >> U64(64 - PLACE_BITS)).astype(np.int64)
        codes = self.placed_codes.take(place)
        rest = np.flatnonzero(self.placed.take(place) != hashes)
        if len(rest):
            codes[rest] = self._search(hashes[rest], data, starts[rest], ends[rest])
            self.placed[place[rest]], self.placed_codes[place[rest]] = hashes[rest], codes[rest]
        limits, flat = np.frombuffer(self.starts, dtype=np.int64), np.frombuffer(self.flat, dtype=np.uint32)
        own = limits.take(codes)
        lengths = limits.take(codes + 1) - own
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat.take(np.repeat(own - total[:-1], lengths) + np.arange(total[-1])) if len(flat) else np.zeros(0, dtype=np.uint32)
        counts = np.bincount(document, weights=lengths, minlength=len(part)).astype(np.int64)
        del limits, flat  # arrays that are looked at cannot grow
        if not self.drops_space:
            odd = np.unique(np.searchsorted(part.offsets, other_spaces(part.data), side="right") - 1)
            if len(odd):
                ids, counts = self._whole(part, odd.tolist(), ids, counts)
        return ids, counts

    def _whole(self, part: Slice, odd: list[int], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with those of some documents replaced by the library's for the whole text."""
        texts = [part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().decode("utf-8") for i in odd]
        limits = np.concatenate([[0], np.cumsum(counts)])
        pieces, at = [], 0
        for i, own in zip(odd, self._call(texts), strict=True):
            pieces += [ids[at : limits[i]], np.array(own, dtype=np.uint32)]
            counts[i], at = len(own), limits[i + 1]
        return np.concatenate([*pieces, ids[at:]]), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; NULL has none."""
        found = [self._encode_slice(part) for part in slices(texts, TEXT_BYTES)]
        if not found:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        return np.concatenate([ids for ids, _ in found]), np.concatenate([counts for _, counts in found])


@lru_cache(maxsize=2)
def word_tokens(path: str, drops_space: bool) -> WordTokens:
    """One for each Python worker."""
    return WordTokens(path, drops_space)
