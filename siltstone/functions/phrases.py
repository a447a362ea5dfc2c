"""Phrases of texts, a batch at a time: one pattern pass over the joined texts, all else on arrays."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.constants import MAX_PHRASE_WORDS, STOPWORDS

#: Characters that are worked on at a time.
BLOCK_CHARS = 2_000_000
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A word, a border (punctuation, or a hyphen between spaces), or the end of a text.
_PARTS = re.compile(rf"[^\W_]+(?:'[^\W\d_]+)?|[.,;:!?()\[\]{{}}\"“”|/\\–—]+|[{_SPACE}]-[{_SPACE}]|\0")
_NUMBER = "^[0-9]+$"
_STOP = list(STOPWORDS)


def normalize(text: str, compose: bool) -> str:
    """Lower case with straight apostrophes, composed (NFKC) unless it is known to be."""
    return (unicodedata.normalize("NFKC", text) if compose else text).lower().replace("’", "'").replace("‘", "'")


def _coded(texts: list[str | None], compose: bool) -> pa.DictionaryArray:
    """The words and borders of the texts, one after another; each text ends with \\0."""
    tokens = _PARTS.findall(normalize("\0".join([(t or "").replace("\0", "\1") for t in texts] + [""]), compose))
    return pa.array(tokens, pa.string()).dictionary_encode()


@dataclass
class Places:
    """The words of texts, one after another: arrays by place, but for known, the different words and borders."""

    known: pa.Array
    codes: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    stop: np.ndarray
    long: np.ndarray
    segment: np.ndarray

    @classmethod
    def of(cls, known: pa.Array, codes: np.ndarray) -> Places:
        """Of coded words and borders."""
        flag = lambda found: found.to_numpy(zero_copy_only=False)
        stop, number = flag(pc.is_in(known, pa.array(_STOP, pa.string()))), flag(pc.match_substring_regex(known, _NUMBER))
        owner, long = flag(pc.ends_with(known, "'s")), pc.utf8_length(known).to_numpy() >= 3
        word = np.fromiter((w[0].isalnum() for w in known.to_pylist()), bool, len(known))
        at = np.flatnonzero(word[codes])
        segment, text = np.cumsum(~word[codes], dtype=np.int32)[at], np.cumsum(flag(pc.equal(known, "\0"))[codes], dtype=np.int32)[at]
        codes = codes[at]
        return cls(known, codes, text, ~(stop | number)[codes], ~(stop | number | owner)[codes], stop[codes], long[codes], segment)

    def good(self, n: int, inner: bool) -> np.ndarray:
        """The places where a phrase of n words begins."""
        many = len(self.codes) - n + 1
        if many <= 0:
            return np.zeros(0, np.int64)
        good = self.first[:many] & self.last[n - 1 :] & (self.segment[:many] == self.segment[n - 1 :])
        if n == 1:
            good &= self.long
        for k in range(1, n - 1 if not inner else 1):
            good &= ~self.stop[k : k + many]
        return np.flatnonzero(good)


def _block(texts: list[str | None], inner: bool, compose: bool) -> tuple[pa.Array, np.ndarray]:
    """(phrases of all texts, one after another; how many each text has)."""
    coded = _coded(texts, compose)
    p = Places.of(coded.dictionary, coded.indices.to_numpy())
    found, place = [], []
    for n in range(MAX_PHRASE_WORDS):
        own = p.good(n + 1, inner)
        words = [p.known.take(pa.array(p.codes[own + k])) for k in range(n + 1)]
        found.append(words[0] if n == 0 else pc.binary_join_element_wise(*words, " "))
        place.append(own * MAX_PHRASE_WORDS + n)
    place = np.concatenate(place)
    order = np.argsort(place, kind="stable")
    phrases = pa.concat_arrays([x.cast(pa.string()) for x in found]).take(pa.array(order))
    return phrases, np.bincount(p.text[place // MAX_PHRASE_WORDS], minlength=len(texts))


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of some BLOCK_CHARS."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= BLOCK_CHARS or i == len(texts) - 1:
            yield texts[begin : i + 1]
            begin, held = i + 1, 0


def places(texts: list[str | None], compose: bool = True) -> Places:
    """The words of all texts, cut in bounded blocks."""
    coded = pa.chunked_array([_coded(x, compose) for x in _blocks(texts)], pa.dictionary(pa.int32(), pa.string())).unify_dictionaries().chunks
    return Places.of(coded[0].dictionary if coded else pa.array([], pa.string()), np.concatenate([x.indices.to_numpy() for x in coded] or [np.zeros(0, np.int32)]))


def phrase_lists(texts: list[str | None], inner: bool = True, compose: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(phrases of all texts, one after another; how many each text has), worked out in bounded blocks."""
    done = [_block(x, inner, compose) for x in _blocks(texts)]
    found, sizes = [x[0] for x in done], [x[1] for x in done]
    return pa.concat_arrays(found or [pa.array([], pa.string())]), np.concatenate(sizes or [np.zeros(0, np.int64)])


@cache
def _udf(inner: bool, compose: bool):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def phrases(texts: pa.Array) -> pa.Array:
        found, sizes = phrase_lists(texts.to_pylist(), inner, compose)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), found)

    return phrases


def phrase_array(c: Column, inner_stopwords: bool = True, compose: bool = True) -> Column:
    """All phrases of 1 to 4 words that stay within punctuation, in order and with repeats; none for null.

    The first and last word are no stopword and no number, the last is no possessive, a single word has 3 letters or more.
    Without inner_stopwords no word is a stopword. Runs in Arrow batches: as nested expressions it took three times as long.
    """
    return _udf(inner_stopwords, compose)(c)
