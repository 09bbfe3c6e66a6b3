"""Evaluation texts inside training texts, found with an FM-index per training shard.

A shard is a run of documents of one input partition, held until it has enough
words; no text is shuffled. Its words become numbers and its suffixes are
sorted. The Burrows-Wheeler transform goes into a wavelet matrix, over which all
phrases of the evaluation items are searched backward at once. Where a phrase
occurs is read off sampled suffix positions, and the occurrences of an item in a
document are merged into spans.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.markup import TAG

#: Words of a phrase.
PHRASE = 13
#: Every so many text positions keep their place in the suffix order.
SAMPLE = 32

_JOINED = re.compile(r"(?<=\d)[.,](?=\d)|['’`­​‌‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+")
#: Characters of a text whose words are not made into a list.
LONG = 1_000_000


def _untagged(m: re.Match) -> str:
    """A blank for a tag, but for one long enough to hold a phrase: its words count."""
    return m.group() if len(_WORD.findall(m.group())) >= PHRASE else " "


def _plain(text: str) -> str:
    text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    return _JOINED.sub("", TAG.sub(_untagged, text) if "<" in text else text)


def words(text: str | None) -> list[str]:
    """Words of a text, whatever its letter case, punctuation, markup and spacing, and whichever way its characters are written. Null has none.

    Markup is what is surely a tag: an element's name alone, or a name with values
    given to attributes. Anything else between or beside angle brackets is text.
    """
    return _WORD.findall(_plain(text)) if text else []


def _numbers(text: str | None, number: dict[str, int], long: int = LONG) -> np.ndarray:
    """The text's words as numbers, 2 for words that no phrase has. A long text is never a list of its words."""
    if text and len(text) > long:
        return np.fromiter((number.get(m.group(), 2) for m in _WORD.finditer(_plain(text))), np.int64)
    return np.fromiter((number.get(x, 2) for x in words(text)), np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order, by prefix doubling over the groups that are still equal.

    ``text`` must end with a symbol that is less than all others and occurs once.
    """
    n = len(text)
    sa = np.argsort(text, kind="stable")
    new = np.concatenate(([True], text[sa][1:] != text[sa][:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    step = 1
    open_ = _shared(start)
    while len(open_):
        suffix = sa[open_]
        group = start[open_]
        follow = rank[np.minimum(suffix + step, n - 1)]
        order = np.argsort(group * n + follow, kind="stable")
        suffix, follow = suffix[order], follow[order]  # groups keep their places: open_ is in order
        sa[open_] = suffix
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])))
        start[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        rank[suffix] = start[open_]
        open_ = open_[_shared(start[open_])]
        step *= 2
    return sa


def _shared(group: np.ndarray) -> np.ndarray:
    """Places whose group has more than one member."""
    if len(group) < 2:
        return np.zeros(0, np.int64)
    same = group[1:] == group[:-1]
    return np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))


class FMIndex:
    """FM-index over a text of numbers, with a wavelet matrix for ranks and sampled suffix positions."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        sa = suffix_array(text)
        self.n, self.bwt = n, text[sa - 1]
        counts = np.bincount(text, minlength=symbols)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        column = self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (column >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            column = np.concatenate((column[bit == 0], column[bit == 1]))
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))  # where each symbol's block begins
        sampled = sa % SAMPLE == 0
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))
        self.places = sa[sampled]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = self.ones[i][at]
            at = np.where((symbol >> level) & 1, self.zeros[i] + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place of the transform."""
        return self._down(symbol, at) - self.start[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``phrases`` the range of suffixes that begin with it, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        open_ = np.arange(len(phrases))
        last = phrases[:, -1]
        l, h = self.first[last], self.first[last + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            some = l < h
            open_, l, h = open_[some], l[some], h[some]
            symbol = phrases[open_, j]
            l, h = self.first[symbol] + self.rank(symbol, l), self.first[symbol] + self.rank(symbol, h)
        low[open_], high[open_] = l, h
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by their place in the order."""
        out, steps = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        open_, row = np.arange(len(row)), row.copy()
        while len(open_):
            here = row[open_]
            known = self.sampled[here + 1] > self.sampled[here]
            done = open_[known]
            out[done] = self.places[self.sampled[row[done]]] + steps[done]
            open_ = open_[~known]
            symbol = self.bwt[row[open_]]
            row[open_] = self.first[symbol] + self.rank(symbol, row[open_])
            steps[open_] += 1
        return out


class Phrases:
    """The phrases of a set of items: numbers for their words, one row per different phrase, and whose they are."""

    def __init__(self, items: Sequence[tuple[int, str | None]], length: int = PHRASE):
        self.length = length
        self.number: dict[str, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        owner, phrase = [], []
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 3) for x in words(text)]
            for k in range(len(w) - length + 1):
                phrase.append(seen.setdefault(tuple(w[k : k + length]), len(seen)))
                owner.append(item)
        self.rows = np.array(list(seen), np.int64).reshape(len(seen), length)
        pairs = np.array(sorted(set(zip(phrase, owner))), np.int64).reshape(-1, 2)
        self.items = pairs[:, 1]
        self.items_from = np.searchsorted(pairs[:, 0], np.arange(len(seen) + 1))
        self.symbols = len(self.number) + 3  # 0 ends the text, 1 ends a document, 2 is any other word


class Shard:
    """Documents, or parts of a long one, gathered for one index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.docs: list[int] = []
        self.offsets: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int, part: np.ndarray, offset: int = 0) -> None:
        if len(part) >= self.phrases.length:
            self.docs.append(doc)
            self.offsets.append(offset)
            self.parts.append(part)
            self.size += len(part) + 1

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where phrases occur: document, item, and first word in the document."""
        p = self.phrases
        none = np.zeros(0, np.int64)
        if not self.docs or not len(p.rows):
            return none, none, none
        sizes = np.array([len(x) + 1 for x in self.parts])
        start = np.concatenate(([0], np.cumsum(sizes)))
        text = np.ones(start[-1] + 1, np.int64)
        for s, part in zip(start.tolist(), self.parts):
            text[s : s + len(part)] = part
        text[-1] = 0
        index = FMIndex(text, p.symbols)
        low, high = index.search(p.rows)
        found = np.flatnonzero(high > low)
        count = (high - low)[found]
        phrase = np.repeat(found, count)
        at = index.locate(np.repeat(low[found], count) + _within(count))
        which = np.searchsorted(start, at, side="right") - 1
        own = (p.items_from[1:] - p.items_from[:-1])[phrase]
        item = p.items[np.repeat(p.items_from[phrase], own) + _within(own)]
        first = at - start[which] + np.array(self.offsets, np.int64)[which]
        return np.repeat(np.array(self.docs, np.int64)[which], own), item, np.repeat(first, own)


def spans(hits: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> pa.RecordBatch:
    """``(doc_id, item_id, first_word, last_word)``: overlapping and touching occurrences of an item's phrases as one."""
    doc, item, first = (np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((first, item, doc))
    doc, item, first = doc[order], item[order], first[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (first[1:] - first[:-1] > length)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(doc))[: len(begins)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[begins]), pa.array(item[begins]), pa.array(first[begins]), pa.array(first[ends] + length - 1)], ["doc_id", "item_id", "first_word", "last_word"])


def _within(count: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each c, one after another."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def leaked_spans(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    phrase: int = PHRASE, shard_words: int = 600_000, block_chars: int = 20_000_000,
) -> DataFrame:
    """``(doc_id, item_id, first_word, last_word)``: stretches of a document that an item's phrases cover.

    A phrase is ``phrase`` successive words (see ``words``); overlapping and
    touching occurrences of an item's phrases make one span, counted in words of
    the document from 0.

    - Null, empty and shorter texts, on either side, hold nothing. Null ids are left out.
    - Repeated documents are each reported; repeated items too, by their ids.
    - A document of any length is searched whole: a long one in parts that overlap by a phrase less one word, its spans merged over them.
    - No documents or no items give no rows. Other columns are not read.

    Items are read to the driver in blocks of at most ``block_chars`` characters
    (or a single item) and each block is searched against all documents; the
    held-out set is a stated query set, small beside the corpus.
    """
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("item_id is not null and text is not null")
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    corpus = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null")
    out, spark = None, documents.sparkSession
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in block], phrase))  # of at most block_chars characters
        found = corpus.mapInArrow(_searcher(phrases, shard_words), "doc_id bigint, item_id bigint, first_word bigint, last_word bigint")
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(held: Broadcast, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = held.value
        overlap = phrases.length - 1
        shard = Shard(phrases)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = _numbers(text.as_py(), phrases.number)
                if len(w) > 2 * shard_words:
                    # Parts share all but one word of a phrase, so each occurrence lies in just one of them.
                    found = []
                    for at in range(0, len(w) - overlap, shard_words):
                        part = Shard(phrases)
                        part.add(doc, w[at : at + shard_words + overlap], at)
                        found.append(part.hits())
                    yield spans(found, phrases.length)
                    continue
                shard.add(doc, w)
                if shard.size >= shard_words:
                    yield spans([shard.hits()], phrases.length)
                    shard = Shard(phrases)
        if shard.size:
            yield spans([shard.hits()], phrases.length)

    return run
