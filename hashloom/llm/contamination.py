"""Test passages inside a corpus: BM25 index of the test items, block-max WAND, exact check.

The index is an inverted index over units: windows of ``run + SLACK`` words of the test items, which
overlap so far that every run of ``run`` consecutive words lies in one. Its terms are ``TERM``
neighbouring words (a run shares all its terms, a chance text hardly any), and each posting
holds a BM25 impact (k1, b, idf over the units). A unit's impacts are divided by the least score that
any of its runs reaches, so a passage that holds such a run scores at least 1 on the unit: no
true case can fall below the threshold, and it is the same for all units.

Every document is cut into passages of as many words that overlap in the same way, and each
passage is a query, evaluated by block-max WAND: the cursors of its terms stand in order of their
units; the first at which the sum of the terms' greatest impacts reaches 1 is the pivot; if the sum
of the block maxima around it stays below 1, all cursors skip to the end of the nearest block, else
those before the pivot skip to it, and once all are there the unit is scored. A passage without a
pivot is done. Passages advance side by side. Retrieved (passage, unit) pairs, and no others, are
verified: the runs of the passage against the runs of the unit, word by word.

The index is broadcast. Items are taken in slices of at most ``SLICE_CHARS`` characters (measured
before), so its size is bounded whatever the number of test items. With several slices the corpus
is cut into words once and staged. The corpus isn't shuffled.

Defined results: null and empty texts match nothing; items shorter than ``run`` words
match nothing; a repeated document row or item gives one row; texts of any length are
read whole; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.words import words
from hashloom.runtime import Shared, stage

RUN = 15
K1, B = 1.2, 0.75
#: Words of a term; codes of three words of a slice's vocabulary fit a long.
TERM = 3
#: Words of a unit and of a passage beyond those of a run.
SLACK = 5
#: Postings of a block of a term's list.
BLOCK = 8
SLICE_CHARS = 4_000_000
#: Passages that advance side by side: bounds the memory of a task.
STEP = 20_000
#: Text handled at once.
STEP_BYTES = 1_000_000
#: A score of 1 but for rounding.
ENOUGH = 1 - 1e-9


@dataclass
class Index:
    """Inverted index; a unit is known by its number."""

    run: int
    vocabulary: dict[str, int]
    #: Sorted codes of the terms.
    terms: np.ndarray
    #: Postings in order of (term, unit): where each term's begin, the unit, the impact, ``term * units + unit``.
    start: np.ndarray
    unit: np.ndarray
    impact: np.ndarray
    key: np.ndarray
    #: Greatest impact of each term; block of each posting, and each block's greatest impact and last unit.
    term_max: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    block_last: np.ndarray
    #: Item of each unit, and its words as codes, -2 where it has none.
    items: list
    item_of: np.ndarray
    words: np.ndarray


def _windows(length: int, size: int, run: int) -> np.ndarray:
    """First word of each window over so many words; every run of ``run`` words lies in one."""
    stride = size - run + 1
    return np.arange(max(1, -(-(length - size) // stride) + 1)) * stride


def _term_codes(words: np.ndarray, base: int) -> np.ndarray:
    """Code of the term that begins at each word, down the first axis; -1 where a word of it is unknown."""
    size = len(words) - TERM + 1
    code, known = np.zeros((max(size, 0), *words.shape[1:]), np.int64), True
    for i in range(TERM):
        part = words[i : i + max(size, 0)]
        code = code * base + part
        known &= part >= 0
    return np.where(known, code, -1)


def build_index(items: list[tuple], run: int = RUN) -> Index | None:
    """Index of ``(item id, text)``; None if no item has ``run`` words."""
    if run < TERM:
        raise ValueError(f"a run has {TERM} words at least")
    vocabulary: dict[str, int] = {}
    size = run + SLACK
    found, numbers, item_of, units = {}, [], [], []
    for item, text in items:
        ws = words(text)
        if len(ws) < run:
            continue
        number = found.setdefault(item, len(found))
        if number == len(numbers):
            numbers.append(item)
        coded = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64)
        for begin in _windows(len(coded), size, run):
            own = coded[begin : begin + size]
            units.append(np.r_[own, np.full(size - len(own), -2)])
            item_of.append(number)
    if not units:
        return None
    held = np.array(units)
    base = len(vocabulary)
    codes = _term_codes(held.T, base).T
    row, place = np.nonzero(codes >= 0)
    terms, term = np.unique(codes[row, place], return_inverse=True)
    count = len(held)
    key, first, times = np.unique(term * count + row, return_index=True, return_counts=True)
    term_of, unit_of = key // count, key % count
    length = (held >= 0).sum(axis=1)
    holders = np.bincount(term_of, minlength=len(terms))
    idf = np.log(1 + (count - holders + 0.5) / (holders + 0.5))
    impact = idf[term_of] * times * (K1 + 1) / (times + K1 * (1 - B + B * length[unit_of] / length.mean()))
    # The least score of a unit's runs: each counts its distinct pairs once.
    at = np.full(codes.shape, -1)
    at[row, place] = np.searchsorted(key, term * count + row)
    least = np.full(count, np.inf)
    for begin in range(held.shape[1] - run + 1):
        own = np.sort(at[:, begin : begin + run - TERM + 1], axis=1)
        whole = own[:, 0] >= 0
        once = np.c_[np.ones(len(own), bool), own[:, 1:] != own[:, :-1]]
        least = np.where(whole, np.minimum(least, np.where(once, impact[own], 0).sum(axis=1)), least)
    impact = impact / least[unit_of]
    start = np.searchsorted(term_of, np.arange(len(terms) + 1))
    inside = np.arange(len(key)) - start[term_of]
    block = np.cumsum(inside % BLOCK == 0) - 1
    begins = np.flatnonzero(inside % BLOCK == 0)
    return Index(
        run, vocabulary, terms, start, unit_of, impact, key, np.maximum.reduceat(impact, start[:-1]),
        block, np.maximum.reduceat(impact, begins), unit_of[np.r_[begins[1:], len(key)] - 1], numbers, np.array(item_of), held,
    )


class _Cursors:
    """Cursors of several passages, a row of ``term`` each, -1 where a row has no more terms."""

    def __init__(self, index: Index, passage: np.ndarray, term: np.ndarray) -> None:
        self.index, self.passage, self.term = index, passage, term
        self.end = np.where(term >= 0, index.start[term + 1], 0)
        self.at = np.where(term >= 0, index.start[term], 0)
        self.done = len(index.item_of)  # greater than any unit
        self.top = np.where(term >= 0, index.term_max[term], 0.0)

    def units(self) -> np.ndarray:
        return np.where(self.at < self.end, self.index.unit[np.minimum(self.at, len(self.index.unit) - 1)], self.done)

    def first_from(self, unit: np.ndarray) -> np.ndarray:
        """Place of each cursor's first posting at or after its row's unit (its end if there is none)."""
        return np.minimum(np.searchsorted(self.index.key, self.term * self.done + unit[:, None]), self.end)

    def keep(self, rows: np.ndarray) -> None:
        self.passage, self.term, self.end, self.at, self.top = (x[rows] for x in (self.passage, self.term, self.end, self.at, self.top))


def _wand(index: Index, cursors: _Cursors) -> tuple[list, list]:
    """(passages, units) with a score of 1 or more."""
    passages, units = [], []
    last = len(index.unit) - 1
    while len(cursors.passage):
        unit = cursors.units()
        order = np.argsort(unit, axis=1)
        in_order = np.take_along_axis(unit, order, axis=1)
        reach = np.cumsum(np.where(in_order < cursors.done, np.take_along_axis(cursors.top, order, axis=1), 0.0), axis=1) >= ENOUGH
        alive = reach[:, -1]
        if not alive.all():
            cursors.keep(alive)
            unit, in_order, reach = unit[alive], in_order[alive], reach[alive]
            if not len(unit):
                break
        pivot = in_order[np.arange(len(unit)), reach.argmax(axis=1)]
        # Block maxima around the pivot, of the cursors that aren't past it.
        meant = unit <= pivot[:, None]
        target = cursors.first_from(pivot)
        there = meant & (target < cursors.end)
        block = index.block[np.minimum(target, last)]
        bound = np.where(there, index.block_max[block], 0.0).sum(axis=1)
        good = bound >= ENOUGH
        together = good & (np.where(meant, unit, pivot[:, None]) == pivot[:, None]).all(axis=1)
        # Score the pivot where all cursors before it have come to it; else bring them to it.
        own = meant & (unit == pivot[:, None])
        score = np.where(own, index.impact[np.minimum(cursors.at, last)], 0.0).sum(axis=1)
        hit = together & (score >= ENOUGH)
        passages.append(cursors.passage[hit])
        units.append(pivot[hit])
        # Where the bound is too small, nothing before the nearest block's end or the next cursor can reach 1.
        ends = np.where(there, index.block_last[block], cursors.done).min(axis=1) + 1
        following = np.where(meant, cursors.done, unit).min(axis=1)
        to = np.where(good, pivot + together, np.maximum(np.minimum(ends, following), pivot + 1))
        cursors.at = np.where(meant, np.maximum(cursors.at, cursors.first_from(to)), cursors.at)
    return passages, units


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (passage, unit) with a score of 1 or more, for distinct (passage, term) rows ordered by passage."""
    passages, units = [], []
    if len(term):
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        # The first pivot: most passages have none.
        bound = np.add.reduceat(index.term_max[term], first)
        width = np.diff(np.r_[first, len(term)])
        chosen = np.flatnonzero(bound >= ENOUGH)
        for begin in range(0, len(chosen), STEP):
            own = chosen[begin : begin + STEP]
            at = np.arange(width[own].max())
            places = np.minimum(first[own][:, None] + at, len(term) - 1)
            table = np.where(at < width[own][:, None], term[places], -1)
            found = _wand(index, _Cursors(index, passage[first[own]], table))
            passages += found[0]
            units += found[1]
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(passages or empty), np.concatenate(units or empty)


def _run_hashes(rows: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of each run of ``run`` words in each row."""
    size = rows.shape[1] - run + 1
    value = np.zeros((len(rows), size), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(run):
            value = value * np.uint64(0x9E3779B97F4A7C15) + rows[:, i : i + size].astype(np.uint64) + np.uint64(1)
            value ^= value >> np.uint64(29)
    return value


def verify(index: Index, windows: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, place in its window) of every run that a pair's window shares with its unit, compared word by word."""
    run, pairs, places = index.run, [], []
    steps = np.arange(run)
    for begin in range(0, len(units), 4096):
        mine, theirs = windows[begin : begin + 4096], index.words[units[begin : begin + 4096]]
        pair, place, other = np.nonzero(_run_hashes(mine, run)[:, :, None] == _run_hashes(theirs, run)[:, None, :])
        a, b = mine[pair[:, None], place[:, None] + steps], theirs[pair[:, None], other[:, None] + steps]
        same = ((a == b) & (a >= 0)).all(axis=1)
        pairs.append(pair[same] + begin)
        places.append(place[same])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(pairs or empty), np.concatenate(places or empty)


def search_texts(index: Index, texts: list[list[str]], counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(item number, text) and how many runs they share, of all texts given as words; ``counts`` gets what was retrieved."""
    run, code, base = index.run, index.vocabulary.get, len(index.vocabulary)
    size = run + SLACK
    stride = size - run + 1
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.fromiter((code(w, -1) for t in texts for w in t), np.int64, int(lengths.sum()))
    begin = np.r_[0, np.cumsum(lengths)[:-1]]
    passages = np.maximum(1, -(-(lengths - size) // stride) + 1)
    number = np.r_[0, np.cumsum(passages)]
    # Places of known terms, then the passages that hold each.
    codes = _term_codes(flat, base)
    at = np.flatnonzero(codes >= 0)
    term = np.searchsorted(index.terms, codes[at])
    term[term == len(index.terms)] = 0
    known = index.terms[term] == codes[at]
    at, term = at[known], term[known]
    text = np.searchsorted(begin, at, side="right") - 1
    at = at - begin[text]
    inside = at + TERM <= lengths[text]
    at, term, text = at[inside], term[inside], text[inside]
    low = np.maximum(0, -((size - TERM - at) // stride))
    high = np.minimum(at // stride, passages[text] - 1)
    several = high - low + 1
    offset = np.arange(several.sum()) - np.repeat(np.r_[0, np.cumsum(several)[:-1]], several)
    passage = np.repeat(number[text] + low, several) + offset
    rows = np.unique(passage * len(index.terms) + np.repeat(term, several))
    p, u = retrieve(index, rows // len(index.terms), rows % len(index.terms))
    owner = np.searchsorted(number, p, side="right") - 1
    first = begin[owner] + (p - number[owner]) * stride
    place = first[:, None] + np.arange(size)
    window = np.where(place < (begin + lengths)[owner][:, None], flat[np.minimum(place, len(flat) - 1)], -1)
    pairs, where = verify(index, window, u)
    if counts is not None:
        for name, more in (("passages", number[-1]), ("retrieved", len(np.unique(p))), ("pairs", len(p)), ("verified", len(np.unique(pairs)))):
            counts[name] = counts.get(name, 0) + int(more)
    # A run may lie in two passages and in two units: it counts once.
    most = int(lengths.max())
    runs = np.unique((index.item_of[u[pairs]] * len(texts) + owner[pairs]) * most + first[pairs] - begin[owner[pairs]] + where)
    return np.unique(runs // most, return_counts=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``STEP_BYTES`` of text, but for a longer single one: bounds the memory of a task."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP_BYTES, side="right"))
            end = max(end, start + 1)
            yield batch.slice(start, end - start)
            start = end


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, joined by blanks."""
    for batch in _slices(batches):
        texts = pa.array([" ".join(words(t.as_py())) for t in batch.column(1)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])


def _search(broadcast, kind: pa.DataType, cut: bool):
    """``cut``: texts are words joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = broadcast.value
        for batch in _slices(batches):
            texts, kept = [], []
            for row, text in enumerate(batch.column(1)):
                found = text.as_py().split() if cut else words(text.as_py())
                if len(found) >= index.run:
                    texts.append(found)
                    kept.append(row)
            if not texts:
                continue
            found, runs = search_texts(index, texts)
            if len(found):
                rows = np.array(kept)[found % len(texts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([index.items[i] for i in found // len(texts)], kind), batch.column(0).take(pa.array(rows)), pa.array(runs, pa.int64())], names=["item_id", "doc_id", "runs"]
                )

    return run


def leaks(items: DataFrame, item: str, item_text: str, docs: DataFrame, doc: str, doc_text: str, run: int = RUN) -> DataFrame:
    """``(item_id, doc_id, runs)``: documents that hold ``run`` or more consecutive words of an item, and how many such runs."""
    spark = docs.sparkSession
    sized = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"), F.length(item_text).alias("n")).where("item_id is not null and text is not null")
    chars = sized.agg(F.sum("n")).first()[0] or 0
    slices = max(1, -(-chars // SLICE_CHARS))
    texts = docs.select(F.col(doc).alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text is not null")
    kind, key = sized.schema["item_id"].dataType, texts.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"item_id {kind.simpleString()}, doc_id {key.simpleString()}, runs bigint"
    found = None
    if slices > 1:
        sized = stage(sized, "items")
        texts = stage(texts.mapInArrow(_cut, texts.schema), "words")
    for number in range(slices):
        own = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == number)
        index = build_index([(r[0], r[1]) for r in own.select("item_id", "text").collect()], run)
        if index is None:
            continue
        part = texts.mapInArrow(_search(Shared(spark, index), to_arrow_type(kind), slices > 1), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.groupBy("item_id", "doc_id").agg(F.max("runs").alias("runs"))
