"""Language of documents and of their segments by rank-order profiles.

A profile is a language's most frequent letter n-grams (1 to 4 letters within words,
without case and accents, of any script) in order of frequency. A text is compared with a profile by
the out-of-place distance: the sum over its own most frequent n-grams of how far the
rank in the text is from the rank in the profile, with the greatest distance for an
n-gram the profile lacks; equal counts share their mean rank.

Documents are cut into clauses at punctuation. Each clause has its distance to every
language; the sequence of languages with the least total distance is found, where
each change costs ``SWITCH``, so that a clause too short to tell follows its neighbours. A clause
most of whose letters no profile knows is in no language known here (``und``). Runs of
clauses in one language are the segments, and each is compared with the profiles again
as a whole: its confidence is how much nearer the named language is than the next one,
from 0 (no nearer) to 1. A language's share is that of the characters of its segments; the
main language has most characters, ties going to the first code in alphabetical order.

Profiles are fitted on at most ``TRAIN_ROWS`` labelled rows (those with the smallest ids).
Everything else is one pass over all documents, whole texts, without a shuffle. Texts
are read in steps of bounded size, and neither what shares a step with a text nor where steps end in it
changes its result: a step ends at white space, and a clause that goes on waits for the rest. Memory
grows with the longest run of letters without white space alone.

Defined results: null and empty texts, and texts without any letter, have
no language and give no row; a segment in no language known here is ``und`` with confidence 0, whatever its script;
texts of any length are read whole; repeated rows give their
rows each; labels that name no language known here count as missing; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.runtime import Shared

TRAIN_ROWS = 20_000
LONGEST = 4
#: n-grams of a profile, and of a text that are compared with it.
PROFILE = 2000
#: Cost of a change of language, in n-grams of greatest distance.
SWITCH = 3.0
#: Characters handled at once, but for a longer single word.
STEP_CHARS = 250_000
UNKNOWN = "und"

_GAP, _CUT, _DROP = 0, -1, -2
_LATIN = 26
_ENDS = frozenset(".!?;:,()[]{}–—…«»“”„\"¡¿。，、；：！？（）「」『』【】《》؟،؛।॥·՝։")
#: Letters without a decomposition that stand for others.
_BASES = {"ß": "s", "æ": "a", "œ": "o", "ø": "o", "ł": "l", "đ": "d"}


def _symbol(char: str) -> int:
    """1..26 for letters that reduce to a..z, above 26 for other letters, else one of the marks."""
    if unicodedata.combining(char):
        return _DROP
    if char in _ENDS:
        return _CUT
    apart = unicodedata.normalize("NFKD", char)
    base = apart[:1].lower()
    base = _BASES.get(base, base)
    if "a" <= base <= "z":
        return ord(base) - 96
    if unicodedata.category(char) not in ("Lu", "Ll", "Lt", "Lm", "Lo", "Mc", "Mn"):
        return _GAP
    # Without case and accents; syllables and the like stay as they are.
    plain = base if all(map(unicodedata.combining, apart[1:])) else char.lower()
    return _LATIN + ord(plain[:1])


_TABLE = np.array([_symbol(chr(c)) for c in range(0x3000)], np.int32)


def _symbols(points: np.ndarray) -> np.ndarray:
    found = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    far = np.flatnonzero(points >= len(_TABLE))
    if len(far):
        own, place = np.unique(points[far], return_inverse=True)
        found[far] = np.array([_symbol(chr(c)) for c in own], np.int32)[place]
    return found


@dataclass
class Profiles:
    languages: list[str]
    #: Number of an n-gram of a..z among those of all profiles, by its code, or -1; of others, by their sorted hashes.
    number: np.ndarray
    hashes: np.ndarray
    hash_number: np.ndarray
    #: Twice the rank of each n-gram in each language (a row), far above ``PROFILE`` where it has none.
    ranks: np.ndarray

    @property
    def grams(self) -> int:
        return self.ranks.shape[1]


@dataclass
class _Units:
    """Clauses of some texts: the letters with gaps and their clauses, then text, first character of each clause."""

    stream: np.ndarray
    unit: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    #: Does a clause end before the first letter, and after the last?
    lead: bool
    trail: bool


def _units(texts: list[str]) -> _Units:
    # A gap after each text: what shares a step with it doesn't touch it.
    points = np.frombuffer("".join(f"{t}\0" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts])
    symbols = _symbols(points)
    letter = symbols > 0
    ends = symbols == _CUT
    places = np.flatnonzero(letter)
    if not len(places):
        empty = np.zeros(0, np.int64)
        return _Units(empty, empty, empty, empty, bool(ends.any()), False)
    cut = np.cumsum(ends)
    text = np.repeat(np.arange(len(texts)), lengths)
    # A clause begins at a text's start and at the first letter after a cut.
    new = np.r_[True, (cut[places[1:]] != cut[places[:-1]]) | (text[places[1:]] != text[places[:-1]])]
    begin = places[new]
    owner = text[begin]
    first = begin - (np.r_[0, np.cumsum(lengths)[:-1]])[owner]
    kept = symbols != _DROP
    stream = np.where(letter, symbols, 0)[kept]
    at = np.flatnonzero(kept)
    unit = np.maximum(np.searchsorted(begin, at, side="right") - 1, 0)
    # One gap between words is enough.
    solid = np.r_[True, (stream[1:] > 0) | (stream[:-1] > 0)]
    return _Units(stream[solid], unit[solid], owner, first, bool(cut[places[0]]), bool(cut[-1] > cut[places[-1]]))


def _grams(stream: np.ndarray, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length (length, clause, symbols as columns' places in the padded stream, that stream) of n-grams; a gap may only begin or end one."""
    padded = np.r_[0, stream, 0].astype(np.int64)
    units = np.r_[unit[:1], unit, unit[-1:]]
    solid = padded > 0
    for n in range(1, LONGEST + 1):
        size = len(padded) - n + 1
        if size <= 0:
            return
        ok = solid[:size].copy() if n == 1 else solid[:size] | solid[1 : 1 + size]
        for i in range(1, n - 1):
            ok &= solid[i : i + size]
        at = np.flatnonzero(ok)
        # The clause of the last letter: a gap at the end belongs to the word before it.
        last = at + n - 1
        own = units[np.where(solid[last], last, np.maximum(last - 1, 0))]
        yield n, own, at, padded


def _latin_codes(n: int, at: np.ndarray, padded: np.ndarray) -> np.ndarray:
    whole = np.zeros(len(padded) - n + 1, np.int64)
    for i in range(n):
        whole = whole << 5 | padded[i : i + len(whole)]
    return whole[at] + (n - 1 << 20)


def _hash_codes(n: int, at: np.ndarray, padded: np.ndarray) -> np.ndarray:
    value = np.full(len(at), n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            value = (value ^ padded[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(32)
    return value


def _coded(stream: np.ndarray, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(length, clause, code, whether codes are hashes) of all n-grams: those of a..z by code, others by hash."""
    plain = not (stream > _LATIN).any()
    for n, own, at, padded in _grams(stream, unit):
        if plain:
            yield n, own, _latin_codes(n, at, padded), False
            continue
        other = np.zeros(len(at), bool)
        for i in range(n):
            other |= padded[at + i] > _LATIN
        yield n, own[~other], _latin_codes(n, at[~other], np.where(padded > _LATIN, 0, padded)), False
        yield n, own[other], _hash_codes(n, at[other], padded), True


def fit_profiles(samples: list[tuple[str, str]]) -> Profiles:
    """Profiles from ``(language, text)``."""
    languages = sorted({lang for lang, _ in samples})
    tops: list[list[tuple]] = []
    for lang in languages:
        found = _units([t for other, t in samples if other == lang])
        counted: list[tuple] = []
        for _, _, codes, hashed in _coded(found.stream, found.unit) if len(found.stream) else ():
            own, counts = np.unique(codes, return_counts=True)
            counted += [(-c, hashed, g) for g, c in zip(own.tolist(), counts.tolist(), strict=True)]
        tops.append([(hashed, g) for _, hashed, g in sorted(counted)[:PROFILE]])
    every = {gram: i for i, gram in enumerate(sorted({g for top in tops for g in top}))}
    table = np.full(LONGEST << 20, -1, np.int32)
    hashes = np.array(sorted(g for hashed, g in every if hashed), np.uint64)
    for (hashed, gram), number in every.items():
        if not hashed:
            table[gram] = number
    ranks = np.full((len(languages), len(every)), 8 * PROFILE, np.int16)
    for row, top in enumerate(tops):
        ranks[row, [every[g] for g in top]] = 2 * np.arange(len(top))
    return Profiles(languages, table, hashes, np.array([every[True, g] for g in hashes.tolist()], np.int32), ranks)


def _numbered(profiles: Profiles, found: _Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(clause, number of each n-gram that a profile has; letters of each clause, those no profile has)."""
    units, numbers = [], []
    letters, strange = np.zeros(len(found.owner), np.int64), np.zeros(len(found.owner), np.int64)
    for n, own, codes, hashed in _coded(found.stream, found.unit):
        if hashed:
            place = np.searchsorted(profiles.hashes, codes)
            place[place == len(profiles.hashes)] = 0
            number = np.where(profiles.hashes[place] == codes, profiles.hash_number[place], -1) if len(profiles.hashes) else np.full(len(codes), -1)
        else:
            number = profiles.number[codes]
        known = number >= 0
        if n == 1:
            letters += np.bincount(own, minlength=len(letters))
            strange += np.bincount(own[~known], minlength=len(letters))
        units.append(own[known])
        numbers.append(number[known])
    return np.concatenate(units), np.concatenate(numbers).astype(np.int64), letters, strange


def _counted(profiles: Profiles, group: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group and number of each n-gram as one sorted key; how often it occurs)."""
    every = np.sort(group.astype(np.int64) * profiles.grams + number)
    if not len(every):
        return every, every
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[first], np.diff(np.r_[first, len(every)])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    width = int(counts.max()).bit_length()
    if int(keys.max()).bit_length() + width < 63:
        packed = np.sort(keys << width | counts)
        keys, counts = packed >> width, packed & ((1 << width) - 1)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def distances(profiles: Profiles, keys: np.ndarray, counts: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(out-of-place distance of each group to each language in units of the greatest one, n-grams compared), for sorted keys."""
    size = len(profiles.languages)
    total, compared = np.zeros((groups, size)), np.zeros(groups)
    if not len(keys):
        return total, compared
    grams = profiles.grams
    owner = keys // grams
    gram = keys - owner * grams
    # Most frequent first within each group, by one sort of a number that holds all.
    most = int(counts.max())
    wide, deep = grams.bit_length(), most.bit_length()
    if groups.bit_length() + wide + deep < 63:
        packed = np.sort((owner << deep | (most - counts)) << wide | gram)
        gram = packed & ((1 << wide) - 1)
        packed >>= wide
        owner = packed >> deep
    else:
        order = np.argsort(owner * (most + 1) + (most - counts), kind="stable")
        gram, owner = gram[order], owner[order]
        packed = owner * (most + 1) + (most - counts[order])
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = np.arange(len(gram)) - np.repeat(start, np.diff(np.r_[start, len(gram)]))
    tie = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    widths = np.diff(np.r_[tie, len(gram)])
    # Ranks are doubled, so that the mean of an even number of them is whole.
    rank = np.repeat(np.minimum(2 * place[tie] + widths - 1, 2 * PROFILE).astype(np.int16), widths)
    if int(place.max()) >= PROFILE:
        most_frequent = place < PROFILE
        gram, rank, owner = gram[most_frequent], rank[most_frequent], owner[most_frequent]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for lang in range(size):
        # A missing n-gram's rank is so far off that its distance is cut to the greatest.
        away = profiles.ranks[lang].take(gram)
        away -= rank
        np.abs(away, out=away)
        np.minimum(away, np.int16(2 * PROFILE), out=away)
        total[owner[start], lang] = np.add.reduceat(away, start, dtype=np.int64) / (2 * PROFILE)
    compared[owner[start]] = np.diff(np.r_[start, len(gram)])
    return total, compared


_SPACE = re.compile(r"\s")


@dataclass
class _Step:
    """Whole texts, or one piece of a longer one."""

    texts: list[str]
    number: int
    begin: int = 0
    #: Does the first text go on from the step before, and the last in the next?
    goes_on: bool = False
    open: bool = False


def _steps(texts: list[str]) -> Iterator[_Step]:
    """Steps of at most ``STEP_CHARS``; a longer text comes in pieces that begin at white space, if need be longer ones."""
    start = 0
    while start < len(texts):
        text = texts[start]
        if len(text) > STEP_CHARS:
            at = 0
            while at < len(text):
                end = len(text)
                if end - at > STEP_CHARS:
                    end = max(text.rfind(" ", at + 1, at + STEP_CHARS), text.rfind("\n", at + 1, at + STEP_CHARS))
                    if end < 0:
                        later = _SPACE.search(text, at + STEP_CHARS)
                        end = later.start() if later else len(text)
                yield _Step([text[at:end]], start, at, at > 0, end < len(text))
                at = end
            start += 1
            continue
        end, chars = start, 0
        while end < len(texts) and len(texts[end]) <= STEP_CHARS and (end == start or chars + len(texts[end]) <= STEP_CHARS):
            chars += len(texts[end])
            end += 1
        yield _Step(texts[start:end], start)
        start = end


def best_sequences(cost: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Language of each clause: the cheapest sequence in each text, texts advancing side by side."""
    n, size = cost.shape
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    lengths = np.diff(np.r_[first, n])
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    back = np.zeros((n, size), np.int16)
    state = cost[first].copy()
    final = np.zeros((len(first), size))
    active = len(first)
    for step in range(1, int(lengths[0]) + 1):
        still = int(np.searchsorted(-lengths, -step, side="left"))
        final[still:active] = state[still:active]
        active = still
        if not active:
            break
        state = state[:active]
        cheapest = state.argmin(axis=1)
        jump = state[np.arange(active), cheapest] + SWITCH
        stay = state <= jump[:, None]
        at = first[:active] + step
        back[at] = np.where(stay, np.arange(size), cheapest[:, None])
        state = np.where(stay, state, jump[:, None]) + cost[at]
    found = np.zeros(n, np.int64)
    now = final.argmin(axis=1)
    for step in range(int(lengths[0]) - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -step, side="left"))
        at = first[:live] + step
        found[at] = now[:live]
        now[:live] = back[at, now[:live]]
    return found


def segment_texts(profiles: Profiles, texts: list[str]):
    """(text, first character, characters, language number, confidence) of every segment, in order; the number is -1 in no language known here.

    Where the texts take several steps, n-grams are counted again for the segments, so memory doesn't grow with a text's n-grams.
    """
    grams, size = profiles.grams, len(profiles.languages)
    none = np.zeros(0, np.int64)
    costs, owners, firsts, letters, strange = [], [], [], [none], [none]
    places, count, done, held, cut, latest = [], 0, 0, (none, none), False, -1
    steps = list(_steps(texts))
    for step in steps:
        found = _units(step.texts)
        if not len(found.owner):
            cut = (cut and step.goes_on) or found.lead
            places.append((none, none) if len(steps) == 1 else None)
            continue
        # Is its first clause the last one of the step before?
        joined = step.goes_on and latest == step.number and not (cut or found.lead)
        cut, latest = found.trail, step.number + int(found.owner[-1])
        offset = count - joined
        unit, number, whole, odd = _numbered(profiles, found)
        if joined:
            letters[-1][-1] += whole[0]
            strange[-1][-1] += odd[0]
        if len(found.owner) > joined:
            for held_back, own in ((letters, whole), (strange, odd), (owners, step.number + found.owner), (firsts, step.begin + found.first)):
                held_back.append(own[joined:])
        count = offset + len(found.owner)
        keys, counts = _counted(profiles, offset + unit, number)
        places.append((keys, counts) if len(steps) == 1 else offset)
        if len(held[0]):
            keys, counts = _summed(np.r_[held[0], keys], np.r_[held[1], counts])
        # A clause that may go on waits for the next step.
        upto = count - step.open
        split = int(np.searchsorted(keys, upto * grams))
        held = keys[split:], counts[split:]
        costs.append(distances(profiles, keys[:split] - done * grams, counts[:split], upto - done)[0])
        done = upto
    if done < count:
        costs.append(distances(profiles, held[0] - done * grams, held[1], count - done)[0])
    if not count:
        return none, none, none, none, np.zeros(0)
    owner, first, letters, strange = (np.concatenate(x) for x in (owners, firsts, letters, strange))
    # Clauses in letters that no profile knows are in no language, and no others are.
    foreign = strange * 2 > letters
    cost = np.c_[np.where(foreign[:, None], 1e12, np.concatenate(costs)), np.where(foreign, 0.0, 1e12)]
    lang = best_sequences(cost, owner)
    new = np.r_[True, (owner[1:] != owner[:-1]) | (lang[1:] != lang[:-1])]
    segment = np.cumsum(new) - 1
    text, begin, number = owner[new], first[new], lang[new]
    begin[np.r_[True, text[1:] != text[:-1]]] = 0
    lengths = np.array([len(t) for t in texts])
    end = np.r_[begin[1:], 0]
    last = np.r_[text[1:] != text[:-1], True]
    end = np.where(last, lengths[text], end)
    whole, compared = np.zeros((len(text), size)), np.zeros(len(text))
    if len(steps) == 1:
        keys, counts = places[0]
        clause = keys // grams
        keys, counts = _summed(segment[clause] * grams + (keys - clause * grams), counts)
        whole, compared = distances(profiles, keys, counts, len(text))
    else:
        held = (none, none)
        lettered = [i for i, offset in enumerate(places) if offset is not None]
        for i in lettered:
            step, offset = steps[i], places[i]
            unit, gram, _, _ = _numbered(profiles, found := _units(step.texts))
            keys, counts = _counted(profiles, segment[offset + unit], gram)
            if len(held[0]):
                keys, counts = _summed(np.r_[held[0], keys], np.r_[held[1], counts])
            # A segment that goes on in the next step waits for it.
            after = offset + len(found.owner)
            ready = int(segment[after - 1]) + (i == lettered[-1])
            split = int(np.searchsorted(keys, ready * grams))
            held = keys[split:], counts[split:]
            if split:
                low = int(keys[0]) // grams
                part = distances(profiles, keys[:split] - low * grams, counts[:split], ready - low)
                held_rows = part[1] > 0
                whole[low:ready][held_rows], compared[low:ready][held_rows] = part[0][held_rows], part[1][held_rows]
    at = np.arange(len(text))
    number = np.where((number < size) & (compared > 0), number, -1)
    own = np.where(number < 0, 0, number)
    others = whole.copy()
    others[at, own] = np.inf
    nearest = others.min(axis=1) if size > 1 else np.maximum(compared, 1)
    confidence = np.where(number < 0, 0.0, np.clip((nearest - whole[at, own]) / np.maximum(nearest, 1e-9), 0, 1))
    return text, begin, end - begin, number, confidence


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch in parts of bounded size."""
    texts = batch.column(1).to_pylist()
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars + len(texts[end]) <= STEP_CHARS):
            chars += len(texts[end])
            end += 1
        yield start, texts[start:end]
        start = end


def _segments(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles: Profiles = broadcast.value
        names = pa.array([*profiles.languages, UNKNOWN], pa.string())
        for batch in batches:
            for start, texts in _batches(batch):
                text, begin, size, number, confidence = segment_texts(profiles, texts)
                at = np.arange(len(text))
                new = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else at
                place = at - np.repeat(new, np.diff(np.r_[new, len(text)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text + start)), pa.array(place, pa.int64()), pa.array(begin, pa.int64()), pa.array(size, pa.int64()),
                        names.take(pa.array(np.where(number < 0, len(profiles.languages), number))), pa.array(confidence, pa.float64()),
                    ],
                    names=["doc_id", "segment", "begin", "chars", "lang", "confidence"],
                )

    return run


def _documents(broadcast, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles: Profiles = broadcast.value
        names, size = pa.array([*profiles.languages, UNKNOWN], pa.string()), len(profiles.languages) + 1
        for batch in batches:
            for start, texts in _batches(batch):
                text, _, chars, number, confidence = segment_texts(profiles, texts)
                cell = text * size + np.where(number < 0, size - 1, number)
                held = np.bincount(cell, chars, len(texts) * size).reshape(len(texts), size)
                sure = np.bincount(cell, chars * confidence, len(texts) * size).reshape(len(texts), size)
                share = held / np.array([len(t) for t in texts])[:, None]
                main = held.argmax(axis=1)
                listed = share >= least
                several = listed.sum(axis=1) > 1
                listed[np.arange(len(texts)), main] |= held.max(axis=1) > 0
                row, lang = np.nonzero(listed)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + start)), batch.column(2).take(pa.array(row + start)), names.take(pa.array(lang)), pa.array(share[row, lang]),
                        names.take(pa.array(main[row])), pa.array(several[row]), pa.array(sure[row, lang] / held[row, lang]),
                    ],
                    names=["doc_id", "label", "lang", "share", "main_lang", "several", "confidence"],
                )

    return run


def train(samples: DataFrame, item: str, lang: str, text: str, rows: int = TRAIN_ROWS) -> Profiles:
    """Profiles of the labelled ``samples``, of which at most ``rows`` are read."""
    labelled = samples.where(f"{text} is not null and {lang} is not null").orderBy(item).limit(rows)
    return fit_profiles([(r[0], r[1]) for r in labelled.select(lang, text).collect()])


def segments(profiles: Profiles, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(doc_id, segment, begin, chars, lang, confidence)``: the one-language segments of every text, numbered from 0."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("text is not null and length(text) > 0")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, segment bigint, begin bigint, chars bigint, lang string, confidence double"
    return rows.mapInArrow(_segments(Shared(docs.sparkSession, profiles)), schema)


def document_languages(profiles: Profiles, docs: DataFrame, doc: str, text: str, label: str, least: float = 0.1) -> DataFrame:
    """``(doc_id, label, lang, share, main_lang, several, confidence)``: the main language and all with a share of ``least`` or more.

    ``several`` tells whether more than one language has that share.
    """
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and length(text) > 0")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label string, lang string, share double, main_lang string, several boolean, confidence double"
    return rows.mapInArrow(_documents(Shared(docs.sparkSession, profiles), least), schema)


def wrong_labels(profiles: Profiles, docs: DataFrame, doc: str, text: str, label: str, least: float = 0.1, labels: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``(doc_id, lang, share, confidence)`` of documents in several languages or whose label doesn't name the main one.

    ``labels``: other codes and names of the languages (see ``label_code``). A language without an entry is named by its code.
    """
    found = document_languages(profiles, docs, doc, text, label, least)
    known = LABELS if labels is None else labels
    named = label_code(F.col("label"), {lang: known.get(lang, ()) for lang in profiles.languages})
    kept = found.where(F.col("several") | named.isNull() | (named != F.col("main_lang"))).where(F.col("lang") != UNKNOWN)
    return kept.where(F.col("share") >= least).select("doc_id", "lang", "share", "confidence")


#: Three-letter ISO 639 codes and English names of languages.
LABELS = {
    "ar": ("ara", "arabic"), "bg": ("bul", "bulgarian"), "cs": ("ces", "cze", "czech"), "da": ("dan", "danish"), "de": ("deu", "ger", "german"),
    "el": ("ell", "gre", "greek"), "en": ("eng", "english"), "es": ("spa", "spanish"), "fi": ("fin", "finnish"), "fr": ("fra", "fre", "french"),
    "he": ("heb", "hebrew"), "hi": ("hin", "hindi"), "hu": ("hun", "hungarian"), "it": ("ita", "italian"), "ja": ("jpn", "japanese"),
    "ko": ("kor", "korean"), "nl": ("nld", "dut", "dutch"), "no": ("nor", "norwegian"), "pl": ("pol", "polish"), "pt": ("por", "portuguese"),
    "ro": ("ron", "rum", "romanian"), "ru": ("rus", "russian"), "sv": ("swe", "swedish"), "tr": ("tur", "turkish"), "uk": ("ukr", "ukrainian"),
    "zh": ("zho", "chi", "chinese"),
}


def label_code(label: Column, labels: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Code that a label names in any case, with or without region; null if it names none of ``labels``."""
    first = F.lower(F.split(F.trim(label), "[-_ ]").getItem(0))
    code = F.lit(None).cast("string")
    for two, others in (LABELS if labels is None else labels).items():
        code = F.when(first.isin(two, *others), two).otherwise(code)
    return code
