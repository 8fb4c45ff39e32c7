"""Groups of records whose sets differ by small edits (pivot distance tables).

The distance of two sets is the Hamming distance of their indicator vectors, |A xor B|; similarity t or
more means at most r = (1-t)/(1+t) (|A|+|B|). References are fixed fingerprints: sets of all tokens
whose hash has some property. A record's distance to one is, but for a constant and its size, how many
of its tokens the reference holds, so a table of distances takes one pass over the tokens. By the triangle
inequality no coordinate of a pair within the bound differs by more than r. Two tables are used:

- Fine: the tokens are split into disjoint bands, about as many as a record has tokens, and each band has
  ``REFERENCES`` references, one for each of so many hash bits. An edit touches the coordinates of one band only,
  so of two records within the bound all bands but r have equal coordinates. That is the join: records meet
  where all coordinates of a band are equal, and as r + 1 bands of each suffice, those that fewest records
  share are taken (by the load of about a million sketch buckets: one fixed order, so exact). There is a table for
  each power of two of the sizes; a record whose partners may be in the next one is in both. Small
  records (and all, for thresholds below 3/4) have one band for each token. Should a record have too few filled
  bands for the guarantee, the tables are made with another hash, at last with one band for each token.
- Coarse: 32 references of half of all tokens. Pairs that met are discarded if their greatest coordinate
  difference is above r; survivors are verified on the sets.

Bands that up to ``COLD`` records share give their pairs. In a hotter band, as of a group of near copies that may hold a
third of all rows, one of its records, which few edits set apart from the others, becomes a further reference
P, and each record x gets its exact distance to it and what it differs in, E(x) = x xor P. Records within the bound of P
are linked to it. Two others y are within the bound d(x,y) = |E(x) xor E(y)| of an x that isn't linked only if E(x) and E(y)
share more than half of E(y), or if even d(x,P) + d(P,y) is within it. So of each record only its edits that
are rare around P, about half of them, are joined with the edits of the records that aren't linked; of the latter case one
linked record, the one with most room, tells whether there is any. The cost is a few rows for each edit of a member,
not the square of the members. Exact copies are one class from the start. Linked classes form groups
by connected components.

Defined results: sets ignore order, repeats and nulls; null and empty sets and null ids
are in no group; an id delivered several times counts once, with its greatest set; ties
at the threshold link; records without a similar one give no row; an empty table gives no
rows; other columns are ignored. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.llm.components import connected
from hashloom.llm.prefix import SKETCH, sets_by_id
from hashloom.llm.set_join import classes_of, paired
from hashloom.runtime import stage

#: References of a band; their coordinates take three bits each of a long.
REFERENCES = 21
#: Records of fewer tokens have one band for each token.
SMALL = 32
#: Hashes tried before all records get one band for each token.
SEEDS = 3
#: Records that share a band and are compared with each other, at most.
COLD = 16
#: Longs of eight coordinates each of the coarse table.
PACKS = 4
_PACKED = [f"c{i}" for i in range(PACKS)]


def _mixed(values: np.ndarray) -> np.ndarray:
    """64 hash bits of each value."""
    mixed = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(33))


def coordinates(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Coarse table: packed distances of each set to the 32 references; ``starts`` are the sets' offsets in ``flat``, none empty.

    Each is, but for a constant, the sum of +1 and -1 over the tokens in and outside the reference. They are
    bytes, clipped, which shrinks differences only.
    """
    mixed = _mixed(flat)
    packs = []
    for pack in range(PACKS):
        value = np.zeros(len(starts), np.uint64)
        for i in range(8):
            sign = ((mixed >> np.uint64(8 * pack + i)) & np.uint64(1)).astype(np.int64) * 2 - 1
            distance = np.clip(np.add.reduceat(sign, starts), -128, 127) + 128 if len(starts) else np.zeros(0, np.int64)
            value |= distance.astype(np.uint64) << np.uint64(8 * i)
        packs.append(value.view(np.int64))
    return packs


def _spread(bits: np.ndarray) -> np.ndarray:
    """Each of the lowest ``REFERENCES`` bits in a field of three bits, so that sums count the tokens of each reference."""
    out = np.zeros(len(bits), np.uint64)
    for i in range(REFERENCES):
        out |= ((bits >> np.uint64(i)) & np.uint64(1)) << np.uint64(3 * i)
    return out


def _level(sizes: np.ndarray) -> np.ndarray:
    """0 for small records, else the number of their power of two."""
    return np.where(sizes < SMALL, 0, np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def band_keys(flat: np.ndarray, sizes: np.ndarray, up: int, down: int, seed: int | None) -> list[tuple]:
    """Fine table: (record, key of the band's coordinates, bands needed of each record, whether it has too few) of each level.

    ``seed`` None gives every token its own band at all sizes.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    banded = seed is not None and 4 * up >= 3 * down
    low, high = (_level(sizes), _level(sizes * down // up)) if banded else (np.zeros(len(sizes), np.int64),) * 2
    out = []
    for level in np.unique(np.r_[low, high]).tolist():
        inside = (low <= level) & (level <= high)
        token = inside[owner]
        mixed, row = _mixed(flat[token] + (seed or 0) * 0x9E3779B1), owner[token]
        if level == 0:
            # A band of one token: what one side lacks of the other are its only differences.
            out.append((row, mixed, np.where(inside, sizes - -(-sizes * up // down) + 1, 0), np.zeros(len(sizes), bool)))
            continue
        bands = 1 << level
        cell = row * bands + (mixed & np.uint64(bands - 1)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        packed = np.add.reduceat(_spread(mixed >> np.uint64(40))[order], first)
        row, band = cell[first] // bands, cell[first] % bands
        key = _mixed(packed ^ _mixed(band + bands))
        need = np.where(inside, sizes * (down - up) // up + 1, 0)
        out.append((row, key, need, np.bincount(row, minlength=len(sizes)) < need))
    return out


def _flat(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = tokens.offsets.to_numpy().astype(np.int64)
    return tokens.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pivot_table(sets: DataFrame) -> DataFrame:
    """``(id, tokens, size, c0, ...)`` with the coarse table of ``(id, tokens)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _flat(batch.column("tokens"))
            packs = coordinates(flat, offsets[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tokens"), pa.array(np.diff(offsets), pa.int64()), *[pa.array(p, pa.int64()) for p in packs]], names=["id", "tokens", "size", *_PACKED])

    return sets.select("id", "tokens").mapInArrow(run, f"id bigint, tokens array<bigint>, size bigint, {', '.join(f'{c} bigint' for c in _PACKED)}")


def band_loads(table: DataFrame, up: int, down: int, seed: int | None) -> np.ndarray | None:
    """How many records share each sketch bucket of band keys; None if a record has too few filled bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads, few = np.zeros(SKETCH, np.int64), 0
        for batch in batches:
            flat, offsets = _flat(batch.column("tokens"))
            for _, key, _, thin in band_keys(flat, np.diff(offsets), up, down, seed):
                loads += np.bincount((key % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                few += int(thin.sum())
        held = np.flatnonzero(loads)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[held, SKETCH], pa.int32()), pa.array(np.r_[loads[held], few], pa.int64())], names=["b", "n"])

    found = table.select("tokens").mapInArrow(run, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    loads = np.zeros(SKETCH + 1, np.int64)
    loads[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return None if loads[SKETCH] else np.minimum(loads[:SKETCH], 2**31 - 1).astype(np.int32)


def pivot_keys(table: DataFrame, loads: np.ndarray, up: int, down: int, seed: int | None) -> DataFrame:
    """``(key, id)``: the least shared bands of each record, as many as the bound asks for."""
    shared = table.sparkSession.sparkContext.broadcast(loads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _flat(batch.column("tokens"))
            for row, key, need, _ in band_keys(flat, np.diff(offsets), up, down, seed):
                order = np.lexsort((key, shared.value[(key % np.uint64(SKETCH)).astype(np.int64)], row))
                row, key = row[order], key[order]
                start = np.searchsorted(row, np.arange(len(need)))
                kept = np.arange(len(row)) - start[row] < need[row]
                yield pa.RecordBatch.from_arrays([pa.array(key[kept].view(np.int64)), batch.column("id").take(pa.array(row[kept]))], names=["key", "id"])

    return table.select("id", "tokens").mapInArrow(run, "key bigint, id bigint")


def within(a: str, b: str, up: int, down: int) -> str:
    """SQL: sizes allow the similarity, and no coarse coordinate of the columns with these prefixes differs by more than the bound."""
    lengths = [f"{a}size * {down} >= {b}size * {up} and {b}size * {down} >= {a}size * {up}"]
    return " and ".join(lengths + [
        f"abs((shiftrightunsigned({a}{c}, {8 * i}) & 255) - (shiftrightunsigned({b}{c}, {8 * i}) & 255)) * {up + down} <= ({a}size + {b}size) * {down - up}"
        for c in _PACKED for i in range(8)
    ])


def similar(pairs: DataFrame, table: DataFrame, up: int, down: int) -> DataFrame:
    """Links ``(u, v)``: the pairs that the coarse table leaves and the sets confirm."""
    both = paired(pairs, table, table).where(within("a_", "b_", up, down))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(shared * F.lit(up + down) >= (F.col("a_size") + F.col("b_size")) * F.lit(up)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _central(hot: DataFrame) -> DataFrame:
    """Distinct ``(id, ref)``: for each key's holders the one that shares most keys, so one with few edits; then the smallest id."""
    weighed = hot.join(hot.groupBy("id").agg(F.count("*").alias("central")), "id")
    refs = weighed.groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"))).alias("r")).select("key", (-F.col("r.minus")).alias("ref"))
    return hot.join(refs, "key").select("id", "ref").distinct()


def _edits(pairs: DataFrame, table: DataFrame, up: int, down: int) -> DataFrame:
    """``(id, ref, size, ref_size, edits, d, linked)`` of ``pairs (id, ref)``: what each record differs from its reference in."""
    sets = table.select("id", "tokens", "size")
    both = paired(pairs.select(F.col("id").alias("a"), F.col("ref").alias("b")), sets, sets)
    apart = F.concat(F.array_except("a_tokens", "b_tokens"), F.array_except("b_tokens", "a_tokens"))
    rows = both.select(F.col("a").alias("id"), F.col("b").alias("ref"), F.col("a_size").alias("size"), F.col("b_size").alias("ref_size"), apart.alias("edits"))
    return rows.withColumn("d", F.size("edits").cast("bigint")).withColumn("linked", F.expr(f"d * {up + down} <= (size + ref_size) * {down - up}"))


def hot_links(hot: DataFrame, table: DataFrame, up: int, down: int) -> DataFrame:
    """Links ``(u, v)`` that connect what all similar pairs of records with a common key of ``hot (key, id)`` would connect."""
    edits = stage(_edits(_central(hot), table, up, down), "edits")
    direct = edits.where("linked and id <> ref").select(F.col("id").alias("u"), F.col("ref").alias("v"))
    # Is a record so near the reference that d(x,P) + d(P,y) is within the bound of x and y? The one with most room tells.
    room = f"size * {down - up} - d * {up + down}"
    roomy = edits.where("linked").groupBy("ref").agg(F.max(F.struct(F.expr(room).alias("room"), "id")).alias("best")).select("ref", "best.room", F.col("best.id").alias("v"))
    near = edits.where("not linked").join(roomy, "ref").where(f"{room} + room >= 0").select(F.col("id").alias("u"), "v")
    # Edits a record shares at least with another one, if that one isn't linked, and if it isn't linked itself.
    shared = F.expr(f"greatest(1, (d * {up + down} + (ref_size - size) * {down - up}) div {2 * (up + down)} + 1)")
    shared = F.when(F.expr(f"d * {up + down} + (ref_size - size) * {down - up} < 0"), 1).otherwise(shared)
    own = F.expr(f"greatest(1, d - (size * {down - up}) div {up})")
    each = edits.select("ref", "id", "linked", (F.col("d") - shared + 1).alias("other_prefix"), (F.col("d") - own + 1).alias("own_prefix"), F.explode("edits").alias("e"))
    each = stage(each, "each-edit")
    ranked = each.join(each.groupBy("ref", "e").agg(F.count("*").alias("n")), ["ref", "e"])
    place = F.row_number().over(Window.partitionBy("ref", "id").orderBy("n", "e"))
    ranked = stage(ranked.withColumn("place", place).where("place <= other_prefix or (not linked and place <= own_prefix)"), "rare-edits")
    x = ranked.where("not linked and place <= own_prefix").select("ref", "e", F.col("id").alias("x"))
    y = ranked.where("place <= other_prefix").select("ref", "e", F.col("id").alias("y"))
    pairs = x.join(y, ["ref", "e"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return direct.unionByName(near).unionByName(similar(pairs, table, up, down))


def class_links(table: DataFrame, threshold: str) -> DataFrame:
    """Links ``(u, v)`` that connect the classes that all similar pairs would connect."""
    share = Fraction(threshold)
    up, down = share.numerator, share.denominator
    for seed in [*range(SEEDS), None]:
        loads = band_loads(table, up, down, seed)
        if loads is not None:
            break
    keys = stage(pivot_keys(table, loads, up, down, seed), "pivot-keys")
    held = stage(keys.join(keys.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1"), "key"), "held-keys")
    cold = held.where(f"holders <= {COLD}").select("key", "id")
    met = cold.select("key", F.col("id").alias("a")).join(cold.select("key", F.col("id").alias("b")), "key").where("a < b")
    links = similar(met.select("a", "b").distinct(), table, up, down)
    hot = held.where(f"holders > {COLD}").select("key", "id")
    return links if hot.isEmpty() else links.unionByName(hot_links(hot, table, up, down))


def groups(rows: DataFrame, item: str, hashes: str, threshold: str = "0.8") -> DataFrame:
    """``(id, group_id, group_size)`` for each id in a group of two or more; group_id is its smallest id."""
    members, classes = classes_of(sets_by_id(rows, item, hashes).withColumn("id", F.col("id").cast("bigint")))
    roots = connected(class_links(stage(pivot_table(classes), "pivot-table"), threshold))
    placed = members.join(roots.select(F.col("id").alias("class"), "root"), "class", "left").select("id", F.coalesce("root", "class").alias("group_id"))
    placed = stage(placed, "placed")
    sizes = placed.groupBy("group_id").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return placed.join(sizes, "group_id").select("id", "group_id", "group_size")
