"""All pairs of records whose sets overlap above a Jaccard threshold (prefix-filtered join).

Records with exactly the same set form one class and are joined once. Each class is
indexed under the rare tokens of its prefix only; classes that meet under a token pass
a length filter (sizes within the threshold of each other) and a positional filter (the
tokens left after the meeting place can still reach the required overlap), then the
exact overlap is counted on the sets. Hot tokens end the order, so they are keys only of
sets that hold little else; the join is a sort-merge join, whose hot keys adaptive
execution splits.

Defined results: sets ignore order, repeats and nulls; null and empty sets are in no
pair; an id counts once, with its newest row (see ``sets_by_id``), and is never paired
with itself; ties at the threshold are kept, in integer arithmetic; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.prefix import prefix_keys, sets_by_id, token_loads
from hashloom.runtime import small_side, stage

SIGNATURE = ["sig_a", "sig_b", "size"]


def classes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members ``(class, id)``, classes ``(id, tokens)`` with the class's smallest id), both staged.

    Equal sets are found by a 128-bit signature and their size.
    """
    signed = sets.withColumn("sig_a", F.xxhash64("tokens")).withColumn("sig_b", F.xxhash64(F.lit(17), "tokens", F.lit(29))).withColumn("size", F.size("tokens"))
    signed = stage(signed, "sets")
    # Map-side combining folds hot classes before the shuffle; the join back is split by adaptive execution.
    heads = signed.groupBy(*SIGNATURE).agg(F.min("id").alias("class"))
    members = stage(signed.select("id", *SIGNATURE).join(heads, SIGNATURE).select("class", "id"), "members")
    own = members.where("class = id").select("id")
    classes = stage(signed.select("id", "tokens").join(own, "id", "left_semi"), "classes")
    return members, classes


def candidates(left: DataFrame, right: DataFrame, up: int, down: int, within: bool) -> DataFrame:
    """Distinct ``(a, b)`` that meet under a prefix token and pass the length and positional filters."""
    a = left.select("token", F.col("id").alias("a"), F.col("size").alias("na"), F.col("place").alias("pa"))
    b = right.select("token", F.col("id").alias("b"), F.col("size").alias("nb"), F.col("place").alias("pb"))
    length = f"na * {down}L >= nb * {up}L and nb * {down}L >= na * {up}L"
    # overlap >= up / (up + down) * (na + nb); at most this many tokens can still be shared from the meeting place on
    still = f"least(na - pa, nb - pb) * {up + down}L >= (na + nb) * {up}L"
    before = f"(least(na - pa, nb - pb) + least(pa, pb)) * {up + down}L >= (na + nb) * {up}L"
    met = a.join(b, "token").where(f"{length} and {before}" + (" and a < b" if within else ""))
    # The first token they share has the smallest place in both.
    first = met.groupBy("a", "b", "na", "nb").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    return first.where(still).select("a", "b")


def paired(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` with the columns of both records, ``a_`` or ``b_`` before their names.

    Pairs are counted: if they are few, they are sent to the records, and only records in a pair are shuffled.
    """
    pairs = small_side(pairs, "pairs")
    a = left.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in left.columns if c != "id"])
    b = right.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in right.columns if c != "id"])
    if pairs.is_small:
        return a.join(pairs, "a").join(b.join(pairs, "b"), ["a", "b"])
    return pairs.join(a, "a").join(b, "b")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, up: int, down: int) -> DataFrame:
    """``(a, b, overlap, joined)`` of pairs whose exact similarity reaches the threshold."""
    both = paired(pairs, left.select("id", "tokens"), right.select("id", "tokens"))
    counted = both.select("a", "b", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("overlap"), (F.size("a_tokens") + F.size("b_tokens")).alias("sizes"))
    return counted.select("a", "b", "overlap", (F.col("sizes") - F.col("overlap")).alias("joined")).where(F.col("overlap") * F.lit(down) >= F.col("joined") * F.lit(up))


def similar_classes(classes: DataFrame, threshold: str) -> DataFrame:
    """``(a, b, overlap, joined)`` between different classes of one table, a < b."""
    share = Fraction(threshold)
    up, down = share.numerator, share.denominator
    keys = prefix_keys(classes, token_loads(classes), up, down)
    return verified(candidates(keys, keys, up, down, True), classes, classes, up, down)


def similar_pairs(rows: DataFrame, item: str, hashes: str, threshold: str, newest: str | None = None) -> DataFrame:
    """``(id_a, id_b, overlap, joined)`` with id_a < id_b of one table; copies are expanded into all their pairs."""
    members, classes = classes_of(sets_by_id(rows, item, hashes, newest))
    links = similar_classes(classes, threshold)
    a, b = members.select(F.col("class").alias("a"), F.col("id").alias("ida")), members.select(F.col("class").alias("b"), F.col("id").alias("idb"))
    across = links.join(a, "a").join(b, "b").where("ida <> idb").select(F.least("ida", "idb").alias("id_a"), F.greatest("ida", "idb").alias("id_b"), "overlap", "joined")
    sizes = classes.select(F.col("id").alias("a"), F.size("tokens").alias("overlap"), F.size("tokens").alias("joined"))
    copied = members.groupBy(F.col("class").alias("a")).agg(F.count("*").alias("n")).where("n > 1").join(sizes, "a").drop("n")
    inside = a.join(copied, "a").join(b, F.col("a") == F.col("b")).where("ida < idb").select(F.col("ida").alias("id_a"), F.col("idb").alias("id_b"), "overlap", "joined")
    return across.unionByName(inside)


def similar_between(left: DataFrame, right: DataFrame, item: str, hashes: str, threshold: str, newest: str | None = None) -> DataFrame:
    """``(left_id, right_id, overlap, joined)`` between two tables, whose ids are unrelated."""
    share = Fraction(threshold)
    up, down = share.numerator, share.denominator
    members_l, classes_l = classes_of(sets_by_id(left, item, hashes, newest))
    members_r, classes_r = classes_of(sets_by_id(right, item, hashes, newest))
    loads = token_loads(classes_l.unionByName(classes_r))
    met = candidates(prefix_keys(classes_l, loads, up, down), prefix_keys(classes_r, loads, up, down), up, down, False)
    links = verified(met, classes_l, classes_r, up, down)
    a, b = members_l.select(F.col("class").alias("a"), F.col("id").alias("left_id")), members_r.select(F.col("class").alias("b"), F.col("id").alias("right_id"))
    return links.join(a, "a").join(b, "b").select("left_id", "right_id", "overlap", "joined")
