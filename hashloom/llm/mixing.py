"""A mixture of sources with target shares, sized in tokens (systematic sampling).

Tokens of every document are counted once with a public tokenizer, and the counts are
staged. The mixture is to be as large as all documents together. Each source's target is
its share of that; a source may give at most ``max_repeats`` times its own tokens, and
what capped sources can't give goes to the others in proportion to their weights, again
within their caps; if all are capped the mixture is smaller. A document's expected copies
are target / tokens of its source. Documents of a source are put in order of size, the
expected copies are summed up along that order from one random offset, and a document is
emitted once for every integer the running sum crosses: never more often than its source's
cap allows, and, the order being by size, with a token total close to the target.

The running sum is exact and even: documents are numbered inside buckets of one source
(size class and hash; the more documents, the more buckets), and bucket counts are prefix-summed, so no task holds a whole
source. The bucket table has at most ``SIZE_CLASSES * MOST_SPREAD`` rows for each listed source.

Defined results: null and empty texts have no tokens and are never emitted; sources are
matched by ``source_key`` (case, spaces and separators don't matter); documents of sources
that are null or not listed, or whose weight is null or not above 0, aren't emitted but
count for the mixture's size; a null ``max_repeats`` is 1; several rows of one source in
the targets: the greatest weight and repeats hold; a listed source without tokens gets
share 0 and its target goes to the others; repeated document rows are documents of their
own; texts are tokenized whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hashloom.runtime import small_side, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of the byte-level vocabulary above.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Size classes; buckets of each, at least and at most, and documents for each of them on average.
SIZE_CLASSES, LEAST_SPREAD, MOST_SPREAD, BUCKET_ROWS = 64, 64, 4096, 100_000
#: Characters handed to the tokenizer at once; longer texts go in pieces.
PIECE = 100_000
#: Where white space begins: the split pattern never joins what is before with it, nor looks back.
_EDGE = re.compile(r"(?<=\S)(?=\s)")


def _pieces(text: str) -> Iterator[str]:
    """A long text cut where white space begins; a piece is longer than ``PIECE`` only where no such place is."""
    at = last = 0
    for edge in _EDGE.finditer(text) if len(text) > PIECE else ():
        if edge.start() - at > PIECE and last > at:
            yield text[at:last]
            at = last
        last = edge.start()
    if len(text) - at > PIECE and last > at:
        yield text[at:last]
        at = last
    yield text[at:]


def count_tokens(encoder, text: str) -> int:
    """Tokens of a text of any length, the same as in one piece.

    A piece that can't be cut is split by the pattern here: the tokenizer's own splitting has no room for very long runs of white space.
    """
    total = 0
    for piece in _pieces(text):
        if len(piece) <= PIECE:
            total += len(encoder.encode_ordinary(piece))
        else:
            total += sum(len(encoder._encode_single_piece(part.group())) for part in regex.finditer(PATTERN, piece))
    return total


def token_counts(docs: DataFrame, columns: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` of every row with ``n_tokens``. The driver reads the vocabulary file and ships it."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [count_tokens(encoder, t) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*columns, "n_tokens"])

    rows = docs.select(*columns, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(run, f"{schema}, n_tokens bigint")


def source_key(source: Column) -> Column:
    """A source's name without regard to case, outer spaces and kind of separator."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "_")


def fill_targets(total: int, sources: list[tuple[str, float, int, int]]) -> dict[str, float]:
    """Target tokens by source from ``(source, weight, max repeats, tokens)``: proportional to weight, within each cap."""
    target = dict.fromkeys((s[0] for s in sources), 0.0)
    open_ = [s for s in sources if s[1] > 0 and s[3] > 0 and s[2] > 0]
    left = float(total)
    while open_ and left > 0:
        weight = sum(s[1] for s in open_)
        capped = [s for s in open_ if left * s[1] / weight >= s[2] * s[3]]
        if not capped:
            target |= {s[0]: left * s[1] / weight for s in open_}
            break
        for s in capped:
            target[s[0]] = float(s[2] * s[3])
            left -= s[2] * s[3]
        open_ = [s for s in open_ if s not in capped]
    return target


def _offset(source: str, seed: int) -> float:
    """The source's random offset in [0, 1), the same on every run with this seed."""
    return int.from_bytes(hashlib.md5(f"{seed}:{source}".encode()).digest()[:6], "big") / 2**48


def plan(spark: SparkSession, counted: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``(source, weight, max_repeats, tokens, target_tokens, rate, offset)``: one row per listed source.

    ``targets`` is the driver's table of sources, of which at most 100 000 are accepted.
    """
    listed = targets.select(source_key(F.col("source")).alias("source"), F.col("weight"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    listed = listed.where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    rows = listed.join(sums, "source", "left").select("source", "weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100 000 sources in the targets")
    wanted = [r for r in rows if r.weight is not None and r.weight > 0]
    target = fill_targets(total, [(r.source, r.weight, r.max_repeats, r.tokens) for r in wanted])
    weights = sum(r.weight for r in wanted) or 1.0
    data = [
        (r.source, r.weight / weights, r.max_repeats, r.tokens, target[r.source], target[r.source] / r.tokens if r.tokens else 0.0, _offset(r.source, seed))
        for r in sorted(wanted, key=lambda r: r.source)
    ]
    return spark.createDataFrame(data, "source string, share double, max_repeats bigint, tokens bigint, target_tokens double, rate double, offset double")


def copies(counted: DataFrame, planned: DataFrame, doc: str) -> DataFrame:
    """``(doc, source, n_tokens, copies)`` of documents emitted at least once; ``counted`` is staged."""
    rates = F.broadcast(planned.where("rate > 0").select("source", "rate", "offset"))
    rows = counted.where("n_tokens > 0").join(rates, "source")
    # Half powers of two: neighbours in size share a class.
    size = F.least(F.floor(F.log2("n_tokens") * 2), F.lit(SIZE_CLASSES - 1))
    spread = min(max(counted.count() // BUCKET_ROWS, LEAST_SPREAD), MOST_SPREAD)
    rows = rows.withColumn("bucket", (size * spread + F.pmod(F.xxhash64(doc), F.lit(spread))).cast("int"))
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = small_side(counts.select("source", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")), "offsets")
    inside = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("n_tokens", doc))
    numbered = rows.withColumn("place", inside).join(before, ["source", "bucket"])
    place = F.col("before") + F.col("place")
    crossed = F.floor(F.col("offset") + F.col("rate") * place) - F.floor(F.col("offset") + F.col("rate") * (place - 1))
    return numbered.select(doc, "source", "n_tokens", crossed.cast("bigint").alias("copies")).where("copies > 0")


def mixture(docs: DataFrame, targets: DataFrame, doc: str, source: str, text: str, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(documents with their copies, plan); see ``copies`` and ``plan``."""
    keyed = docs.select(F.col(doc), source_key(F.col(source)).alias("source"), F.col(text).alias("text"))
    counted = stage(token_counts(keyed, [doc, "source"], "text", vocabulary), "token-counts")
    planned = plan(docs.sparkSession, counted, targets, seed)
    return copies(counted, planned, doc), planned


def shares(chosen: DataFrame, planned: DataFrame) -> DataFrame:
    """``(source, target_share, target_tokens, tokens, share, documents, copies)``: what each listed source gives."""
    sums = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("given"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    every = planned.join(sums, "source", "left")
    zero = F.lit(0)
    given = F.coalesce("given", zero)
    return every.select(
        "source", F.col("share").alias("target_share"), "target_tokens", given.alias("tokens"), (given / F.sum(given).over(Window.partitionBy())).alias("share"),
        F.coalesce("documents", zero).alias("documents"), F.coalesce("copies", zero).alias("copies"),
    )
