import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hashloom.functions import blocks, names
from hashloom.functions.ints import u32, u32_set
from hashloom.functions.msgpack import pack, unpack, unpack_stream
from hashloom.metrics import Metrics
from hashloom.plans.merge_policy import TieredPolicy

u32s = st.integers(0, 2**32 - 1)


@given(st.lists(u32s, max_size=300), st.sampled_from(["0124", "1234"]))
@settings(max_examples=60, deadline=None)
def test_values_round_trip(values, ladder):
    data = blocks.encode(np.array(values, np.int64), ladder)
    assert len(data) == blocks.encoded_size(np.array(values, np.int64), ladder)
    back, read = blocks.decode(data, len(values), ladder)
    assert back.tolist() == values and read == len(data)


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 2**32 - 1)), max_size=900))
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip(items):
    items = sorted(items)
    hashes, ids = (np.array([i[k] for i in items], np.int64) for k in (0, 1))
    coded = blocks.encode_blocks(hashes, ids)
    assert all(len(b) == blocks.BLOCK_BYTES for b in coded)
    back = [blocks.decode_block(b) for b in coded]
    assert [x for h, _ in back for x in h.tolist()] == hashes.tolist()
    assert [x for _, i in back for x in i.tolist()] == ids.tolist()


def test_truncated_values_are_refused():
    data = blocks.encode(np.array([70000] * 8), "1234")
    with pytest.raises(ValueError):
        blocks.decode(data[:-1], 8, "1234")


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(max_size=60) | st.binary(max_size=60),
    lambda inner: st.lists(inner, max_size=20) | st.dictionaries(st.text(max_size=5), inner, max_size=20), max_leaves=25,
)


@given(values)
@settings(max_examples=120, deadline=None)
def test_msgpack_round_trip(value):
    assert unpack(pack(value)) == value


def test_msgpack_known_bytes_and_errors():
    assert pack({"q": [1, 300]}) == b"\x81\xa1q\x92\x01\xcd\x01\x2c"
    assert list(unpack_stream(pack(1) + pack([]))) == [1, []]
    for bad in (b"", b"\x92\x01", b"\xa5ab", b"\x01\x02", b"\xc1"):
        with pytest.raises(ValueError):
            unpack(bad)


def test_names(spark):
    rows = spark.createDataFrame([("main",), ("a-b_9",), ("",), ("x y",), ("é",), ("a" * 255,), ("a" * 256,), (None,)], "n string")
    assert [r[0] for r in rows.select(names.valid_index_name(F.col("n"))).collect()] == [True, True, False, False, False, True, False, False]
    one = spark.range(1).select(
        names.segment_name(F.lit(255), F.lit(3)).alias("s"), names.lineage_dir(F.lit(7)).alias("d"), names.lineage_dir(F.lit(12345678)).alias("e"),
        names.parse_segment_name(F.lit("00000000000000ff-00000003.data")).alias("p"), names.parse_segment_name(F.lit("x")).alias("q"),
        names.clamped_nap(F.lit(10), F.lit(1000)).alias("n1"), names.clamped_nap(F.lit(900), F.lit(300)).alias("n2"), names.clamped_nap(F.lit(900), F.lit(0)).alias("n3"),
    ).first()
    assert one.s == "00000000000000ff-00000003.data" and one.d == "v000007" and one.e == "v12345678"
    assert tuple(one.p) == (255, 3) and one.q is None
    assert (one.n1, one.n2, one.n3) == (50, 300, None)


def test_hash_lists(spark):
    rows = spark.createDataFrame([("-1,2147483648",), ("",), ("1,x",), ("1,,2",), ("9223372036854775808",)], "t string")
    assert [r[0] for r in rows.select(names.parse_hash_list(F.col("t"))).collect()] == [[4294967295, 2147483648], None, None, None, None]


def test_u32(spark):
    row = spark.createDataFrame([([-1, None, 5, 5, 4294967295],), (None,)], "h array<bigint>").select(u32_set(F.col("h")).alias("s")).collect()
    assert [r.s for r in row] == [[5, 4294967295], []]
    assert spark.range(1).select(u32(F.lit(-2147483648))).first()[0] == 2147483648


@given(st.lists(st.integers(0, 10**6), min_size=0, max_size=40))
@settings(max_examples=100, deadline=None)
def test_merge_policy_ends_within_budget(sizes):
    policy, steps = TieredPolicy(), 0
    while chosen := policy.choose(sizes):
        first, end = chosen
        assert 0 <= first and end - first >= 2
        sizes = [*sizes[:first], sum(sizes[first:end]), *sizes[end:]]
        steps += 1
        assert steps < 100
    assert len(sizes) <= policy.budget(sizes)


def test_merge_policy_with_empty_and_oversized_segments():
    policy = TieredPolicy(most_segments=1, most_size=100)
    assert policy.choose([0, 0, 0]) is not None
    assert policy.choose([1000, 10, 1000]) is None


def test_metrics_text():
    m = Metrics()
    m.add("searches", "main")
    m.set("docs", 3, "main")
    m.observe("scanned_docs_per_hash", 7)
    text = m.render()
    assert 'hashloom_searches_total{index="main"} 1' in text and 'hashloom_docs{index="main"} 3' in text
    assert 'hashloom_scanned_docs_per_hash_bucket{le="5"} 0' in text and 'hashloom_scanned_docs_per_hash_bucket{le="10"} 1' in text
    m.drop_index("main")
    assert 'index="main"' not in m.render()
