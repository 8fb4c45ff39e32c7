"""Frequent values, top N, set joins and near duplicates against brute force, with hot keys and dirty rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hashloom.llm import near_dups
from hashloom.llm.components import connected
from hashloom.llm.heavy_hitters import Summary, frequent_values, summarize
from hashloom.llm.set_join import similar_between, similar_classes, similar_pairs
from hashloom.llm.top_n import top_n, top_n_newest


@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=12), st.integers(1, 8))
@settings(max_examples=80, deadline=None)
def test_summary_bounds_hold_through_merges(parts, counters):
    whole, true = Summary(counters), Counter()
    for part in parts:
        one = Summary(counters)
        for value, n in Counter(part).items():
            one.add(pa.array([value]), pa.array([n]), 0, n)
        true.update(part)
        if one.table is not None and one.table.num_rows:
            whole.add(one.table.column("value").combine_chunks(), one.table.column("low").combine_chunks(), one.floor, one.n)
        else:
            whole.add(pa.array([], pa.int64()), pa.array([], pa.int64()), one.floor, one.n)
    n = sum(true.values())
    assert whole.n == n and whole.floor <= n / (counters + 1)
    low = dict(zip(whole.table.column("value").to_pylist(), whole.table.column("low").to_pylist(), strict=True)) if whole.table is not None else {}
    assert len(low) <= counters
    for value, count in true.items():
        assert low.get(value, 0) <= count <= low.get(value, 0) + whole.floor


def test_frequent_values(spark):
    rnd = random.Random(1)
    bags = [(i, [rnd.choice([7, 7, 7, 8, rnd.randint(100, 10**6)]) for _ in range(rnd.randint(0, 30))] + [None], "x") for i in range(400)] + [(1, None, None), (2, [], None)]
    df = spark.createDataFrame(bags, "id bigint, h array<bigint>, value string").repartition(70)
    true = Counter(v for _, b, _ in bags for v in b or () if v is not None)
    total = sum(true.values())
    got = {r.value: r for r in frequent_values(df, "h", "0.05", counters=40).collect()}
    assert {v: r["count"] for v, r in got.items()} == {v: c for v, c in true.items() if c >= 0.05 * total}
    assert all(r.low <= r["count"] <= r.high and r.total == total for r in got.values())
    assert summarize(df, "h", 40).count() <= 40
    assert frequent_values(df.limit(0), "h", "0.05").collect() == []
    words = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "w string")
    assert {(r.value, r["count"]) for r in frequent_values(words, "w", "0.3").collect()} == {("a", 2), ("b", 1)}
    with pytest.raises(ValueError):
        frequent_values(df, "h", "0.001", counters=10)


def brute_top(rows, n):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    order = lambda r: (r[2] is None, -(r[2] or 0), r[1] is not None, r[1] or 0, r[3] is not None, r[3] or "")
    return {(k, i, *r[1:]) for k, rs in groups.items() for i, r in enumerate(sorted(rs, key=order)[:n], 1)}


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_top_n(spark, hot_rows):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *range(50)]), rnd.choice([None, 5, 5, *range(9)]), rnd.choice([None, "a", "b"])) for _ in range(900)]
    rows += rows[:100]
    df = spark.createDataFrame([(*r, 0) for r in rows], "group bigint, id bigint, score bigint, x string, rank int").repartition(6)
    for n in (1, 7, 40):
        got = {(r.group, r.rank, r.id, r.score, r.x) for r in top_n(df, "group", "score", ["id"], n, hot_rows).collect()}
        assert got == brute_top(rows, n)
    assert top_n(df.limit(0), "group", "score", ["id"], 3).collect() == []


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_top_n_newest(spark, hot_rows):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), rnd.randint(0, 60), rnd.choice([None, *range(9), 2**32 - 1]), rnd.choice([None, 1, 5, 2**32 - 1])) for _ in range(700)]
    df = spark.createDataFrame(rows + rows[:50], "q bigint, id bigint, score bigint, commit bigint")
    newest = {}
    for q, i, s, c in rows:
        if s is not None:
            newest[q, i] = max(newest.get((q, i), (-1, -1)), (c or 0, s))
    groups = defaultdict(list)
    for (q, i), (_, s) in newest.items():
        groups[q].append((-s, i))
    want = {(q, i, -s, k) for q, found in groups.items() for k, (s, i) in enumerate(sorted(found)[:5], 1)}
    assert {(r.q, r.id, r.score, r["rank"]) for r in top_n_newest(df, "q", "id", "score", "commit", 5, hot_rows).collect()} == want


def jaccard(a, b):
    return len(a & b), len(a | b)


def make_sets(rnd, n):
    sets = []
    for _ in range(n):
        if sets and rnd.random() < 0.5:
            s = set(rnd.choice(sets))
            for _ in range(rnd.randint(0, 4)):
                (s.discard if rnd.random() < 0.5 else s.add)(rnd.randint(0, 80))
        else:
            s = {rnd.choice([rnd.randint(0, 6), rnd.randint(0, 80), rnd.randint(0, 2**32 - 1)]) for _ in range(rnd.randint(0, 20))}
        sets.append(s)
    return sets


def stored(rnd, h):
    """A hash as some rows hold it: signed."""
    return h - 2**32 if h >= 2**31 and rnd.random() < 0.5 else h


@pytest.mark.parametrize(("threshold", "up", "down"), [("0.5", 1, 2), ("0.8", 4, 5), ("1", 1, 1)])
def test_similar_pairs(spark, threshold, up, down):
    rnd = random.Random(4)
    sets = make_sets(rnd, 120)
    rows = [(i, [stored(rnd, h) for h in s] * 2 + [None], 1, "t") for i, s in enumerate(sets)]
    rows += [(3, [1, 2], 0, None), (500, None, 1, None), (None, [1], 1, None), (501, [None], 1, None)] + rows[:20]
    df = spark.createDataFrame(rows, "id bigint, hashes array<bigint>, version int, token string")
    want = set()
    for a in range(120):
        for b in range(a + 1, 120):
            k, u = jaccard(sets[a], sets[b])
            if u and sets[a] and sets[b] and k * down >= u * up:
                want.add((a, b, k, u))
    got = similar_pairs(df, "id", "hashes", threshold, "version").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert similar_pairs(df.limit(0), "id", "hashes", threshold, "version").collect() == []
    assert similar_pairs(df.where("id = 501"), "id", "hashes", threshold).collect() == []


def test_similar_between(spark):
    rnd = random.Random(5)
    left, right = make_sets(rnd, 60), make_sets(rnd, 60)
    right[:20] = left[:20]
    frame = lambda sets: spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "id bigint, hashes array<bigint>")
    want = {(a, b, *jaccard(x, y)) for a, x in enumerate(left) for b, y in enumerate(right) if x and y and jaccard(x, y)[0] * 5 >= jaccard(x, y)[1] * 3}
    assert {tuple(r) for r in similar_between(frame(left), frame(right), "id", "hashes", "0.6").collect()} == want


def test_many_copies_are_one_class(spark):
    """A third of all rows holds one set: it is joined once."""
    df = spark.createDataFrame([(i, [1, 2, 3]) for i in range(500)] + [(1000 + i, [1, 2, 3, 4 + i]) for i in range(3)], "id bigint, hashes array<bigint>")
    from hashloom.llm.prefix import sets_by_id
    from hashloom.llm.set_join import classes_of

    members, classes = classes_of(sets_by_id(df, "id", "hashes"))
    assert members.count() == 503 and classes.count() == 4 and {r.id for r in classes.collect()} == {0, 1000, 1001, 1002}
    assert similar_classes(classes, "0.75").count() == 3


def groups_of(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = defaultdict(set)
    for i in ids:
        found[find(i)].add(i)
    return {(i, min(g)) for g in found.values() if len(g) > 1 for i in g}


@pytest.mark.parametrize(("seed", "cold"), [(6, 16), (7, 1), (8, 3)])
def test_near_duplicates(spark, monkeypatch, seed, cold):
    """Also with bands that count as hot from two records on."""
    monkeypatch.setattr(near_dups, "COLD", cold)
    rnd = random.Random(seed)
    sets = make_sets(rnd, 90)
    hot = {rnd.randint(0, 2**32 - 1) for _ in range(40)}
    for _ in range(60):  # one group of near copies, whose edges are not all near its middle
        s = set(hot)
        for _ in range(rnd.randint(0, 5)):
            s.discard(rnd.choice(sorted(s)))
            s.add(rnd.randint(0, 2**32 - 1))
        sets.append(s)
    ids = [i for i, s in enumerate(sets) if s]
    links = [(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b])[0] * 5 >= jaccard(sets[a], sets[b])[1] * 4]
    rows = [(i, [stored(rnd, h) for h in s] + [None], "r") for i, s in enumerate(sets)]
    rows += [(None, [1, 2], "r"), (900, None, None), (901, [], None)] + rows[:30]
    df = spark.createDataFrame(rows, "id bigint, hashes array<bigint>, root string")
    got = near_dups.groups(df, "id", "hashes", "0.8").collect()
    assert {(r.id, r.group_id) for r in got} == groups_of(links, ids)
    sizes = Counter(r.group_id for r in got)
    assert all(r.group_size == sizes[r.group_id] for r in got)


@pytest.mark.parametrize(("small", "threshold", "cold"), [(32, "0.8", 16), (4, "0.8", 1), (2, "0.9", 2), (32, "0.6", 1)])
def test_near_duplicates_of_all_sizes(spark, monkeypatch, small, threshold, cold):
    """Sizes on both sides of the tables' powers of two; with a small bound some records have too few filled bands at first."""
    monkeypatch.setattr(near_dups, "SMALL", small)
    monkeypatch.setattr(near_dups, "COLD", cold)
    rnd = random.Random(small)
    sets = []
    for size in [3, 5, 8, 14, 27, 30, 31, 33, 50, 62, 64, 66, 100, 126, 129, 140] * 3:
        base = {rnd.randint(0, 2**32 - 1) for _ in range(size)}
        for _ in range(4):
            s, edits = set(base), rnd.randint(0, size // 4)
            for x in rnd.sample(sorted(s), edits // 2):
                s.discard(x)
            sets.append(s | {rnd.randint(0, 2**32 - 1) for _ in range(rnd.randint(0, edits))})
    up, down = {"0.8": (4, 5), "0.9": (9, 10), "0.6": (3, 5)}[threshold]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if jaccard(sets[a], sets[b])[0] * down >= jaccard(sets[a], sets[b])[1] * up]
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "id bigint, hashes array<bigint>").repartition(4)
    assert {(r.id, r.group_id) for r in near_dups.groups(df, "id", "hashes", threshold).collect()} == groups_of(links, range(len(sets)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hot_links_connect_what_all_pairs_connect(spark, seed):
    """Records around one middle, most of them near the threshold, of several sizes, some by removals or additions only."""
    rnd = random.Random(seed)
    base = [rnd.randint(0, 2**32 - 1) for _ in range(50)]
    extra = [rnd.randint(0, 2**32 - 1) for _ in range(12)]
    sets = [set(base)]
    for _ in range(150):
        s = set(rnd.choice(sets)) if rnd.random() < 0.3 else set(base)
        drop, add = rnd.choice([(0, 1), (1, 0), (0.5, 0.5)])
        k = rnd.randint(0, 14)
        s -= set(rnd.sample(sorted(s), int(k * drop)))
        sets.append(s | {rnd.choice([rnd.choice(extra), rnd.randint(0, 2**32 - 1)]) for _ in range(int(k * add))})
    sets = [set(s) for s in {frozenset(s) for s in sets}]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, tokens array<bigint>")
    table = near_dups.stage(near_dups.pivot_table(df), "t")
    links = near_dups.hot_links(spark.range(len(sets)).selectExpr("1L AS key", "id"), table, 4, 5)
    similar = lambda a, b: jaccard(sets[a], sets[b])[0] * 5 >= jaccard(sets[a], sets[b])[1] * 4
    got = [tuple(r) for r in links.collect()]
    assert all(similar(*link) for link in got)
    ids = range(len(sets))
    assert groups_of(got, ids) == groups_of([(a, b) for a in ids for b in ids if a < b and similar(a, b)], ids)


def test_similar_records_share_a_needed_band():
    """The guarantee behind the fine table, without the engine: of each record the least shared bands meet those of the other."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = int(rng.integers(32, 200))
        a = rng.choice(2**32, size, replace=False)
        edits = int(rng.integers(0, size // 4))
        b = np.r_[a[edits // 2 :], rng.choice(2**32, edits - edits // 2, replace=False)]
        k, u = jaccard(set(a.tolist()), set(b.tolist()))
        if k * 5 < u * 4:
            continue
        chosen = []
        for x in (a, b):
            own = set()
            for level, (_, key, need, thin) in enumerate(near_dups.band_keys(x, np.array([len(x)]), 4, 5, 0)):
                assert not thin.any()
                own |= set(np.sort(key)[: need[0]].tolist())
            chosen.append(own)
        assert chosen[0] & chosen[1]


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [7, 8, 9])], "id bigint, hashes array<bigint>")
    assert near_dups.groups(df, "id", "hashes").collect() == [] and near_dups.groups(df.limit(0), "id", "hashes").collect() == []


def test_coordinates_never_differ_by_more_than_the_distance():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a = set(rng.integers(0, 2**32, 300).tolist())
        b = (a - set(list(a)[:20])) | set(rng.integers(0, 2**32, 15).tolist())
        flat = np.array([*a, *b])
        packs = near_dups.coordinates(flat, np.array([0, len(a)]))
        for p in packs:
            for i in range(8):
                x, y = ((int(v) >> (8 * i)) & 255 for v in p)
                assert abs(x - y) <= len(a ^ b)


def test_components(spark):
    rnd = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 1), (7, None)]
    df = spark.createDataFrame(links + links[:20], "u bigint, v bigint")
    clean = [(a, b) for a, b in links if a is not None and b is not None]
    want = {(i, g) for i, g in groups_of(clean, {x for link in clean for x in link}) if i != g}
    assert {tuple(r) for r in connected(df).collect()} == want
    assert connected(df.limit(0)).collect() == []
    # Links held by many tasks take the rounds of contraction.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = connected(df.repartition(7)).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
        chain = spark.range(3000).selectExpr("(id * 7919) % 3001 AS u", "((id + 1) * 7919) % 3001 AS v")
        assert {r.root for r in connected(chain).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
