"""Every core query against its SQL twin."""

import pytest
from oracle import SF, same

from hashloom.plans import registry

ORACLES = registry.oracles()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    if name in ORACLES:
        same(df, ORACLES[name], SF)
    else:
        assert df.count() >= 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["id", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_contamination_has_every_copy_of_a_passage(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    spark.createDataFrame([(0, " ".join(words))], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    run = " ".join(words[100:115])
    texts = [(i, f"a{i} b{i} {run} c{i}") for i in range(60)] + [(60, " ".join(words)), (61, "w1 w2 w3"), (62, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["search_contamination_all"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [*((0, i, 13) for i in range(60)), (0, 60, 398)]
