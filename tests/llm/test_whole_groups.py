"""What the dedup stages shuffle: row numbers instead of texts, and each shingle set once for all tables."""

import random
from collections import defaultdict

import pytest

from relgrove.llm import exact_dedup, near_copies
from relgrove.llm.common import numbered


@pytest.mark.parametrize("count", [0, 1, 400])
def test_numbered(spark, count):
    rng = random.Random(count)
    rids = sorted({(k << 33) + n for k in range(4) for n in (0, 1, 62, 63, 64, 127, 128, *rng.sample(range(5000), 200))})
    chosen = set(rng.sample(rids, count))
    df = spark.createDataFrame([(r, f"t{r}", k, "b") for k, r in enumerate(rids)], "rid long, text string, word int, Bits string").repartition(3).checkpoint()
    numbers = spark.createDataFrame([(r,) for r in [*chosen, *chosen]], "n long")
    for keep in (True, False):
        got = numbered(df, "rid", numbers, keep)
        assert got.columns == df.columns
        assert sorted(tuple(r) for r in got.collect()) == [(r, f"t{r}", k, "b") for k, r in enumerate(rids) if (r in chosen) == keep]


@pytest.mark.parametrize("stage", [exact_dedup.deduplicate, near_copies.deduplicate])
def test_no_text_is_shuffled_for_the_rows_that_stay(spark, stage):
    docs = spark.createDataFrame([(k, " ".join(f"w{k // 2}_{n}" for n in range(50))) for k in range(40)], "doc_id long, text string").repartition(3).checkpoint()
    left = stage(docs)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(1 if stage is exact_dedup.deduplicate else 0, 40, 2))


def test_groups_of_many_tables_are_compared_once(spark):
    """Tables 1 to 3 find parts of one group; where dealing it into pairs of chunks takes more rows the groups stay as they were found."""
    rows = [(rid, head, table) for table, head, members in ((1, 1, "123"), (2, 1, "123"), (3, 2, "234"), (1, 7, "789"), (3, 7, "789")) for rid in map(int, members)]
    found = spark.createDataFrame(rows, "rid long, head long, key long")
    nodes = spark.createDataFrame([(k, 10) for k in range(10)], "rid long, size long").checkpoint()

    def members(chunk):
        out = defaultdict(list)
        for r in near_copies.groups(found, nodes, chunk).collect():
            assert r["size"] == 10
            out[r["key"]].append(r["rid"])
        return sorted(sorted(x) for x in out.values())

    assert members(1024) == [[1, 2, 3, 4], [7, 8, 9]]
    assert members(2) == [[1, 2, 3, 4], [7, 8, 9]]  # 4 rows in two chunks each instead of 9
    assert members(1) == [[1, 2, 3], [1, 2, 3], [2, 3, 4], [7, 8, 9], [7, 8, 9]]
