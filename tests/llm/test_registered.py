import os

import pytest

import __spark_entry__
import corpus_pipeline
from relgrove.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{k}_" for k in range(1, 11)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")} and "pipeline" in names


def test_sql_gives_the_same_rows(spark):
    from tests.compare import differences

    names = [n for n in __spark_entry__.oracle_sql() if n.startswith("op")]
    assert len(names) >= 4
    for n in names:
        assert differences(spark, n, SF) is None, n


def test_quality_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op6_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r["doc_id"]], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert sum(g["predicted"] == q for g, q in held) / len(held) > 0.95


def test_pipeline_against_its_parts(spark):
    """The stages by plain means on a small table: the documents that are left, and their ids' number."""
    from tests.llm.test_near_copies import brute_kept

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality.scores(docs, trees).collect() if r["predicted"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    last = {t: d for d, t in sorted(texts.items())}
    left = sorted(last.values())
    kept, near, _ = brute_kept([texts[d] for d in left])  # five words, a similarity of 0.8 or more, all pairs
    assert near
    left = [left[k] for k in kept]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    index = decontaminate.Index(items)
    left = [d for d in left if not index.leaks(texts[d])]
    got = corpus_pipeline.run(spark, SF)
    assert sorted({r["doc_id"] for r in got.collect()}) == left and 0 < len(left) < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


CLASHING = "doc_id long, text string, lang string, source string, n_chars int, rid long, node string, kept boolean, recipe string, fp string"


def awkward_documents():
    """Nulls in all columns, empty, repeated and very long texts, and columns whose names the stages use."""
    prose = "The river rose in the night, and by the morning the lower fields were under water. "
    rows = [(k, f"{prose * 3}Chapter {k} tells what came of it, {k * 7} words or so. " + " ".join(f"w{k}x{j}" for j in range(60)), "en", "a", 1, 0, "x", True, "y", "z") for k in range(12)]
    rows += [(20, None, None, None, None, None, None, None, None, None), (None, rows[0][1], "en", "a", 1, 0, "x", True, "y", "z"), (21, "", "en", "a", 0, 0, "x", True, "y", "z")]
    rows += [(22, None, *rows[0][2:]), (3, rows[3][1], *rows[0][2:]), (23, " ".join(f"long{j % 977}" for j in range(60_000)), *rows[0][2:]), rows[5]]
    return rows


def test_pipeline_stages_on_awkward_documents(spark, tmp_path):
    docs = spark.createDataFrame(awkward_documents(), CLASHING)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "too short"), (None, " ".join(f"w3x{j}" for j in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[1:]:  # all rows to each; a classifier of twelve labels may reject any
        got = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert got.columns == docs.columns
        ids = sorted((r["doc_id"] for r in got.select("doc_id").distinct().collect()), key=repr)
        # of equal texts the largest id stays, of near ones the smallest; ids without text count as one empty text
        want = {"exact_dedup": {*range(12), 22, 23}, "simhash_near_dedup": {*range(12), 20, 23}, "benchmark_decontamination": {*range(12), 20, 21, 22, 23, None} - {3}, "best_fit_packing": {*range(12), 20, 21, 22, 23, None}}[name]
        assert set(ids) == want, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name, schema in (("documents", CLASHING), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
