"""SQL twins of the registered queries, and the pipeline, on the small tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from featloom.llm import catalog, decontam, line_dedup, near_dup, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    rel = con.execute(catalog.ORACLES[name])
    order = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(order)
    assert sorted(map(tuple, df.select(order).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_pipeline_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == corpus_pipeline.COLUMNS, name
        kept = spark.createDataFrame(after.collect(), docs.schema)
    assert 0 < kept.count() < docs.count()
    assert line_dedup.dedup(kept).agg(F.sum("n_dropped")).first()[0] == 0
    assert near_dup.near_duplicates(kept).where("component_id <> doc_id").count() == 0
    assert decontam.decontaminate(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    clean = quality.run(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").select("doc_id")
    assert kept.join(clean, "doc_id", "left_anti").count() == 0
    pieces = corpus_pipeline.bm25_packing(spark, kept, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}


def test_decontamination_judges_rows_not_ids(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(13))
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, "clean without an id"), (1, item), (1, "clean under the same id"), (2, "clean"), (2, "clean"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.benchmark_index(spark, docs.repartition(3), str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted((r for r in rows if r[1] != item), key=repr)


STAGE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "every harbour keeps old ropes near grey boats while gulls watch tired sailors mend torn nets before rain"
AWKWARD = [(1, PROSE), (1, PROSE), (2, PROSE), (None, PROSE), (3, None), (4, ""), (5, " \n\t"), (None, None), (6, "short line\n" * 3), (7, "word " * 30_000)]


def stage_of(name):
    return dict(corpus_pipeline.STAGES)[name]


def awkward(spark, rows):
    """Documents with nulls in every column and extra columns named like helpers."""
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], STAGE_COLUMNS)
    return docs.withColumns({c: F.lit(f"own {c}") for c in ("_row", "_l", "wh", "did", "k1", "rid", "n", "shard")}).repartition(3)


def small_tables(spark, path):
    spark.createDataFrame([(1, 1, 0), (None, None, None), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(9, "a b c"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def kept_rows(spark, name, rows, path):
    out = stage_of(name)(spark, awkward(spark, rows), str(path))
    assert out.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_quality_stage_on_awkward_rows(spark, tmp_path):
    small_tables(spark, tmp_path)
    got = kept_rows(spark, "quality_rules", AWKWARD, tmp_path)
    assert all(x in AWKWARD for x in got) and not [t for _, t in got if len((t or "").split()) < 10 or t.startswith("word word")]
    judged = quality.run(awkward(spark, AWKWARD), spark.read.parquet(f"{tmp_path}/labels.parquet")).where("kept")
    assert got == sorted(((r.doc_id, r.text) for r in judged.collect()), key=repr)


def test_line_stage_on_awkward_rows(spark, tmp_path):
    got = kept_rows(spark, "line_dedup", AWKWARD, tmp_path)
    assert len(got) == len(AWKWARD)
    assert [t for i, t in got if i in (3, 4)] == ["", ""] and (6, "short line\n" * 3) in got
    assert got.count((1, PROSE)) == 2 and (2, "") in got


def test_near_duplicate_stage_on_awkward_rows(spark, tmp_path):
    got = kept_rows(spark, "near_duplicates", AWKWARD, tmp_path)
    assert got == sorted([(1, PROSE), *AWKWARD[4:]], key=repr)


def test_decontamination_stage_on_awkward_rows(spark, tmp_path):
    small_tables(spark, tmp_path)
    assert kept_rows(spark, "decontamination", [*AWKWARD, (8, "a B c")], tmp_path) == sorted(AWKWARD, key=repr)


def test_packing_stage_on_awkward_rows(spark, tmp_path):
    rows = stage_of("packing")(spark, awkward(spark, AWKWARD), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in rows if r.start == 0 and r.doc_id in (3, 4)) == [(3, 1), (4, 1)]
    assert len([r for r in rows if r.start == 0]) == len(AWKWARD)
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, tmp_path, name):
    small_tables(spark, tmp_path)
    assert stage_of(name)(spark, awkward(spark, []), str(tmp_path)).collect() == []


def test_pipeline_leaves_nothing_but_its_result(spark):
    from featloom.llm import common
    from featloom.session import checkpoint_dir

    fs_path = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(fs_path))
    out = corpus_pipeline.run(spark, SF)
    after = {x for x in set(os.listdir(fs_path)) - before if x.startswith("llm-")}
    assert after == {os.path.basename(common._PATHS[out])} and out.count() > 0
