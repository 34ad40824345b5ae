"""The pipeline stage by stage."""

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    body = "\n".join(f"the line number {k} of this text says something of its own" for k in range(8))
    leak = "what is the least number of steps that a lame knight needs to cross the whole board twice"
    rows = [(0, body, "en"), (1, body, "en"), (2, "12 34 !!", "en"), (3, None, None), (4, "a text that nobody else has written " * 5, "en"), (5, "A text that nobody else has written " * 5, "en"), (6, "we ask " + leak + " and no more", "en"), (7, "short", "en"), (None, "a text without a number", "en")]
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.dtypes, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        kept.append({r.doc_id for r in docs.collect()})
        assert name == corpus_pipeline.STAGES[-1][0] or docs.dtypes == columns
    ids = set(range(8)) | {None}
    assert kept[0] == ids - {2, 3}  # no letter
    assert kept[1] == kept[0]  # line dedup empties 1 but keeps the row
    assert kept[2] == kept[1] - {5}  # 4 and 5 differ in case alone
    assert kept[3] == kept[2] - {6}
    assert kept[4] == kept[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == kept[4]


def test_whole_lines_go(spark, folder):
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    assert out[1].text == "" and out[1].n_chars == 0 and out[0].n_chars == len(out[0].text) > 0


def test_hostile_rows_and_names(spark, folder, tmp_path):
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` int, `class` int, at int, gone_id int, key_id int, c0 int, whole int, block int"
    one = "every text in this table is one that somebody has written by hand"
    rows = [(1, None), (2, ""), (3, one), (3, one), (4, one.upper()), (None, one), (None, None), (5, " \n\t"), (6, "every " * 30_000), (7, "½ ② Ⅷ"), (8, one + "\n" + one)]
    spark.createDataFrame([(i, t, "en", "s", None, *range(8)) for i, t in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        kept.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
    assert [i for i, _ in kept[0]] == [3, 3, 4, 6, 8, None]
    assert [i for i, _ in kept[2]] == [3, 6, 8, None] and kept[3] == kept[2]
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == 4


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
