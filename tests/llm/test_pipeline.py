"""The pipeline's stages against what each is meant to do to its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import ngramjoin, workspace
from corpusloom.llm.queries import op9_quality


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        kept = stage(spark, docs, tables)
        assert kept.columns == corpus_pipeline.COLUMNS
        rows = {r.doc_id: r for r in kept.collect()}
        assert set(rows) <= set(before)
        if name == "quality":
            assert set(rows) == {r.doc_id for r in op9_quality(spark, tables).collect() if r.predicted == 1}
        elif name == "line_dedup":
            assert all(r.n_chars == len(r.text) and set(r.text.split("\n")) <= {*before[k].text.split("\n"), ""} for k, r in rows.items())
        elif name == "near_duplicates":
            found = ngramjoin.near_duplicates(docs).collect()
            assert set(rows) == {r.component_id for r in found}
        docs = spark.createDataFrame([rows[k] for k in sorted(rows)], kept.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_odd_rows_pass_through(spark, tables):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "Some words here. And more of them.", "en", None, 3), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_duplicate_stage(spark, docs, tables).count() == 3
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).collect()
    assert corpus_pipeline.near_duplicate_stage(spark, docs.where("false"), tables).count() == 0


def test_repeated_ids_with_different_texts(spark, tables):
    text = lambda a: " ".join(f"{a}{k}" for k in range(40))
    texts = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("c")), (3, text("d")), (4, None), (4, text("e")), (5, text("d") + " more"), (None, text("f"))]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, tables)
    wanted = [(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (4, None), (4, text("e")), (None, text("f"))]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, wanted))
    pieces = corpus_pipeline.packing_stage(spark, kept, tables).collect()
    assert {r.doc_id for r in pieces} >= {1, 2, 3, 4}


def test_many_partitions_make_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_folder", lambda _: f"file://{tmp_path}")
    most = workspace.WAVES * spark.sparkContext.defaultParallelism
    text = lambda a: " ".join(f"{a}{k}" for k in range(40))
    rows = [(k, text(k // 2) if k % 3 else None, "en", "s", 0) for k in range(300)] + [(7, text("x"), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(100)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    seen, wanted = set(), []
    for k, t, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        if t is None or t not in seen:
            wanted.append((k, t))
        seen.add(t)
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, wanted))
    written = [len([*d.glob("part-*")]) for d in tmp_path.glob("*/*") if d.is_dir()]
    assert written and max(written) <= most
    numbered = workspace.Workspace(spark, "t", few_files=True).table(spark.range(1000).repartition(100).withColumn("row", F.monotonically_increasing_id()))
    assert numbered.select("row").distinct().count() == 1000 and len(numbered.inputFiles()) <= most
