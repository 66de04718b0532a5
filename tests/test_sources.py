import json

import pytest

from corpusloom.sources import readers as R
from corpusloom.sources import writers as W
from corpusloom.streaming import ingest as I


def test_zipped_lines_stop_at_the_shorter(spark, tmp_path):
    (tmp_path / "x.pt_BR").write_text("um\n\ntrês\nquatro", encoding="utf-8")
    (tmp_path / "x.pt").write_text("one\ntwo\nthree\n", encoding="utf-8")
    a, b = R.file_pair(str(tmp_path))
    got = sorted(tuple(r) for r in R.zipped_lines(spark, a, b).select("line_no", "br", "pt").collect())
    assert got == [(1, "um", "one"), (2, "", "two"), (3, "três", "three")]
    assert R.zipped_lines(spark, a, b, start_at=2).count() == 1 and R.line_count(spark, b) == 3
    (tmp_path / "y.pt").write_text("", encoding="utf-8")
    with pytest.raises(FileNotFoundError):
        R.file_pair(str(tmp_path))


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\r\n00:00:01,500 --> 00:00:02,000\r\nOlá\r\nmundo \r\n\r\n2\r\n01:00:00,000 --> 01:00:01,001\r\n<i>fim</i>\r\n\r\nnada\r\n", encoding="utf-8", newline="")
    got = R.subtitles(spark, str(tmp_path / "*.srt")).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(1500, 2000, "Olá mundo"), (3_600_000, 3_601_001, "<i>fim</i>")]


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,pt,br\n1,"a, b",c\n', encoding="utf-8")
    assert [tuple(r) for r in R.csv(spark, str(tmp_path / "c.csv"), ["id", "pt"]).collect()] == [("1", "a, b")]
    with pytest.raises(ValueError, match="nope"):
        R.csv(spark, str(tmp_path / "c.csv"), ["nope"])
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n', encoding="utf-8")
    assert R.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2


def test_logs(spark, tmp_path):
    for name, log in (("t1", [{"step": 1, "eval_loss": 2.0}, {"step": 2, "eval_loss": 1.0}, {"step": 3, "eval_loss": 1.0}, {"step": 4}]), ("t2", [{"step": 9}])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "trainer_state.json").write_text(json.dumps({"log_history": log}))
    (tmp_path / "t3").mkdir()
    (tmp_path / "t3" / "trainer_state.json").write_text("not json")
    assert [(r.best, r.step) for r in R.best_of_logs(spark, str(tmp_path), "eval_loss").collect()] == [(1.0, 2)]


def test_examples_in_answers(spark):
    assert R.examples_in('```json\n{"exemplos": [{"pt_PT": "a", "pt_BR": "b"}, {"pt_PT": "", "pt_BR": "x"}]}\n```') == [("a", "b")]
    assert R.examples_in('{"outer": {"examples": [{"pt_PT": "a", "pt_BR": "b"}]}}') == [("a", "b")]
    assert R.examples_in('x "pt_BR": "b\\"", "pt_PT": "a" y') == [("a", 'b"')]
    assert R.examples_in(None) == [] and R.examples_in("{") == []
    df = spark.createDataFrame([(1, '{"pt_PT": "a", "pt_BR": "b"}'), (2, None)], "k int, answer string")
    assert [(r.k, r.pt_PT, r.pt_BR) for r in R.examples(df, "answer").collect()] == [(1, "a", "b")]


def test_tables_by_name(spark):
    spark.range(3).selectExpr("id AS a", "id AS b").createOrReplaceTempView("have_ab")
    assert R.first_table(spark, ["none", "have_ab"], {"a": "long"}).count() == 3
    assert R.first_table(spark, ["have_ab"], {"zz": "string"}).columns == ["zz"]
    assert [tuple(r) for r in R.relation_summary(spark, ["none", "have_ab"]).collect()] == [("have_ab", 2, 3)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(3, "c\tc", None), (1, "a\na", "x"), (2, "b", "y")], "k long, br string, pt string")
    W.parallel_files(df, "k", "br", "pt", str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out/ids")).collect()]
    assert sorted(lines) == ["1\t0", "2\t1", "3\t2"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/br")).collect()) == ["a a", "b", "c c"]
    W.json_lines(df, str(tmp_path / "j"))
    assert any(json.loads(r.value)["pt"] is None for r in spark.read.text(str(tmp_path / "j")).collect())
    assert sorted(r.id for r in W.csv_rows(df, str(tmp_path / "c"), "k", seed=1, after=10).collect()) == [11, 12, 13]
    t = W.VersionedTable(spark, "versions", str(tmp_path / "v"))
    t.replace(df)
    assert t.upsert(spark.createDataFrame([(1, "n", "n"), (9, "n", "n")], df.schema), "k").count() == 4
    assert t.insert(spark.createDataFrame([(1, "m", "m"), (10, "m", "m")], df.schema), "k").where("br = 'm'").count() == 1
    W.replace_partitions(df, str(tmp_path / "p"), "k")
    W.replace_partitions(df.where("k = 1"), str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    assert json.loads(W.report(df.groupBy().count())) == {"count": 3}


def test_stream_reads_each_file_once(spark, tmp_path):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    rows = lambda v, keys: spark.createDataFrame([(k, v) for k in keys], "k long, v string").coalesce(1)
    rows("a", [1, 2]).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    assert I.ingest(spark, str(source), "*.parquet", schema, target, "k").count() == 2
    rows("b", [2, 3]).write.mode("append").parquet(str(source))
    got = {r.k: r.v for r in I.ingest(spark, str(source), "*.parquet", schema, target, "k").collect()}
    assert got == {1: "a", 2: "b", 3: "b"}


def test_same_content_once(spark, tmp_path):
    for n, c in (("a", b"x"), ("b", b"x"), ("c", b"y")):
        (tmp_path / n).write_bytes(c)
    assert R.distinct_contents(spark, f"{tmp_path}/*").count() == 2
