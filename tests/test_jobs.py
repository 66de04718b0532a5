"""Jobs over several tables or runs, numbers from counted ranges, and searches, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import alignment as A
from corpusloom.operators import examples as X
from corpusloom.operators import relational as R
from corpusloom.plans import jobs
from corpusloom.sources import readers, writers
from corpusloom.streaming import ingest as I

SIDES = "pair_id long, line_no long, br string, pt string"


def test_cleaning_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(1, 1, "Ele foi", "Ele foi"), (1, 2, "embora.", "embora."), (1, 3, "Ele foi embora. Depois voltou para casa.", "Ele foi embora. Depois voltou para casa."), (2, 4, "Bom dia, senhor.", "Nada disso hoje.")]
    df = spark.createDataFrame(rows, SIDES)
    folder = f"file://{tmp_path}/job"
    first = {n: sorted(map(tuple, t.collect())) for n, t in jobs.clean_corpus(df, folder).items()}
    assert first["merged"][0] == (1, 1, "Ele foi embora.", "Ele foi embora.") and [r[1] for r in first["merged"]] == [1, 3, 4]
    assert [r[1] for r in first["alike"]] == [1, 3]
    again = jobs.clean_corpus(df.where("line_no = 4"), folder)  # every step is there
    assert sorted(map(tuple, again["alike"].collect())) == first["alike"]
    assert jobs.clean_corpus(df.where("line_no = 4"), folder, reset=True)["alike"].count() == 0


def test_highlights():
    assert A.highlighted("o gato preto dorme", "o gato dorme bem") == "o gato preto dorme"  # one token between reached ones
    assert A.highlighted("o gato muito preto dorme", "o gato dorme") == "o gato [muito preto] dorme" and A.highlighted("x, y", "o") == "[x, y]"
    assert A.highlighted(None, "a") == "" and A.highlighted("a a", "a") == "a [a]"


def test_prompts(spark):
    got = spark.range(1).select(X.prompt("Say {source} in {lang}, as {this}.", source=F.lit("olá {lang}"), lang=F.lit("pt"))).first()[0]
    assert got == "Say olá {lang} in pt, as {this}."


@pytest.mark.parametrize("most, accuracy", [(100_000, 10_000), (10, 20), (1, 7)])
def test_exact_percentiles(spark, most, accuracy):
    rng = random.Random(4)
    for values in ([rng.gauss(0, 5) for _ in range(400)], [1.0] * 50 + [2.0] * 50 + [3.0], [float(rng.randrange(5)) for _ in range(300)], [7.0], []):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        shares = (0.0, 0.25, 0.5, 0.9, 1.0)
        got = R.exact_percentiles(df, "v", shares, most, accuracy)
        want = [r and float(r) for r in df.agg(*[F.percentile("v", F.lit(s)) for s in shares]).first()]
        assert got == [None if not values else pytest.approx(w) for w in want]


def test_running_places_of_skewed_keys(spark):
    rng = random.Random(5)
    keys = [*range(300), 2**60, -(2**60), *[rng.randrange(10**9) for _ in range(200)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    got = {r.k: r.at for r in R.running_place(df, "k", "at", rows=40).collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys))}
    sizes = [r["count"] for r in df.groupBy(R.counted_cells(df, "k", 40)).count().collect()]
    assert max(sizes) <= 120 and R.running_place(df.where("false"), "k", "at").count() == 0


def test_contiguous_ranges():
    for low, high, n in ((0, 9, 3), (5, 6, 4), (1, 7, 7)):
        parts = R.contiguous_ranges(low, high, n)
        assert [x for a, b in parts for x in range(a, b + 1)] == list(range(low, high + 1)) and len(parts) == n
        assert max(b - a for a, b in parts) - min(b - a for a, b in parts) <= 1


def test_contained_texts_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(60)] + [None, ""]
    needles = sorted({" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7) for _ in range(6)} | {texts[0][1:9] or "a", "b", "ab"})
    got = R.contained_texts(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", spark.createDataFrame(list(enumerate(needles)), "i long, needle string"), "needle")
    assert sorted((r.k, r.i) for r in got.collect()) == [(k, i) for k, t in enumerate(texts) for i, x in enumerate(needles) if t and x in t]
    assert R.contained_texts(spark.createDataFrame([(1, "a")], "k long, t string"), "k", "t", spark.createDataFrame([], "i long, needle string"), "needle").count() == 0


def test_csv_goes_on(spark, tmp_path):
    path = f"{tmp_path}/c"
    df = spark.createDataFrame([(3, 'x "y"'), (1, "b,c"), (2, None)], "k long, t string")
    writers.resume_csv(df, path, "k")
    writers.resume_csv(df.withColumn("k", F.col("k") + 10), path, "k")
    got = sorted((int(r.id), int(r.k), r.t) for r in readers.csv(spark, path, ["id", "k", "t"]).collect())
    assert got == [(1, 1, "b,c"), (2, 2, None), (3, 3, 'x "y"'), (4, 11, "b,c"), (5, 12, None), (6, 13, 'x "y"')]
    with pytest.raises(ValueError, match="other"):
        writers.resume_csv(df.withColumn("other", F.lit(1)), path, "k")


def test_batches_and_pages(spark):
    df = spark.range(10, numPartitions=3)
    assert [len(b) for b in readers.batches(df, 4)] == [4, 4, 2] and list(readers.batches(df.where("false"))) == []
    assert [r.id for r in readers.page(df, "id", 3, 5).collect()] == [6, 7, 8]


def test_old_versions_go(spark, tmp_path):
    v = writers.VersionedTable(spark, "some_versions", f"file://{tmp_path}/v")
    for k in range(3):
        v.replace(spark.range(k + 1))
    v.vacuum()
    assert spark.table("some_versions").count() == 3 and len(list((tmp_path / "v").iterdir())) == 1


def test_ingested_batches_are_compacted(spark, tmp_path):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    for k in range(3):
        spark.createDataFrame([(k, k), (9, k)], "k long, v long").coalesce(1).write.mode("append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    before = sorted(map(tuple, I.ingest(spark, str(source), "*.parquet", schema, target, "k").collect()))
    I.compact(spark, target, "k", 2)
    assert sorted(map(tuple, I.current(spark, target, "k").collect())) == before and len(before) == 4
    assert [d.name for d in (tmp_path / "out/data").iterdir()] == ["batch=2"]
    spark.createDataFrame([(0, 77)], "k long, v long").coalesce(1).write.mode("append").parquet(str(source))
    assert {r.k: r.v for r in I.ingest(spark, str(source), "*.parquet", schema, target, "k").collect()}[0] == 77


def test_translation_table_equals_plain_counting(spark):
    from collections import defaultdict

    from corpusloom.operators import lexical as L

    rows = [(1, ["a", "casa"], ["the", "house"]), (2, ["a", "casa", "azul"], ["the", "blue", "house"]), (3, ["azul", "azul"], ["blue"]), (4, [], ["x"]), (5, None, ["y"])]
    df = spark.createDataFrame(rows, "k long, a array<string>, b array<string>")
    keep = lambda x: x.sparkSession.createDataFrame(x.collect(), x.schema)
    got = {(r.x, r.y): r.p for r in L.translation_table(df, "k", "a", "b", keep, 3).collect()}
    p = defaultdict(lambda: 1.0)
    for _ in range(3):
        e, total = defaultdict(float), defaultdict(float)
        for _, xs, ys in rows:
            for y in ys:
                whole = sum(p[x, y] for x in xs or ())
                for x in xs or ():
                    e[x, y] += p[x, y] / whole
        for (x, _), v in e.items():
            total[x] += v
        p = {k: v / total[k[0]] for k, v in e.items()}
    assert got == pytest.approx(p)
    links = sorted((r.k, r.x, r.y) for r in L.mutual_links(df, "k", "a", "b", L.translation_table(df, "k", "a", "b", keep, 3)).collect())
    assert links == [(1, "a", "house"), (2, "a", "house"), (2, "azul", "blue"), (3, "azul", "blue")]  # "a" and "casa" always stand together


def test_pairs_of_words_are_not_written(spark):
    """Rows of several pieces with repeated words: the same chances and links as by plain counting, from tables with a row for a word, not for a pair of words."""
    import random
    from collections import Counter, defaultdict

    from corpusloom.operators import lexical as L

    r = random.Random(5)
    side = lambda name, n: [f"{name}{int(r.paretovariate(0.6)) % 60}" for _ in range(n)]
    rows = [(k, side("x", n), side("y", m)) for k, (n, m) in enumerate([(30, 120), (450, 210), (5, 401), (201, 3), (0, 4), (7, 0)] + [(6, 25)] * 20)]
    rows += [(90, None, ["y1"]), (91, ["x1"], None)]
    df, written = spark.createDataFrame(rows, "k long, a array<string>, b array<string>"), []

    def keep(x):
        got = x.collect()
        written.append(len(got))
        return x.sparkSession.createDataFrame(got, x.schema)

    pieces = [(k, Counter((a or [])[i : i + L.LONGEST]), Counter((b or [])[i : i + L.LONGEST])) for k, a, b in rows for i in (0, 200, 400)]
    p = defaultdict(lambda: 1.0)
    for _ in range(2):
        e, total = defaultdict(float), Counter()
        for _, xs, ys in pieces:
            for y, d in ys.items():
                whole = sum(p[x, y] * c for x, c in xs.items())
                for x, c in xs.items():
                    e[x, y] += d * p[x, y] * c / whole
        for (x, _), v in e.items():
            total[x] += v
        p = {k: v / total[k[0]] for k, v in e.items()}
    least = sorted(p.values())[-60]
    chances = L.translation_table(df, "k", "a", "b", keep, 2, least)
    assert max(written) <= 60 and len(written) == 3  # totals twice, chances once
    assert {(x.x, x.y): x.p for x in chances.collect()} == pytest.approx({k: v for k, v in p.items() if v >= least})
    assert {(x.x, x.y): x.p for x in L.translation_table(df, "k", "a", "b", keep, 2).collect()} == pytest.approx(p)
    wanted = set()
    for k in {k for k, _, _ in pieces}:
        seen = {(x, y): round(p[x, y], 12) for j, xs, ys in pieces if j == k for x in xs for y in ys if round(p[x, y], 12) >= round(least, 12)}
        of_x = {x: min((-v, y) for (z, y), v in seen.items() if z == x)[1] for x, _ in seen}
        of_y = {y: min((-v, x) for (x, z), v in seen.items() if z == y)[1] for _, y in seen}
        wanted |= {(k, x, y) for x, y in of_x.items() if of_y[y] == x}
    assert {(x.k, x.x, x.y) for x in L.mutual_links(df, "k", "a", "b", chances, round(least, 12)).collect()} == wanted and wanted


def test_blocks_of_words_whatever_their_sizes(monkeypatch):
    import pickle

    import numpy as np
    import pyarrow as pa

    from corpusloom.operators import lexical as L

    r = np.random.default_rng(4)
    sides = [[(r.zipf(1.4, n) % 50).astype(np.int64) for n in r.integers(0, most, 80)] for most in (9, 300)]
    batch = pa.RecordBatch.from_arrays([pa.array(s, pa.list_(pa.int64())) for s in sides], ["a", "b"])
    found = []
    for at_once, alone, dealt in ((10**6, 10**6, 10**6), (10**6, 0, 500), (50, 10, 40), (3, 2, 1)):
        for name, n in (("AT_ONCE", at_once), ("ALONE", alone), ("DEALT_AT_ONCE", dealt)):
            monkeypatch.setattr(L, name, n)
        e = {}
        for block in (0, 1):
            parts = [pickle.loads(x["what"][0].as_py()) for x in L._dealt([0, 1])(iter([batch])) if x["block"][0].as_py() == block]
            for xs, x, y, n in L._learnt(parts, lambda xs: [xs + 2.0], 2):
                assert not e.keys() & set(zip(xs[x].tolist(), y.tolist()))
                e |= zip(zip(xs[x].tolist(), y.tolist()), n.tolist())
        found.append(e)
    assert len(found[0]) > 300 and all(x == pytest.approx(found[0]) for x in found)


def test_mean_offset():
    from corpusloom.operators import subtitles as U

    a, b = [{"start_ms": 1000, "text": "x"}, {"start_ms": 3000, "text": "y"}], [{"start_ms": 500, "text": "x"}, {"start_ms": 3100, "text": "y"}]
    assert U.mean_offset(a, b, {0: (0, 0.5), 1: (1, 1.0)}) == (200.0, 500, 1.0, 0.75) and U.mean_offset(a, b, {}) == (0.0, 0.0, 0.0, 0.0)
