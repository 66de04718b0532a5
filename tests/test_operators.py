import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import examples as X
from corpusloom.operators import metrics as M
from corpusloom.operators import nearest as N
from corpusloom.operators import relational as R
from corpusloom.operators import sequence as S
from corpusloom.operators import subtitles as U


def test_merge_continuations():
    rows = [(1, "Ele foi", "Ele foi"), (2, "embora.", "embora."), (3, "Fim.", "Fim."), (5, "", "só um lado longo que não continua mesmo nada.")]
    assert S.merge_continuations(rows)[:2] == [(1, "update", "Ele foi embora.", "Ele foi embora."), (2, "delete", None, None)]
    assert (5, "delete", None, None) in S.merge_continuations(rows)
    assert S.merge_continuations([]) == []


def test_normal_line():
    assert S.normal_line("- JOÃO: OLÁ. TUDO BEM?") == "Olá. Tudo bem?"
    assert S.normal_line("“ 'sim' ”") == "sim" and S.normal_line(None) == "" and S.normal_line('"') == ""
    for s in ("- Olá , tudo", "“a” b", "A: b"):
        assert S.normal_line(S.normal_line(s)) == S.normal_line(s)


def test_clauses():
    assert S.split_tail("vamos embora,agora") == ("vamos embora", "agora") and S.split_head("vamos embora,agora") == ("vamos embora,", "agora")
    assert S.split_tail("um - dois") == ("um", "dois") and S.split_head("um - dois - três") == ("um -", "dois - três")
    assert S.split_tail("a, " + "b" * 61) == ("a, " + "b" * 61, "") and S.split_head("a" * 60 + ", b") == ("", "a" * 60 + ", b") and S.split_head("a" * 59 + ", b") == ("a" * 59 + ",", "b")
    assert S.split_tail("Um. Dois. Três") == ("Um. Dois.", "Três") and S.split_head("Um. Dois. Três") == ("Um.", "Dois. Três")
    assert S.split_tail(None) == ("", "") and S.split_head("só") == ("", "só") and S.split_tail("fim,") == ("fim,", "")


def test_sentences_keep_every_sign():
    assert S.sentences("Lei § 5 vale. O Sr. Sá veio… Sim? p.ex. hoje.") == ["Lei § 5 vale.", "O Sr. Sá veio…", "Sim?", "p.ex. hoje."]
    assert S.sentences(None) == [] and S.sentences(" . ") == ["."] and S.sentences("DR. X. y") == ["DR. X.", "y"]
    assert S.sentence_case("OLÁ! 3 VEZES.") == "Olá! 3 Vezes." and S.sentence_case("Já ESTÁ") == "Já ESTÁ" and S.sentence_case("12") == "12"


def test_blocks_with_seams_equal_one_block(spark):
    rng = random.Random(9)
    words = "casa gato rio sol mar pão".split()
    said = lambda: " ".join(rng.choices(words, k=rng.randrange(2, 7))).capitalize() + "."
    rows = [(k % 2, k, f"{said()} {said()}", said()) for k in range(40)]
    once = lambda part: [(a, b, x.upper(), y) for a, b, x, y in part]
    assert list(S.in_blocks(iter(rows), once, 7, 3)) == once(rows) and list(S.in_blocks(iter(()), once, 7, 3)) == []
    move = lambda part: [(a, b, *m) for (a, b, _, _), m in zip(part, S.move_clauses([r[2:] for r in part]))]
    df = spark.createDataFrame(rows, "pair_id long, line_no long, br string, pt string")
    got = {r.line_no: (r.br, r.pt) for r in S.over_blocks(df, "pair_id", "line_no", move, "pair_id long, line_no long, br string, pt string").collect()}
    want = {b: (x, y) for k in (0, 1) for _, b, x, y in move([r for r in rows if r[0] == k])}
    assert got == want
    log = []
    S.move_clauses([("Bom dia a todos. Vamos para casa agora.", "Bom dia a todos."), ("Está frio.", "Vamos para casa agora. Está frio.")], log=log)
    assert [(x[0], x[1], x[2], x[3]) for x in log] == [(0, 1, "head_from_next", "Vamos para casa agora.")] and log[0][4] > 0.04


def test_move_clauses_moves_a_sentence_over():
    rows = [("Bom dia a todos. Vamos para casa agora.", "Bom dia a todos."), ("Está frio.", "Vamos para casa agora. Está frio.")]
    assert S.move_clauses(rows) == [("Bom dia a todos. Vamos para casa agora.", "Bom dia a todos. Vamos para casa agora."), ("Está frio.", "Está frio.")]
    assert S.move_clauses([]) == []


def test_clean_prefixes():
    first = "O gato preto dorme em cima da mesa."
    rows = [(1, first, first), (2, f"{first} Depois acorda.", f"{first} Depois acorda."), (3, "Nada a ver com isso hoje.", "Nada.")]
    assert S.clean_prefixes(rows) == [(2, "delete", None, None)]
    assert S.clean_prefixes(rows, trim=True) == [(2, "update", "Depois acorda.", "Depois acorda.")]
    assert S.collapse_repeats(["Olá mundo.", "olá, mundo", "outro"]) == ["Olá mundo.", "outro"]


def test_admission():
    rows = [(1, "t", "um dois três quatro"), (2, "t", "Um dois três quatro!"), (3, "t", "um dois três quatro cinco"), (4, "u", "x y z"), (5, "t", "a b c d e")]
    assert S.admit(rows, {"t": 2}) == [(1, "accepted"), (2, "seen"), (3, "alike"), (4, "quota"), (5, "accepted")]


def test_assignment_is_optimal_and_one_to_one(monkeypatch):
    monkeypatch.setattr(U, "LEAST_SCORE", 0)
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        scores = {i: {j: rng.random() for j in range(m) if rng.random() < 0.6} for i in range(n)}
        best = (0, 0.0)
        for pick in itertools.product(*[[None, *scores[i]] for i in range(n)]):
            used = [x for x in pick if x is not None]
            if len(used) == len(set(used)):
                best = max(best, (len(used), sum(scores[i][x] for i, x in enumerate(pick) if x is not None)))
        got = U.optimal(scores, n)
        assert len({j for j, _ in got.values()}) == len(got) == best[0]
        assert sum(s for _, s in got.values()) == pytest.approx(best[1])
        assert sum(s for _, s in U.greedy(scores, n).values()) <= best[1] + 1e-9 or len(U.greedy(scores, n)) < len(got)


def test_synchronise_finds_the_shift():
    b = [{"start_ms": 5000 * k, "text": f"frase número {k * 7919}"} for k in range(12)]
    a = [{"start_ms": x["start_ms"] + 2300, "text": x["text"]} for x in b]
    shift, pairs = U.synchronise(a, b)
    assert abs(shift - 2300) < 50 and len(pairs) == 12
    assert U.synchronise([], b)[1] == {}


def test_fragments(spark):
    rows = [(1, 0, 1000, "Olá,"), (1, 1100, 2000, "mundo."), (1, 2050, 3000, "novo"), (1, 3100, 3500, "dia"), (1, 9000, 9500, "fim")]
    got = U.merge_fragments(spark.createDataFrame(rows, "film long, start_ms long, end_ms long, text string"), "film").orderBy("start_ms").collect()
    assert [(r.text, r.end_ms, r.fragments) for r in got] == [("Olá, mundo.", 2000, 2), ("novo dia", 3500, 2), ("fim", 9500, 1)]


def test_align_in_spark(spark):
    rows = [(1, 0, "olá mundo", "a"), (1, 100, "olá mundo", "b"), (1, 500_000, "só", "a")]
    df = spark.createDataFrame(rows, "film long, start_ms long, text string, track string")
    got = {r.a_start_ms: r.b_start_ms for r in U.align(df, "film").collect()}
    assert got == {0: 100, 500_000: None}


def test_ranges_equal_the_nested_loop(spark):
    rng = random.Random(2)
    a, b = ([(k, rng.randrange(-300, 300)) for k in range(40)] for _ in "ab")
    got = R.within(spark.createDataFrame(a, "i long, x long"), spark.createDataFrame(b, "j long, y long"), "x", "y", 25)
    assert {(r.i, r.j) for r in got.collect()} == {(i, j) for i, x in a for j, y in b if abs(x - y) <= 25}


def test_quotas():
    assert R.quotas(10, [1, 1, 1]) == [4, 3, 3] and R.quotas(3, [0.5, 0.5]) == [2, 1] and R.quotas(5, [0, 0]) == [0, 0]


def test_splits_cover_the_input(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    got = {r.split: r.n for r in R.ratio_split(df, "k", 1).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 802, "valid": 100, "test": 101}


def test_changes_keep_count(spark):
    base = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "k long, t string")
    out = R.apply_changes(base, base.where("k = 1").selectExpr("k", "'new' AS t"), base.where("k in (1, 2)").select("k"), "k", ["t"])
    assert {r.k: r.t for r in out.collect()} == {0: "t0", 1: "new", 3: "t3", 4: "t4", 5: "t5"}


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice("abcdefgh") for _ in range(rng.randrange(7))]) for k in range(60)]
    got = {(r.a, r.b): round(r.jaccard, 6) for r in N.similar_pairs(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t", 0.6).collect()}
    sets = {k: frozenset(t) for k, t in rows}
    rep = {}
    for k, s in sets.items():
        rep.setdefault(s, k)
    wanted = {}
    for a, b in itertools.combinations(sets, 2):
        s, t = sets[a], sets[b]
        if s and t and len(s & t) >= 0.6 * len(s | t) and (rep[s] == a and (s == t or rep[t] == b)):
            wanted[min(a, b), max(a, b)] = round(len(s & t) / len(s | t), 6)
    assert got == wanted


def test_labels_and_messages(spark):
    df = spark.createDataFrame([("PT-BR ",), ("outro",), (None,)], "l string")
    assert [r[0] for r in df.select(X.repaired_label(F.col("l"), {"pt-br": "pt-BR"})).collect()] == ["pt-BR", "outro", None]
    assert [r[0] for r in spark.createDataFrame([("Brasil e Portugal",), ("EQUAL",), ("x",)], "l string").select(X.variety_label(F.col("l"))).collect()] == ["pt-BR", "equal", None]
    chat = X.chat_messages(spark.createDataFrame([(1, "a", "b")], "source_id long, user_text string, assistant_text string")).first()
    assert [m.role for m in chat.messages] == ["system", "user", "assistant"]


def plain_bleu(pairs, orders, smooth):
    """BLEU of (hyp, ref) token lists, counted one by one."""
    from collections import Counter
    from math import exp, log

    matched, total = [0] * 4, [0] * 4
    for hyp, ref in pairs:
        for n in range(1, 5):
            a, b = (Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1)) for x in (hyp, ref))
            matched[n - 1] += (a & b).total()
            total[n - 1] += a.total()
    used = [n for n in range(4) if total[n]]
    if not any(matched) or len(used) < orders or (not smooth and any(not matched[n] for n in used)):
        return 0.0
    logs, zeros = [], 0
    for n in used:
        zeros += not matched[n]
        logs.append(log(matched[n] / total[n] if matched[n] else 1 / (2**zeros * total[n])))
    h, r = (sum(map(len, x)) for x in zip(*pairs))
    return round(100 * (1 if h >= r else exp(1 - r / h)) * exp(sum(logs) / len(logs)), 4)


def test_bleu(spark):
    schema = "id long, hyp string, ref string"
    assert M.corpus_bleu(spark.createDataFrame([(1, "a b c d e", "a b c d e")], schema)).first().bleu == 100
    no_fours = M.corpus_bleu(spark.createDataFrame([(1, "a b c d e", "a b c x y")], schema)).first()
    assert no_fours.bleu == 0 and no_fours.bleu_smoothed == plain_bleu([("a b c d e".split(), "a b c x y".split())], 4, True) > 0
    rng = random.Random(8)
    texts = [(k, " ".join(rng.choices("abcd", k=rng.randrange(9))), " ".join(rng.choices("abcd", k=rng.randrange(1, 9)))) for k in range(60)]
    split = [(h.split(), r.split()) for _, h, r in texts]
    df = spark.createDataFrame(texts, schema)
    got = M.corpus_bleu(df, tokenise=True).first()
    assert (got.bleu, got.bleu_smoothed) == (plain_bleu(split, 4, False), plain_bleu(split, 4, True))
    each = {k: plain_bleu([p], 1, True) for k, p in enumerate(split)}
    assert {r.id: r.sentence_bleu for r in M.sentence_bleu(df).collect()} == pytest.approx(each)
    assert [r.id for r in M.worst_by_bleu(df, 7).collect()] == sorted(each, key=lambda k: (each[k], k))[:7]
    assert tuple(M.corpus_bleu(df.where("false")).first()) == (0, 0, 0.0, 0.0)


@pytest.mark.parametrize("text, tokens", [("Hello, world.", "Hello , world ."), ("3,5 and 4.", "3,5 and 4 ."), ("10-year (old)", "10 - year ( old )"), ("a &amp; b&lt;c", "a & b < c"), ("it's “so”", "it's “so”"), ("", ""), ("x-\ny", "xy")])
def test_bleu_tokens(spark, text, tokens):
    assert spark.createDataFrame([(text,)], "t string").select(M.bleu_tokens(F.col("t"))).first()[0] == tokens.split()


def test_sentence_moves():
    from corpusloom.functions.alignment import damped_set_ratio

    rows = [("vamos todos para casa agora mesmo.", "vamos todos para casa agora mesmo. amanhã faremos tudo outra vez."), ("amanhã faremos tudo outra vez.", "")]
    assert S.move_sentences(rows, damped_set_ratio) == [(rows[0][0], rows[0][0]), (rows[1][0], rows[1][0])]


def test_targets(spark):
    df = spark.createDataFrame([("<BR2PT> a b",), ("<CLS> equal",), ("<CLS> no",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.target_format(F.col("t"))).collect()] == ["translation", "classification", "bad", "bad", "bad"]


def test_texts_that_only_begin_alike_stay(spark, tmp_path):
    begin = "The same twenty characters and more, "
    rows = [(1, begin + "one"), (2, begin + "two"), (3, (begin + "TWO").upper()), (4, begin + "two"), (5, ""), (6, None), (7, "ẞ" + begin), (8, "other")]
    spark.createDataFrame([(k, t, "xx" if k == 8 else "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    from corpusloom import plans

    got = plans.queries()["a8_canonical_text"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.chars) for r in got) == [(1, len(rows[0][1])), (4, len(rows[3][1])), (7, len(rows[6][1])), (8, 5)]


UNIFIED_ROWS = [(1, "OpenSubs", " a ", "b", None), (2, "OpenSubs", "a", " ", None), (3, "PtBrVarId", "", "b", "pt-PT"), (4, "PtBrVId", "a", "b", "x"), (5, "FRMT", "a", "b", None), (6, None, None, "b", "pt-BR")]


@pytest.mark.parametrize("mode, back", [("multitask", 0), ("translation", 10_000), ("classification", 0)])
def test_chat_examples_of_each_dataset(spark, mode, back):
    df = spark.createDataFrame(UNIFIED_ROWS, "k long, dataset string, text_pt_br string, text_pt_pt string, label string")
    got = X.dataset_chat_examples(df, "k", 1, mode, back)
    way = ("translate_pt2br", "b", "a") if back else ("translate_br2pt", "a", "b")
    translations = {(1, *way), (5, *way)}
    classes = {(k, "classify", t, v) for k in (1, 5) for t, v in (("a", "pt-BR"), ("b", "pt-PT"))} | {(3, "classify", "b", "pt-PT"), (6, "classify", "b", "pt-PT")}
    wanted = {"multitask": translations | classes, "translation": translations, "classification": classes}[mode]
    assert sorted((r.source_id, r.task, r.source, r.target) for r in got.collect()) == sorted(wanted)
    said = X.task_messages(got).first().messages
    assert [m.role for m in said] == ["system", "user", "assistant"] and said[1].content.endswith((": a", ": b"))
    with pytest.raises(ValueError):
        X.dataset_chat_examples(df, "k", 1, "both")


def test_task_files_and_what_is_skipped(spark):
    t = [(1, "a", "<pt-br> z", "b", " BR2PT"), (2, " ", " <pt-br> z", "b", None), (3, "a", "z", "b", ""), (4, "a", "<br-pt> z", "b", "xx"), (5, None, "<br-pt> ", "b", None), (6, "a", "<br-pt> a", " ", None)]
    c = [(7, "a", None, " PT-br"), (8, None, "<id> z", "pt-PT"), (9, "a", "z", "equal"), (10, "a", "z", None), (11, "", "<id>", "equal")]
    t, c = spark.createDataFrame(t, "k long, source_text string, input_text string, target_text string, direction string"), spark.createDataFrame(c, "k long, text string, input_text string, label string")
    translations, classes = [(1, "translate_br2pt", "a", "b"), (2, "translate_pt2br", "z", "b")], [(7, "classify", "a", "pt-BR"), (8, "classify", "z", "pt-PT")]
    for mode, wanted, counts in (("multitask", translations + classes, (11, 4, 1, 1, 2, 2)), ("translation", translations, (6, 2, 1, 1, 0, 0)), ("classification", classes, (5, 2, 0, 0, 2, 2))):
        got = X.task_verdicts(t, c, "k", mode)
        assert sorted((r.source_id, r.task, r.source, r.target) for r in X.task_examples(got).collect()) == wanted
        assert tuple(X.task_counts(got).first()) == counts


@pytest.mark.parametrize("block", [3, 1024])
def test_nearest_jaccard_of_every_row(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(5)
    rows = [(k, [str(rng.randrange(60)) for _ in range(rng.randrange(9))]) for k in range(40)] + [(40, None), (41, []), (42, ["only"]), (43, ["1", "2", "1"]), (44, ["2", "1"])]
    got = N.nearest_jaccard(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t")
    sets = {k: set(t or ()) for k, t in rows}
    want = {k: max(len(s & t) / len(s | t) if s | t else 1.0 for m, t in sets.items() if m != k) for k, s in sets.items()}
    assert {r.k: r.j for r in got.collect()} == want and 0 < min(x for x in want.values() if x) < 0.3
    assert N.nearest_jaccard(spark.createDataFrame([(1, []), (2, ["a"])], "k long, t array<string>"), "k", "t").agg(F.max("j")).first()[0] == 0
    ranked = sorted(want.values())
    r = N.nearest_report(got).first()
    assert (r.n, r.mean_max, r.p90_max, r.ge_0_6, r.ge_0_7) == (45, round(sum(ranked) / 45, 4), round(ranked[-(-9 * 45 // 10) - 1], 4), sum(x >= 0.6 for x in ranked), sum(x >= 0.7 for x in ranked))
    empty = N.nearest_report(N.nearest_jaccard(got.where("k < 0").select("k", F.array(F.lit("x")).alias("t")), "k", "t")).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0, 0)
