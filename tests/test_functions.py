import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import boilerplate as B
from corpusloom.functions import quality as Q
from corpusloom.functions import similarity as S
from corpusloom.functions import text as T


def values(spark, fn, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(fn(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "fn, given, wanted",
    [
        (T.clean_text, [None, "", " a \n <i>b</i> {x}c "], ["", "", "a b c"]),
        (T.strip_leading_dash, ["- olá", " – x", "a-b"], ["olá", "x", "a-b"]),
        (T.dash_after_punctuation, ["Sim, - disse", "a.—b"], ["Sim, disse", "a. b"]),
        (T.drop_speaker_labels, ["João Silva: olá", "Oi. MARIA : bom dia", "às 10:30"], ["olá", "bom dia", "às 10:30"]),
        (T.normalize_spaces, ["a  b , c !", None], ["a b, c!", ""]),
        (T.capitalize_first_letter, ["¿élan", "12 a", ""], ["¿Élan", "12 A", ""]),
        (T.has_inner_hard_stop, ["A. B.", "A b."], [True, False]),
        (T.last_sign, ['fim." ', "x", ""], [".", "x", ""]),
        (T.sentences, ["O Dr. Sá foi. E tu? Sim", None, "Lei § 5 vale. N.º. 3"], [["O Dr. Sá foi.", "E tu?", "Sim"], [], ["Lei § 5 vale.", "N.º. 3"]]),
        (T.tokens, ["Guarda-chuva d'água 12!", None], [["Guarda-chuva", "d'água", "12"], []]),
        (T.match_key, ["Ação, NÃO!", ""], ["acao nao", ""]),
        (T.srt_time, ["3723004"], ["01:02:03,004"]),
        (T.without_thoughts, ["<think>a\nb</think>  sim "], ["sim"]),
        (T.remove_bullet, ["12. item", "1) item"], ["item", "item"]),
        (T.close_quote_gaps, ['" olá "'], ['"olá"']),
        (T.remove_mentions, ["oi @joão_1 tudo"], ["oi  tudo"]),
        (T.remove_initial_labels, ["A. -- Vim."], ["Vim."]),
        (T.author_chain, ["RT @ana: <b>«olá»</b> #hoje ver http://a.com/b?c fim"], ['"olá" ver fim']),
    ],
)
def test_text(spark, fn, given, wanted):
    got = values(spark, (lambda c: fn(c.cast("long"))) if fn is T.srt_time else fn, given)
    assert got == wanted


def test_predicates(spark):
    bad = {"t40_starts_with_month": "March 3", "t41_long_word": "a" * 21, "t42_bad_start": "#x", "t43_bad_middle": "a | b", "t44_bad_end": "a (", "t45_many_points": "a....", "t46_empty": "", "t47_bad_sign": "a…", "t48_odd_brackets": "a)", "t49_odd_quotes": 'a"'}
    for name, text in bad.items():
        assert values(spark, Q.BAD[name], [text, "Um texto bom."]) == [True, False], name
    assert values(spark, Q.passes, ["Um texto (bom).", "mau ("]) == [True, False]


def test_edit_measures_against_tables():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(10))) for _ in "ab")
        last = list(range(len(b) + 1))
        common = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            row, crow = [i], [0]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
                crow.append(common[j - 1] + 1 if x == y else max(common[j], crow[-1]))
            last, common = row, crow
        assert S.edit_distance(a, b) == last[-1] and S.common_subsequence(a, b) == common[-1]
    assert S.blended("", "") == 1 and S.blended("a", "") == 0 and S.blended("olá", "olá") == pytest.approx(1)


def test_alignment_measures():
    a, b = "o gato dorme".split(), "O gato come".split()
    links = S.same_form_links(a, b)
    assert links == [(0, 0), (1, 1)]
    assert S.linked_types(a, b, links) == 0.5 and S.coverage(a, b, links) == pytest.approx(2 / 3)
    assert S.uncovered_runs(6, {0, 2, 5}) == [(3, 5)]


def test_similarity_udf(spark):
    df = spark.createDataFrame([("casa", "cama"), (None, None)], "a string, b string")
    assert [round(r[0], 3) for r in df.select(S.as_udf(S.indel_ratio)("a", "b")).collect()] == [0.75, 1.0]


def test_boilerplate():
    text = "o livro que a menina leu em casa e na escola de que se fala com os amigos da rua " * 3
    page = f"<html><head><title>x</title></head><body><div><a href=a>home</a> <a href=b>news</a></div><h1>título</h1><p>{text}</p><p>© 2020 loja</p></body></html>"
    assert B.content(page) == "título\n" + text.strip()
    assert B.content(None) == "" and B.content("<p>curto</p>") == "" and B.content("<p>" + "xyz " * 40 + "</p>") == ""
    assert B.content(page + "<!--" + "x" * 6 * len(page) + "-->") == ""
    assert B.plain_text("a<script>x</script>&amp;<b>c</b>") == "a & c"


def test_alignment_features_and_policy(spark):
    from corpusloom.functions import alignment as A

    same = A.features((None, "o gato preto dorme muito", None), (None, "o gato preto dorme muito", None))
    assert same["cov_min"] == same["base_sim"] == 1 and same["br_len"] == 5
    rows = [(0, None, "o gato preto dorme muito hoje ali", None, None, "o gato preto dorme muito hoje ali", None), (1, None, "o gato preto dorme", None, None, "choveu ontem toda noite", None)]
    df = spark.createDataFrame(rows, "k int, a string, b string, c string, d string, e string, f string")
    made = df.select("k", A.feature_struct((F.col("a"), F.col("b"), F.col("c")), (F.col("d"), F.col("e"), F.col("f"))).alias("x"))
    got = {r.k: (r.v.flagged, r.v.reasons) for r in made.select("k", A.policy(F.col("x")).alias("v")).collect()}
    assert got == {0: (False, "ok"), 1: (True, "low_similarity")}
    assert A.token_set_ratio("a b c", "a b") == 1 and A.token_set_ratio("", "a") == 0
    assert A.damped_set_ratio("abc", "abc") == pytest.approx(0.0625) and A.text_only_score("a", "a") == 1


def test_repairs(spark):
    from corpusloom.functions import repair as P

    assert P.capitalise_sentences('olá. "tudo bem?\nfim') == 'Olá. "Tudo bem?\nFim'
    assert P.mend_unicode("OlÃ¡") == "Olá" and P.mend_unicode(None) == "" and P.to_ascii("Ação…") == "Acao..."
    df = spark.createDataFrame([("á",), (None,)], "t string")
    assert [r[0] for r in df.select(P.column(P.to_ascii, F.col("t"))).collect()] == ["a", ""]
