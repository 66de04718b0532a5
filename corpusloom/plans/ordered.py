"""Order-dependent operators, tracks, near neighbours, admission and streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import alignment as A
from corpusloom.functions import boilerplate as B
from corpusloom.functions import text as T
from corpusloom.operators import nearest as N
from corpusloom.operators import sequence as S
from corpusloom.operators import subtitles as U
from corpusloom.plans.views import PAIRS, pairs, table
from corpusloom.session import shared_folder
from corpusloom.streaming import ingest as I

CHANGES = "pair_id long, line_no long, op string, br string, pt string"


def _changes(fn):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = fn([(int(n), a or "", b or "") for n, a, b in zip(rows.line_no, rows.br, rows.pt)])
        return pd.DataFrame([(rows.pair_id.iloc[0], *x) for x in got], columns=["pair_id", "line_no", "op", "br", "pt"])

    return run


def continuation_merge(spark, d):
    return S.over_segments(pairs(spark, d), "pair_id", "line_no", _changes(S.merge_continuations), CHANGES)


def neighbour_moves(spark, d):
    def run(rows: list[tuple]) -> list[tuple]:
        moved = S.move_clauses([(a or "", b or "") for *_, a, b in rows])
        return [(p, n, *sides) for (p, n, _, _), sides in zip(rows, moved)]

    return S.over_blocks(pairs(spark, d).select("pair_id", "line_no", "br", "pt"), "pair_id", "line_no", run, "pair_id long, line_no long, br string, pt string")


def move_preview(spark, d):
    """The moves with the greatest gain: between which lines, on which side, which way, and the piece that moves."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        log: list[tuple] = []
        S.move_clauses([(a or "", b or "") for a, b in zip(rows.br, rows.pt)], rounds=1, log=log)
        made = [(int(rows.line_no[k]), int(rows.line_no[k + 1]), ("br", "pt")[side], name, piece, round(gain, 6)) for k, side, name, piece, gain in log]
        return pd.DataFrame(made, columns=["line_no", "next_line_no", "side", "operation", "piece", "gain"])

    moves = S.over_segments(pairs(spark, d), "pair_id", "line_no", run, "line_no long, next_line_no long, side string, operation string, piece string, gain double")
    return moves.orderBy(F.col("gain").desc(), "line_no", "side").limit(8)


def prefix_clean(spark, d):
    """Pairs of which every third begins with what the row before it says, on both sides."""
    w = Window.partitionBy("pair_id").orderBy("line_no")
    again = lambda c: F.when(F.row_number().over(w) % 3 == 0, F.concat_ws(" ", F.lag(c).over(w), F.col(c))).otherwise(F.col(c)).alias(c)
    return S.over_segments(pairs(spark, d).select("pair_id", "line_no", again("br"), again("pt")), "pair_id", "line_no", _changes(S.clean_prefixes), CHANGES)


def _blocks(spark, d):
    e = table(spark, d, "events")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select("user_id", start.alias("start_ms"), (start + 60_000).alias("end_ms"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("track"))


def fragment_merge(spark, d):
    return U.merge_fragments(_blocks(spark, d).drop("track"), "user_id", 3_600_000).select("user_id", "start_ms", "end_ms", "text", F.col("fragments").cast("long").alias("fragments"))


FRAGMENT_MERGE = """WITH b AS (SELECT user_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 60000 AS end_ms, event_type AS text FROM events),
l AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, end_ms, text)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms, text ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT user_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY start_ms, end_ms, text) AS text, count(*) AS fragments FROM i GROUP BY user_id, island"""


def sessions(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = I.sessions(e, "user_id", "ts", "6 hours")
    return s.select("user_id", F.unix_millis("begins").alias("begins_ms"), F.unix_millis("ends").alias("ends_ms"), "n")


SESSIONS = """WITH b AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us FROM events),
l AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS new FROM b),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, min(ms) AS begins_ms, max(ms) + 21600000 AS ends_ms, count(*) AS n FROM i GROUP BY user_id, s"""


def _align(method):
    return lambda spark, d: U.align(_blocks(spark, d), "user_id", method)


def nearest(spark, d):
    """Every row's largest Jaccard with any other row, however small."""
    p = pairs(spark, d).select("line_no", T.tokens(F.lower("br")).alias("t"))
    return N.nearest_jaccard(p, "line_no", "t").select(F.col("k").alias("line_no"), F.round("j", 6).alias("nearest"))


def similar_pairs(spark, d):
    """Pairs of rows whose token sets have a Jaccard of 0.75 or more, copies with the first of them only; every fifth row is there again without its end."""
    p = pairs(spark, d).select("line_no", "br")
    cut = p.where("line_no % 5 = 0").select((-F.col("line_no") - 1).alias("line_no"), F.expr("left(br, greatest(length(br) - line_no % 20, 0))").alias("br"))
    p = p.unionByName(cut).select("line_no", T.tokens(F.lower("br")).alias("t"))
    return N.similar_pairs(p, "line_no", "t", 0.75).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("jaccard", 6).alias("jaccard"))


_TOK = "list_distinct(regexp_extract_all(lower(coalesce(br, '')), '" + T.TOKEN.replace("'", "''") + "'))"
_NEAREST = f"""{PAIRS}, s AS (SELECT line_no AS k, {_TOK} AS s FROM pairs),
j AS (SELECT a.k, max(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE)) AS j FROM s a JOIN s b ON a.k <> b.k AND len(a.s) > 0 AND len(b.s) > 0 GROUP BY a.k),
k AS (SELECT s.k, CASE WHEN len(s.s) = 0 AND (SELECT count(*) FROM s WHERE len(s) = 0) > 1 THEN 1 ELSE coalesce(j, 0) END AS j FROM s LEFT JOIN j ON s.k = j.k)"""
NEAREST = f"WITH {_NEAREST} SELECT k AS line_no, round(j, 6) AS nearest FROM k"
SIMILAR_PAIRS = f"""WITH {PAIRS}, p AS (SELECT line_no, br FROM pairs UNION ALL SELECT -line_no - 1, left(br, greatest(length(br) - line_no % 20, 0)) FROM pairs WHERE line_no % 5 = 0),
s AS (SELECT line_no AS k, list_sort({_TOK}) AS s FROM p), r AS (SELECT s, min(k) AS k FROM s WHERE len(s) > 0 GROUP BY s)
SELECT least(r.k, s.k) AS a, greatest(r.k, s.k) AS b, 1.0 AS jaccard FROM s JOIN r ON s.s = r.s AND s.k <> r.k
UNION ALL SELECT a.k, b.k, round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 6) FROM r a JOIN r b ON a.k < b.k AND 100 * len(list_intersect(a.s, b.s)) >= 75 * len(list_distinct(list_concat(a.s, b.s)))"""


def nearest_report(spark, d):
    p = pairs(spark, d).select("line_no", T.tokens(F.lower("br")).alias("t"))
    return N.nearest_report(N.nearest_jaccard(p, "line_no", "t"))


NEAREST_REPORT = f"""WITH {_NEAREST}
SELECT count(*) AS n, coalesce(round(avg(j), 4), 0) AS mean_max, coalesce(round(quantile_disc(j, 0.9), 4), 0) AS p90_max, count(*) FILTER (WHERE j >= 0.6) AS ge_0_6, count(*) FILTER (WHERE j >= 0.7) AS ge_0_7 FROM k"""


def admission(spark, d):
    """Candidates of each conversation in order of line, with the verdict of the admission control."""
    p = pairs(spark, d).withColumn("segment", F.col("pair_id"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = S.admit([(int(n), "short" if len(t or "") < 200 else "long", t or "") for n, t in zip(rows.line_no, rows.br)], {"short": 2, "long": 3})
        return pd.DataFrame([(rows.segment.iloc[0], *x) for x in got], columns=["segment", "line_no", "verdict"])

    return S.over_segments(p, "segment", "line_no", run, "segment long, line_no long, verdict string")


def sentence_moves(spark, d):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        moved = S.move_sentences([(a or "", b or "") for a, b in zip(rows.br, rows.pt)], A.damped_set_ratio)
        return pd.DataFrame([(p, n, a, b) for p, n, (a, b) in zip(rows.pair_id, rows.line_no, moved)], columns=["pair_id", "line_no", "br", "pt"])

    return S.over_segments(pairs(spark, d), "pair_id", "line_no", run, "pair_id long, line_no long, br string, pt string")


def alignment_flags(spark, d):
    """Features of each pair with its neighbours in the conversation, and what the policy says."""
    w = Window.partitionBy("pair_id").orderBy("line_no")
    three = lambda c: (F.lag(c).over(w), F.col(c), F.lead(c).over(w))
    names = [f"{side}{k}" for side in ("br", "pt") for k in range(3)]
    rows = pairs(spark, d).select("line_no", *[x.alias(n) for n, x in zip(names, (*three("br"), *three("pt")))])
    made = rows.select("line_no", A.feature_struct(tuple(F.col(n) for n in names[:3]), tuple(F.col(n) for n in names[3:])).alias("f"))
    return made.select("line_no", "f.*", A.policy(F.col("f")).alias("v")).select("*", "v.flagged", "v.reasons").drop("v")


def boilerplate(spark, d):
    return table(spark, d, "pages").select("page_id", B.content_udf(F.col("html")).alias("text"))


def stream_ingest(spark, d):
    schema = table(spark, d, "events").schema
    got = I.ingest(spark, d, "events.parquet", schema, shared_folder(spark, "stream"), "event_id")
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


STREAM_INGEST = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"

QUERIES = {
    "q1_continuation_merge": (continuation_merge, None),
    "q4_neighbour_moves": (neighbour_moves, None),
    "q8_prefix_clean": (prefix_clean, None),
    "q11_fragment_merge": (fragment_merge, FRAGMENT_MERGE),
    "q12_sessions": (sessions, SESSIONS),
    "q13_autosync": (_align("sync"), None),
    "q17_admission": (admission, None),
    "j11_assignment": (_align("optimal"), None),
    "j12_greedy": (_align("greedy"), None),
    "j14_nearest": (nearest, NEAREST),
    "j14_similar_pairs": (similar_pairs, SIMILAR_PAIRS),
    "o10_move_preview": (move_preview, None),
    "a32_nearest_report": (nearest_report, NEAREST_REPORT),
    "q7_sentence_moves": (sentence_moves, None),
    "t34_alignment_flags": (alignment_flags, None),
    "t58_boilerplate": (boilerplate, None),
    "stream_ingest": (stream_ingest, STREAM_INGEST),
}
