"""Joins: lookups, intersections, overlays, guards, ranges, neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import similarity as S
from corpusloom.functions import text as T
from corpusloom.operators import relational as R
from corpusloom.plans.views import PAIRS, documents, pairs, table


def pair_dedup(spark, d):
    return R.keep_first(pairs(spark, d), ["br", "pt"], ["line_no"])


PAIR_DEDUP = f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY br, pt ORDER BY line_no) AS n FROM pairs) SELECT line_no, pair_id, br, pt FROM r WHERE n = 1"


def intersect(spark, d):
    """Customers with orders of every one of three priorities; the first one's order date stands."""
    o = table(spark, d, "orders")
    lists = [o.where(F.col("o_orderpriority") == p).groupBy("o_custkey").agg(F.min("o_orderkey").alias(f"k{i}")) for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM"))]
    return lists[0].join(lists[1].select("o_custkey"), "o_custkey").join(lists[2].select("o_custkey"), "o_custkey").select("o_custkey", F.col("k0").alias("first_order"))


INTERSECT = "SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS first_order FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderpriority = '1-URGENT') > 0 AND count(*) FILTER (WHERE o_orderpriority = '2-HIGH') > 0 AND count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') > 0"


def lookup(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


LOOKUP = "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


def apply_changes(spark, d):
    p = pairs(spark, d)
    updates = p.where("line_no % 7 = 0").select("line_no", F.concat(F.lit("+"), "br").alias("br"), F.lit(None).cast("string").alias("pt"))
    deletes = p.where("line_no % 5 = 0").select("line_no")
    return R.apply_changes(p, updates, deletes, "line_no", ["br", "pt"])


APPLY_CHANGES = f"WITH {PAIRS} SELECT line_no, pair_id, CASE WHEN line_no % 7 = 0 THEN coalesce('+' || br, br) ELSE br END AS br, pt FROM pairs WHERE line_no % 7 = 0 OR line_no % 5 <> 0"


def upsert(spark, d):
    p = pairs(spark, d).select("line_no", "br")
    new = p.where("line_no % 3 = 0").withColumn("br", F.reverse("br")).unionByName(p.where("line_no % 11 = 0 and line_no % 3 <> 0").select((-F.col("line_no") - 1).alias("line_no"), "br"))
    return R.upsert(p, new, "line_no")


UPSERT = f"""WITH {PAIRS}, new AS (SELECT line_no, reverse(br) AS br FROM pairs WHERE line_no % 3 = 0 UNION ALL SELECT -line_no - 1 AS line_no, br FROM pairs WHERE line_no % 11 = 0 AND line_no % 3 <> 0)
SELECT * FROM new UNION ALL SELECT line_no, br FROM pairs WHERE line_no NOT IN (SELECT line_no FROM new)"""


def anti(spark, d):
    """Customers without an urgent order."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


ANTI = "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' WHERE o_custkey IS NULL"


def semi(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


SEMI = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) GROUP BY o_orderstatus"


def insert_missing(spark, d):
    docs = documents(spark, d).select("doc_id", F.lower(F.trim("text")).alias("t"))
    old = docs.where("doc_id % 2 = 0").dropDuplicates(["t"]).select("t")
    return R.insert_missing(old, docs.where("doc_id % 2 = 1").select("t"), "t").agg(F.count("*").alias("n"), F.sum(F.length("t")).cast("long").alias("chars"))


INSERT_MISSING = "WITH t AS (SELECT DISTINCT lower(trim(text)) AS t FROM documents) SELECT count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM t"


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def range_join(spark, d):
    e = _events(spark, d)
    a = e.where("event_type = 'purchase'").select(F.col("event_id").alias("a_id"), F.col("user_id").alias("a_user"), F.col("ms").alias("a_ms"))
    b = e.where("event_type = 'click'").select(F.col("event_id").alias("b_id"), F.col("user_id").alias("b_user"), F.col("ms").alias("b_ms"))
    near = R.within(a, b, "a_ms", "b_ms", 3_600_000, [("a_user", "b_user")])
    return near.select("a_id", "b_id", F.round(1 - F.abs(F.col("a_ms") - F.col("b_ms")) / 3_600_000, 6).alias("time_score"))


RANGE_JOIN = """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events)
SELECT a.event_id AS a_id, b.event_id AS b_id, round(1 - abs(a.ms - b.ms) / 3600000.0, 6) AS time_score FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.ms - b.ms) <= 3600000
WHERE a.event_type = 'purchase' AND b.event_type = 'click'"""


def neighbours(spark, d):
    w = Window.partitionBy("pair_id").orderBy("line_no")
    return pairs(spark, d).select("line_no", F.lag(F.length("br")).over(w).cast("long").alias("before"), F.length("br").cast("long").alias("here"), F.lead(F.length("br")).over(w).cast("long").alias("after"))


NEIGHBOURS = f"WITH {PAIRS} SELECT line_no, lag(length(br)) OVER w AS before, length(br) AS here, lead(length(br)) OVER w AS after FROM pairs WINDOW w AS (PARTITION BY pair_id ORDER BY line_no)"


def context_rows(spark, d):
    p = pairs(spark, d)
    w = Window.partitionBy("pair_id").orderBy("line_no")
    r = p.select("pair_id", "line_no", F.row_number().over(w).alias("rn"))
    hit = r.where("line_no % 10 = 0").select(F.col("pair_id").alias("p2"), F.col("line_no").alias("of_line"), F.col("rn").alias("at"))
    return r.join(hit, (F.col("pair_id") == F.col("p2")) & F.col("rn").between(F.col("at") - 1, F.col("at") + 1)).select("of_line", "line_no", (F.col("rn") - F.col("at")).cast("int").alias("distance"))


CONTEXT_ROWS = f"""WITH {PAIRS}, r AS (SELECT pair_id, line_no, row_number() OVER (PARTITION BY pair_id ORDER BY line_no) AS rn FROM pairs)
SELECT h.line_no AS of_line, r.line_no, CAST(r.rn - h.rn AS INTEGER) AS distance FROM r JOIN r h ON r.pair_id = h.pair_id AND r.rn BETWEEN h.rn - 1 AND h.rn + 1 WHERE h.line_no % 10 = 0"""


def _flags(spark, d):
    p = pairs(spark, d).select("line_no", F.size(T.tokens(F.col("br"))).alias("l"), F.round(S.type_jaccard(F.col("br"), F.col("pt")), 9).alias("base_sim"), F.length("br").alias("lb"), F.length("pt").alias("lp"))
    return p.withColumn("thr", S.adaptive_threshold(F.col("l"), 0.02, 0.06))


def similarity_flags(spark, d):
    return _flags(spark, d).where("base_sim < thr").select("line_no", F.round("base_sim", 6).alias("base_sim"), F.round("thr", 6).alias("thr"), F.col("l").cast("long").alias("l"))


_TOK = "regexp_extract_all({}, '" + T.TOKEN.replace("'", "''") + "')"
_FLAGS = f"""x AS (SELECT line_no, len({_TOK.format("coalesce(br, '')")}) AS l, list_distinct({_TOK.format("lower(coalesce(br, ''))")}) AS a, list_distinct({_TOK.format("lower(coalesce(pt, ''))")}) AS b, length(br) AS lb, length(pt) AS lp FROM pairs),
f AS (SELECT line_no, l, lb, lp, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 9) AS base_sim,
  CASE WHEN l <= 8 THEN 0.02 WHEN l >= 28 THEN 0.06 ELSE CAST(0.02 AS DOUBLE) + (l - 8) * ((CAST(0.06 AS DOUBLE) - CAST(0.02 AS DOUBLE)) / 20) END AS thr FROM x)"""
SIMILARITY_FLAGS = f"WITH {PAIRS}, {_FLAGS} SELECT line_no, round(base_sim, 6) AS base_sim, round(thr, 6) AS thr, l FROM f WHERE base_sim < thr"


def ratio_flags(spark, d):
    p = pairs(spark, d).select("line_no", F.length("br").alias("lb"), F.length("pt").alias("lp"))
    return p.where(S.ratio_is_bad(F.col("lb"), F.col("lp"), 0.5, 2.0)).select("line_no", F.round(S.length_ratio(F.col("lb"), F.col("lp")), 6).alias("ratio"))


RATIO_FLAGS = f"WITH {PAIRS} SELECT line_no, round(CASE WHEN length(br) > 0 AND length(pt) > 0 THEN length(pt) / CAST(length(br) AS DOUBLE) END, 6) AS ratio FROM pairs WHERE NOT (length(br) > 0 AND length(pt) > 0 AND length(pt) / CAST(length(br) AS DOUBLE) BETWEEN 0.5 AND 2.0)"


def apply_flags(spark, d):
    flags = ratio_flags(spark, d).select("line_no")
    return pairs(spark, d).join(flags, "line_no", "left_anti").select("line_no", "pair_id")


APPLY_FLAGS = f"WITH {PAIRS} SELECT line_no, pair_id FROM pairs WHERE length(br) > 0 AND length(pt) > 0 AND length(pt) / CAST(length(br) AS DOUBLE) BETWEEN 0.5 AND 2.0"


def worst_flag(spark, d):
    f = _flags(spark, d)
    both = f.select("line_no", F.lit("similarity").alias("reason"), "base_sim").unionByName(f.where(S.ratio_is_bad(F.col("lb"), F.col("lp"), 0.5, 2.0)).select("line_no", F.lit("ratio").alias("reason"), (F.col("base_sim") / 2).alias("base_sim")))
    return R.keep_first(both, ["line_no"], ["base_sim", "reason"]).select("line_no", "reason", F.round("base_sim", 6).alias("base_sim"))


WORST_FLAG = f"""WITH {PAIRS}, {_FLAGS}, u AS (SELECT line_no, 'similarity' AS reason, base_sim FROM f UNION ALL SELECT line_no, 'ratio', base_sim / 2 FROM f WHERE NOT (lb > 0 AND lp > 0 AND lp / CAST(lb AS DOUBLE) BETWEEN 0.5 AND 2.0)),
r AS (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY base_sim, reason) AS n FROM u) SELECT line_no, reason, round(base_sim, 6) AS base_sim FROM r WHERE n = 1"""


def vocabulary_full_join(spark, d):
    v = documents(spark, d).select("lang", F.explode(T.words(F.lower("text"))).alias("tok")).where("lang in ('de', 'fr')").groupBy("lang", "tok").agg(F.count("*").alias("c"))
    a, b = v.where("lang = 'de'").select("tok", F.col("c").alias("c_a")), v.where("lang = 'fr'").select("tok", F.col("c").alias("c_b"))
    return a.join(b, "tok", "full").na.fill(0).groupBy((F.col("c_a") > 0).alias("in_a"), (F.col("c_b") > 0).alias("in_b")).agg(F.count("*").alias("types"), F.sum(F.col("c_a") + F.col("c_b")).cast("long").alias("tokens"))


VOCABULARY_FULL_JOIN = """WITH v AS (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\S+')) AS tok FROM documents WHERE lang IN ('de', 'fr')),
w AS (SELECT tok, count(*) FILTER (WHERE lang = 'de') AS a, count(*) FILTER (WHERE lang = 'fr') AS b FROM v GROUP BY tok)
SELECT a > 0 AS in_a, b > 0 AS in_b, count(*) AS types, CAST(sum(a + b) AS BIGINT) AS tokens FROM w GROUP BY 1, 2"""


def shared_vocabulary(spark, d):
    a, b = F.array_distinct(T.tokens(F.lower("br"))), F.array_distinct(T.tokens(F.lower("pt")))
    return pairs(spark, d).select("line_no", F.size(F.array_intersect(a, b)).cast("long").alias("shared"))


SHARED_VOCABULARY = f"WITH {PAIRS} SELECT line_no, len(list_intersect(list_distinct({_TOK.format(chr(108) + 'ower(coalesce(br, ' + chr(39) * 2 + '))')}), list_distinct({_TOK.format('lower(coalesce(pt, ' + chr(39) * 2 + '))')}))) AS shared FROM pairs"

QUERIES = {
    "w1_pair_dedup": (pair_dedup, PAIR_DEDUP),
    "w2_worst_flag": (worst_flag, WORST_FLAG),
    "w5_neighbours": (neighbours, NEIGHBOURS),
    "w8_context": (context_rows, CONTEXT_ROWS),
    "j1_intersect": (intersect, INTERSECT),
    "j2_lookup": (lookup, LOOKUP),
    "j3_apply_changes": (apply_changes, APPLY_CHANGES),
    "j5_anti": (anti, ANTI),
    "j7_semi": (semi, SEMI),
    "j8_vocabulary_full_join": (vocabulary_full_join, VOCABULARY_FULL_JOIN),
    "j10_range_join": (range_join, RANGE_JOIN),
    "k2_upsert": (upsert, UPSERT),
    "k3_insert_missing": (insert_missing, INSERT_MISSING),
    "e1_ratio_flags": (ratio_flags, RATIO_FLAGS),
    "e2_similarity_flags": (similarity_flags, SIMILARITY_FLAGS),
    "e3_apply_flags": (apply_flags, APPLY_FLAGS),
    "r18_shared_vocabulary": (shared_vocabulary, SHARED_VOCABULARY),
}
