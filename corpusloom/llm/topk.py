"""Exact top-k by integer inner product, with block-at-a-time pruning.

Vectors are rows of a forward index over terms (their components).  In order of id, every 128 vectors form a block, which keeps each
term's largest and smallest weight; 32 blocks form a range.  A query's bound on a block is the sum over terms of the better of
the two products.  The search has two steps.  First each query is scored against the block with its largest bound, and the k-th
score found there is where it starts.  Then each query is sent only to ranges that hold a block whose bound reaches that score; there
it visits blocks in order of falling bound, scores a whole block through its forward index, and stops when the next bound is below
the best k-th score it has seen.  The few best of each range are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.workspace import Workspace

#: Vectors in a block, blocks in a range, ranges whose maxima one task holds, and queries in a set.
BLOCK, RANGE, SUMMARY, QUERIES = 128, 32, 128, 4096
_LONGEST = np.iinfo(np.int64)
#: Beyond any score: added to scores it makes them numbers of equally many digits, which sort as text.
_FAR = 5 * 10**59


def number_kind(a: np.ndarray, b: np.ndarray) -> type:
    """In which sums of products of the rows of two integer matrices are exact: float64 where every partial sum fits its 53 bits, else int64 or Python's integers."""
    if not a.size or not b.size:
        return np.float64
    largest = max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min()))) * a.shape[1]
    return np.float64 if largest < 2**53 else np.int64 if largest < 2**63 else object


def bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Greatest score that each query may have in each block, from the blocks' largest and smallest weights."""
    kind = number_kind(queries, np.concatenate([top, low]))
    q, zero = queries.astype(kind), kind(0) if kind is not object else 0
    return np.maximum(q, zero) @ top.astype(kind).T + np.minimum(q, zero) @ low.astype(kind).T


def _best(scores: list, ids: list, k: int) -> list[int]:
    return sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k]


def top_in_blocks(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, start: np.ndarray | None = None, visits: list | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """(query position, id, score) of each query's k best among ``vectors``, its own id left out, ties to the smaller id.

    ids rise.  ``start`` is a score for each query that k candidates elsewhere are known to reach: what is below it is left out.  ``visits`` gets the
    number of (query, block) pairs that were scored.
    """
    n, nq = len(ids), len(queries)
    kind = number_kind(queries, vectors)
    edges = np.arange(0, n, block)
    top, low = np.maximum.reduceat(vectors, edges, axis=0), np.minimum.reduceat(vectors, edges, axis=0)
    bound = bounds(queries, top, low)
    who_out, id_out, score_out = [], [], []
    if kind is object:  # beyond 64 bits: exact, one query at a time
        for w in range(nq):
            found: list[tuple[int, int]] = []
            for b in sorted(range(len(edges)), key=lambda j: -bound[w, j]):
                least = found[k - 1][0] if len(found) >= k else None
                if least is not None and bound[w, b] < least or start is not None and bound[w, b] < start[w]:
                    break
                part = slice(edges[b], min(n, edges[b] + block))
                scores = (vectors[part].astype(object) @ queries[w].astype(object)).tolist()
                found += [(s, i) for s, i in zip(scores, ids[part].tolist()) if i != query_ids[w]]
                found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
            who_out += [w] * len(found)
            id_out += [i for _, i in found]
            score_out += [s for s, _ in found]
        return np.array(who_out, dtype=np.int64), np.array(id_out, dtype=np.int64), score_out
    q, v = queries.astype(kind), vectors.astype(kind)
    least = -np.inf if kind is np.float64 else _LONGEST.min
    floor = np.full(nq, least, dtype=kind) if start is None else np.array([max(s, least) for s in start]).astype(kind)
    order = np.argsort(-bound if kind is np.float64 else ~bound, axis=1, kind="stable")
    best = np.full((nq, k), least, dtype=kind)
    found = np.full((nq, k), _LONGEST.max, dtype=np.int64)
    filled = np.zeros((nq, k), dtype=bool)
    alive = np.arange(nq)
    seen = 0
    for step in range(len(edges)):
        here = order[alive, step]
        reach = bound[alive, here]
        going = (reach >= floor[alive]) & (~filled[alive, k - 1] | (reach >= best[alive, k - 1]))
        alive, here = alive[going], here[going]
        if not len(alive):
            break
        seen += len(alive)
        for b in np.unique(here):
            who = alive[here == b]
            part = slice(edges[b], min(n, edges[b] + block))
            scores = q[who] @ v[part].T
            own = ids[part][None, :] == query_ids[who][:, None]
            s = np.concatenate([best[who], scores], axis=1)
            i = np.concatenate([found[who], np.broadcast_to(ids[part], scores.shape)], axis=1)
            f = np.concatenate([filled[who], ~own], axis=1)
            pick = np.lexsort((i, -s if kind is np.float64 else ~s, ~f), axis=1)[:, :k]
            best[who], found[who], filled[who] = (np.take_along_axis(x, pick, axis=1) for x in (s, i, f))
    if visits is not None:
        visits.append((seen, nq * len(edges)))
    at = np.nonzero(filled)
    return at[0], found[at], best[at].astype(np.int64).tolist()


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, dim) if dim else np.zeros((len(raw), 0), dtype=np.int64)


def forward_index(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows`` (dim, vec_id, v) in order of id: ``g`` (range), ``b`` (place in it), ``dim``, ``n``, and as little-endian 64-bit numbers ``ids``, ``v``, ``top``, ``low``.

    Rows are dealt into ranges by sampled borders of (dim, id, hash of the vector, place in the input), so that neither far ids nor repeated rows
    fill a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, made = TaskContext.get().partitionId() << 32, 0
        dim, ids, vectors = None, np.zeros(0, dtype=np.int64), None

        def blocks(last: bool) -> pa.RecordBatch | None:
            nonlocal ids, vectors, made
            out = []
            while len(ids) >= BLOCK or last and len(ids):
                i, v = ids[:BLOCK], vectors[:BLOCK]
                out.append((group + made // RANGE, made % RANGE, dim, len(i), i.astype("<i8").tobytes(), v.astype("<i8").tobytes(), v.max(axis=0).astype("<i8").tobytes(), v.min(axis=0).astype("<i8").tobytes()))
                ids, vectors, made = ids[BLOCK:], vectors[BLOCK:], made + 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)], ["g", "b", "dim", "n", "ids", "v", "top", "low"]) if out else None

        for batch in batches:
            dims = batch["dim"].to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(borders[:-1], borders[1:]):
                if a == b:
                    continue
                if dims[a] != dim:
                    if done := blocks(True):
                        yield done
                    made = -(-made // RANGE) * RANGE  # a range holds vectors of one length
                    dim, vectors = int(dims[a]), np.zeros((0, int(dims[a])), dtype=np.int64)
                part = batch.slice(a, b - a)
                ids = np.concatenate([ids, part["vec_id"].to_numpy(zero_copy_only=False)])
                flat = part["v"].flatten().to_numpy(zero_copy_only=False)
                vectors = np.concatenate([vectors, flat.reshape(b - a, dim)])
                if done := blocks(False):
                    yield done
        if done := blocks(True):
            yield done

    order = ["dim", "vec_id", "tie", "spot"]
    dealt = rows.withColumn("tie", F.xxhash64("v")).withColumn("spot", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("dim", "vec_id", "v").mapInArrow(run, "g long, b int, dim int, n int, ids binary, v binary, top binary, low binary")


def top_k(df: DataFrame, k: int = 5, query_step: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k best candidates of every query, all of them if there are fewer.

    Components are turned into floor(scale * x), computed in double; what passes 64 bits stands at their end.  Queries are the rows whose key is
    divisible by ``query_step``; candidates are all rows but those with the query's own key.  Null vectors, vectors with null or non-finite
    components and rows with a null key take no part.  Vectors of unlike length have no product and never meet; those without components score 0.
    Scores are exact whatever their size and rank so; one beyond 64 bits is shown at their end.  Ties go to the smaller key.  Of rows that
    repeat a key the candidate is each of them; a repeated query asks once, with the smallest vector.  An empty table gives no rows.  Other
    columns are ignored, whatever their names; keys are whole numbers.

    Vectors move once to their range, and a range once more to each set of queries of which one needs it; what every set of queries meets are
    the maxima of all blocks, a 64th of the vectors.
    """
    spark = df.sparkSession
    work = Workspace(spark, "topk")
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))
    queries = rows.where(F.pmod("vec_id", F.lit(query_step)) == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    index = work.table(forward_index(rows))
    sizes = index.agg(F.countDistinct("g").alias("ranges"), F.sum("n").alias("n")).first()
    if not sizes["n"]:
        work.close()
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = queries.count()
    sets, groups = max(1, -(-asked // QUERIES)), -(-sizes["ranges"] // SUMMARY)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = work.table(queries.select("vec_id", "dim", "v", F.pmod(F.xxhash64("vec_id"), F.lit(sets)).cast("int").alias("qs")))
    maxima = index.select("g", "b", "dim", "top", "low", F.pmod(F.xxhash64("g"), F.lit(groups)).cast("int").alias("sg"))
    summary = maxima.select("*", every(sets).alias("qs"))
    cut = ["qs", "sg", "dim"]

    def largest(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        """The block with each query's largest bound."""
        if not len(q) or not len(s):
            return _none("q", "d", "g", "b", "bound")
        dim = int(q["dim"].iloc[0])
        bound = bounds(np.stack(list(q["v"])).reshape(len(q), dim), _matrix(list(s["top"]), dim), _matrix(list(s["low"]), dim))
        at = np.array([max(range(len(s)), key=row.__getitem__) for row in bound]) if bound.dtype == object else bound.argmax(axis=1)
        return pd.DataFrame({"q": q["vec_id"].to_numpy(), "d": dim, "g": s["g"].to_numpy()[at], "b": s["b"].to_numpy()[at], "bound": bound[np.arange(len(q)), at].astype(np.float64)})

    first = asking.select("*", every(groups).alias("sg")).groupBy(*cut).cogroup(summary.groupBy(*cut)).applyInPandas(largest, "q long, d int, g long, b int, bound double")
    first = first.groupBy("q", "d").agg(F.max(F.struct("bound", "g", "b")).alias("s")).select("q", "d", F.col("s.g").alias("g"), F.col("s.b").alias("b"))
    there = work.table(asking.join(first, (F.col("vec_id") == F.col("q")) & (asking["dim"] == F.col("d"))).select("vec_id", "dim", "v", "qs", "g", "b"))
    seats = there.select(F.col("qs").alias("sq"), F.col("g").alias("sg"), F.col("b").alias("sb")).distinct()
    blocks = index.join(seats, (F.col("g") == F.col("sg")) & (F.col("b") == F.col("sb"))).select(F.col("sq").alias("qs"), "g", "b", F.col("dim").alias("dim"), "ids", "v")

    def begin(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """The k-th score that each query reaches in its first block."""
        if not len(q) or not len(c):
            return _none("q", "d", text="score")
        dim, at = int(q["dim"].iloc[0]), q["vec_id"].to_numpy()
        ids = np.frombuffer(b"".join(c["ids"]), dtype="<i8")
        who, _, score = top_in_blocks(np.stack(list(q["v"])).reshape(len(q), dim), at, _matrix(list(c["v"]), dim), ids, k)
        held = pd.DataFrame({"w": who, "s": [str(s) for s in score]})
        full = held.groupby("w", sort=False)["s"].agg(["size", "last"])
        full = full[full["size"] == k]
        return pd.DataFrame({"q": at[full.index.to_numpy(dtype=np.int64)], "d": dim, "score": full["last"].to_numpy(dtype=object)})

    start = there.groupBy("qs", "g", "b", "dim").cogroup(blocks.groupBy("qs", "g", "b", "dim")).applyInPandas(begin, "q long, d int, score string")
    start = start.withColumnRenamed("score", "start")
    started = work.table(asking.join(start, (F.col("vec_id") == F.col("q")) & (asking["dim"] == F.col("d")), "left").select("vec_id", "dim", "v", "qs", "start"))
    work.drop(asking, there)

    def needed(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        """The ranges that hold a block whose bound reaches where a query starts."""
        if not len(q) or not len(s):
            return _none("q", "d", "g")
        dim = int(q["dim"].iloc[0])
        s = s.sort_values("g", kind="stable")
        bound = bounds(np.stack(list(q["v"])).reshape(len(q), dim), _matrix(list(s["top"]), dim), _matrix(list(s["low"]), dim))
        ranges, edges = np.unique(s["g"].to_numpy(), return_index=True)
        reach = np.maximum.reduceat(bound, edges, axis=1)
        low = _starts(q["start"])
        hit = np.array([[low[w] is None or x >= low[w] for x in row] for w, row in enumerate(reach)]) if reach.dtype == object else reach >= np.array([-np.inf if x is None else x for x in low])[:, None]
        w, r = np.nonzero(hit)
        return pd.DataFrame({"q": q["vec_id"].to_numpy()[w], "d": dim, "g": ranges[r]})

    wanted = started.select("*", every(groups).alias("sg")).groupBy(*cut).cogroup(summary.groupBy(*cut)).applyInPandas(needed, "q long, d int, g long")
    left = work.table(started.join(wanted, (F.col("vec_id") == F.col("q")) & (started["dim"] == F.col("d"))).select("vec_id", "dim", "v", "qs", "start", "g"))
    work.drop(started)
    pairs = left.select(F.col("qs").alias("sq"), F.col("g").alias("sg")).distinct()
    right = index.join(pairs, F.col("g") == F.col("sg")).select(F.col("sq").alias("qs"), "g", "b", "dim", "ids", "v")

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return _none("query_id", "vec_id", "score", text="place")
        dim, at = int(q["dim"].iloc[0]), q["vec_id"].to_numpy()
        c = c.sort_values("b", kind="stable")
        ids = np.frombuffer(b"".join(c["ids"]), dtype="<i8")
        low = [-_FAR if x is None else x for x in _starts(q["start"])]
        who, found, score = top_in_blocks(np.stack(list(q["v"])).reshape(len(q), dim), at, _matrix(list(c["v"]), dim), ids, k, start=low)
        return pd.DataFrame({"query_id": at[who], "vec_id": found, "score": [min(max(x, _LONGEST.min), _LONGEST.max) for x in score], "place": [str(x + _FAR) for x in score]})

    found = left.groupBy("qs", "g", "dim").cogroup(right.groupBy("qs", "g", "dim")).applyInPandas(search, "query_id long, vec_id long, score long, place string")
    order = Window.partitionBy("query_id").orderBy(F.col("place").desc(), "vec_id")
    out = work.table(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    work.drop(index, left)
    return out


def _none(*numbers: str, text: str | None = None) -> pd.DataFrame:
    made = {n: pd.Series(dtype="int64") for n in numbers}
    return pd.DataFrame(made | ({text: pd.Series(dtype=object)} if text else {}))


def _starts(column: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in column]


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
