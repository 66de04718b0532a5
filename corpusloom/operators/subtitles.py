"""Timed tracks: fragments merged, two tracks scored, matched one to one and brought into time."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.similarity import indel_ratio
from corpusloom.operators.relational import islands

# Fixed values of the aligner: window, weights of time and text, least score.
#: Cost of a left block that stays alone: more than any gain in score, so the number of pairs comes first.
ALONE = 1000.0
WINDOW_MS, TIME_WEIGHT, TEXT_WEIGHT, LEAST_SCORE = 60_000, 0.3, 0.7, 0.30


def merge_fragments(df: DataFrame, by: str, gap_ms: int = 120) -> DataFrame:
    """Blocks (``by``, ``start_ms``, ``end_ms``, ``text``) that go on in the next one become one block, with ``fragments`` counted.

    The next block is taken in if the gap is small and this one ends in a comma, or in no stop and the next begins in lower case.  Only
    neighbours matter, so a lag and a running sum give the groups.
    """
    w = Window.partitionBy(by).orderBy("start_ms", "end_ms", "text")
    tail = F.substring(F.regexp_replace(F.lag("text").over(w), r"\s+$", ""), -1, 1)
    head = F.substring(F.regexp_replace("text", r"^\s+", ""), 1, 1)
    lower = (F.lower(head) == head) & (F.upper(head) != head)
    soft = (tail == ",") | ((tail != "") & ~tail.isin(".", "?", "!") & lower)
    goes_on = (F.col("start_ms") - F.lag("end_ms").over(w) <= gap_ms) & soft
    marked = islands(df, [by], ["start_ms", "end_ms", "text"], ~F.coalesce(goes_on, F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", F.trim("text").alias("text"))))
    return marked.groupBy(by, "island").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", "end_ms")).alias("end_ms"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.count("*").alias("fragments"))


def time_score(a: Column, b: Column, window_ms: int = WINDOW_MS) -> Column:
    gap = F.abs(a - b)
    return F.when(gap > window_ms, F.lit(0.0)).otherwise(1.0 - gap / window_ms)


def score(a: dict, b: dict, shift: float = 0.0) -> float | None:
    gap = abs(a["start_ms"] - shift - b["start_ms"])
    if gap > WINDOW_MS:
        return None
    return TIME_WEIGHT * (1 - gap / WINDOW_MS) + TEXT_WEIGHT * indel_ratio(a["text"], b["text"])


def greedy(scores: dict[int, dict[int, float]], n: int) -> dict[int, tuple[int, float]]:
    """Each left block in order takes its best free partner; ties to the earliest."""
    used: set[int] = set()
    out = {}
    for i in range(n):
        free = [(-s, j) for j, s in scores.get(i, {}).items() if j not in used]
        if free and -min(free)[0] >= LEAST_SCORE and -min(free)[0] > 0:
            best = min(free)
            used.add(best[1])
            out[i] = (best[1], -best[0])
    return out


def optimal(scores: dict[int, dict[int, float]], n: int) -> dict[int, tuple[int, float]]:
    """As many pairs as can be, of those the ones with the greatest total, by shortest augmenting paths over the feasible pairs only.

    Pairs below the least score are dropped afterwards.
    """
    cost = {i: {j: 1.0 - s for j, s in row.items()} | {-1 - i: ALONE} for i, row in scores.items() if row}
    of_left: dict[int, int] = {}
    of_right: dict[int, int] = {}
    high_left: dict[int, float] = dict.fromkeys(cost, 0.0)
    high_right: dict[int, float] = {}
    waiting = set(cost)
    for root in sorted(cost):
        while root in waiting:
            near: dict[int, float] = {}
            back: dict[int, int] = {}
            done: set[int] = set()
            tree = {root: 0.0}
            heap: list[tuple[float, int]] = []
            i, base, end = root, 0.0, None
            while True:
                for j, c in cost[i].items():
                    if j not in done:
                        d = base + c - high_left[i] - high_right.get(j, 0.0)
                        if d < near.get(j, float("inf")) - 1e-12:
                            near[j], back[j] = d, i
                            heapq.heappush(heap, (d, j))
                while heap and (heap[0][1] in done or heap[0][0] > near[heap[0][1]] + 1e-12):
                    heapq.heappop(heap)
                if not heap:
                    break
                base, j = heapq.heappop(heap)
                done.add(j)
                if j not in of_right:
                    end = j
                    break
                i = of_right[j]
                tree[i] = base
            waiting.discard(root)
            if end is None:
                break
            for k, d in tree.items():
                high_left[k] += base - d
            for j in done:
                high_right[j] = high_right.get(j, 0.0) - (base - near[j])
            j = end
            while True:
                i = back[j]
                before = of_left.get(i)
                of_left[i], of_right[j] = j, i
                j = before
                if i == root:
                    break
    return {i: (j, scores[i][j]) for i, j in of_left.items() if j >= 0 and scores[i][j] >= LEAST_SCORE and i < n}


def candidates(a: list[dict], b: list[dict], shift: float = 0.0) -> dict[int, dict[int, float]]:
    """Scores of all pairs within the window, by two moving borders over blocks in order of start."""
    out: dict[int, dict[int, float]] = {}
    order = sorted(range(len(b)), key=lambda j: b[j]["start_ms"])
    low = 0
    for i in sorted(range(len(a)), key=lambda i: a[i]["start_ms"]):
        at = a[i]["start_ms"] - shift
        while low < len(order) and b[order[low]]["start_ms"] < at - WINDOW_MS:
            low += 1
        k = low
        while k < len(order) and b[order[k]]["start_ms"] <= at + WINDOW_MS:
            s = score(a[i], b[order[k]], shift)
            if s is not None:
                out.setdefault(i, {})[order[k]] = s
            k += 1
    return out


def offset(a: list[dict], b: list[dict], pairs: dict[int, tuple[int, float]], shift: float, top: float = 10.0) -> tuple[float, float, float, float]:
    """(median difference of the best-scored pairs, greatest, share of left blocks matched, mean score) in milliseconds; zeros without pairs."""
    if not pairs:
        return 0.0, 0.0, 0.0, 0.0
    marks = pd.Series([s for _, s in pairs.values()])
    least = marks.quantile(1 - top / 100)
    gaps = pd.Series([a[i]["start_ms"] - shift - b[j]["start_ms"] for i, (j, s) in pairs.items() if s >= least])
    return float(gaps.median()), float(gaps.abs().max()), len(pairs) / len(a), float(marks.mean())


def mean_offset(a: list[dict], b: list[dict], pairs: dict[int, tuple[int, float]], shift: float = 0.0) -> tuple[float, float, float, float]:
    """(mean difference of all pairs, greatest, share of left blocks matched, mean score) in milliseconds; zeros without pairs."""
    if not pairs:
        return 0.0, 0.0, 0.0, 0.0
    gaps = [a[i]["start_ms"] - shift - b[j]["start_ms"] for i, (j, _) in pairs.items()]
    return sum(gaps) / len(gaps), max(map(abs, gaps)), len(pairs) / len(a), sum(s for _, s in pairs.values()) / len(pairs)


def synchronise(a: list[dict], b: list[dict], close_ms: float = 50.0, plateau: int = 2, most: int = 50) -> tuple[float, dict[int, tuple[int, float]]]:
    """The shift of ``a`` that brings it into time with ``b``, and the matching then.

    Stops when the offset is close to nothing, when coverage and mean score stay the same, or after ``most`` rounds.
    """
    shift, last, same = 0.0, None, 0
    pairs: dict[int, tuple[int, float]] = {}
    for _ in range(most):
        pairs = optimal(candidates(a, b, shift), len(a))
        middle, widest, share, mean = offset(a, b, pairs, shift)
        if abs(middle) < close_ms and widest < 2 * close_ms:
            break
        now = round(share, 3), round(mean, 3)
        same = same + 1 if now == last else 0
        if same >= plateau:
            break
        last = now
        shift += middle
    return shift, pairs


def align(df: DataFrame, by: str, method: str = "optimal") -> DataFrame:
    """One-to-one matches of blocks of track ``a`` with those of track ``b`` (column ``track``) within each film.

    Columns: ``by``, ``a_start_ms``, ``b_start_ms`` and ``score`` (null and 0 for a block without a partner), ``shift_ms``.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_ms", "text"], kind="stable")
        a, b = ([{"start_ms": int(s), "text": t or ""} for s, t in zip(rows[rows.track == k].start_ms, rows[rows.track == k].text)] for k in "ab")
        shift = 0.0
        if method == "sync":
            shift, pairs = synchronise(a, b)
        else:
            pairs = (optimal if method == "optimal" else greedy)(candidates(a, b), len(a))
        film = rows[by].iloc[0]
        made = [(film, a[i]["start_ms"], b[pairs[i][0]]["start_ms"] if i in pairs else None, round(pairs[i][1], 9) if i in pairs else 0.0, shift) for i in range(len(a))]
        return pd.DataFrame(made, columns=[by, "a_start_ms", "b_start_ms", "score", "shift_ms"]).astype({"b_start_ms": "Int64"})

    return df.groupBy(by).applyInPandas(one, f"{by} long, a_start_ms long, b_start_ms long, score double, shift_ms double")
