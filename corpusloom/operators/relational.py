"""Deduplication, change sets, guards, splits, unions and range joins as Catalyst plans."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, by: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group in a total order; nulls in a key are a group like any other."""
    place = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(place)).where(F.col("__n") == 1).drop("__n")


def keep_canonical(df: DataFrame, by: Sequence[Column], text: str, key: str) -> DataFrame:
    """Of each group the row with the longest text, of those the one with the greatest key; rows without a text don't stand."""
    names = df.columns
    best = df.where(F.col(text).isNotNull()).groupBy(*[c.alias(f"__g{k}") for k, c in enumerate(by)])
    return best.agg(F.max_by(F.struct(*names), F.struct(F.length(text), F.col(key))).alias("__r")).select("__r.*")


def apply_changes(base: DataFrame, updates: DataFrame, deletes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of ``base`` with the updates' non-null values laid over, without deleted keys; an update cancels the deletion of its key."""
    gone = deletes.select(key).join(updates.select(key), key, "left_anti")
    laid = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(laid, key, "left").join(gone, key, "left_anti")
    return out.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those of ``new`` whose key isn't there, once each."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def without_guarded(df: DataFrame, guard: DataFrame, pairs: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Rows of which no guard row has the same normalised key."""
    test = F.lit(True)
    for a, b in pairs:
        test = test & (a == b)
    return df.join(guard, test, "left_anti")


def contained_texts(df: DataFrame, key: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Rows of ``needles`` beside the ``key`` of every row of ``df`` whose text contains the needle, exactly as it stands; needles aren't empty, keys are unique.

    Texts and needles meet by equal keys: of a needle with three words or more the hash of up to three words behind its first one, which a text
    that contains it has whole; of others the hash of their first three characters, or of all if they have fewer.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    held = needles.withColumn("__w", words(F.col(needle)))
    inner = F.least(F.size("__w") - 2, F.lit(3))
    signs = F.least(F.length(needle), F.lit(3))
    kind = F.when(inner > 0, F.concat(F.lit("w"), inner.cast("string"))).otherwise(F.concat(F.lit("c"), signs.cast("string")))
    of = F.when(inner > 0, F.array_join(F.slice("__w", F.lit(2), F.greatest(inner, F.lit(1))), " ")).otherwise(F.substring(needle, 1, 3))
    held = held.withColumn("__kind", kind).withColumn("__key", F.xxhash64("__kind", of)).drop("__w", "__kind")
    kinds = [r[0] for r in needles.withColumn("__w", words(F.col(needle))).select(kind.alias("k")).distinct().collect()]  # six at most

    def runs(kind: str) -> Column:
        n = int(kind[1])
        if kind[0] == "w":
            w = words(F.col(text))
            return F.transform(F.array(w), lambda u: F.when(F.size(u) >= n, F.transform(F.sequence(F.lit(1), F.size(u) - n + 1), lambda k: F.xxhash64(F.lit(kind), F.array_join(F.slice(u, k, n), " ")))).otherwise(F.array().cast("array<bigint>")))[0]
        return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))), lambda u: F.xxhash64(F.lit(kind), u))

    if not kinds:
        return needles.join(df.select(key), F.lit(False))
    keys = df.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.concat(*map(runs, kinds)))).alias("__key"))
    met = keys.join(held, "__key").drop("__key").distinct()
    return met.join(df.select(key, text), key).where(F.contains(text, needle)).drop(text)


def hash_bucket(parts: Sequence[Column], buckets: int) -> Column:
    """A stable bucket from the first 32 bits of the MD5 of the parts, joined by a unit separator."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def split_name(bucket: Column, test_below: int, valid_below: int) -> Column:
    return F.when(bucket < test_below, "test").when(bucket < valid_below, "valid").otherwise("train")


def ratio_split(df: DataFrame, key: str, seed: int, train: float = 0.8, valid: float = 0.1, step: int = 1 << 12) -> DataFrame:
    """Exact shares after a seeded shuffle: ranks by MD5 of seed and key, cut at floor(n * share).

    Ranks come from counts of hash ranges and row numbers within a range, so no task sorts the whole table.
    """
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    df = df.withColumn("__h", mixed).withColumn("__r", F.pmod(F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"), F.lit(step)))
    sizes = df.groupBy("__r").agg(F.count("*").alias("__c"), F.lit(1).alias("__one"))
    before = Window.partitionBy("__one").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__one")
    sizes = sizes.select("__r", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(whole).alias("__total"))
    ranked = df.join(F.broadcast(sizes), "__r").withColumn("__n", F.col("__before") + F.row_number().over(Window.partitionBy("__r").orderBy("__h", key)))
    a = F.floor(F.col("__total") * F.lit(train))
    b = a + F.floor(F.col("__total") * F.lit(valid))
    out = ranked.withColumn("split", F.when(F.col("__n") <= a, "train").when(F.col("__n") <= b, "valid").otherwise("test"))
    return out.drop("__h", "__r", "__before", "__total", "__n")


def stratified_sample(df: DataFrame, by: Sequence[str], key: str, seed: int, n: int) -> DataFrame:
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    place = Window.partitionBy(*by).orderBy(order, key)
    return df.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= n).drop("__n")


def within(a: DataFrame, b: DataFrame, at_a: str, at_b: str, width: int, on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs with abs(at_a - at_b) <= width: an equi-join on time cells, the right side standing in its cell and both beside it.

    Columns of the two sides must have different names.
    """
    left = a.withColumn("__cell", F.floor(F.col(at_a) / width))
    right = b.withColumn("__near", F.explode(F.array(*[F.floor(F.col(at_b) / width) + d for d in (-1, 0, 1)])))
    test = (F.col("__cell") == F.col("__near")) & (F.abs(F.col(at_a) - F.col(at_b)) <= width)
    for x, y in on:
        test = test & (F.col(x) == F.col(y))
    return left.join(right, test).drop("__cell", "__near")


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], begins: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a run begins where ``begins`` (over the ordered rows of a group) is true."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__new", begins.cast("int")).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def canonical_columns(df: DataFrame, columns: Sequence[str], **constants) -> DataFrame:
    """A projection onto fixed string columns, matched without regard to case; what isn't there is null or a constant."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda c: F.lit(constants[c]) if c in constants else F.col(have[c.lower()]) if c.lower() in have else F.lit(None)
    return df.select(*[pick(c).cast("string").alias(c) for c in columns])


def counted_cells(df: DataFrame, key: str, rows: int = 100_000, most: int = 10_000) -> Column:
    """A cell for every row, rising with a numeric key, of about ``rows`` rows each: borders are quantiles of the keys, so far keys make no difference."""
    cells = max(1, min(most, -(-df.count() // rows)))
    marks = F.split(F.lit(",".join(str(k / cells) for k in range(1, cells))), ",").cast("array<double>")
    found = df.agg(F.percentile_approx(key, marks, 10 * cells).alias("q")).first()["q"] if cells > 1 else None
    borders = F.split(F.lit(",".join(str(q) for q in sorted(set(found or [])))), ",")
    kind = df.schema[key].dataType.simpleString()
    return F.size(F.filter(borders.cast(f"array<{kind}>"), lambda b: b < F.col(key))).cast("int") if found else F.lit(0)


def running_place(df: DataFrame, key: str, name: str, **sizes: int) -> DataFrame:
    """``df`` with ``name``, each row's place (from 0) in order of a numeric key: cells are counted first, so that no task numbers the whole table."""
    celled = df.withColumn("__cell", counted_cells(df, key, **sizes))
    counts = {r["__cell"]: r["count"] for r in celled.groupBy("__cell").count().collect()}  # a number a cell
    used = sorted(counts)
    starts = dict(zip(used, itertools.accumulate([0, *(counts[c] for c in used)])))
    start = F.get(F.split(F.lit(",".join(str(starts.get(c, 0)) for c in range(max(used, default=0) + 1))), ","), F.col("__cell")).cast("long")
    place = start + F.row_number().over(Window.partitionBy("__cell").orderBy(key)) - 1
    return celled.withColumn(name, place.cast("long")).drop("__cell")


def exact_percentiles(df: DataFrame, value: str, shares: Sequence[float], most: int = 100_000, accuracy: int = 10_000) -> list[float | None]:
    """Percentiles with linear interpolation, exact, without one task that holds all values.

    A rank is bracketed by approximate quantiles, what lies below is counted, and the bracket is narrowed until it holds few values, of which the
    histogram is taken.  Nulls are left out; None for no values.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    n = rows.count()

    def ranked(k: int) -> float:
        part, rank, size = rows, k, n
        while size > most:
            marks = [max(0.0, (rank - 2 * size / accuracy) / size), min(1.0, (rank + 1 + 2 * size / accuracy) / size)]
            low, high = part.agg(F.percentile_approx("v", marks, accuracy).alias("q")).first()["q"]
            c = part.agg(F.count_if(F.col("v") < low).alias("below"), F.count_if(F.col("v").between(low, high)).alias("inside")).first()
            if not c["below"] <= rank < c["below"] + c["inside"]:
                break
            if low == high:
                return low
            if c["inside"] == size:
                break
            part, rank, size = part.where(F.col("v").between(low, high)), rank - c["below"], c["inside"]
        seen = 0
        for r in part.groupBy("v").count().orderBy("v").toLocalIterator():
            seen += r["count"]
            if seen > rank:
                return r["v"]
        raise AssertionError("rank beyond the values")

    out: list[float | None] = []
    for share in shares:
        if not n:
            out.append(None)
            continue
        at = share * (n - 1)
        low = ranked(int(at))
        high = low if at == int(at) else ranked(int(at) + 1)
        out.append(low + (high - low) * (at - int(at)))
    return out


def contiguous_ranges(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """n ranges of whole numbers that cover low to high, both included; the first ones take what doesn't divide; empty ones end before they begin."""
    whole, rest = divmod(high - low + 1, n)
    ends = list(itertools.accumulate(whole + (k < rest) for k in range(n)))
    return [(low + end - whole - (k < rest), low + end - 1) for k, end in enumerate(ends)]


def quotas(total: int, shares: Sequence[float]) -> list[int]:
    """Largest remainders: whole parts first, what is left to the largest fractions, earlier ones first."""
    whole = sum(shares)
    exact = [total * s / whole for s in shares] if whole else [0.0 for _ in shares]
    out = [int(x) for x in exact]
    by_rest = sorted(range(len(shares)), key=lambda k: (out[k] - exact[k], k))
    for k in by_rest[: total - sum(out) if whole else 0]:
        out[k] += 1
    return out
