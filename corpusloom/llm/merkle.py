"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions alone.

Paragraphs are lines.  A paragraph's leaves are the hashes of all its overlapping runs of three words, its node is the MD5 of its leaves.  A
section is a run of paragraphs that ends where a paragraph's node says so, so that sections re-align after an insertion; its node is
the MD5 of its paragraphs' nodes.  The root is the SHA-256 of the sections' nodes.  Equal roots mean equal texts.  Where roots differ,
sections that both trees have at either end are passed over, and only the paragraphs of the others are looked at to locate the edit.

Likeness is the share of leaves that two trees have in common (Dice).  A tree keeps its SKETCH smallest distinct leaves, which makes a
fingerprint of bounded size whatever the text: ``root:leaves``, the leaves as 32-bit numbers in base 64.  Two trees with fewer leaves are
compared exactly; of others the leaves up to the least of their greatest ones are a sample of both by the same hash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct leaves that a fingerprint keeps, and one in how many paragraphs ends a section.
SKETCH, SECTION = 128, 8
#: All signs from "!" on but those of scripts that are written without blanks: Thai, Lao, Myanmar, Khmer, kana and Chinese characters.
_OF_WORDS = r"[!-\x{DFF}\x{F00}-\x{FFF}\x{10A0}-\x{177F}\x{1800}-\x{303F}\x{3100}-\x{33FF}\x{A000}-\x{F8FF}\x{FB00}-\x{1FFFF}\x{40000}-\x{10FFFF}]"
#: A word of at most 64 signs, and what is taken one by one: a sign of those scripts or of a longer word (but for its last 64).
_WORD, _SIGN = rf"{_OF_WORDS}{{1,64}}+(?!{_OF_WORDS})\s*+", r"\S\s*+"
#: Units of a paragraph: words, and at each single sign the eight that begin there; white space at its head is a unit.
UNIT = rf"(?=({_WORD}|(?:{_SIGN}){{1,8}}+|\s++))(?:{_WORD}|{_SIGN}|\s++)"
#: Rows of a bucket of neighbours, about, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 256, 20_000


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``df`` with ``<prefix>root``, ``<prefix>sections`` (first paragraph, node, paragraphs' nodes of each) and ``<prefix>leaves`` (the smallest, rising) of a text column without nulls."""
    nodes, leaves = f"{prefix}nodes", f"{prefix}leaves"
    units = lambda p: F.transform(F.regexp_extract_all(p, F.lit(UNIT), F.lit(1)), lambda u: F.xxhash64(u))
    runs = lambda h: F.transform(h, lambda x, k: F.xxhash64(x, F.get(h, k + 1), F.get(h, k + 2)))
    df = df.withColumn(leaves, F.transform(F.split(F.col(text), "\n"), lambda p: _let(units(p), runs)))
    df = df.withColumn(nodes, F.transform(leaves, lambda x: F.md5(x.cast("string").cast("binary"))))
    last = F.size(nodes) - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda k: (k == last) | (F.pmod(F.xxhash64(F.get(F.col(nodes), k)), F.lit(SECTION)) == 0))
    df = df.withColumn(f"{prefix}ends", ends)
    begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(F.col(f"{prefix}ends"), j - 1) + 1)
    parts = F.transform(f"{prefix}ends", lambda e, j: F.struct(begin(j).alias("first"), F.slice(F.col(nodes), begin(j) + 1, e - begin(j) + 1).alias("paragraphs")))
    df = df.withColumn(f"{prefix}sections", F.transform(parts, lambda s: F.struct(s["first"].alias("first"), F.md5(F.array_join(s["paragraphs"], "").cast("binary")).alias("node"), s["paragraphs"].alias("paragraphs"))))
    df = df.withColumn(f"{prefix}root", F.sha2(F.array_join(F.col(f"{prefix}sections")["node"], "").cast("binary"), 256))
    least = F.slice(F.array_sort(F.array_distinct(F.transform(F.flatten(leaves), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))))), 1, SKETCH)
    return df.withColumn(leaves, least).drop(nodes, f"{prefix}ends")


def fingerprint(prefix: str) -> Column:
    """The fingerprint string of a tree that ``with_tree`` made."""
    leaves = F.transform(F.col(f"{prefix}leaves"), lambda x: F.lpad(F.hex(x), 8, "0"))
    return F.concat_ws(":", F.col(f"{prefix}root"), F.base64(F.unhex(F.array_join(leaves, ""))))


def leaf_likeness(x: Column, y: Column) -> Column:
    """Dice of the leaf sets that two sketches stand for: exact up to SKETCH - 1 leaves, else estimated on what both sketches cover; 0 if neither has any."""
    end = F.lit(1 << 32)
    reach = lambda s: F.when(F.size(s) < SKETCH, end).otherwise(F.element_at(s, -1))
    upto = F.least(reach(x), reach(y))
    both = F.size(F.filter(F.array_intersect(x, y), lambda v: v <= upto))
    every = F.size(F.filter(F.array_union(x, y), lambda v: v <= upto))
    return F.when(every == 0, F.lit(0.0)).otherwise(2.0 * both / (every + both))


def likeness(a: str, b: str) -> Column:
    """1 for equal roots, else the likeness of the leaves."""
    return F.when(F.col(f"{a}root") == F.col(f"{b}root"), F.lit(1.0)).otherwise(leaf_likeness(F.col(f"{a}leaves"), F.col(f"{b}leaves")))


def fingerprint_likeness(x: Column, y: Column) -> Column:
    """Likeness of two fingerprint strings, 0 to 1: the same number as that of their trees."""

    def leaves(f: Column) -> Column:
        hexes = F.regexp_extract_all(F.hex(F.unbase64(F.split(f, ":")[1])), F.lit("[0-9A-F]{8}"), F.lit(0))
        return F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("long"))

    return F.when(F.split(x, ":")[0] == F.split(y, ":")[0], F.lit(1.0)).otherwise(leaf_likeness(leaves(x), leaves(y)))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``fingerprint string`` and ``sections`` (the tree, for ``differing_paragraphs``) of every row.

    Null texts count as empty, and the empty text is one empty paragraph; texts of any length are read whole, into a fingerprint of at most
    750 characters; repeated rows and ties give repeated rows; an empty table gives none; other columns are ignored.  Keys may be of any type.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return with_tree(rows, "t", "a_").select(F.col("k").alias(key), fingerprint("a_").alias("fingerprint"), F.col("a_sections").alias("sections"))


def _shared(x: Column, y: Column) -> Column:
    """How many items two arrays have in common at their heads."""
    at = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    return F.when(at == 0, F.least(F.size(x), F.size(y))).otherwise(at - 1).cast("int")


def _between(x: Column, y: Column, of: Column) -> Column:
    """The items of ``of`` (which goes with ``y``) that are neither in the head nor in the tail that ``x`` and ``y`` share."""

    def cut(head: Column) -> Column:
        rest = F.least(F.size(x), F.size(y)) - head
        tail = F.least(_shared(F.reverse(x), F.reverse(y)), rest)
        return F.slice(of, head + 1, F.size(y) - head - tail)

    return _let(_shared(x, y), cut)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Positions (from 0) of the paragraphs of tree ``b`` that are not in tree ``a``, both as ``sections`` columns; empty for equal trees and where ``b`` only lacks some.

    Sections that both have at their heads and tails are passed over, then paragraphs of those left.  Between them a paragraph is marked whose node
    isn't among those that stand between them in ``a``; if there is none, as where a line was repeated or moved, all between are.
    """
    mine, theirs = _between(a["node"], b["node"], b), _between(b["node"], a["node"], a)

    def inside(sections: Column) -> Column:
        return F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda n, k: F.struct((s["first"] + k).alias("at"), n.alias("node")))))

    def mark(x: Column, y: Column) -> Column:
        def of(new: Column) -> Column:
            return _let(
                _between(y["node"], x["node"], x),
                lambda old: _let(F.filter(new, lambda p: ~F.array_contains(old["node"], p["node"])), lambda lone: F.when(F.size(lone) > 0, lone["at"]).otherwise(new["at"])),
            )

        return _let(_between(x["node"], y["node"], y), of)

    return _let(inside(theirs), lambda x: _let(inside(mine), lambda y: mark(x, y)))


def _number_list(values: list[int]) -> Column:
    """A constant array; as text, as a plan with thousands of literals is slow to make."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def bucket_of(df: DataFrame, key: str, tie: str, rows: int | None = None, most: int = MOST_BUCKETS) -> Column:
    """A bucket number for every row, 0 for the greatest keys, that falls with the key and, within a key, rises with ``tie`` (a long); null keys have the last.

    Borders are counted: quantiles of the keys, so that far keys make no empty or full buckets.  A key that holds several quantiles has as many
    buckets of its own, which ranges of ``tie`` share.
    """
    rows = rows or BUCKET_ROWS
    n = df.where(F.col(key).isNotNull()).count()
    buckets = max(1, min(most, -(-n // rows)))
    marks = F.split(F.lit(",".join(str(k / buckets) for k in range(1, buckets))), ",").cast("array<double>")
    found = df.agg(F.percentile_approx(key, marks, 10 * buckets).alias("q")).first()["q"] if buckets > 1 else []
    borders: dict[int, int] = {}
    for q in found or []:
        borders[q] = borders.get(q, 0) + 1
    keys = sorted(borders, reverse=True)
    own = [borders[q] if borders[q] > 1 else 0 for q in keys]  # buckets of the key itself
    begin = [1]
    for c in own:
        begin.append(begin[-1] + c + 1)
    # keys above the first border: 0; from border j on: its own buckets from begin[j] on, then those below it
    step = 100
    heads, parts = keys[::step], [keys[k : k + step] for k in range(0, len(keys), step)]
    last = begin[-1]
    if not keys:
        return F.when(F.col(key).isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
    nested = F.split(F.lit(";".join(",".join(map(str, p)) for p in parts)), ";")
    coarse = F.size(F.filter(_number_list(heads), lambda b: b >= F.col(key)))  # parts whose first border the key doesn't pass
    fine = F.filter(F.split(F.get(nested, coarse - 1), ",").cast("array<bigint>"), lambda b: b >= F.col(key))
    place = F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + F.size(fine))  # borders that are the key or above
    at = lambda values, k: F.get(_number_list(values), k)
    many = at(own, place - 1)
    on_border = (place > 0) & (many > 0) & (at(keys, place - 1) == F.col(key))
    rising = F.shiftrightunsigned(F.col(tie).bitwiseXOR(F.lit(-(1 << 63))), 1)  # in the order of signed numbers
    share = F.least((rising / F.lit(float(1 << 63)) * many).cast("long"), many - 1)
    return F.when(F.col(key).isNull(), F.lit(last)).when(place == 0, F.lit(0)).when(on_border, at(begin, place - 1) + share).otherwise(at(begin, place - 1) + many).cast("long")


def among_neighbours(df: DataFrame, key: str, text: str) -> tuple[DataFrame, list[Column]]:
    """``df`` dealt into buckets ``__b`` of neighbouring keys, so that in each row's bucket there is the one that follows in descending order; and that order.

    Within a key rows stand by a hash of their texts, null keys come last, and the first row follows the last.  A bucket's first row is also
    sent to the bucket before it, as a guest (``__late`` 1) that stands at its end.  So no order over the whole table is needed, and text
    moves once.  The driver sees the numbers of the buckets, MOST_BUCKETS and as many again at most.
    """
    df = df.withColumn("__tie", F.xxhash64(text))
    df = df.withColumn("__b", bucket_of(df, key, "__tie"))
    order = [F.col(key).desc_nulls_last(), F.col("__tie"), F.col(text)]
    sort_key = F.struct(F.col(key).isNull().alias("none"), F.bitwise_not(F.coalesce(F.col(key), F.lit(0).cast("long"))).alias("down"), F.col("__tie").alias("tie"))
    heads = {r["__b"]: r["head"] for r in df.groupBy("__b").agg(F.min(sort_key).alias("head")).collect()}
    used = sorted(heads)
    if not used:
        return df.withColumn("__late", F.lit(0)), order
    before = [{"to_b": used[k - 1], "from_b": b} | heads[b].asDict() for k, b in enumerate(used)]
    rows = F.from_json(F.lit(json.dumps(before)), "array<struct<to_b: bigint, from_b: bigint, none: boolean, down: bigint, tie: bigint>>")
    follow = F.broadcast(df.sparkSession.range(1).select(F.inline(rows)))
    of = sort_key
    match = (F.col("__b") == F.col("from_b")) & (of["none"] == F.col("none")) & (of["down"] == F.col("down")) & (of["tie"] == F.col("tie"))
    guests = df.join(follow, match).groupBy(F.col("to_b").alias("__b")).agg(F.min(F.struct(key, "__tie", text)).alias("g"))
    guests = guests.select(F.col(f"g.{key}").alias(key), F.col(f"g.{text}").alias(text), F.col("g.__tie").alias("__tie"), "__b", F.lit(1).alias("__late"))
    return df.withColumn("__late", F.lit(0)).unionByName(guests).repartition(len(used), "__b"), order


def compare_with_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: key, ``n_chars``, ``edited`` (its last third replaced by the next text's beginning), both fingerprints and likenesses, ``differing``.

    Columns: key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, differing (paragraphs of the edited text that are not the
    text's).  Keys are whole numbers, in descending order; rows that share a key follow each other by a hash of their texts, null keys come
    last, and the last row's next is the first.  Null texts are empty; texts of any length are read whole; an empty table gives no rows; a table of
    one row is its own next; other columns are ignored.  Rows that repeat key and text both stand in one task.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    near, order = among_neighbours(rows, "k", "t")
    window = Window.partitionBy("__b").orderBy("__late", *order)
    dealt = with_tree(near, "t", "a_")
    led = dealt.select("*", *[F.lead(c).over(window).alias(n) for c, n in (("t", "next_t"), ("a_root", "n_root"), ("a_leaves", "n_leaves"))]).where(F.col("__late") == 0)
    led = led.withColumn("edited", F.concat(F.expr("substring(t, 1, length(t) - cast(floor(length(t) / 3) AS int))"), F.expr("substring(next_t, 1, cast(floor(length(t) / 3) AS int))")))
    both = with_tree(led.withColumn("n_chars", F.length("t").cast("long")).drop("next_t"), "edited", "e_")
    return both.select(
        F.col("k").alias(key), "n_chars", "edited", fingerprint("a_").alias("fingerprint"), fingerprint("e_").alias("edited_fingerprint"),
        likeness("a_", "e_").alias("near_edited"), likeness("a_", "n_").alias("near_next"), differing_paragraphs(F.col("a_sections"), F.col("e_sections")).alias("differing"),
    )
