"""Merkle manifest of a dataset, its leaves placed by bitmap ranks.

Each row is a leaf. The ids of a group are held as a compressed bitmap: only words of 64 bits that hold an id are
kept, with their popcount and a directory of the popcounts before them, in steps of bounded width up to the whole
group. A leaf's coordinate is its rank: the directory's count before its word and the popcount of the lower bits in it.
No leaves are sorted. Levels are then reduced by key: a node is its slot array of at most 16 digests, the coordinate's
low bits name the slot, the rest the node.

Proofs go back down the same tables: every node hands each child the digests left and right of it at each level, so
that a row's proof is hashed and its root folded again where its leaf is.

Defined results: a group is a source, null being one of its own; rows of one id (and those without an id, before all
others) follow one another by digest, equal ones in any order, as they are alike; a null field is ``-``; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landsieve.llm.common import ascii_lower, written
from landsieve.operators.ordering import ordered_id

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, as a power of two.
FAN_BITS = 4
FAN = 1 << FAN_BITS
#: Bits of an id inside a word, and inside each step of the directory; the 14 bits left are the last step's.
WORD_BITS = 6
STEP_BITS = (8, 12, 12, 12)
SIDES = "array<struct<before:string,after:string>>"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the fields, each as its length in bytes, a colon and itself, or a dash."""
    def part(v: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]), 256)


def joined_digest(parts: Column) -> Column:
    """SHA-256 of digests written one after the other."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """tree, doc_id, leaf, and the leaf of the altered text where ``tampered`` holds and the text changes."""
    cols = {c: F.col(c) for c in FIELDS}
    altered = ascii_lower(cols["text"])
    return docs.select(
        # a group's key is never null, and sorts as the groups do: null first, then by bytes
        F.when(cols["source"].isNull(), "").otherwise(F.concat(F.lit("+"), cols["source"])).alias("tree"),
        cols["doc_id"].cast("long").alias("doc_id"), leaf_digest([cols[c] for c in FIELDS]).alias("leaf"),
        F.when(F.coalesce(tampered, F.lit(False)), leaf_digest([*[cols[c] for c in FIELDS[:-1]], altered])).alias("altered"))


def _shifted(value: int, doc_id: Column) -> Column:
    """``value`` moved to the place of an id's bit in its word."""
    return F.call_function("shiftleft", F.lit(value).cast("long"), doc_id.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int"))


def word_of(doc_id: Column) -> Column:
    """Number of an id's word; rows without id have one before all others."""
    return F.coalesce(F.shiftright(doc_id, WORD_BITS), F.lit(-(1 << 63 - WORD_BITS) - 1))


def id_bitmap(ids: DataFrame, tree: str = "tree", doc_id: str = "doc_id") -> DataFrame:
    """The bitmap of each tree's ids with its popcount directory: tree, word, bits, ids, rows, first, total.

    ``first`` counts the rows of the tree in words before this one, ``total`` all of them. Prefix sums run inside
    steps of at most 2**14 entries, so no tree is gone through by one task.
    """
    step = ids.groupBy(tree, word_of(F.col(doc_id)).alias("w0")).agg(
        F.bit_or(_shifted(1, F.col(doc_id))).alias("bits"), F.count(F.lit(1)).alias("rows"))
    words = written(step.withColumn("ids", F.coalesce(F.bit_count("bits"), F.lit(0)).cast("long")), "bitmap")
    steps, level = [], words.select(tree, "w0", "rows")
    for k, bits in enumerate((*STEP_BITS, None)):
        up = F.shiftright(f"w{k}", bits) if bits else F.lit(0).cast("long")
        before = Window.partitionBy(tree, f"w{k + 1}").orderBy(f"w{k}").rowsBetween(Window.unboundedPreceding, -1)
        placed = written(level.withColumn(f"w{k + 1}", up).withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))),
                         "directory")
        steps.append(placed)
        level = placed.groupBy(tree, f"w{k + 1}").agg(F.sum("rows").alias("rows"))
    # the counts of the outer steps come down to the words
    start = level.select(tree, F.col(f"w{len(steps)}"), F.lit(0).cast("long").alias("first"), F.col("rows").alias("total"))
    for k in reversed(range(len(steps))):
        start = steps[k].hint("merge").join(start, [tree, f"w{k + 1}"]).select(
            tree, f"w{k}", (F.col("first") + F.col("before")).alias("first"), "total")
    return words.hint("merge").join(start, [tree, "w0"]).select(tree, F.col("w0").alias("word"), "bits", "ids", "rows", "first", "total")


def ranked(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Rows (tree, doc_id, leaf, ...) with their coordinate ``pos`` in the tree and its size ``n``.

    Words in which an id stands twice, or none stands, can't place their rows by bits: those rows are numbered by
    one parallel range sort.
    """
    lower = F.bitwise_not(_shifted(-1, F.col("doc_id")))
    held = rows.withColumn("word", word_of(F.col("doc_id"))).hint("merge").join(bitmap, ["tree", "word"]).withColumnRenamed("total", "n")
    inside = F.bit_count(F.col("bits").bitwiseAND(lower)).cast("long")
    single = held.filter(F.col("rows") == F.col("ids")).withColumn("pos", F.col("first") + inside)
    several = held.filter(F.col("rows") != F.col("ids"))
    cols = [*rows.columns, "n", "pos"]
    if several.isEmpty():
        return single.select(*cols)
    tie = F.xxhash64(F.monotonically_increasing_id())
    numbered = ordered_id(several.withColumn("tie", tie), [F.col("tree"), F.col("word"), F.col("doc_id"), F.col("leaf"), F.col("tie")], "at")
    starts = numbered.groupBy("tree", "word").agg(F.min("at").alias("base"))
    # a word without ids may hold any number of rows: its start is met by key and rows stay spread
    again = numbered.join(F.broadcast(starts) if starts.limit(20_001).count() <= 20_000 else starts, ["tree", "word"])
    return single.select(*cols).unionByName(
        again.withColumn("pos", F.col("first") + F.col("at") - F.col("base")).select(*cols))


def reduce_levels(nodes: DataFrame, largest: int, keep: list[str]) -> list[DataFrame]:
    """Slot arrays of every level from leaves (tree, n, pos, h): tree, n, node, slots, h.

    A slot is (slot, h), at the lowest level with the columns ``keep`` beside. A tree of one leaf keeps that leaf's digest.
    """
    levels, level = [], nodes
    while not levels or FAN ** len(levels) < largest:
        slot = F.struct(F.col("pos").bitwiseAND(F.lit(FAN - 1)).cast("int").alias("slot"), "h", *(keep if not levels else []))
        arrays = level.groupBy("tree", F.shiftright("pos", FAN_BITS).alias("node")).agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(slot)).alias("slots"))
        digests = F.transform("slots", lambda s: s["h"])
        h = F.when(F.col("n") == 1, digests[0]).otherwise(joined_digest(digests))
        levels.append(written(arrays.withColumn("h", h), "level"))
        level = levels[-1].filter(F.col("n") > FAN ** len(levels)).select("tree", "n", F.col("node").alias("pos"), "h")
    return levels


def _is_top(level: int) -> Column:
    """Whether the node of this level (from 1) is the last one of its tree."""
    top = F.col("n") <= FAN ** level
    return top if level == 1 else top & (F.col("n") > FAN ** (level - 1))


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, h: the last digest of every tree."""
    out = None
    for k, level in enumerate(levels, 1):
        one = level.filter(_is_top(k)).select("tree", "h")
        out = one if out is None else out.unionByName(one)
    return out


def _children(level: DataFrame, keep: list[str], carried: list[str]) -> DataFrame:
    """One row for each slot: tree, pos, its columns, and ``sides`` with the digests beside it at this level first."""
    digests = lambda c: F.transform(c, lambda s: s["h"])
    rows = level.select("tree", "node", "n", "sides", *carried, "slots", F.posexplode("slots").alias("at", "one"))
    beside = F.struct(
        F.array_join(F.slice(digests("slots"), F.lit(1), F.col("at")), "").alias("before"),
        F.array_join(F.slice(digests("slots"), F.col("at") + 2, F.greatest(F.size("slots") - F.col("at") - 1, F.lit(0))), "").alias("after"))
    own = F.when(F.col("n") == 1, F.array().cast(SIDES)).otherwise(F.array(beside))
    return rows.select("tree", (F.shiftleft("node", FAN_BITS) + F.col("at")).alias("pos"), F.col("one.h").alias("h"),
                       F.concat(own, F.col("sides")).alias("sides"), *carried, *[F.col(f"one.{c}").alias(c) for c in keep])


def paths(levels: list[DataFrame], top: DataFrame, keep: list[str], carried: list[str]) -> DataFrame:
    """Every leaf with ``sides``, the digests beside its path up to what ``top`` (tree, sides, carried) has for its tree."""
    above = None
    for k in range(len(levels), 0, -1):
        level = levels[k - 1]
        last = level.filter(_is_top(k)).hint("merge").join(top, "tree")
        rows = last if above is None else last.unionByName(level.filter(F.col("n") > FAN ** k).hint("merge").join(
            above.select("tree", F.col("pos").alias("node"), "sides", *carried), ["tree", "node"]))
        above = _children(rows, keep if k == 1 else [], carried)
    return above


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest: doc_id, leaf, subroot, root, proof_sha256, and the root folded again from the altered leaf."""
    placed = written(leaves(docs, tampered), "leaves")
    bitmap = written(id_bitmap(placed.select("tree", "doc_id")), "ranks")
    nodes = ranked(placed, bitmap).withColumnRenamed("leaf", "h")
    largest = bitmap.agg(F.max("total")).first()[0] or 0
    keep = ["doc_id", "altered"]
    levels = reduce_levels(nodes, largest, keep)
    # the subroots, in order of their sources, are the leaves of one more tree
    subroots = written(ordered_id(roots(levels), [F.col("tree")], "number"), "subroots")
    count = subroots.count()
    tops = reduce_levels(subroots.select(F.lit("").alias("tree"), F.lit(count).cast("long").alias("n"), (F.col("number") - 1).alias("pos"),
                                         "h", F.col("tree").alias("group")), count, ["group"])
    root = roots(tops).select("tree", F.array().cast(SIDES).alias("sides"), F.col("h").alias("root"))
    top = written(paths(tops, root, ["group"], ["root"]).select(F.col("group").alias("tree"), "sides", "root", F.col("h").alias("subroot")), "tops")
    rows = paths(levels, top, keep, ["subroot", "root"])
    proof = F.sha2(F.array_join(F.transform("sides", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    folded = F.aggregate("sides", F.coalesce("altered", "h"), lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))
    return rows.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_fifth(doc_id: Column) -> Column:
    """Whether 5 divides the CRC of the id written in decimals."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0
