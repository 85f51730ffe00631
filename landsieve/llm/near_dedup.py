"""Near duplicates by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Each distinct word sequence gets a MinHash signature. The forest sorts signatures in several coordinate orders.
Texts that share a long enough prefix in some order form a region and are each other's candidates. Depth adapts:
a region with too many texts is split by deeper prefixes, others stay shallow, where recall is highest. What is
still large at full depth has all but equal signatures; it is dealt into parts that share its least text. The
members of a region meet once, with their whole texts, and a link is kept only if the sets pass the threshold.
A region hands on no more links than connect its members, never all pairs.

Splitting a large region parts some of its pairs. So its members outside its main component are afterwards held
against all the others, in blocks: a shallow region loses no link, however large it is.

Defined results: a null text is an empty one; a text without words has no set and is linked with nothing; repeated
rows are equal texts and so linked; rows without id keep their place and take the least id of their group, if any
has one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landsieve.llm.common import batches, join_counted, map_batches, row_numbers, texts, words_of, written
from landsieve.llm.components import components

COORDINATES = 32
ORDERS = 16
#: Prefix lengths of a region, one after another.
DEPTHS = (2, 4, 8, 32)
REGION = 256
#: Members of a block in which large regions are compared once more.
BLOCK = 512
WORD_CACHE = 1 << 19
BLOCK_WORDS = 1 << 19
#: Bits at most by which texts that no region asks for are left out (16 MB, broadcast).
WANTED_BITS = 1 << 27

_rng = np.random.default_rng(20_011)
_FACTORS = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Each order starts with two coordinates of its own and goes on with the others.
_PERMUTED = [np.concatenate([[2 * o, 2 * o + 1], _rng.permutation(
    [c for c in range(COORDINATES) if c // 2 != o])]) for o in range(ORDERS)]

#: ``packed`` is the whole text, compressed, since it goes through shuffles.
_SIGNED_DDL = "uid long, doc_id long, n_shingles long, seq binary, sig binary, packed binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Distinct hashes of all runs of ``width`` words; fewer words make one run."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > WORD_CACHE:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = _mix(out + h[k:k + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES minima for each set; zeros for an empty one."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for c in range(COORDINATES):
            out[full, c] = np.minimum.reduceat(((flat * _FACTORS[c]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sign(docs: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """Each document's set size, digest of its word sequence, signature, packed text and kept columns."""
    keep = [c for c in keep if c != "text"]
    row = F.struct(*keep).alias("row") if keep else F.lit(None).cast("int").alias("row")
    inputs = docs.select(F.col("doc_id").cast("long"), "text", row)
    out = T.StructType([*T.StructType.fromDDL(_SIGNED_DDL).fields, inputs.schema["row"]])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, pack = row_numbers(), zstandard.ZstdCompressor(1).compress

        def signed(part: pa.RecordBatch, seqs: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
            packed = [None if t is None else pack(t.encode()) for t in part.column(1).to_pylist()]
            own = [pa.array([next(uid) for _ in sets], pa.int64()), part.column(0),
                   pa.array([len(s) for s in sets], pa.int64()), pa.array(seqs, pa.binary()),
                   pa.array([x.tobytes() for x in signatures(sets)], pa.binary()), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays([*own, part.column(2)], names=out.names)

        for batch in source:
            start, seqs, sets, held = 0, [], [], 0
            for i, text in enumerate(texts(batch.column(1)), 1):
                words = words_of(text)
                seqs.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sets.append(shingle_hashes(words, width))
                held += len(words)
                if held > BLOCK_WORDS or i == batch.num_rows:
                    yield signed(batch.slice(start, i - start), seqs, sets)
                    start, seqs, sets, held = i, [], [], 0

    return map_batches(inputs, run, out)


def _prefix_keys(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, order, key) of the signature prefixes of ``nodes`` (node, sig, orders)."""
    schema = pa.schema([("node", pa.int64()), ("order", pa.int32()), ("key", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            mask = np.zeros((len(node), ORDERS), bool)
            for i, orders in enumerate(batch.column(2).to_pylist()):
                mask[i, orders] = True
            for o in range(ORDERS):
                rows = np.flatnonzero(mask[:, o])
                if len(rows):
                    key = np.full(len(rows), depth * 1000 + o, np.uint64)
                    for c in _PERMUTED[o][:depth]:
                        key = _mix(key + sig[rows, c])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[rows]), pa.array(np.full(len(rows), o, np.int32)), pa.array(key.view(np.int64))],
                        schema=schema)

    return map_batches(nodes.select("node", "sig", "orders"), run, "node long, order int, key long")


def regions(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Distinct sets of 2 to REGION + 1 nodes that share a prefix in some order: (region, node).

    Beside them the members (key, node, n) of the shallow regions that were too large and so were split, if any.
    """
    todo = reps.select("node", "sig", F.sequence(F.lit(0), F.lit(ORDERS - 1)).alias("orders"))
    found = shallow = None
    for depth in DEPTHS:
        keyed = written(_prefix_keys(todo, depth), "prefixes")
        counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1")
        met = written(join_counted(keyed, counts, "key", keyed.count()).filter("n > 1"), "met")
        here = met.filter(F.col("n") <= REGION).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        found = here.select("nodes") if found is None else found.unionByName(here.select("nodes"))
        large = met.filter(F.col("n") > REGION)
        if large.isEmpty():
            break
        shallow = shallow or large.select("key", "node", "n")
        if depth == DEPTHS[-1]:
            part = F.pmod(F.xxhash64("node", "order"), F.ceil(F.col("n") / F.lit(REGION // 2)))
            parts = large.filter(F.col("node") != F.col("least")).groupBy("key", "least", part.alias("part")).agg(
                F.collect_list("node").alias("nodes"))
            found = found.unionByName(parts.select(F.sort_array(F.array_append("nodes", F.col("least"))).alias("nodes")))
        todo = large.groupBy("node").agg(F.collect_set("order").alias("orders")).join(reps.select("node", "sig"), "node")
    distinct = found.groupBy(F.xxhash64("nodes").alias("h"), "nodes").agg(F.lit(1)).select("nodes")
    return distinct.select(F.xxhash64("nodes").alias("region"), F.explode("nodes").alias("node")), shallow


def _exact_set(packed: bytes, width: int, known: dict) -> np.ndarray:
    """Shingles as numbers that are equal where the words are."""
    words = zstandard.ZstdDecompressor().decompress(packed).lower().split()
    n = max(1, len(words) - width + 1)
    runs = set(zip(*(words[k:k + n] for k in range(min(width, len(words)))), strict=True))
    return np.array([known.setdefault(r, len(known)) for r in runs], np.int64)


def links_within(members: list[tuple], width: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that connect the members as far as any pair of them is linked.

    A member is (node, root, probe, packed text): those of equal root are connected already, and only pairs with a
    probe among them are compared. An index from shingles to members gives a probe's overlap with all at once.
    """
    known: dict = {}
    sets = [_exact_set(m[3], width, known) for m in members]
    first: dict = {}
    root = [first.setdefault(m[1], i) for i, m in enumerate(members)]
    if len(first) < 2:
        return []
    size = np.array([len(s) for s in sets])
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(shingle, kind="stable")
    owner = owner[order]
    begin = np.searchsorted(shingle[order], np.arange(len(known) + 1))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, member in enumerate(members):
        if not member[2]:
            continue
        start, n = begin[sets[i]], begin[sets[i] + 1] - begin[sets[i]]
        at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(100 * both >= percent * (size[i] + size - both)).tolist():
            if top(i) != top(j):
                root[top(i)] = top(j)
                out.append((members[j][0], member[0]))
    return out


def only_wanted(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (node, ...) without most of those that are not among ``nodes``: what is left is worth a shuffle.

    A bit stands for each hash of a node, some sixteen bits for a node, WANTED_BITS at most. No wanted row is lost.
    """
    bits = min(WANTED_BITS, 1 << max(15, (16 * nodes.count()).bit_length()))
    number = F.pmod(F.xxhash64("node"), F.lit(bits))
    maps = nodes.select(number.alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    at = F.bitmap_bit_position("_h")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hashed = rows.withColumn("_h", number).withColumn("_bucket", F.bitmap_bucket_number("_h"))
    return hashed.join(F.broadcast(maps), "_bucket").filter(
        byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).drop("_h", "_bucket", "_bits")


def confirmed(members: DataFrame, bodies: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of all regions (region, node, root, probe).

    A region has few members, and its rows follow each other in one partition. Texts are dealt by node at every
    size, all but those of no region: a plan that turns from a broadcast to this at some size scales by surprise.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, held = None, []
            for batch in source:
                for region, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if region != at:
                        yield from links_within(held, width, percent)
                        at, held = region, []
                    held.append(member)
            yield from links_within(held, width, percent)

        yield from batches(rows(), schema)

    wanted = only_wanted(bodies, members.select("node").distinct())
    met = members.join(wanted.hint("merge"), "node").repartition("region").sortWithinPartitions("region", "node")
    return map_batches(met.select("region", "node", "root", "probe", "packed"), run, "a long, b long").distinct()


def outside_main(shallow: DataFrame, roots: DataFrame) -> DataFrame:
    """What is left to compare in large regions: (region, node, root, probe).

    In each, the component with most members is the main one. Members outside it are probes; blocks of them meet
    blocks of all members. Nothing is left of a region that is one component.
    """
    members = written(shallow.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "large")
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.first("n").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.first("n").alias("n"),
                                    F.max("size").alias("most")).filter("most < n")
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    main = main.select("key", "n", "main", parts(F.col("n")).alias("blocks"), parts(F.col("n") - F.col("most")).alias("probes"))
    met = written(join_counted(members.drop("n"), main, "key", members.count()).filter("main is not null"), "outside")
    probe = F.col("root") != F.col("main")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    cols = ["key", "node", "root"]
    all_ = met.select(*cols, dealt(1, F.col("blocks")).alias("block"), every(F.col("probes")).alias("part"), F.lit(False).alias("probe"))
    some = met.filter(probe).select(*cols, every(F.col("blocks")).alias("block"), dealt(2, F.col("probes")).alias("part"), F.lit(True).alias("probe"))
    return all_.unionByName(some).groupBy(F.xxhash64("key", "block", "part").alias("region"), "node").agg(
        F.first("root").alias("root"), F.max("probe").alias("probe"))


def connect(has_set: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) of all linked texts."""
    bodies = has_set.select(F.col("uid").alias("node"), "packed")
    members, shallow = regions(reps)
    once = written(members.select("region", "node", F.col("node").alias("root"), F.lit(True).alias("probe")), "regions")
    links = written(confirmed(once, bodies, width, percent), "confirmed")
    roots = components(links)
    if shallow is None:
        return roots
    rest = written(outside_main(shallow, roots), "rest")
    if rest.isEmpty():
        return roots
    more = written(confirmed(rest, bodies, width, percent), "confirmed")
    if more.isEmpty():
        return roots
    # what is joined already comes as stars, so that few rounds are left
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, keep: list[str] | None = None) -> DataFrame:
    """For each document: doc_id, n_shingles, component_id, kept, and ``first`` (true for one row of each group).

    ``keep`` names columns that come back beside these, in the struct ``row``; a text comes back as ``packed``.
    """
    signed = written(sign(docs, width, keep or []), "signed")
    has_set = signed.filter("n_shingles > 0")
    reps = written(has_set.groupBy("seq").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("doc"), F.min_by("sig", "uid").alias("sig"),
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("lead")), "reps")
    roots = connect(has_set, reps, width, percent)
    rooted = written(reps.drop("sig").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    of_root = rooted.groupBy("root").agg(F.min("doc").alias("component_id"), F.min("lead").alias("lead"),
                                         F.count(F.lit(1)).alias("texts"))
    by_text = written(join_counted(rooted.select("seq", "n", "root"), of_root, "root", reps.count(), "texts")
                      .select("seq", "n", "component_id", F.col("lead.uid").alias("lead")), "by_text")
    carried = ["row", "packed"] if keep else []
    plain = signed.select("uid", "doc_id", "n_shingles", "seq", *carried)
    grouped = join_counted(plain.filter("n_shingles > 0"), by_text, "seq", has_set.count())
    alone = plain.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "lead": F.col("uid")})
    cols = ["uid", "doc_id", "n_shingles", "component_id", "lead", *carried]
    return grouped.select(*cols).unionByName(alone.select(*cols)).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        (F.col("uid") == F.col("lead")).alias("first"), *carried)


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: that with the least id."""
    others = [c for c in docs.columns if c != "text"]
    found = near_duplicates(docs, width, percent, docs.columns).filter("first").select("row", "packed")
    schema = T.StructType([*[docs.schema[c] for c in others], docs.schema["text"]])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in source:
            back = [None if p is None else unpack(p).decode() for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(back, pa.string())], names=schema.names)

    return map_batches(found, run, schema).select(*docs.columns)
