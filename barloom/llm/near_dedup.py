"""Near-duplicate grouping: SuperMinHash, banding, verification on full sets, union-find.

A document's set holds its distinct shingles of five words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); with fewer words, the
whole sequence is one shingle. Documents are linked if 100 * intersection >= 75 * union.

1. Each text is sketched by SuperMinHash: a shingle draws a random permutation of the SLOTS slots, and the slot at rank j
   gets the least of j + a uniform draw. Ranks of a shingle are all different, which lowers the variance, and a document
   stops at the first rank after which all its slots are filled. ROWS slots make a band: at a similarity of 0.75, a pair
   shares none of BANDS bands with a chance of 1e-5, and unlike pairs rarely share one.
2. Documents with equal sets are one node. Bands are taken in WAVES. Those of a wave are aggregated to buckets with the
   least and the largest component found so far, and a bucket that lies in one component goes before any join: a large group
   of near copies is united by the first wave's round and doesn't show up in the next wave. Buckets with the same members count once.
3. Buckets never emit all pairs. In the first round each member is checked against its bucket's first node; in further
   rounds (of the last wave), members of buckets that still hold several components are dealt anew into parts of PART members, each with a
   pivot of its own. So a round checks at most one pair for each member of a bucket. Rounds go on while they link much.
4. What is still open after all waves is joined exactly: a node's shingles are ordered from rare to frequent, those that no
   other open component has first, and two sets that are similar enough share one so early that enough follow it in both.
   Sizes and places bound the overlap, so a passage that many texts share makes no candidates where it can't make links.
   Links are reduced to forests within tasks. Every pair of a bucket is in one component, was checked or is ruled out.
5. Pairs are confirmed on the full sets (64-bit hashes of shingles), read again only for documents in open buckets.

Null or empty text, or white space only: an empty set (n_shingles 0), linked with nothing. A null id is linked with nothing.
Rows that share an id share a component. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bloom
from .common import materialize, scratch, small_batches, spread
from .components import components, united

BANDS, ROWS = 80, 7
#: Bands of each wave; they add up to BANDS.
WAVES = (16, 64)
#: Members of a part of a bucket in later rounds, and the share of pairs that a round must link for another one to follow.
PART, WORTH = 8, 0.05
SLOTS = BANDS * ROWS
SHINGLE = 5
#: Shingles sketched at once.
CHUNK = 15_000
KEPT_WORDS = 150_000
EMPTY = np.uint32(0xFFFFFFFF)
C1, C2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes; hashes of words are kept for the partition."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def set_of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # on bytes: A-Z only, and white space as WORD has it
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(SHINGLE, len(words))
        acc = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            acc = mix64(acc * GOLDEN + h[k : k + len(acc)])
        return np.unique(acc)


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A sketch of each set: slots of rank << 22 | draw. All sets must have elements."""
    doc = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    x = np.concatenate(sets)
    sketch = np.full(len(sets) * slots, EMPTY, np.uint32)
    perm, check = None, 0
    for j in range(slots):
        draw = mix64(x + np.uint64(int(GOLDEN) * (j + 1) % (1 << 64)))
        k = (((draw >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64) + j
        if j:  # Fisher-Yates, one step
            rows = np.arange(len(x))
            slot = perm[rows, k]
            perm[rows, k] = perm[:, j]
        else:
            slot = k
        np.minimum.at(sketch, doc * slots + slot, np.uint32(j << 22) | (draw & np.uint64(0x3FFFFF)).astype(np.uint32))
        if j < check:
            continue
        check = j + 1 + j // 4  # a rank too many changes nothing
        open_docs = np.unique(doc)
        open_docs = open_docs[(sketch.reshape(-1, slots)[open_docs] == EMPTY).any(1)]
        if not len(open_docs):
            break
        stay = np.zeros(len(sets), bool)
        stay[open_docs] = True
        keep = stay[doc]
        if perm is None:
            x, doc, k = x[keep], doc[keep], k[keep]
            perm = np.tile(np.arange(slots, dtype=np.uint16), (len(x), 1))
            perm[np.arange(len(x)), k] = 0
        elif keep.mean() < 0.7:
            x, doc, perm = x[keep], doc[keep], perm[keep]
    return sketch.reshape(-1, slots)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, -1).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(parts.shape[2]):
        acc = mix64(acc * GOLDEN + parts[:, :, r])
    return acc.view(np.int64)


def _chunks(sets: list[np.ndarray]) -> Iterator[list[int]]:
    at, n = [], 0
    for k, s in enumerate(sets):
        if len(s):
            if at and n + len(s) > CHUNK:
                yield at
                at, n = [], 0
            at.append(k)
            n += len(s)
    if at:
        yield at


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, f1, f2 (a 128-bit hash of the set, null for an empty one) and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                sets = [shingler.set_of(x) for x in part.column(1).to_pylist()]
                keys = np.zeros((len(sets), BANDS), np.int64)
                for at in _chunks(sets):
                    keys[at] = band_keys(superminhash([sets[k] for k in at]))
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                f1 = np.array([mix64(s ^ C1).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                f2 = np.array([mix64(s ^ C2).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                offsets = np.r_[0, np.cumsum((n > 0) * BANDS)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(f1, mask=n == 0), pa.array(f2, mask=n == 0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].ravel()))],
                    ["id", "n_shingles", "f1", "f2", "keys"],
                )

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, n_shingles long, f1 long, f2 long, keys array<long>")


def shingle_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                sets = [shingler.set_of(x) for x in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "shingles"])

    return df.select(id_col, text_col).mapInArrow(run, "id long, shingles array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b"))
    two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a"))
    both = pairs.join(one, "b").join(two, "a")
    na, nb = F.size("_a"), F.size("_b")
    both = both.where(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(100 * common >= percent * (na + nb - common)).select("a", "b")


def _members(reps: DataFrame, wave: int, known: DataFrame | None) -> DataFrame:
    """(key, node, c) of the nodes in buckets of the wave that hold several components."""
    coloured = reps.select("node", F.col(f"keys{wave}").alias("keys"))
    if known is None:
        coloured = coloured.withColumn("c", F.col("node"))
    else:  # only nodes that have links are shuffled
        tested = bloom.test(coloured, "node", bloom.written(bloom.filter_of, known, "id"), "_maybe")
        linked = tested.where("_maybe").join(spread(known), F.col("node") == F.col("id"), "left")
        coloured = tested.where(~F.col("_maybe")).select("node", "keys", F.col("node").alias("c")).union(linked.select("node", "keys", F.coalesce("component", "node")))
    bands = coloured.select("node", "c", F.explode("keys").alias("key"))
    h = F.xxhash64("node")  # the sum tells members apart that repeated rows cancel in the exclusive or
    buckets = bands.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("k"), F.bit_xor(h).alias("m1"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("m2")).where("c1 < c2")
    buckets = materialize(buckets.groupBy("c1", "c2", "k", "m1", "m2").agg(F.min("key").alias("key")).select("key"), "buckets")
    inside = bloom.test(bands, "key", bloom.written(bloom.filter_of, buckets, "key"), "_maybe").where("_maybe").drop("_maybe")
    return materialize(inside.join(spread(buckets), "key").select("key", "node", "c"), "members")


def _recoloured(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (key, node, c) with the components of now, of buckets that still hold several; k is a bucket's size."""
    now = rows.drop("c").join(known, F.col("node") == F.col("id"), "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    now = materialize(now, "coloured")
    several = now.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("k")).where("c1 < c2").select("key", "k")
    return now.join(spread(several), "key")


def star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """One pair (a, b) at most for each row: its part's pivot and itself, if they are of two components."""
    part = F.lit(0) if not turn else F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("k") / PART))
    rows = rows.select("key", "node", "c", part.alias("part"))
    pivots = rows.groupBy("key", "part").agg(F.min(F.struct("node", "c")).alias("p")).select("key", "part", F.col("p.node").alias("a"), F.col("p.c").alias("d"))
    return rows.join(spread(pivots), ["key", "part"]).where("c <> d").select("a", F.col("node").alias("b")).distinct()


def _rounds(rows: DataFrame, sets: DataFrame, known: DataFrame | None, percent: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """The components after one round of star_pairs, or in the last wave after several, and (node) of buckets that still hold several."""
    turn = 0
    while True:
        pairs = materialize(star_pairs(rows, turn), "pairs")
        links = materialize(_linked(pairs, sets, percent), "confirmed")
        n, checked = links.count(), pairs.count()
        if n or known is None:
            known = components(links if known is None else known.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))
        rows = materialize(_recoloured(rows, known), "open")
        turn += 1
        if not last or n < WORTH * checked or not n:
            return known, rows.select("node").distinct()


def exact_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), as forests within tasks, between the similar nodes of rows (node, c) that are of two components."""
    own = rows.join(sets, F.col("node") == F.col("id")).select(F.xxhash64("node", "shingles").alias("row"), "node", "c", F.size("shingles").alias("n"), "shingles")
    own = materialize(own.dropDuplicates(["row"]), "candidates")  # rows that share an id may have several sets

    def useful(of: DataFrame) -> DataFrame:
        """Shingles that several components have, with how many nodes have them."""
        each = of.select("c", F.explode("shingles").alias("x"))
        return spread(each.groupBy("x").agg(F.count("*").alias("k"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("x", "k"))

    # first only how many useful shingles a node has: most nodes can be ruled out by that
    shared = own.select("row", F.explode("shingles").alias("x")).join(useful(own), "x", "left_semi").groupBy("row").agg(F.count("*").alias("s"))
    able = materialize(own.join(shared, "row").where(100 * F.col("s") >= percent * F.col("n")).drop("s"), "able")
    places = able.select("row", "node", "c", "n", F.explode("shingles").alias("x")).join(useful(able), "x")
    by = Window.partitionBy("row")
    # left: useful shingles from this one on; an overlap that starts here can't be larger
    left = F.count("*").over(by) - F.row_number().over(by.orderBy("k", "x")) + 1
    places = places.withColumn("left", left).where(100 * F.col("left") >= percent * F.col("n"))
    places = places.select("x", "node", "c", "n", F.expr(f"({100 + percent} * left - {percent} * n) div {percent}").alias("most"))
    places = materialize(places, "places")  # most: the largest set that this overlap is enough for
    bounds = places.groupBy("x").agg(F.min("n").alias("n0"), F.max("most").alias("m1"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2")
    places = materialize(places.join(spread(bounds), "x").where("most >= n0 and n <= m1").select("x", "node", "c", "n", "most"), "places")
    a, b = (places.select("x", *[F.col(k).alias(f"{k}_{z}") for k in ("node", "c", "n", "most")]) for z in "ab")
    pairs = a.join(spread(b), "x").where("c_a < c_b and n_b <= most_a and n_a <= most_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    links = _linked(pairs, able.select(F.col("node").alias("id"), "shingles"), percent)
    return links.mapInPandas(united, "a long, b long")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """id_col, n_shingles, component_id (the least id that links reach) and kept (it is its own), one row for each row."""
    small_batches(df.sparkSession)
    with scratch():
        seen = materialize(sketches(df, id_col, text_col), "sketches")
        usable = seen.where("f1 is not null and id is not null")
        groups = spread(usable.groupBy("f1", "f2").agg(F.min("id").alias("node")))
        first = F.col("id") == F.col("node")
        cuts = [1 + sum(WAVES[:w]) for w in range(len(WAVES))]
        slices = [F.when(first, F.slice("keys", cut, size)).alias(f"keys{w}") for w, (cut, size) in enumerate(zip(cuts, WAVES, strict=True))]
        nodes = materialize(usable.join(groups, ["f1", "f2"]).select("id", "node", *slices), "nodes")
        reps = nodes.where("keys0 is not null").drop("id")
        texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
        sets, known, rest = None, None, []
        for wave in range(len(WAVES)):
            inside = _members(reps, wave, known)
            new = inside.select(F.col("node").alias("id")).distinct()
            new = materialize(new if sets is None else new.join(sets.select("id"), "id", "left_anti"), "new")
            wanted = bloom.test(texts, "id", bloom.written(bloom.filter_of, new, "id"), "_maybe").where("_maybe")
            more = materialize(shingle_sets(wanted, "id", "text"), "sets")
            sets = more if sets is None else sets.union(more)
            known, open_ = _rounds(inside, sets, known, percent, wave == len(WAVES) - 1)
            rest.append(open_)
        left = functools.reduce(DataFrame.union, rest).distinct()
        left = left.join(known, F.col("node") == F.col("id"), "left").select("node", F.coalesce("component", "node").alias("c"))
        links = materialize(exact_links(left, sets, percent), "links")
        if not links.isEmpty():
            known = components(known.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))
        placed = nodes.select("id", "node").distinct().join(known.withColumnRenamed("id", "node"), "node", "left").groupBy("id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
        out = seen.select("id", "n_shingles").join(placed, "id", "left")
        component = F.coalesce("component_id", "id")
        out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
        return materialize(out, "components", keep=True)
