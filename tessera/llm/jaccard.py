"""Operator 7, n-gram Jaccard join with Bayesian candidate pruning.

Similarity is the Jaccard coefficient of the sets of five-word shingles (lower-cased words); a link is a similarity of
``threshold`` or more.

1. Each text gives a 128-bit digest of its shingle set, ``BANDS * ROWS`` MinHash values and a key for each band.
   Texts with equal sets are copies: one *node* stands for them, with its number of copies.
2. Nodes that share a band key are candidates. Large buckets are cut into blocks of ``BLOCK`` nodes and every two
   blocks meet in a task of their own; buckets with the same members are kept once.
3. In a block, MinHash values are compared ``STEP`` at a time. With a uniform prior, the posterior after m of n equal
   values is Beta(m + 1, n - m + 1); a pair goes when its probability of reaching the threshold is below
   ``TOLERANCE``. What stays is returned as a spanning forest, so the rows are linear in the nodes.
4. Components of that graph are found by alternating large-star and small-star steps. Inside a component every two
   blocks meet again, now with the shingle sets: pairs pass the same pruning and the rest are verified exactly.
   Links are returned as a sum for each node and a forest, never as pairs.

A pair at the threshold shares none of the 30 bands of 5 with probability (1 - 0.8**5)**30 < 1e-5; a pair inside one
component is compared whether it shares a band or not.

Nulls and empties: null texts are empty. A text of fewer than five words has one shingle, all its words; a text without
words but not blank has itself as its shingle; a blank text has none, is similar to nothing, and is a class of
its own (class_id is its identifier). Null identifiers are ignored for class_id unless a class has no other. Repeated rows are copies
and count as links of each other. An empty table gives no rows. Columns other than identifier and text aren't read. Very long texts are read whole;
their blocks have fewer nodes. Ties: a class is named, and represented, by its smallest identifier, then by the smallest hash of the text.

Hot keys (a band, the centre of a star, a component, a class or a text that more than one of ``common.HOT_SHARE`` rows have) aren't shuffled to one task:
``common.hot_join`` leaves their rows where they are. In a component of n nodes each node is sent once per block, n / ``BLOCK`` times, as the
shingles in which it differs from the component's root: in a group of near copies a tenth of its set or less."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5
STEP, TOLERANCE = 30, 1e-6
#: Nodes of a block at most; in the exact comparison a block has BLOCK * BLOCK_SHINGLES shingles at most too, or one node's.
BLOCK, BLOCK_SHINGLES = 512, 2048
#: A root with more shingles isn't joined to its component's members; they are sent whole.
BASE_SHINGLES = 65_536
#: Documents are broadcast, as a number or two each, to be picked out or dropped, if they are so many at most; more are joined by a shuffle.
GONE_AT_ONCE = 1_000_000
#: A name that no column of a table has.
OWN = "__tessera_jaccard__"

_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = common.WORD.findall(text.lower())
    if not words:
        bare = text.strip()
        return np.array([xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass"), 7)] if bare else [], np.uint64)
    h = common.word_hashes(words)
    return np.unique(common.rolling(h, width)) if len(h) >= width else common.rolling(h, len(h)) + np.uint64(len(h))


def minhash(sh: np.ndarray) -> np.ndarray:
    """The MinHash values, 32 bits each."""
    low = np.full(len(_A), np.iinfo(np.uint64).max)
    for at in range(0, len(sh), 1024):
        part = np.multiply.outer(_A, sh[at : at + 1024])
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


@cache
def least_equal(n: int, threshold: float, tolerance: float, bits: int = 16) -> int:
    """The fewest equal values of n that keep a pair: fewer make P(similarity >= threshold) < tolerance. Values cut to
    ``bits`` bits are equal by chance now and then, which raises the threshold a little."""
    t = threshold + (1 - threshold) / 2**bits
    # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def surviving(sig_a: np.ndarray, sig_b: np.ndarray, within: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that pass all comparisons. within: a and b are the same rows, and i < j is asked for."""
    found_i, found_j = [], []
    for at in range(0, len(sig_a), 64):
        rows = sig_a[at : at + 64]
        equal = (rows[:, None, :STEP] == sig_b[None, :, :STEP]).sum(axis=2, dtype=np.int16)
        keep = equal >= least_equal(STEP, threshold, tolerance)
        if within:
            keep &= np.arange(at, at + len(rows))[:, None] < np.arange(len(sig_b))[None, :]
        i, j = np.nonzero(keep)
        same = equal[i, j]
        for k in range(STEP, sig_a.shape[1], STEP):
            if not len(i):
                break
            same = same + (rows[i, k : k + STEP] == sig_b[j, k : k + STEP]).sum(axis=1, dtype=np.int16)
            ok = same >= least_equal(k + STEP, threshold, tolerance)
            i, j, same = i[ok], j[ok], same[ok]
        found_i.append(i + at)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) have a Jaccard coefficient of threshold or more, exactly."""
    t = Fraction(str(threshold))
    na, nb = (np.array([len(s) for s in sets], np.int64) for sets in (sets_a, sets_b))
    if len(i) > 2 * (len(sets_a) + len(sets_b)):
        # Many pairs: intersections by matrix products over slices of the shingles that occur twice or more.
        words, counts = np.unique(np.concatenate([*sets_a, *(sets_b if sets_b is not sets_a else [])]), return_counts=True)
        words = words[counts > 1]
        both = np.zeros((len(sets_a), len(sets_b)), np.float32)
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            grids = []
            for sets in (sets_a, sets_b) if sets_b is not sets_a else (sets_a,):
                grid = np.zeros((len(sets), len(part)), np.float32)
                for r, s in enumerate(sets):
                    own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                    k = np.searchsorted(part, own)
                    grid[r, k[part[k] == own]] = 1
                grids.append(grid)
            both += grids[0] @ grids[-1].T
        inter = both[i, j].astype(np.int64)
    else:
        inter = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    # inter / (na + nb - inter) >= t, in whole numbers
    return (t.denominator + t.numerator) * inter >= t.numerator * (na[i] + nb[j])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indexes is joined to."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
        part = root[i] != root[j]
        i, j = i[part], j[part]
    while (root[root] != root).any():
        root = root[root]
    return root


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (a hash of the text), node (the digest of the shingle set; null for a blank text), n (its shingles), sig (MinHash
    values, 16 bits each), bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin(common.HASHES)
        for batch in batches:
            for part in common.slices(batch, "text"):
                nodes: list[bytes | None] = []
                counts: list[int] = []
                sigs = np.zeros((part.num_rows, BANDS * ROWS), np.uint32)
                for r, text in enumerate(common.texts_of(part.column("text"))):
                    sh = shingles(text)
                    nodes.append(xxhash.xxh3_128_digest(sh.tobytes()) if len(sh) else None)
                    counts.append(len(sh))
                    if len(sh):
                        sigs[r] = minhash(sh)
                keys = np.zeros((part.num_rows, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
                for k in range(ROWS):
                    keys = common.mix(keys ^ sigs[:, k::ROWS][:, :BANDS].astype(np.uint64)) * np.uint64(0xE7037ED1A0B428DB)
                raw = sigs.astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.array([x.tobytes() for x in raw], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64).ravel()))],
                    schema=schema,
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text")).mapInArrow(sketch, "doc_id long, h long, node binary, n long, sig binary, bands array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], heavy: str) -> Iterator[dict[str, list]]:
    """The rows of each run of equal keys; a run may go on over batches. heavy: the column with the most bytes."""
    held: dict[str, list] = {}
    last = None
    for batch in (part for whole in batches for part in common.slices(whole, heavy, 16_000_000)):
        cols = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        marks = list(zip(*(cols[k] for k in keys), strict=True))
        start = 0
        for r in range(len(marks) + 1):
            if r < len(marks) and marks[r] == last:
                continue
            if r > start or held:
                for n, c in cols.items():
                    held.setdefault(n, []).extend(c[start:r])
            if r == len(marks):
                break
            if held:
                yield held
            held, last, start = {}, marks[r], r
    if held:
        yield held


def _blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """Deals the members of each group into its number of blocks and repeats each for every two blocks that meet (_p <= _q): once per block."""
    met = members.withColumn("_own", F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return met.withColumn("_p", F.least("_own", "_other")).withColumn("_q", F.greatest("_own", "_other")).drop("_other")


def _sides(own: list[int], p: int, q: int) -> tuple[list[int], list[int], bool]:
    a = [k for k, x in enumerate(own) if x == p]
    return (a, a, True) if p == q else (a, [k for k, x in enumerate(own) if x == q], False)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node of its component. Alternates the
    large-star and small-star steps until they change nothing; each round is written to the shared folder."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        # Large star: a node's larger neighbours go to the least of the node and its neighbours. Small star: its smaller ones and itself.
        if large:
            near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = near.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).withColumn("low", F.least("u", "low"))
        low = common.written(low, "low")
        met = common.hot_join(near, low, "u", "n")  # the centre of a star may have a third of all edges
        if large:
            moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        else:
            moved = met.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        return moved.where(F.col("u") != F.col("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = common.written(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    seen = mark(now)
    while True:
        now = common.written(stars(common.written(stars(now, True), "edges"), False), "edges")
        if (then := mark(now)) == seen:
            break
        seen = then
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def candidate_edges(nodes: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Spanning forests (u, v) of the pairs that share a band and survive the pruning."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    full = common.written(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    dealt = _blocks(common.hot_join(rows, full, "band", "n"), F.ceil(F.col("n") / block))
    met = dealt.groupBy("band", "_p", "_q").agg(F.sort_array(F.collect_list(F.struct("node", "_own"))).alias("members"))  # 2 * block at most, about
    met = met.where(F.size("members") > 1).withColumn("_set", F.xxhash64("members", "_p", "_q")).groupBy("_set").agg(F.first("members").alias("members"), F.first("_p").alias("_p"), F.first("_q").alias("_q"))
    out = met.select("_set", "_p", "_q", F.explode("members").alias("m")).select("_set", "_p", "_q", "m.node", "m._own").join(nodes.select("node", "sig"), "node")
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        us: list[bytes] = []
        vs: list[bytes] = []
        for g in _groups(batches, ["_set"], "sig"):
            sig = np.frombuffer(b"".join(g["sig"]), "<u2").reshape(len(g["sig"]), -1)
            a, b, within = _sides(g["_own"], g["_p"][0], g["_q"][0])
            if not a or not b:
                continue
            i, j = surviving(sig[a], sig[b], within, threshold, tolerance)
            i, j = np.array(a)[i], np.array(b)[j]
            root = forest(len(sig), i, j)
            moved = np.flatnonzero(root != np.arange(len(root)))
            us += [g["node"][k] for k in moved]
            vs += [g["node"][k] for k in root[moved]]
            if len(us) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], schema=schema)
                us, vs = [], []
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], schema=schema)

    return out.repartition("_set").sortWithinPartitions("_set").mapInArrow(compare, "u binary, v binary")


def exact_links(members: DataFrame, threshold: float, tolerance: float, several: bool) -> DataFrame:
    """members: root, blocks (of the component), short (whether to send differences from the root), node, copies, text. Returns node, links (documents of other
    nodes that it is linked to) and to (a linked node, or itself), several rows a node where a component has several blocks. several: whether any is to be sent short."""
    shape = pa.schema([("root", pa.binary()), ("blocks", pa.int64()), ("short", pa.bool_()), ("node", pa.binary()), ("copies", pa.int64()), ("sh", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin(common.HASHES)
        for batch in batches:
            for part in common.slices(batch, "text"):
                sh = [shingles(t).tobytes() for t in common.texts_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in shape.names[:5]), pa.array(sh, pa.binary())], schema=shape)

    sets = members.mapInArrow(cut, "root binary, blocks long, short boolean, node binary, copies long, sh binary")
    if several:
        # Members of a component of several blocks are sent once per block, so they go as what tells them from the component's root, if that is shorter.
        sets = common.written(sets, "sets")
        large = sets.where("short")
        roots = common.written(large.where("node = root").select("root", F.col("sh").alias("base")).join(large.groupBy("root").agg(F.count("*").alias("members")), "root"), "roots")
        told = pa.schema([*shape, ("delta", pa.bool_())])

        def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.begin()
            for batch in batches:
                for part in common.slices(batch, "sh"):
                    own = []
                    for sh, base in zip(part.column("sh").to_pylist(), part.column("base").to_pylist(), strict=True):
                        d = np.setxor1d(np.frombuffer(sh, np.uint64), np.frombuffer(base, np.uint64), assume_unique=True).tobytes()
                        own.append((d, True) if len(d) < len(sh) else (sh, False))
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in shape.names[:5]), pa.array([x for x, _ in own], pa.binary()), pa.array([x for _, x in own], pa.bool_())], schema=told)

        short = common.hot_join(large, roots, "root", "members", wide=50).mapInArrow(shorten, "root binary, blocks long, short boolean, node binary, copies long, sh binary, delta boolean")
        pairs = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
        # The root itself goes to every two blocks that meet, before their members.
        bases = large.where("node = root").withColumn("_p", pairs).withColumn("_q", F.explode(F.sequence(F.col("_p"), F.col("blocks").cast("int") - 1))).withColumn("_own", F.lit(-1)).withColumn("delta", F.lit(False))
        dealt = _blocks(short, F.col("blocks")).unionByName(bases).unionByName(_blocks(sets.where("not short").withColumn("delta", F.lit(False)), F.col("blocks")))
    else:
        dealt = _blocks(sets.withColumn("delta", F.lit(False)), F.col("blocks"))
    schema = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("to", pa.binary())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        rows: list[tuple] = []
        for g in _groups(batches, ["root", "_p", "_q"], "sh"):
            own = [np.frombuffer(x, np.uint64) for x in g["sh"]]
            if g["_own"][0] == -1:
                base = own[0]
                own = [np.setxor1d(base, x, assume_unique=True) if d else x for x, d in zip(own[1:], g["delta"][1:], strict=True)]
                g = {name: col[1:] for name, col in g.items()}
            a, b, within = _sides(g["_own"], g["_p"][0], g["_q"][0])
            copies = np.array(g["copies"], np.int64)
            links = np.zeros(len(own), np.int64)
            root = np.arange(len(own))
            if a and b and len(own) > 1:
                sig = np.array([minhash(x).astype("<u2") for x in own])
                sets_a = [own[k] for k in a]
                sets_b = sets_a if within else [own[k] for k in b]
                i, j = surviving(sig[a], sig[b], within, threshold, tolerance)
                ok = linked(sets_a, sets_b, i, j, threshold)
                i, j = np.array(a)[i[ok]], np.array(b)[j[ok]]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                root = forest(len(own), i, j)
            rows += zip(g["node"], links.tolist(), (g["node"][k] for k in root), strict=True)
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return dealt.select("root", "_p", "_q", "_own", "node", "copies", "sh", "delta").repartition("root", "_p", "_q").sortWithinPartitions("root", "_p", "_q", "_own", "node").mapInArrow(compare, "node binary, links long, to binary")


def join(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest identifier of its class), n_links (documents with a
    similarity of threshold or more, copies included)."""
    return labelled(docs, **how).select("doc_id", "class_id", "n_links")


def labelled(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``join``, with h (a hash of the text) and label (of the class; null for a blank text)."""
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = common.written(sketches(docs).withColumn("k", F.xxhash64("doc_id", "h")), "sketches")
    there = known.where(F.col("node").isNotNull())
    nodes = common.written(there.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "h", "k")).alias("one"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    comps = components(candidate_edges(nodes.select("node", "sig", "bands"), threshold, tolerance, block))
    same = there.groupBy("k").agg(F.count("*").alias("same"))
    placed = common.written(comps.join(nodes.select("node", "copies", "one", "n"), "node").withColumn("k", F.col("one.k")).join(same, "k"), "placed")
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / block), F.ceil(F.sum("n") / (block * BLOCK_SHINGLES)))
    sizes = placed.groupBy("root").agg(F.count("*").alias("size"), blocks.cast("long").alias("blocks"), F.max(F.when(F.col("node") == F.col("root"), F.col("n"))).alias("root_n"))
    sizes = common.written(sizes.select("root", "size", "blocks", ((F.col("blocks") > 1) & (F.col("root_n") <= BASE_SHINGLES)).alias("short")), "sizes")
    placed = common.written(common.hot_join(placed.drop("n"), sizes, "root", "size"), "placed")
    # The text of each node: that of one of its rows, known by identifier and hash (identifiers may repeat or be null).
    texts = docs.withColumn("h", F.xxhash64("text")).withColumn("k", F.xxhash64("doc_id", "h"))
    if placed.count() <= GONE_AT_ONCE:
        texts = texts.join(F.broadcast(placed.select("k")), "k", "left_semi")  # eight bytes each
    found = common.hot_join(texts, placed, "k", "same").where(F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("h") == F.col("one.h")))
    members = found.select("root", "blocks", "short", "node", "copies", "text").dropDuplicates(["node"])
    found = common.written(exact_links(members, threshold, tolerance, bool(sizes.where("short").limit(1).count())), "links")
    # Components of one block have their classes already; those of several are joined by their forests.
    labels = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    by = common.written(nodes.select("node", "copies", "low").join(links, "node", "left").join(labels, "node", "left").select("node", "copies", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("label")), "classes")
    lows = common.written(by.groupBy("label").agg(F.min("low").alias("class_id"), F.count("*").alias("members")), "lows")
    named = common.hot_join(by, lows, "label", "members").select("node", "label", "class_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    named = common.written(named, "named")
    out = common.hot_join(there.select("doc_id", "h", "node"), named, "node", "copies").select("doc_id", "h", "label", "class_id", F.col("n_links").cast("long").alias("n_links"))
    blank = known.where(F.col("node").isNull())
    return out.unionByName(blank.select("doc_id", "h", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents with one of each class: the one with the smallest identifier, then the smallest hash of its text;
    of rows that repeat both, one. Blank texts are classes of their own and stay."""
    rows = common.written(labelled(docs, **how).where("label is not null").select("label", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h").alias("row")), "rows")
    chosen = common.written(rows.groupBy("label").agg(F.min("row").alias("first"), F.count("*").alias("members")), "chosen")
    met = common.hot_join(rows, chosen, "label", "members")
    gone = common.written(met.where("row != first").select(F.col("row.doc_id").alias(OWN), F.col("row.h").alias(OWN + "h")).distinct(), "gone")
    kept = _without(docs, gone, "left_anti")
    # Rows that repeat identifier and text: one of them, with the smallest hash of all its columns. Blank texts aren't touched.
    again = met.where("row = first").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row.doc_id").alias(OWN), F.col("row.h").alias(OWN + "h"))
    again = common.written(again, "again")
    if not again.limit(1).count():
        return kept
    names = kept.columns
    repeated = _without(kept, again, "left_semi").groupBy(F.col("doc_id").alias(OWN), F.xxhash64(F.col("text").cast("string")).alias(OWN + "h"))
    once = repeated.agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias(OWN + "row")).select(*[F.col(OWN + "row")[c].alias(c) for c in names])
    return _without(kept, again, "left_anti").unionByName(once)


def _without(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents whose identifier and hash of the text are among the rows (left_semi) or not (left_anti)."""
    listed = F.broadcast(rows) if rows.count() <= GONE_AT_ONCE else rows
    return docs.join(listed, docs["doc_id"].cast("long").eqNullSafe(rows[OWN]) & (F.xxhash64(docs["text"].cast("string")) == rows[OWN + "h"]), how)
