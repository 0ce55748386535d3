"""MinHash near-duplicate groups by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles. Documents with equal sets collapse into
one class first, so copies never meet one another. Every class then has a signature of
``COORDS`` minwise values. A tree's root chooses some of these coordinates and sends a class to a
child for each chosen coordinate's minwise value; crowded children branch in the same way. Small
nodes are compared exhaustively, several independent trees bring the recall of a pair at the
threshold to ``recall`` even if its nodes are crowded at every level down to ``depth``.

Large groups of near copies make crowded nodes. Only links between different components can
change the result, so pairs that earlier links connect are never compared again:

- a first wave compares the members of a few trees' nodes with one pivot only, a second one settles
  these nodes, and the other trees follow, some at a time, so that each wave takes little disk;
- a node whose members are all of one component is finished;
- a node is small if members times members outside its largest component are at most ``work``:
  those outside are compared with all, block by block, which settles every possible link in it;
- other nodes branch; at ``depth`` levels the same comparison settles what is left.

No node, bucket or partner list is capped or sampled. Comparisons first use two bits of each
minwise value to find the classes that may have a link, and then their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bitmap, bitmap_bits, components, contracted, in_bitmap, labels, lean, read_documents, without
from .text import binary_column, chunks, distinct_sorted, mix64, row_minima, row_sums, shingles, stream64, words

COORDS = 128
_U = np.uint64
_SKETCH = [f"s{i}" for i in range(4)]
#: Trees of the first two waves; what they link, the other trees need not compare. Trees of a later wave.
_EARLY, _LATER = 2, 4
#: Blocks of a node's side that one task joins, so that a crowded node is dealt over many.
_GRID = 8


def least_agree(percent: int) -> int:
    """In how many of their two-bit values two sets at the threshold agree, less 4.3 standard deviations.

    A share j of the minwise values is equal, and of the others a quarter agree by chance.
    """
    p = percent / 100 + (1 - percent / 100) / 4
    return math.floor(COORDS * p - 4.3 * math.sqrt(COORDS * p * (1 - p)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mult = (stream64(3, COORDS) >> _U(32)).astype(np.uint32) | np.uint32(1)
    for batch in batches:
        ids, hashes = batch.column(0), batch.column(1)
        for lo, hi, buf, offs in chunks(batch.column(2)):
            w = words(buf, offs)
            s, so = shingles(w.hashes(), w.offs)
            u, uo = distinct_sorted(s, so)
            h = (u >> _U(32)).astype(np.uint32)
            sig = np.empty((hi - lo, COORDS), np.uint32)
            for j in range(COORDS):
                sig[:, j] = row_minima(h * mult[j], uo)
            two = (mix64(sig.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(62)).reshape(hi - lo, 4, 32)
            sketch = (two << (np.arange(32, dtype=np.uint64) * _U(2))).sum(axis=2, dtype=np.uint64).view(np.int64)
            parts = u.view(np.uint8).reshape(-1, 8)[:, 2:] if u.size else np.zeros((0, 6), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    hashes.slice(lo, hi - lo),
                    pa.array(np.diff(uo)),
                    pa.array(row_sums(mix64(u.copy()), uo).view(np.int64)),
                    pa.array(row_sums(mix64(u ^ _U(0xA5A5A5A5A5A5A5A5)), uo).view(np.int64)),
                    *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(4)),
                    binary_column(sig.view(np.uint8).reshape(-1), np.arange(hi - lo + 1) * COORDS * 4),
                    binary_column(np.ascontiguousarray(parts).reshape(-1), uo * 6),
                ],
                names=["doc_id", "text_hash", "n_shingles", "f1", "f2", *_SKETCH, "sig", "items"],
            )


def _choices(nodes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of node, coordinate) of the coordinates that nodes branch by: each with probability ``share``, one at least."""
    h = mix64(nodes[:, None] ^ stream64(29, COORDS)[None, :])
    pick = h < _U(int(share * 2.0**64))
    pick[np.arange(len(nodes)), h.argmin(axis=1)] = True
    return np.nonzero(pick)


def _children(share: float, trees: int):
    """The children of the roots of some trees, with the tree's number; of nodes if there are none, with the child's level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = stream64(41, max(trees, 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.slice(lo, 2048)
                c = b.column("c").to_numpy(zero_copy_only=False)
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
                if trees:
                    tree, coord = _choices(roots, share)
                    row = np.repeat(np.arange(len(c)), len(tree))
                    node, coord, tree = np.tile(roots[tree], len(c)), np.tile(coord, len(c)), np.tile(tree, len(c))
                else:
                    own = b.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
                    row, coord = _choices(own, share)
                    node, tree = own[row], b.column("level").to_numpy(zero_copy_only=False)[row] + 1
                child = mix64(mix64(node + coord.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) ^ (sig[row, coord].astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(c[row]), pa.array(tree.astype(np.int32))], names=["node", "c", "tree"])

    return run


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many of their two-bit values the rows of two sketch arrays agree."""
    d = x ^ y
    return COORDS - np.bitwise_count((d | (d >> _U(1))) & _U(0x5555555555555555)).sum(axis=1)


def _members(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, classes, components and sketches of a column of member lists."""
    flat = column.flatten()
    c, k = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("c", "k"))
    s = np.stack([flat.field(x).to_numpy(zero_copy_only=False) for x in _SKETCH], axis=1).view(np.uint64)
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]), c, k, s


def _similar(least: int, node: np.ndarray, c: np.ndarray, k: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(node, class) of the classes with a possible link to another component; i and j index the pairs to look at."""
    keep = k[i] != k[j]
    i, j = i[keep], j[keep]
    keep = _agree(s[i], s[j]) >= least
    own = np.unique(np.concatenate([i[keep], j[keep]]))
    return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(c[own])], names=["node", "c"])


def _similar_within(least: int):
    """All pairs of each row's members; rows of equal length are compared together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                b = batch.slice(lo, 128)
                offs, c, k, s = _members(b.column("members"))
                sizes = np.diff(offs)
                node = np.repeat(b.column("node").to_numpy(zero_copy_only=False), sizes)
                for size in np.unique(sizes):
                    x, y = np.triu_indices(size, 1)
                    first = offs[:-1][sizes == size][:, None]
                    yield _similar(least, node, c, k, s, (first + x).ravel(), (first + y).ravel())

    return run


def _similar_across(least: int):
    """All pairs of a member and one of the others of each row; of a node's rows that follow one another each class comes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, told = None, set()
        for batch in batches:
            for r in range(batch.num_rows):
                b = batch.slice(r, 1)
                own = b.column("node")[0].as_py()
                if own != node or len(told) > 1 << 20:
                    node, told = own, set()
                _, c, k, s = _members(b.column("members"))
                _, c2, k2, s2 = _members(b.column("others"))
                i, j = np.divmod(np.arange(len(c) * len(c2)), len(c2))
                c, k, s = np.concatenate([c, c2]), np.concatenate([k, k2]), np.concatenate([s, s2])
                found = set(_similar(least, np.full(len(c), node), c, k, s, i, len(c) - len(c2) + j).column("c").to_pylist()) - told
                told |= found
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())], names=["node", "c"])

    return run


def _link_blocks(percent: int):
    """Links of a spanning forest between the components of each row's two blocks, confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                b = batch.slice(r, 1)
                yield _forest(b.column("members"), b.column("others"), percent)

    return run


def _forest(members: pa.Array, others: pa.Array, percent: int) -> pa.RecordBatch:
    _, c, k, s = _members(members)
    _, c2, k2, s2 = _members(others)
    root = {x: x for x in np.concatenate([k, k2]).tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    sets = [_unpack(x.as_py()) for x in members.flatten().field("items")]
    sizes = np.array([x.size for x in sets])
    found = []
    for x, kx, sx, items in zip(c2.tolist(), k2.tolist(), s2, others.flatten().field("items")):
        own = np.array([find(v) for v in k.tolist()])
        may = np.flatnonzero((own != find(kx)) & (_agree(s, sx[None, :]) >= least_agree(percent)))
        if not may.size:
            continue
        items = _unpack(items.as_py())
        flat = np.concatenate([sets[m] for m in may])
        at = np.minimum(np.searchsorted(items, flat), items.size - 1)
        common = row_sums(items[at] == flat, np.concatenate([[0], np.cumsum(sizes[may])]))
        for m in may[100 * common >= percent * (sizes[may] + items.size - common)]:
            if find(int(k[m])) != find(kx):
                root[find(int(k[m]))] = find(kx)
                found.append((min(x, int(c[m])), max(x, int(c[m]))))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)
            keep = np.zeros(len(a), bool)
            for r, (x, y) in enumerate(zip(batch.column("items_a"), batch.column("items_b"))):
                x, y = _unpack(x.as_py()), _unpack(y.as_py())
                if 100 * min(x.size, y.size) >= percent * max(x.size, y.size):
                    common = np.intersect1d(x, y, assume_unique=True).size
                    keep[r] = 100 * common >= percent * (x.size + y.size - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _needed(bits: np.ndarray, log_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits, batch.column(0).to_numpy(zero_copy_only=False), log_bits)))

    return run


def _survives(threshold: float, levels: int) -> float:
    """Chance that a pair at the threshold still shares a node of one tree after some levels."""
    rate, alive = 1 / threshold, 1.0
    for _ in range(levels):
        q = 1 - threshold * alive
        p0, p1 = math.exp(-rate), rate * math.exp(-rate)
        alive = 1 - ((p0 + p1) * q + math.exp(rate * (q - 1)) - p0 - p1 * q)
    return alive


def trees_for(recall: float, threshold: float, levels: int = 1) -> int:
    """Independent trees after which a pair at the threshold has met, that many levels deep, with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - _survives(threshold, levels)))


def _links(rows: DataFrame, classes: DataFrame, ws: Workspace, percent: int, recall: float, block: int, work: int, depth: int) -> DataFrame | None:
    """Components ``(c, k)`` of the classes that have links; None if no pair has any."""
    threshold, least = percent / 100, least_agree(percent)
    share = 1 / (threshold * COORDS)
    trees = trees_for(recall, threshold, depth)
    sketches, signatures, items = rows.select("c", *_SKETCH), rows.select("c", "sig"), rows.select("c", "items")
    level = ws.write(signatures.mapInArrow(lean(_children(share, trees)), "node long, c long, tree int").join(classes, "c", "left_semi"))

    def nodes_of(first: int, size: int) -> DataFrame:
        return level.filter(F.col("tree").between(first, first + size - 1)).select("node", "c", F.lit(1).alias("level"))

    waiting = list(range(_EARLY, trees, _LATER))
    comp, known, wave = None, None, 0
    frontier = nodes_of(0, _EARLY)
    while frontier is not None:
        f = frontier.withColumn("k", F.col("c")) if comp is None else frontier.join(comp, "c", "left").withColumn("k", F.coalesce("k", "c"))
        sizes = f.groupBy("node").agg(F.count("*").alias("n"), F.min("k").alias("k0"), F.max("k").alias("k1")).filter("k0 < k1")
        live = ws.write(f.join(sizes.select("node", "n"), "node").join(sketches, "c"), small=True)
        nxt = nodes_of(0, _EARLY) if wave == 0 else None
        if wave == 0:
            links = _pivot_links(live, items, ws, percent)
        else:
            shares = live.filter(F.col("n") > block).groupBy("node", "k").agg(F.count("*").alias("m")).groupBy("node").agg(F.max(F.struct("m", "k")).alias("top"), F.sum("m").alias("all"))
            shares = shares.select("node", F.col("top.k").alias("main"), (F.col("all") - F.col("top.m")).alias("n_out"))
            settled = (F.col("level") >= depth) | (F.col("n") * F.col("n_out") <= work)
            big = ws.write(live.join(shares, "node").withColumn("settled", settled), small=True)
            lists = live.filter(F.col("n") <= block).groupBy("node").agg(F.collect_list(F.struct("c", "k", *_SKETCH)).alias("members"))
            near = lists.mapInArrow(lean(_similar_within(least)), "node long, c long")
            near = near.union(_blocks(big.filter("settled"), block, ["c", "k", *_SKETCH]).mapInArrow(lean(_similar_across(least)), "node long, c long"))
            near = ws.write(near.distinct().join(live.select("node", "c", "k", *_SKETCH), ["node", "c"]), small=True)
            sets = _needed_sets(near.select("c"), items)
            counts = near.groupBy("node", "k").agg(F.count("*").alias("m")).groupBy("node").agg(F.max(F.struct("m", "k")).alias("top"), F.sum("m").alias("n"))
            counts = counts.select("node", F.col("top.k").alias("main"), "n", (F.col("n") - F.col("top.m")).alias("n_out"))
            full = _blocks(near.join(counts, "node").join(sets, "c"), block, ["c", "k", *_SKETCH, "items"])
            links = full.mapInArrow(lean(_link_blocks(percent)), "a long, b long")
            if waiting:
                nxt = nodes_of(waiting.pop(0), _LATER)
            branch = big.filter("not settled")
            if not branch.isEmpty():
                links = links.union(_pivot_links(branch, items, ws, percent))
                children = branch.select("node", "c", "level").join(signatures, "c").mapInArrow(lean(_children(share, 0)), "node long, c long, level int")
                children = ws.write(children.select("node", "c", "level"))
                nxt = children if nxt is None else nxt.unionByName(children)
        links = ws.write(links.distinct(), small=True)
        edges = links if known is None else links.union(known.select("u", "v"))
        ws.drop(live)
        if wave > 0:
            ws.drop(big, near)
        ws.release()
        wave, frontier = wave + 1, nxt
        # What is linked stays linked by about one edge a class, so that later rounds do not meet all links again.
        before, known = known, contracted(edges, ws, rounds=2)
        ws.drop(links, before)
        # Labels that join most of what is linked so far; they only save comparisons.
        comp = labels(known, ws)
    ws.drop(level)
    return None if known.isEmpty() else components(known.select(F.col("u").alias("a"), F.col("v").alias("b")), ws)


def _needed_sets(classes: DataFrame, items: DataFrame) -> DataFrame:
    """The shingle sets of some classes; a bitmap of bounded size keeps the others out of the shuffle."""
    log_bits = bitmap_bits(4 * classes.count())
    return items.mapInArrow(lean(_needed(bitmap(classes, "c", log_bits), log_bits)), "c long, items binary")


def _pivot_links(rows: DataFrame, items: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """Links between each node's pivot, the class first in a fixed random order, and the other members."""
    own = ["c", "k", *_SKETCH]
    pivots = rows.groupBy("node").agg(F.min(F.struct(F.xxhash64("c").alias("o"), *(F.col(x).alias(f"p_{x}") for x in own))).alias("p")).select("node", "p.*")
    off = F.lit(0)
    for x in _SKETCH:
        d = F.col(x).bitwiseXOR(F.col(f"p_{x}"))
        off = off + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    near = rows.join(pivots, "node").filter((F.col("k") != F.col("p_k")) & (off <= COORDS - least_agree(percent)))
    pairs = ws.write(near.select(F.least("c", "p_c").alias("a"), F.greatest("c", "p_c").alias("b")).distinct(), small=True)
    sets = _needed_sets(pairs.select(F.explode(F.array("a", "b")).alias("c")), items)
    full = pairs.join(sets.select(F.col("c").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("c").alias("b"), F.col("items").alias("items_b")), "b")
    return full.mapInArrow(lean(_verify(percent)), "a long, b long")


def _blocks(rows: DataFrame, block: int, columns: list[str]) -> DataFrame:
    """Each node's members in blocks of about ``block``, beside each block of its members outside the largest component.

    Both sides are dealt over a grid: a task joins ``_GRID`` blocks of each side, however crowded a node is.
    """
    member = F.struct(*columns)
    blocks = {x: F.ceil(F.col(x) / block) for x in ("n", "n_out")}
    own = {x: F.pmod(F.xxhash64("c"), b).alias("i") for x, b in blocks.items()}
    grid = {x: F.ceil(b / _GRID) for x, b in blocks.items()}
    members = rows.groupBy("node", "n", "n_out", own["n"]).agg(F.collect_list(member).alias("members"))
    members = members.select("node", F.pmod("i", grid["n"]).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), grid["n_out"] - 1)).alias("y"), "members")
    outside = rows.filter("k <> main").groupBy("node", "n", "n_out", own["n_out"]).agg(F.collect_list(member).alias("others"))
    outside = outside.select("node", F.explode(F.sequence(F.lit(0).cast("long"), grid["n"] - 1)).alias("x"), F.pmod("i", grid["n_out"]).alias("y"), "others")
    return members.join(outside, ["node", "x", "y"]).drop("x", "y")


def near_duplicates(docs: DataFrame, *, percent: int = 75, recall: float = 0.9999, block: int = 128, work: int = 1 << 24, depth: int = 8) -> DataFrame:
    """Groups of near-duplicate documents.

    Args:
        docs: a frame with ``doc_id`` and ``text``; other columns are ignored.
        percent: documents are linked if 100 * intersection >= percent * union of their sets, 30 at least.
        recall: least probability with which a pair exactly at the threshold meets in some node, in
            crowded nodes of ``depth`` levels too; it gives the number of trees.
        block: members that are compared at once.
        work: a node with more pairs to settle than this branches, and is settled ``depth`` levels
            down at the latest; all nodes together still hold every pair with probability ``recall``.

    Of pairs exactly at the threshold, one in 10^5 is lost by the sketches.

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest
    doc_id reachable over links, itself included), ``kept`` (doc_id = component_id) and ``group``
    (a number that all rows of a component share). Words are lower-cased A-Z runs outside
    ``[\\x20\\x09-\\x0D]``; a text of one to four words has its whole sequence as its only shingle.
    Null, empty and blank texts have an empty set and link with nothing; their ``group`` is null.
    Repeated rows are equal sets and so one component. A null doc_id takes part, but never names a
    component: component_id is null and kept false where no row of the component has an id.
    """
    return _grouped(docs, percent, recall, block, work, depth).drop("text_hash")


def _grouped(docs: DataFrame, percent: int = 75, recall: float = 0.9999, block: int = 128, work: int = 1 << 24, depth: int = 8) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text."""
    if not 30 <= percent <= 100:
        raise ValueError("percent must lie between 30 and 100")
    ws = Workspace(docs.sparkSession, "near-dup")
    schema = "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, s0 long, s1 long, s2 long, s3 long, sig binary, items binary"
    feats = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(lean(_features), schema)
    feats = ws.write(feats.withColumn("rid", F.monotonically_increasing_id()))
    some = feats.filter("n_shingles > 0")
    key = ["n_shingles", "f1", "f2"]
    classes = ws.write(some.groupBy(*key).agg(F.min("rid").alias("c"), F.min("doc_id").alias("first_id")), small=True)
    comp = _links(some.withColumnRenamed("rid", "c"), classes.select("c"), ws, percent, recall, block, work, depth)
    if comp is None:
        named = classes.select(*key, F.col("c").alias("group"), F.col("first_id").alias("component_id"))
    else:
        k = classes.join(comp, "c", "left").withColumn("k", F.coalesce("k", "c"))
        names = k.groupBy("k").agg(F.min("first_id").alias("component_id"))
        named = k.join(names, "k").select(*key, F.col("k").alias("group"), "component_id")
    rows = feats.select("doc_id", "text_hash", *key)
    out = rows.join(named, key, "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return ws.keep(out.select("doc_id", "text_hash", "n_shingles", "component_id", kept, "group"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all its columns.

    Of several rows of a group with its smallest doc_id one stays; rows of other groups stay, also
    if they repeat a doc_id. Rows without an id, and those without a word, all stay. A row is known
    by a 64-bit hash of its id and text.
    """
    rows = _grouped(docs, **options).filter("doc_id is not null and group is not null")
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text_hash"))
    heads = rows.filter("kept").groupBy("group").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = rows.filter("kept").select("group", "key").distinct().join(heads, "group")
    gone = rows.filter("not kept").select("key").union(same.filter("key <> first").select("key")).distinct()
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    return without(docs, gone, own, same.filter("key = first").select("key"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir)).drop("group")


#: The same groups by an inverted index of all shingles and reachability.
OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
