"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size: class ``s`` holds the items of ``2**s`` to ``2**(s+1) - 1``
shingles. For each class that occurs, documents are cut into windows of four times its least
size, each beginning half a window after the one before, so that every item lies whole in a
window whose Jaccard similarity to it is at least about a fifth, however long the document is.
Item and window then have each of ``COORDS`` minwise values in common with that probability; a
common value makes the pair a candidate, and candidates are verified by exact containment of the
item's shingles in the whole document.

The documents are read once. Tasks hold two bitmaps of bounded size, of the items' minwise values
and of their shingles; only rows that hit the first leave the task, with the few shingles that hit
the second, and meet the items in shuffle joins that confirm both exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bitmap, bitmap_bits, in_bitmap, lean, read_documents, without
from .text import chunks, distinct_sorted, mix64, row_minima, shingles, stream64, words

COORDS = 48
_U = np.uint64
_TOP = np.uint32(0xFFFFFFFF)


def _mult() -> np.ndarray:
    return (stream64(7, COORDS) >> _U(32)).astype(np.uint32) | np.uint32(1)


def _keys(size_class: int, coord: int, value: np.ndarray) -> np.ndarray:
    return mix64(value.astype(np.uint64) + _U((size_class * COORDS + coord) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every item's distinct shingles, size class and minwise keys."""
    mult = _mult()
    for batch in batches:
        for lo, hi, buf, offs in chunks(batch.column(1)):
            w = words(buf, offs)
            u, uo = distinct_sorted(*shingles(w.hashes(), w.offs))
            sizes = np.diff(uo)
            h = (u >> _U(32)).astype(np.uint32)
            keys = np.zeros((hi - lo, COORDS), np.uint64)
            for j in range(COORDS):
                low = row_minima(h * mult[j], uo)
                for s in np.unique(sizes[sizes > 0]):
                    at = sizes == s
                    keys[at, j] = _keys(int(s).bit_length() - 1, j, low[at])
            some = np.flatnonzero(sizes > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)), pa.array(u.view(np.int64)))
            keyed = pa.ListArray.from_arrays(pa.array((np.arange(some.size + 1) * COORDS).astype(np.int32)), pa.array(keys[some].ravel().view(np.int64)))
            classes = pa.array([int(s).bit_length() - 1 for s in sizes[some]], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(some)), classes, lists, keyed], names=["item_id", "size_class", "shingles", "keys"])


def _windows(offs: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of each row's windows of two steps, and their rows."""
    have = np.diff(offs)
    n = np.where(have > 0, np.maximum(-(-have // step) - 1, 1), 0)
    row = np.repeat(np.arange(have.size), n)
    first = offs[:-1][row] + (np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)) * step
    return first, np.minimum(first + 2 * step, offs[1:][row]), row


def _search(classes: list[int], key_bits: np.ndarray, key_log: int, set_bits: np.ndarray, set_log: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = _mult()
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column(1)):
                w = words(buf, offs)
                s, so = shingles(w.hashes(), w.offs)
                h = (s >> _U(32)).astype(np.uint32)
                found_row, found_key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                least = 1 << (classes[0] + 1)
                # Blocks of one step of the least class; rows start new blocks.
                blocks = -(-np.diff(so) // least)
                block_offs = np.concatenate([[0], np.cumsum(blocks)])
                row = np.repeat(np.arange(hi - lo), blocks)
                starts = so[:-1][row] + (np.arange(row.size) - block_offs[row]) * least
                spans = [(c, *_windows(block_offs, 1 << (c - classes[0]))) for c in classes]
                for j in range(COORDS if starts.size else 0):
                    low = np.minimum.reduceat(h * mult[j], starts)
                    for c, first, end, of in spans:
                        step = 1 << (c - classes[0])
                        half = low
                        if step > 1:
                            size = -(-np.diff(block_offs) // step)
                            at = np.concatenate([[0], np.cumsum(size)])
                            r = np.repeat(np.arange(hi - lo), size)
                            half = np.minimum.reduceat(low, block_offs[r] + (np.arange(r.size) - at[r]) * step)
                            n = np.where(size > 0, np.maximum(size - 1, 1), 0)
                            a = np.repeat(at[:-1], n) + np.arange(of.size) - np.repeat(np.cumsum(n) - n, n)
                            top = at[1:][of]
                        else:
                            a, top = first, end
                            top = np.minimum(top, block_offs[1:][of])
                        value = half[a]
                        two = a + 1 < top
                        value[two] = np.minimum(value[two], half[a[two] + 1])
                        key = _keys(c, j, value)
                        hit = np.flatnonzero(in_bitmap(key_bits, key, key_log))
                        found_row.append(of[hit])
                        found_key.append(key[hit])
                rows, keys = np.concatenate(found_row), np.concatenate(found_key)
                if not rows.size:
                    continue
                order = np.lexsort((keys, rows))
                rows, keys = rows[order], keys[order]
                hits = np.unique(rows)
                ks = [np.unique(keys[a:b]) for a, b in zip(np.searchsorted(rows, hits), np.searchsorted(rows, hits, side="right"))]
                ss = [np.unique(x[in_bitmap(set_bits, x, set_log)]) for x in (s[so[r] : so[r + 1]] for r in hits)]
                both = np.array([x.size > 0 for x in ss])
                if not both.any():
                    continue
                hits, ks, ss = hits[both], [k for k, b in zip(ks, both) if b], [x for x, b in zip(ss, both) if b]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(hits)), _lists(ks), _lists(ss)], names=["doc_id", "keys", "shingles"])

    return run


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([p.size for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(parts).view(np.int64)))


def contained_items(docs: DataFrame, items: DataFrame, *, percent: int = 75) -> DataFrame:
    """Pairs of a document and a test item whose shingles it holds.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns are
    ignored. One row per pair with 100 * shared >= ``percent`` * the item's distinct five-word
    shingles: ``doc_id``, ``item_id``, ``n_shared``, ``n_item``, ``containment``. Words are
    lower-cased A-Z. An item of one to four words is its whole sequence and is found only in a
    document that consists of it. Items and documents that are null, empty or blank have no
    shingles and no pairs. Repeated ids count as one document or item whose shingles are those of
    the row that holds most of the item; rows with a null id give no pairs.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "decontaminate")
    schema = "item_id long, size_class int, shingles array<long>, keys array<long>"
    marked = ws.write(items.filter("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(lean(_item_keys), schema).withColumn("item", F.monotonically_increasing_id()))
    classes = sorted(r[0] for r in marked.select("size_class").distinct().collect())
    pair = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    if not classes:
        return spark.createDataFrame([], pair)
    keys = marked.select("item", F.explode("keys").alias("key"))
    parts = marked.select("item", F.explode("shingles").alias("shingle"))
    sizes = marked.agg(F.count("*"), F.sum(F.size("shingles"))).first()
    key_log, set_log = bitmap_bits(256 * sizes[0] * COORDS, most=27), bitmap_bits(64 * sizes[1], most=27)
    search = _search(classes, bitmap(keys, "key", key_log), key_log, bitmap(parts, "shingle", set_log), set_log)
    hits = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(search), "doc_id long, keys array<long>, shingles array<long>")
    hits = ws.write(hits.withColumn("row", F.monotonically_increasing_id()))
    candidates = hits.select("row", F.explode("keys").alias("key")).join(keys, "key").select("row", "item").distinct()
    # Only candidates are compared, shingles against shingles: one that many items share multiplies nothing.
    items_of = marked.select("item", "item_id", F.col("shingles").alias("asked"), F.size("shingles").cast("long").alias("n_item"))
    found = candidates.join(items_of, "item").join(hits.select("row", "doc_id", "shingles"), "row")
    found = found.withColumn("n_shared", F.size(F.array_intersect("shingles", "asked")).cast("long")).drop("shingles", "asked")
    found = found.filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_item", F.col("b.c").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item; rows without a doc_id stay."""
    return without(docs, contained_items(docs, items, **options).select(F.col("doc_id").alias("key")).distinct(), F.col("doc_id"))


def op1_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same pairs by plain set containment over all documents.
OP1_SQL = """
WITH w AS (
  SELECT doc_id AS id, 0 AS kind, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT item_id, 1, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT id, kind, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n.n_item) AS n_item, count(*) / any_value(n.n_item)::DOUBLE AS containment
FROM s d JOIN s i ON d.sh = i.sh AND d.kind = 0 AND i.kind = 1 JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= 75 * any_value(n.n_item)
"""
