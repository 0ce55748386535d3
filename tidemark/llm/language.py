"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of the labelled texts into ``buckets`` hash buckets by language;
each task adds up its own counts, Spark sums them. The matrix of log-probabilities has languages
times buckets cells and is broadcast; texts are scored in numpy, half a megabyte at a time. More
languages than ``max_cells`` allows are blocks of languages with a matrix each: a text's blocks meet
in the largest log-probability and the sum of all, so that no bucket is given up for a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read_documents
from .text import CHUNK_BYTES, chunks

LENGTHS = (1, 2, 3)
#: Languages whose names are collected; more are refused.
MAX_LANGUAGES = 1 << 14
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_tables: dict[str, np.ndarray] = {}


def _folded() -> np.ndarray:
    """Lower-cased code point of every letter; a space for everything else."""
    if "fold" not in _tables:
        fold = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _tables["fold"] = fold
    return _tables["fold"]


def _letters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of consecutive rows and their offsets."""
    lead = np.zeros(buf.size + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    text = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return _folded()[text], lead[offs]


def _grams(letters: np.ndarray, offs: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each code point, and whether it lies in one row and has a letter."""
    size = max(letters.size - n + 1, 0)
    h = np.full(size, np.uint32(n * 0x1B873593 & 0xFFFFFFFF))
    some = np.zeros(size, bool)
    for i in range(n):
        x = letters[i : i + size]
        h += x * _MULT[i]
        h ^= h >> np.uint32(15)
        some |= x != 32
    h *= np.uint32(0x2C1B3C6D)
    last = np.repeat(offs[1:], np.diff(offs))[:size]
    return (h >> np.uint32(32 - bits)).astype(np.int64), some & (np.arange(n, size + n) <= last)


def _count(langs: list[str], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {x: i for i, x in enumerate(langs)}
        total = np.zeros(len(langs) << bits, np.int64)
        for batch in batches:
            known = np.array([code[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi, buf, offs in chunks(batch.column(0)):
                letters, at = _letters(buf, offs)
                lang = np.repeat(known[lo:hi] << bits, np.diff(at))
                for n in LENGTHS:
                    g, good = _grams(letters, at, n, bits)
                    total += np.bincount((lang[: g.size] + g)[good], minlength=total.size)
        cells = np.flatnonzero(total)
        for lo in range(0, cells.size, 1 << 16):
            c = cells[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(total[c])], names=["cell", "n"])

    return run


def _score(model, langs: list[str], bits: int, first: int):
    """Best language of each text with its log-probability, and the log of the sum over the languages; keys stand before the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, prior = model.value
        for batch in batches:
            keys = batch.schema.names[:-1]
            for lo, hi, buf, offs in chunks(batch.column(len(keys)), max(1 << 15, min(CHUNK_BYTES, (1 << 23) // len(langs)))):
                letters, at = _letters(buf, offs)
                n_rows = hi - lo
                scores = np.tile(prior, (n_rows, 1))
                row = np.repeat(np.arange(n_rows), np.diff(at))
                has = np.bincount(row[letters != 32], minlength=n_rows) > 0
                filled = np.flatnonzero(np.diff(at) > 0)
                for n in LENGTHS:
                    g, good = _grams(letters, at, n, bits)
                    g[~good] = weights.shape[0] - 1
                    g = np.concatenate([g, np.full(letters.size - g.size, weights.shape[0] - 1)])
                    if filled.size:
                        scores[filled] += np.add.reduceat(weights[g], at[:-1][filled], axis=0)
                best = scores.argmax(axis=1)
                top = scores[np.arange(n_rows), best]
                total = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
                out = [*(batch.column(i).slice(lo, n_rows) for i in range(len(keys))), pa.array(has), pa.array(np.array(langs, object)[best], pa.string()), pa.array(best + first), pa.array(top), pa.array(total)]
                yield pa.RecordBatch.from_arrays(out, names=[*keys, "has", "best", "place", "top", "total"])

    return run


_SCORED = "has boolean, best string, place long, top double, total double"


def identify_language(docs: DataFrame, held_out: Column, *, buckets: int = 1 << 16, smoothing: float = 0.5, max_cells: int = 1 << 22) -> DataFrame:
    """Predicted language of every whole text, learned from the rows that are not held out.

    Args:
        docs: a frame with ``doc_id``, ``text`` and ``lang``; a prediction uses the text alone.
        held_out: rows that teach nothing.
        buckets: hash buckets of n-grams, a power of two, whatever the number of languages.
        smoothing: added to every bucket's count.
        max_cells: languages times buckets of a matrix, which is broadcast (16 MB at the default) and
            collected once. More languages (over 64 at the defaults) are several matrices, each of
            which is one more pass over the texts. More than ``MAX_LANGUAGES`` are refused.

    One row per input row: ``doc_id``, ``held_out``, ``lang_pred`` (a learned value of lang; ``und`` for a null
    text or one without a letter), ``score`` (the posterior probability; 0 for ``und``). Rows with
    a null lang or text teach nothing, repeated rows teach as often as they occur. Without any
    labelled row all predictions are ``und``. Of equally probable languages the first by name is told.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text", "lang")
    train = docs.filter("not held_out and lang is not null and text is not null").select("text", "lang")
    seen = train.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not seen:
        return docs.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    langs = [r["lang"] for r in seen]
    bits = int(np.log2(buckets))
    size = max(max_cells >> bits, 1)
    blocks = [langs[i : i + size] for i in range(0, len(langs), size)]
    prior = np.log(np.array([r["count"] for r in seen], float) / sum(r["count"] for r in seen))

    def scorer(i: int, centre: np.ndarray | None):
        """The scoring of one block; log-probabilities are taken from a bucket's centre, the same for all languages, as single numbers are short."""
        own = blocks[i]
        some = train if len(blocks) == 1 else train.filter(F.col("lang").between(own[0], own[-1]))
        cells = some.mapInArrow(_count(own, bits), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(len(own) << bits)
        counts[cells["cell"]] = cells["n"]
        counts = counts.reshape(len(own), -1)
        logp = np.log((counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True))
        centre = logp.mean(axis=0) if centre is None else centre
        weights = np.zeros(((1 << bits) + 1, len(own)), np.float32)
        weights[:-1] = (logp - centre).T
        model = spark.sparkContext.broadcast((weights, prior[i * size : i * size + len(own)]))
        return _score(model, own, bits, i * size), centre

    share = F.when(F.col("has"), F.exp(F.col("top") - F.col("total"))).otherwise(0.0).alias("score")
    told = F.when(F.col("has"), F.col("best")).otherwise("und").alias("lang_pred")
    score, centre = scorer(0, None)
    if len(blocks) == 1:
        one = docs.select("doc_id", "held_out", "text").mapInArrow(score, f"doc_id long, held_out boolean, {_SCORED}")
        return one.select("doc_id", "held_out", told, share)
    rows = Workspace(spark, "language").write(docs.select("doc_id", "held_out", "text").withColumn("row", F.monotonically_increasing_id()))
    parts = rows.select("row", "text").mapInArrow(score, f"row long, {_SCORED}")
    for i in range(1, len(blocks)):
        parts = parts.unionByName(rows.select("row", "text").mapInArrow(scorer(i, centre)[0], f"row long, {_SCORED}"))
    # A few numbers a row and block meet: the best of all, and the sum of all about it.
    met = parts.groupBy("row").agg(F.bool_or("has").alias("has"), F.max_by("best", F.struct("top", -F.col("place"))).alias("best"), F.max("top").alias("top"), F.collect_list("total").alias("all"))
    around = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    met = met.withColumn("total", F.col("top") + F.log(around))
    return rows.select("row", "doc_id", "held_out").join(met, "row").select("doc_id", "held_out", told, share)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return identify_language(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
