"""Phrase collocations by SON partitioning.

A phrase that a language has ``support`` times has, in at least one shard, its support times the
shard's share of the language's words, rounded up: were it rarer in every shard, the sum would be
too small. So each shard is mined completely at that lowered support, and what is frequent in some
shard is a candidate. Shards that do not report a candidate hold it less often than their local
support, which bounds its total from above; candidates that cannot reach the support go, the
others are counted exactly in all shards.

A shard is a run of whole texts of about ``BLOCK`` words, mined in numpy level by level: a phrase of
k words can only be frequent where its first and its last k - 1 words are. Candidates are 64-bit
hashes. Tasks know them by a bitmap of bounded size, whose false hits cost a count that the support
then drops; counts meet by hash in a shuffle. The phrases' words travel only for phrases that reach
the support, from the shard that has most of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, bitmap, bitmap_bits, in_bitmap, lean, read_documents, trim
from .text import LOWER, chunks, mix64, words

#: Bytes that end a piece, and those between words.
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
BREAKS = ENDS.copy()
BREAKS[[0x20, 0x09]] = True

#: Words of a shard; a task's last shard has half to one and a half times as many, if the task has.
#: Mining takes some sixteen bytes a word. Larger shards have a larger local support and fewer candidates.
BLOCK = 13 << 20
MOST_WORDS = 5
#: Places looked at together.
SLICE = 1 << 18
#: Classes of keys that are sorted one after the other.
CLASSES = 16
#: Makes one number of a key and a count.
_MARK = 0x9E3779B1
#: Languages whose totals are broadcast; more of them meet the texts in a shuffle.
BROADCAST_LANGS = 10_000
#: First ranking of a language's phrases: so many parts, whose best meet in the second.
RANK_PARTS = 64

_U = np.uint64
_JOIN = _U(0xC2B2AE3D27D4EB4F)


class _Shard:
    """Words of whole texts by their number among the shard's distinct words; words left in the piece, and language."""

    def __init__(self, vocabulary, ids, left, lang, salts, totals, texts):
        self.vocabulary, self.ids, self.left, self.lang, self.salts, self.totals, self.texts = vocabulary, ids, left, lang, salts, totals, texts

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the phrases of k words at some places, with their language's salt."""
        h = self.vocabulary[self.ids[at]]
        for j in range(1, k):
            h *= _JOIN
            h += self.vocabulary[self.ids[at + j]]
        h += _U(k)
        h ^= self.salts.view(_U)[self.lang[at]]
        return mix64(h)

    def needs(self, support: int) -> np.ndarray:
        """Each language's local support: the share of the support that its words of the shard are of all, rounded up."""
        have = np.bincount(self.lang, minlength=self.salts.size)
        return np.array([max(-(-support * int(w) // max(int(t), 1)), 1) for w, t in zip(have, self.totals)], np.int64)

    def spell(self, at: np.ndarray, k: int) -> list[str]:
        """The phrases at ascending places, words lower-cased and joined by a space."""
        out: list[str] = []
        first = np.cumsum([0] + [t[0] for t in self.texts])
        for i in np.unique(np.searchsorted(first, at, side="right") - 1):
            _, size, packed, offs = self.texts[i]
            buf = np.frombuffer(pa.decompress(packed, size, "lz4"), np.uint8)
            w = words(buf, offs, BREAKS)
            data = LOWER[buf].tobytes()
            mine = at[np.searchsorted(at, first[i]) : np.searchsorted(at, first[i + 1])] - first[i]
            out += [b" ".join(data[a:b].split()).decode("utf-8", "replace") for a, b in zip(w.starts[mine].tolist(), w.ends[mine + k - 1].tolist())]
        return out


class _Words:
    """Chunks of texts until they make a shard."""

    def __init__(self, spelt: bool):
        self.spelt, self.parts, self.n = spelt, [], 0

    def add(self, buf: np.ndarray, offs: np.ndarray, salts: np.ndarray, totals: np.ndarray) -> None:
        w = words(buf, offs, BREAKS)
        n = w.starts.size
        if not n:
            return
        ends = np.zeros(buf.size + 1, np.int32)
        np.cumsum(ENDS[buf], out=ends[1:])
        last = np.ones(n, bool)  # of its piece
        last[:-1] = ends[w.starts[1:]] > ends[w.ends[:-1]]
        last[w.offs[1:][w.offs[1:] > 0] - 1] = True
        left = np.ones(n, np.int8)
        for k in range(2, MOST_WORDS + 1):
            left[: max(n - k + 1, 0)][~_any(last, k - 1)[: max(n - k + 1, 0)]] = k
        distinct, ids = np.unique(w.hashes(), return_inverse=True)
        self.parts.append((distinct, ids.astype(np.uint16 if distinct.size <= 1 << 16 else np.int32), left, w.counts, salts, totals, (n, buf.size, pa.compress(buf, "lz4"), offs) if self.spelt else None))
        self.n += n

    def take(self, least: int) -> _Shard | None:
        """A shard of whole chunks with at least ``least`` words; what remains stays."""
        n, many = 0, 0
        while many < len(self.parts) and n < least:
            n += self.parts[many][1].size
            many += 1
        if not n:
            return None
        columns = [list(c) for c in zip(*self.parts[:many])]
        del self.parts[:many]
        self.n -= n
        vocabulary = np.unique(np.concatenate(columns[0]))
        ids = np.empty(n, np.int32)
        at = 0
        for distinct in columns[0]:
            own = columns[1].pop(0)
            ids[at : at + own.size] = np.searchsorted(vocabulary, distinct).astype(np.int32)[own]
            at += own.size
        left = np.concatenate(columns[2])
        columns[0] = columns[2] = None
        salts, first, lang = np.unique(np.concatenate(columns[4]), return_index=True, return_inverse=True)
        lang = lang.astype(np.uint8 if salts.size <= 256 else np.int32)
        trim()  # what the chunks took, before mining takes as much again
        return _Shard(vocabulary, ids, left, np.repeat(lang, np.concatenate(columns[3])), salts, np.concatenate(columns[5])[first], columns[6])


def _any(flags: np.ndarray, k: int) -> np.ndarray:
    """Whether any of k flags from here on is set (those past the end are not)."""
    out = flags.copy()
    for i in range(1, k):
        out[:-i] |= flags[i:]
    return out


def _places(mask: np.ndarray) -> Iterator[np.ndarray]:
    """The marked places, a slice after the other."""
    for lo in range(0, mask.size, SLICE):
        at = np.flatnonzero(mask[lo : lo + SLICE])
        if at.size:
            yield at + lo


def _levels(shard: _Shard, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, keys, counts, first places) of the kept phrases of k words, level by level.

    ``keep(key_of, mask)`` returns the distinct kept keys of the phrases at the marked places, as
    (keys, counts, first places, mask of the kept places); ``key_of`` gives the keys of some places.
    """
    mask = np.ones(shard.ids.size, bool)
    for k in range(1, MOST_WORDS + 1):
        if k > 1:
            mask[:-1] &= mask[1:]
            mask &= shard.left >= k
        keys, counts, first, mask = keep(lambda at, k=k: shard.keys(at, k), mask)
        trim()
        if not keys.size:
            return
        yield k, keys, counts, first


def _frequent(need: np.ndarray, lang: np.ndarray):
    """Keeps phrases with their language's local support; keys are made and sorted one class at a time."""

    def keep(key_of, mask: np.ndarray):
        out, kept = [], np.zeros(mask.size, bool)
        for c in range(CLASSES):
            keys, places = [np.zeros(0, _U)], [np.zeros(0, np.int32)]
            for at in _places(mask):
                key = key_of(at)
                mine = (key >> _U(32)) % _U(CLASSES) == c
                keys.append(key[mine])
                places.append(at[mine].astype(np.int32 if mask.size < 1 << 31 else np.int64))
            own, mine = np.concatenate(keys), np.concatenate(places)
            del keys, places
            order = np.argsort(own)
            own, mine = own[order], mine[order]
            del order
            starts = np.flatnonzero(np.concatenate([np.ones(min(own.size, 1), bool), own[1:] != own[:-1]]))
            counts = np.diff(np.concatenate([starts, [own.size]]))
            good = counts >= need[lang[mine[starts]]]
            kept[mine[np.repeat(good, counts)]] = True
            out.append((own[starts[good]], counts[good], mine[starts[good]]))
        return *(np.concatenate(x) for x in zip(*out)), kept

    return keep


def _summed(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """Keys, counts and first places of all parts as one part."""
    keys, first, at = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    counts = np.zeros(keys.size, np.int64)
    np.add.at(counts, at, np.concatenate([p[1] for p in parts]))
    return [(keys, counts, np.concatenate([p[2] for p in parts])[first])]


def _hits(bits: np.ndarray, log_bits: int):
    """Keeps phrases whose bit is set; counted slice by slice, so that memory follows the distinct ones."""

    def keep(key_of, mask: np.ndarray):
        parts, held, kept = [(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, np.zeros(mask.size, bool)
        for at in _places(mask):
            key = key_of(at)
            hit = in_bitmap(bits, key, log_bits)
            at = at[hit]
            kept[at] = True
            keys, first, counts = np.unique(key[hit], return_index=True, return_counts=True)
            parts.append((keys, counts, at[first]))
            held += keys.size
            if held > 2 * parts[0][0].size + 4 * SLICE:
                parts, held = _summed(parts), 0
        return *_summed(parts)[0], kept

    return keep


def _shards(spelt: bool, block: int, use):
    """``use(shard)`` of one shard after the other; rows are (salt of the language, words of it, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Words(spelt)
        for batch in batches:
            salts, totals = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, buf, offs in chunks(batch.column(2)):
                shard.add(buf, offs, salts[lo:hi], totals[lo:hi])
                while shard.n >= block + block // 2:
                    yield from use(shard.take(block))
        rest = shard.take(max(shard.n, 1))
        if rest is not None:
            yield from use(rest)

    return run


def _mine(support: int, block: int):
    """Keys with their counts, local supports and salts; and for each language of a shard, without a key, its local support less one."""

    def use(shard: _Shard) -> Iterator[pa.RecordBatch]:
        names = ["key", "n", "need", "salt"]
        need = shard.needs(support)
        none = pa.nulls(need.size, pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(need - 1), none, pa.array(shard.salts)], names=names)
        for _, keys, counts, first in _levels(shard, _frequent(need, shard.lang)):
            lang = shard.lang[first]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(need[lang]), pa.array(shard.salts[lang])], names=names)

    return _shards(False, block, use)


def _count(bits: np.ndarray, log_bits: int, block: int):
    def use(shard: _Shard) -> Iterator[pa.RecordBatch]:
        for _, keys, counts, _ in _levels(shard, _hits(bits, log_bits)):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "n"])

    return _shards(False, block, use)


def _spell(bits: np.ndarray, log_bits: int, marks: np.ndarray | None, log_marks: int, block: int):
    """Words of phrases whose bit is set, from the shards whose count of them is marked, or from all without ``marks``."""

    def use(shard: _Shard) -> Iterator[pa.RecordBatch]:
        for k, keys, counts, first in _levels(shard, _hits(bits, log_bits)):
            own = keys.view(np.int64)
            hit = np.arange(keys.size) if marks is None else np.flatnonzero(in_bitmap(marks, (own ^ (counts * _MARK)).view(_U), log_marks))
            hit = hit[np.argsort(first[hit])]
            at = first[hit]
            salts = shard.salts[shard.lang[at]]
            yield pa.RecordBatch.from_arrays([pa.array(own[hit]), pa.array(salts), pa.array(np.full(at.size, k, np.int32)), pa.array(shard.spell(at, k), pa.string())], names=["key", "salt", "k", "phrase"])

    return _shards(True, block, use)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words(buf, offs, BREAKS).counts)], names=["lang", "n"])


def frequent_phrases(docs: DataFrame, *, support: int = 100, block: int = BLOCK) -> DataFrame:
    """All phrases of one to five words that their language has at least ``support`` times.

    Returns ``lang``, ``phrase`` (words joined by a space), ``k`` (words), ``a`` (occurrences,
    overlaps included, none across the end of a piece) and ``n`` (all words of the language).
    ``docs`` has ``text`` and ``lang``; other columns are ignored. Letters A-Z are lower-cased; a null
    language is ``und``, a null text empty. Repeated rows count as often as they occur.

    The local support of a shard is ``support`` times its share: where a language has more than
    ``support`` shards it is 1, and every phrase of a shard is a candidate. The counts stay exact,
    but nothing is saved then; a support that grows with the corpus keeps the candidates few.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "phrases")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(lean(_word_counts), "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    totals = ws.write(counted.withColumn("salt", F.xxhash64("lang")), small=True)
    langs, total = totals.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = langs <= BROADCAST_LANGS
    rows = rows.join(F.broadcast(totals) if few else totals, "lang").select("salt", "n", "text")
    # Shards are neither tiny nor more than tasks or memory ask for.
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-total // block)))
    mined = ws.write(rows.mapInArrow(lean(_mine(support, block)), "key long, n long, need long, salt long"))
    # What shards that do not report a phrase can hold of it: all local supports less one, but those of the reporting shards.
    slack = mined.filter("key is null").groupBy("salt").agg(F.sum("n").alias("slack"))
    told = mined.filter("key is not null").groupBy("key").agg(F.sum("n").alias("s"), F.max("n").alias("most"), F.sum(F.col("need") - 1).alias("r"), F.min("salt").alias("salt"))
    possible = told.join(F.broadcast(slack) if few else slack, "salt").filter(F.col("s") + F.col("slack") - F.col("r") >= support)
    candidates = ws.write(possible.select("key", "most"))
    ws.drop(mined)
    log_bits = bitmap_bits(candidates.count())
    counting = rows.mapInArrow(lean(_count(bitmap(candidates, "key", log_bits), log_bits, block)), "key long, n long")
    counts = ws.write(counting.groupBy("key").agg(F.sum("n").alias("a")).filter(F.col("a") >= support).join(candidates, "key"))
    ws.drop(candidates)

    log_bits = bitmap_bits(counts.count())
    frequent = bitmap(counts, "key", log_bits)

    def spelt(keys: DataFrame, most: bool) -> DataFrame:
        mark = F.col("key").bitwiseXOR(F.col("most") * F.lit(_MARK).cast("long"))
        marks = bitmap(keys.select(mark.alias("key")), "key", log_bits) if most else None
        spelling = rows.mapInArrow(lean(_spell(frequent, log_bits, marks, log_bits, block)), "key long, salt long, k int, phrase string")
        one = spelling.groupBy("key").agg(F.min(F.struct("phrase", "k", "salt")).alias("p"))
        return ws.write(keys.join(one, "key").select("key", "p.*", "a"))

    found = spelt(counts, True)
    # A task that came out with other shards than when it mined may have missed some.
    left = counts.join(found, "key", "left_anti")
    if not left.isEmpty():
        found = found.unionByName(spelt(left, False))
    named = found.join(F.broadcast(totals) if few else totals, "salt")
    return ws.write(named.select("lang", "phrase", F.col("k").cast("long"), "a", "n"))


def collocations(docs: DataFrame, *, support: int = 100, top: int = 2000, block: int = BLOCK) -> DataFrame:
    """Each language's ``top`` phrases of two to five words by collocation score.

    Returns ``lang``, ``rank`` (from 1), ``phrase``, ``a`` (occurrences), ``l``, ``r`` (those of the
    parts before and after the lowest-scoring cut, the earliest of equal ones), ``n`` (words of the
    language) and ``score``: floor(1000 a n / (l r)), exact. Phrases within a longer one that occurs
    as often are dropped. Order: score, then a, descending, then phrase in UTF-8 order.

    Null texts are empty, a null lang is ``und``; texts without a phrase of ``support`` occurrences,
    and empty tables, give no rows. Repeated rows count as often as they occur.
    """
    spark = docs.sparkSession
    found = frequent_phrases(docs, support=support, block=block)
    longer = found.filter("k >= 2").withColumn("w", F.split("phrase", " "))
    k = F.col("k").cast("int")
    # A phrase inside a longer one of the same count is inside one that is a single word longer, too.
    inner = [F.array_join(F.slice("w", s, k - 1), " ") for s in (1, 2)]
    covered = longer.filter("k >= 3").select("lang", "a", F.explode(F.array(*inner)).alias("phrase")).distinct()
    cuts = longer.join(covered, ["lang", "phrase", "a"], "left_anti").withColumn("cut", F.explode(F.sequence(F.lit(1), k - 1)))
    cuts = cuts.withColumns({"first": F.array_join(F.slice("w", F.lit(1), F.col("cut")), " "), "rest": F.array_join(F.slice("w", F.col("cut") + 1, k), " ")})
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(part), F.col("a").alias(count)), ["lang", part])
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    best = best.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language's phrases are first ranked in parts, so that no task orders all of them.
    part = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_documents(spark, sf_dir))


#: The same by counting every phrase.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest(range(1, 6)) AS k) ks WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
inside AS (SELECT DISTINCT lang, a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase FROM c WHERE k >= 3),
open AS (SELECT * FROM c ANTI JOIN inside USING (lang, a, phrase)),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM open),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, cut, 1000 * c.a * n // (l.a * r.a) AS score
  FROM cuts c JOIN totals USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:c.k], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""
