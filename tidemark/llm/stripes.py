"""Source divergence audit by in-mapper stripes.

Each partition folds whole documents into hash stripes, one a language and term: the number of
documents that hold the term, and its occurrences by source. Stripes that no longer fit a bound of
entries are spilled to the shuffle, sorted by key there, and stripes of one key are merged as they
stream by: a task holds one merged stripe at a time, and a very common term is one row a spill,
however many documents have it. The merged stripes, with the totals of their language, directly
emit the divergences: partial sums for pairs of sources, and the best terms of each source.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, lean, read_documents
from .text import LOWER, chunks, mix64, words

#: Bytes outside terms: all of ASCII but letters.
BREAKS = np.ones(256, bool)
BREAKS[65:91] = BREAKS[97:123] = BREAKS[128:] = False

#: Entries (term and source) that a task folds before it spills.
ENTRIES = 1 << 20
#: Cells of pair sums, and terms of sources, that a task holds before it hands them on.
CELLS = 1 << 20
SCALE_DIGITS = 9
#: Groups (language and source) whose totals are broadcast; more of them meet the stripes in a shuffle.
BROADCAST_GROUPS = 1 << 14
#: First ranking of a group's terms: so many parts, whose best meet in the second.
RANK_PARTS = 16

STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
_U = np.uint64


def _spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans of a buffer, A-Z lower-cased, as an Arrow string column."""
    sizes = ends - starts
    offs = np.concatenate([[0], np.cumsum(sizes)])
    data = LOWER[buf[np.repeat(starts - offs[:-1], sizes) + np.arange(offs[-1])]]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class _Fold:
    """The stripes of a task so far: terms by key, and entries of (term, group) with their counts."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple] = []
        self.entries, self.compact = 0, 0

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, buf: np.ndarray, offs: np.ndarray, groups: np.ndarray, salts: np.ndarray) -> None:
        """Whole rows: their terms, groups and the salts of their languages."""
        w = words(buf, offs, BREAKS)
        if not w.starts.size:
            return
        rows = np.repeat(np.arange(groups.size), w.counts)
        keys, first, term = np.unique(mix64(w.hashes() ^ salts[rows]), return_index=True, return_inverse=True)
        width = len(self.groups)
        pair, counts = np.unique(term * width + groups[rows], return_counts=True)
        holds = np.unique(term * groups.size + rows) // groups.size
        self.parts.append((keys, groups[rows[first]], np.bincount(holds, minlength=keys.size), _spans(buf, w.starts[first], w.ends[first]), pair // width, pair % width, counts))
        self.entries += pair.size

    def folded(self) -> tuple:
        """All parts as one; entries are in the order of their terms."""
        if len(self.parts) > 1:
            sizes = np.cumsum([0] + [p[0].size for p in self.parts])
            keys, first, back = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
            holds = np.zeros(keys.size, np.int64)
            np.add.at(holds, back, np.concatenate([p[2] for p in self.parts]))
            width = len(self.groups)
            pair = np.concatenate([back[at + p[4]] * width + p[5] for at, p in zip(sizes, self.parts)])
            pair, where = np.unique(pair, return_inverse=True)
            counts = np.zeros(pair.size, np.int64)
            np.add.at(counts, where, np.concatenate([p[6] for p in self.parts]))
            texts = pa.concat_arrays([p[3] for p in self.parts]).take(pa.array(first))
            self.parts = [(keys, np.concatenate([p[1] for p in self.parts])[first], holds, texts, pair // width, pair % width, counts)]
            self.entries = pair.size
        self.compact = self.entries
        return self.parts[0]

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The stripes, and for each language one of the empty term that names its groups; the fold is empty afterwards."""
        names = list(self.groups)
        sources = pa.array([s for _, s in names], pa.string())
        langs = pa.array([x for x, _ in names], pa.string())
        for lang in sorted({x for x, _ in names}):
            mine = [s for x, s in names if x == lang]
            yield _batch(pa.array([lang]), pa.array([""]), np.zeros(1, np.int64), np.array([0, len(mine)]), pa.array(mine, pa.string()), np.zeros(len(mine), np.int64))
        if self.parts:
            _, group, holds, texts, term, source, counts = self.folded()
            offs = np.searchsorted(term, np.arange(holds.size + 1))
            for lo in range(0, holds.size, 1 << 15):
                hi = min(lo + (1 << 15), holds.size)
                a, b = offs[lo], offs[hi]
                yield _batch(langs.take(pa.array(group[lo:hi])), texts.slice(lo, hi - lo).cast(pa.string()), holds[lo:hi], offs[lo : hi + 1] - a, sources.take(pa.array(source[a:b])), counts[a:b])
        self.__init__()


def _batch(langs: pa.Array, terms: pa.Array, holds: np.ndarray, offs: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    offs = pa.array(offs.astype(np.int32))
    lists = [pa.ListArray.from_arrays(offs, sources), pa.ListArray.from_arrays(offs, pa.array(counts))]
    return pa.RecordBatch.from_arrays([langs, terms, pa.array(holds), *lists], names=["lang", "term", "df", "sources", "counts"])


def _stripes(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold()
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            salts = batch.column(2).to_numpy(zero_copy_only=False).view(_U)
            for lo, hi, buf, offs in chunks(batch.column(3)):
                groups = np.array([fold.group(langs[i], sources[i]) for i in range(lo, hi)], np.int64)
                fold.add(buf, offs, groups, salts[lo:hi])
                if fold.entries > max(2 * fold.compact, entries // 4):
                    fold.folded()
                if fold.compact > entries or len(fold.groups) > entries:
                    yield from fold.spill()
        yield from fold.spill()

    return run


def _merge(min_docs: int):
    """Stripes in the order of their keys, those of one key merged; terms of fewer documents are left out."""

    def combined(t: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        """One stripe for each run of rows; ``new`` marks where runs begin."""
        run = np.cumsum(new) - 1
        heads = pa.array(np.flatnonzero(new))
        entries = t.column(3).flatten().dictionary_encode()
        of = np.repeat(run, pc.list_value_length(t.column(3)).to_numpy(zero_copy_only=False))
        width = max(len(entries.dictionary), 1)
        pair, where = np.unique(of * width + entries.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        counts, holds = np.zeros(pair.size, np.int64), np.zeros(len(heads), np.int64)
        np.add.at(counts, where, t.column(4).flatten().to_numpy(zero_copy_only=False))
        np.add.at(holds, run, t.column(2).to_numpy(zero_copy_only=False))
        return _batch(t.column(0).take(heads), t.column(1).take(heads), holds, np.searchsorted(pair // width, np.arange(len(heads) + 1)), entries.dictionary.take(pa.array(pair % width)), counts)

    def kept(t: pa.RecordBatch) -> pa.RecordBatch:
        return t.filter(pc.or_(pc.greater_equal(t.column(2), min_docs), pc.equal(t.column(1), "")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch if open_ is None else pa.concat_batches([open_, batch])
            same = [pc.equal(c.slice(1), c.slice(0, len(c) - 1)) for c in t.columns[:2]]
            new = np.concatenate([[True], ~pc.and_(*same).to_numpy(zero_copy_only=False)])
            t = combined(t, new)
            yield kept(t.slice(0, t.num_rows - 1))
            open_ = t.slice(t.num_rows - 1)
        if open_ is not None:
            yield kept(open_)

    return run


def term_stripes(docs: DataFrame, *, min_docs: int = 3, entries: int = ENTRIES) -> DataFrame:
    """Merged stripes: ``lang``, ``term``, ``df``, ``sources``, ``counts``, one row a language and term.

    Only terms of at least ``min_docs`` documents of the language; besides, for each language one
    row of the empty term with all sources that occur and counts of 0. ``docs`` has ``text``,
    ``lang`` and ``source``, nulls in which are read as ''; other columns are ignored. Every row is
    a document, also one that repeats another.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("lang", "source", F.xxhash64("lang").alias("salt"), "text").mapInArrow(lean(_stripes(entries)), STRIPE)
    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(lean(_merge(min_docs)), STRIPE)


def _scaled(c: np.ndarray, m: np.ndarray) -> np.ndarray:
    """1 + floor(10**SCALE_DIGITS * c / m) by long division: exact for m below 9 * 10**17."""
    q = c // m
    r = c - q * m
    for _ in range(SCALE_DIGITS):
        r *= 10
        digit = r // m
        q = q * 10 + digit
        r -= digit * m
    return q + 1


class _Best:
    """The terms of largest value of each group, ties to the smaller term, ``top`` a group at most."""

    def __init__(self, top: int):
        self.top, self.held, self.of = top, 0, {}

    def add(self, group: tuple[str, str], values: np.ndarray, terms: pa.Array) -> None:
        if values.size > self.top:
            cut = np.partition(values, values.size - self.top)[values.size - self.top]
            at = np.flatnonzero(values >= cut)
            values, terms = values[at], terms.take(pa.array(at))
        before = self.of.get(group, [])
        now = heapq.nsmallest(self.top, [*before, *zip((-values).tolist(), terms.to_pylist())])
        self.of[group] = now
        self.held += len(now) - len(before)

    def rows(self) -> Iterator[tuple[str, str, str, str, int]]:
        for (lang, source), best in self.of.items():
            yield from ((lang, source, "term", term, -value) for value, term in best)


def _diverge(top: int, cells: int):
    """Divergences of the sources from each row's first one on, as many as ``_width`` says, from all of the language."""

    def divergences(p: np.ndarray, own: range) -> np.ndarray:
        """Sums of f over the terms (rows), for each own source (column) to all."""
        out = np.zeros((len(own), p.shape[1]), np.int64)
        for i, s in enumerate(own):
            d = p[:, s : s + 1] - p
            d *= d
            d //= p
            out[i] = d.sum(axis=0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[str, int], tuple[list[str], range, np.ndarray]] = {}
        best = _Best(top)
        columns = ["lang", "source", "part", "item", "value"]

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, _), (names, own, sums) in pairs.items():
                n = len(names) - 1
                for i, s in enumerate(own if n else ()):
                    items = pa.array(names[:s] + names[s + 1 :], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([names[s]] * n), pa.array(["pair"] * n), items, pa.array(np.delete(sums[i], s))], names=columns)
            rows = list(zip(*best.rows()))
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in rows[:4]), pa.array(rows[4], pa.int64())], names=columns)
            pairs.clear()
            best.of.clear()
            best.held = 0

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(7).to_pylist()))
            which = np.array([hash(k) for k in keys], np.int64)
            for code in np.unique(which):
                rows = np.flatnonzero(which == code)
                key = lang, first = keys[rows[0]]
                names = batch.column(4)[rows[0].item()].as_py()
                if key not in pairs:
                    own = range(first, min(first + _width(len(names), cells), len(names)))
                    pairs[key] = (names, own, np.zeros((len(own), len(names)), np.int64))
                _, own, sums = pairs[key]
                totals = np.array(batch.column(5)[rows[0].item()].as_py(), np.int64)
                v = batch.column(6)[rows[0].item()].as_py()
                step = max(cells // len(names), 1)
                for lo in range(0, rows.size, step):
                    t = batch.take(pa.array(rows[lo : lo + step]))
                    t = t.filter(pc.not_equal(t.column(1), ""))
                    if not t.num_rows:
                        continue
                    of = np.repeat(np.arange(t.num_rows), pc.list_value_length(t.column(2)).to_numpy(zero_copy_only=False))
                    counts = np.zeros((t.num_rows, len(names)), np.int64)
                    counts[of, pc.index_in(t.column(2).flatten(), value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False)] = t.column(3).flatten().to_numpy(zero_copy_only=False)
                    p = _scaled(counts + 1, totals + v)
                    q = _scaled(counts.sum(axis=1) + 1, totals.sum() + v)
                    sums += divergences(p, own)
                    for s in own:
                        at = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q))
                        if at.size:
                            d = p[at, s] - q[at]
                            best.add((lang, names[s]), d * d // q[at], t.column(1).take(pa.array(at)))
            if sum(x.size for _, _, x in pairs.values()) > 2 * cells or best.held > cells:
                yield from out()
        yield from out()

    return run


def _width(sources: int, cells: int) -> int:
    """Sources of a language whose pairs with all are summed together."""
    return max(cells // max(sources, 1), 1)


def source_divergence(docs: DataFrame, *, min_docs: int = 3, top: int = 200, entries: int = ENTRIES, cells: int = CELLS) -> DataFrame:
    """How each source's use of terms differs from the other sources' and from its language's.

    One row per language, source and item: ``lang``, ``source``, ``part``, ``item``, ``value``,
    ``rank``. A language keeps its V terms of at least ``min_docs`` documents. In each group
    (language and source), and in the whole language, a kept term that occurs ``count`` times has
    ``p = 1 + floor(10**9 * (count + 1) / (N + V))``, N being the count's sum over kept terms. Part
    ``pair`` has every other source of the language with the sum over kept terms of
    ``floor((p - q)**2 / q)``, q the other source's; part ``term`` the ``top`` terms that the group
    has with p above the language's q, by the same value. Ranks run from 1 in each group and part by
    falling value, ties by item in UTF-8 order. All arithmetic is exact (N + V below 9 * 10**17).

    Null text, lang and source are ''. Texts that are null, empty or without letters have no terms,
    but their groups are compared. A language without kept terms has pairs of value 0, one of a
    single source no pairs; an empty table gives no rows. Repeated rows count as often as they
    occur; other columns are ignored. Work grows with kept terms times the square of a language's
    sources, as the pairs do.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "stripes")
    stripes = ws.write(term_stripes(docs, min_docs=min_docs, entries=entries))
    n = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    groups = n.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))
    v = stripes.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"))
    totals = ws.write(groups.join(v, "lang").select("lang", F.col("g.source").alias("all_sources"), F.col("g.n").alias("totals"), "v"), small=True)
    groups, most = totals.agg(F.coalesce(F.sum(F.size("totals")), F.lit(0)), F.coalesce(F.max(F.size("totals")), F.lit(0))).first()
    few = groups <= BROADCAST_GROUPS
    rows = stripes.join(F.broadcast(totals) if few else totals, "lang").select("lang", "term", "sources", "counts", "all_sources", "totals", "v", F.lit(0).alias("first"))
    if most > _width(most, cells):
        width = F.greatest(F.lit(cells).cast("int") / F.size("totals"), F.lit(1)).cast("int")
        rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.size("totals") - 1, width))).repartition("lang", "first")
    parts = ws.write(rows.mapInArrow(lean(_diverge(top, cells)), "lang string, source string, part string, item string, value long"))
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    kept = (F.col("part") == "pair") | (F.col("rank") <= top)
    order = [F.desc("value"), "item"]
    # The tasks' best terms are ranked in parts first, so that a group that most tasks know is not one task's.
    some = summed.withColumn("dealt", F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS))).repartition("lang", "source", "part", "dealt")
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part", "dealt").orderBy(*order))).filter(kept)
    return some.drop("dealt").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))).filter(kept)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_documents(spark, sf_dir))


#: The same by plain counts of all terms.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT g.lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept USING (lang) GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
groups AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source),
p AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (total + v))::HUGEINT AS p FROM cells JOIN groups USING (lang, source) JOIN v USING (lang)),
whole AS (SELECT lang, sum(total) AS total FROM groups GROUP BY lang),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(whole.total) + any_value(v)))::HUGEINT AS q FROM cells JOIN whole USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
