"""Quality rules from repetition: how much of a text lies inside its own repeated n-grams and lines.

Rolling hashes of several n-gram lengths are taken over whole texts in numpy. For each length the
operator measures the characters of all words inside n-grams that occur more than once in the
text (first occurrence included, overlaps counted once); for lines, the characters of lines equal
to an earlier one. Each text is judged on its own, so tasks need no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, read_documents
from .text import SPACE, Words, chunks, mix64, row_sums, shingles, words

#: Largest share of a text's word characters inside repeated n-grams, by n-gram length.
NGRAM_LIMITS = {5: 0.35, 7: 0.32, 10: 0.30}
LINE_LIMIT = 0.30
#: Largest number of symbols a word.
SYMBOL_LIMIT = 0.10
WINDOW = 8

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _repeated(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a value occurs more than once in its row."""
    key = mix64(hashes + rows.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not twice.size:
        return np.zeros(key.size, bool)
    at = np.minimum(np.searchsorted(twice, key), twice.size - 1)
    return twice[at] == key


def covered_words(w: Words, hashes: np.ndarray, n: int) -> np.ndarray:
    """Whether a word lies inside an n-word window that its row has twice or more."""
    have = w.counts
    s, so = shingles(hashes, w.offs, n)
    counts = np.where(have >= n, have - n + 1, 0)
    long = np.repeat(have >= n, np.diff(so))
    s = s[long]
    rows = np.repeat(np.arange(have.size), counts)
    first = np.arange(s.size) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(w.offs[:-1], counts)
    hit = first[_repeated(s, rows)]
    step = np.zeros(hashes.size + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + n, -1)
    return np.cumsum(step[:-1]) > 0


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and byte span of every line that has a word."""
    buf, offs = w.buf, w.row_offs
    breaks = np.flatnonzero(buf == 0x0A)
    starts = np.unique(np.concatenate([offs[:-1][offs[:-1] < buf.size], breaks + 1]))
    starts = starts[starts < buf.size]
    ends = np.concatenate([starts[1:], [buf.size]]).astype(np.int64)
    ends -= (ends > starts) & (buf[np.maximum(ends - 1, 0)] == 0x0A)
    some = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[some], ends[some]
    rows = np.searchsorted(offs, starts, side="right") - 1
    return rows, Words(buf, offs, starts, ends, offs).hashes(lower=False), starts, ends


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch, whose last column is the text to measure, with the measures in its place."""
    for batch in batches:
        kept = batch.schema.names[:-1]
        for lo, hi, buf, offs in chunks(batch.column(batch.num_columns - 1)):
            w = words(buf, offs)
            n = hi - lo
            h = w.hashes(lower=False)
            lead = np.zeros(buf.size + 1, np.int64)
            np.cumsum(_LEAD[buf] & ~SPACE[buf], out=lead[1:])
            chars = lead[w.ends] - lead[w.starts]
            word_chars = row_sums(chars, w.offs)
            rows, lines, starts, ends = _lines(w)
            key = mix64(lines + rows.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
            later = np.ones(key.size, bool)
            later[np.unique(key, return_index=True)[1]] = False
            dup_chars = np.bincount(rows[later], weights=(lead[ends] - lead[starts])[later], minlength=n)
            full = np.maximum(word_chars, 1)
            out = {
                **{c: batch.column(i).slice(lo, n) for i, c in enumerate(kept)},
                "n_words": w.counts,
                "word_chars": word_chars,
                "n_symbols": row_sums(_SYMBOL[buf], offs),
                "n_dup_lines": np.bincount(rows[later], minlength=n),
                "n_repeat_words": row_sums(covered_words(w, h, WINDOW), w.offs),
                "dup_line_share": dup_chars / full,
            }
            for k in NGRAM_LIMITS:
                out[f"dup_{k}gram_share"] = row_sums(covered_words(w, h, k) * chars, w.offs) / full
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))


_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repetition(docs: DataFrame, min_words: int = 20, columns: list[str] | None = None) -> DataFrame:
    """Repetition measures and verdict of every text.

    One row per input row of ``docs``, with its ``columns`` (``doc_id`` by default; ``text`` is
    needed, and columns named like a measure are not taken): ``n_words``, ``word_chars`` (code
    points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word, equal to an earlier line),
    ``n_repeat_words`` (words in repeated 8-word windows), the shares of word characters inside
    repeated lines and n-grams, ``base_failed`` (fewer than ``min_words`` words, or over 30 % of
    them in repeated windows) and ``kept``: not base_failed, and no share above its limit, and at
    most one symbol for ten words. Null, empty and blank texts have no words: all counts are 0 and
    they are not kept. Repeated rows are judged alike.
    """
    shares = {"dup_line_share": LINE_LIMIT} | {f"dup_{k}gram_share": v for k, v in NGRAM_LIMITS.items()}
    measures = [*_LONGS, *shares, "base_failed", "kept"]
    columns = ["doc_id"] if columns is None else [c for c in columns if c not in measures]
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select(*columns, F.col("text").alias("_text"))
    schema = T.StructType([rows.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in _LONGS] + [T.StructField(c, T.DoubleType()) for c in shares])
    rows = rows.mapInArrow(lean(_measure), schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = F.col("n_symbols") <= SYMBOL_LIMIT * F.col("n_words")
    for c, limit in shares.items():
        good = good & (F.col(c) <= limit)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts pass the rules."""
    names = docs.columns
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), "doc_id", "text") if set(names) & {*_LONGS, "kept"} else docs
    if plain is docs:
        return repetition(docs, columns=names).filter("kept").select(*names)
    kept = repetition(plain, columns=[f"c{i}" for i in range(len(names))]).filter("kept")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(read_documents(spark, sf_dir))


def _covered_sql(n: int) -> str:
    """CTE of the words (rid, i) inside n-word windows that their text has twice or more."""
    return f"""v{n} AS (SELECT rid, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM d)),
c{n} AS (SELECT DISTINCT rid, unnest(range(i, i + {n})) AS i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS m FROM v{n}) WHERE m > 1),
k{n} AS (SELECT rid, count(*) AS n, sum(length(word)) AS chars FROM c{n} JOIN w USING (rid, i) GROUP BY rid)"""


#: The same measures by plain windows and lines.
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
t AS (SELECT rid, sum(length(word)) AS chars FROM w GROUP BY rid),
l AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line) AS nth FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
x AS (SELECT rid, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars FROM l WHERE nth > 1 GROUP BY rid),
{", ".join(_covered_sql(n) for n in (WINDOW, *NGRAM_LIMITS))},
m AS (
  SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(t.chars, 0)::BIGINT AS word_chars, length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(x.n, 0)::BIGINT AS n_dup_lines, coalesce(k{WINDOW}.n, 0)::BIGINT AS n_repeat_words, coalesce(x.chars, 0)::DOUBLE / greatest(coalesce(t.chars, 0), 1) AS dup_line_share,
    {", ".join(f"coalesce(k{n}.chars, 0)::DOUBLE / greatest(coalesce(t.chars, 0), 1) AS dup_{n}gram_share" for n in NGRAM_LIMITS)}
  FROM d LEFT JOIN t USING (rid) LEFT JOIN x USING (rid) {" ".join(f"LEFT JOIN k{n} USING (rid)" for n in (WINDOW, *NGRAM_LIMITS))}
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_symbols <= {SYMBOL_LIMIT}::DOUBLE * n_words AND dup_line_share <= {LINE_LIMIT}::DOUBLE AND {" AND ".join(f"dup_{n}gram_share <= {v}::DOUBLE" for n, v in NGRAM_LIMITS.items())} AS kept FROM f
"""
