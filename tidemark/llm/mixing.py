"""Mixing sources by temperature, as DataFrame expressions only.

Every source's token share is raised to an exponent between 0 (all alike) and 1 (as they are) and
normalised. The exponent is found by section search: each pass tries ``POINTS`` exponents at once
over the table of sources, and only their figures reach the driver. The weights times the token
budget are the sources' quotas, met by whole passes over a source and one part of a pass; each
pass takes the source's documents in an order permuted anew. The result is dealt into blocks:
every block holds each source in proportion to its quota, and its documents in a permuted order.

No source needs to fit a task: running sums are taken over buckets of the permuted order first,
and then inside each bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, read_documents

POINTS, PASSES = 17, 5
#: Equal rows that one task numbers.
COPIES = 1 << 16
NO_SOURCE = ""
WORD = r"[^\x20\x09-\x0D]+"


def permuted(*what: Column | str, copy: Column) -> Column:
    """A number below 2**52 that orders rows at random, the same in every run; equal rows differ by their number ``copy``."""
    text = F.concat_ws("|", *(F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("-")) for x in what), F.when(copy > 0, copy.cast("string")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _figures(sources: DataFrame, points: list[float], budget: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy in nats, largest number of passes over a source) for some exponents."""
    tried = sources.select("tokens", F.explode(F.array(*(F.lit(x) for x in points))).alias("a"))
    p = F.exp(F.col("a") * (F.log("tokens") - F.col("top")))
    tried = tried.crossJoin(F.broadcast(sources.agg(F.log(F.max("tokens")).alias("top"))))
    sums = tried.groupBy("a").agg(F.sum(p).alias("z"), F.sum(p * F.log(p)).alias("s"), F.max(p / F.col("tokens")).alias("r"))
    return sorted((r["a"], float(r["h"]), float(r["e"])) for r in sums.select("a", (F.log("z") - F.col("s") / F.col("z")).alias("h"), (F.col("r") / F.col("z") * budget).alias("e")).collect())


def find_exponent(sources: DataFrame, budget: float, entropy: float | None, max_passes: float | None) -> float:
    """Smallest exponent of 0 to 1 with an entropy of at most ``entropy`` and no source passed more often than ``max_passes``.

    Both figures fall as the exponent grows; where even 1 does not meet them, it is 1. Rounded to
    a multiple of 2**-20, upwards.
    """
    lo, hi = 0.0, 1.0
    for step in range(PASSES):
        points = [lo + (hi - lo) * i / (POINTS - 1) for i in range(POINTS)]
        good = [a for a, h, e in _figures(sources, points, budget) if (entropy is None or h <= entropy) and (max_passes is None or e <= max_passes)]
        if not good:
            return 1.0
        hi = min(good)
        if hi == lo:
            return hi
        lo = max(x for x in points if x < hi)
    return hi


def mixture(
    docs: DataFrame,
    *,
    budget: int | None = None,
    entropy: float | None = None,
    entropy_share: float | None = None,
    max_passes: float | None = 4.0,
    block_tokens: int = 1 << 18,
    bucket_rows: int = 20_000,
    seed: str = "mix",
) -> DataFrame:
    """A mixture of sources by temperature within a token budget.

    Args:
        docs: a frame with ``doc_id``, ``text`` and ``source``; other columns are ignored.
        budget: tokens (words) of the mixture; all tokens of ``docs`` if None.
        entropy: target entropy of the weights in nats, or ``entropy_share`` of the largest one possible.
        max_passes: how often a source may be repeated, 1 at least; None for any. A budget that
            takes more passes over all of ``docs`` is refused with a ValueError.
        block_tokens: about how many tokens a block has.
        bucket_rows: about how many rows of a source are summed up in one task.

    Returns one row per document and pass: ``doc_id``, ``source``, ``n_tokens``, ``pass`` (from 0),
    ``block`` (from 0) and ``place`` (from 0, within the block). A document is taken in a pass if
    the source's documents before it, in this pass's order, have fewer tokens than the quota
    leaves; a quota is so exceeded by less than one document. A null source is a source of its own
    (written as it is); a null text or one without words has 0 tokens, and such documents are
    spread like others. Sources without tokens have no weight and no rows. Repeated rows, and rows
    of one source and length without an id, count as often as they occur and are told apart by a
    number, so that they spread like others too. An entropy that no exponent of 0 to 1 gives is
    met as nearly as it can be. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    rows = docs.select(F.col("doc_id").cast("long"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    equal = rows.groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("m"))
    parts = equal.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(COPIES).cast("long"))))
    parts = parts.repartition("doc_id", "source", "n_tokens", "first")
    copies = parts.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, F.col("m")) - 1)))
    return mix_counted(ws.write(copies.select("doc_id", "source", "n_tokens", "copy")), ws, budget, entropy, entropy_share, max_passes, block_tokens, bucket_rows, seed)


def mix_counted(rows: DataFrame, ws: Workspace, budget: int | None, entropy: float | None, entropy_share: float | None, max_passes: float | None, block_tokens: int, bucket_rows: int, seed: str) -> DataFrame:
    """``mixture`` of rows whose ``n_tokens`` are known, with the number ``copy`` of each of equal ones."""
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = rows.withColumn("s", key)
    sources = ws.write(rows.groupBy("s").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).filter("tokens > 0"))
    total, count = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    size = int(total if budget is None else budget)
    if count and max_passes is not None and size > max_passes * total:
        raise ValueError(f"{size} tokens take {size / total:.2f} passes over {total} tokens, and {max_passes} are allowed")
    if entropy is None and entropy_share is not None and count:
        entropy = entropy_share * math.log(count)
    alpha = find_exponent(sources, float(size), entropy, max_passes) if count else 1.0
    top = sources.agg(F.log(F.max("tokens")).alias("top"))
    raised = sources.crossJoin(F.broadcast(top)).withColumn("p", F.exp(F.lit(alpha) * (F.log("tokens") - F.col("top")))).drop("top")
    z = raised.agg(F.sum("p").alias("z"))
    quotas = raised.crossJoin(F.broadcast(z)).withColumn("quota", F.greatest(F.floor(F.round(F.col("p") / F.col("z") * size, 6)), F.lit(1)))
    quotas = quotas.select("s", "tokens", "docs", "quota", F.floor(F.col("quota") / F.col("tokens")).alias("full"))
    quotas = ws.write(quotas.withColumn("last", F.when(F.col("quota") % F.col("tokens") == 0, F.col("full") - 1).otherwise(F.col("full"))))

    # Each document once a pass, in the pass's order: a bucket of about bucket_rows rows, then a place in it.
    copies = rows.join(quotas, "s").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    copies = copies.withColumn("o", permuted(seed, F.col("s"), F.col("pass"), F.col("doc_id"), copy=F.col("copy")))
    n_buckets = F.greatest(F.ceil(F.col("docs") / bucket_rows), F.lit(1))
    copies = copies.withColumn("bucket", F.floor(F.col("o") / F.pow(F.lit(2.0), F.lit(52)) * n_buckets))
    sums = copies.groupBy("s", "pass", "bucket").agg(F.sum("n_tokens").alias("t"))
    ahead = Window.partitionBy("s").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("t").over(ahead), F.lit(0))).drop("t")
    inside = Window.partitionBy("s", "pass", "bucket").orderBy("o", "doc_id", "n_tokens", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, ["s", "pass", "bucket"])
    placed = placed.withColumn("before", F.col("before") + F.col("ahead")).filter("before < quota")
    blocks = max(round(size / block_tokens), 1)
    placed = placed.withColumn("block", F.floor(F.col("before") * blocks / F.col("quota")))
    deal = Window.partitionBy("block").orderBy(permuted(seed, F.lit("block"), F.col("block"), F.col("pass"), F.col("doc_id"), copy=F.col("copy")), "doc_id", "pass", "s", "n_tokens")
    return placed.select("doc_id", "source", "n_tokens", "pass", "block", (F.row_number().over(deal) - 1).alias("place"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_documents(spark, sf_dir), entropy_share=0.95, max_passes=4.0)


#: The same mixture; the exponent by the same section search in a recursive query.
OP7_SQL = r"""
WITH RECURSIVE r AS (
  SELECT *, nullif(row_number() OVER (PARTITION BY doc_id, source, n_tokens) - 1, 0) AS copy
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens, coalesce('s' || source, 'n') AS s FROM documents)
), src AS (
  SELECT s, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY s HAVING sum(n_tokens) > 0
), tot AS (
  SELECT sum(tokens)::DOUBLE AS size, 0.95 * ln(count(*)) AS target, ln(max(tokens)) AS top FROM src
), search AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, true AS ok
  UNION ALL
  SELECT step + 1, CASE WHEN g IS NULL OR g = lo THEN coalesce(g, 1.0) ELSE g - (hi - lo) / 16 END, coalesce(g, 1.0), g IS NOT NULL AND g > lo
  FROM (
    SELECT step, lo, hi, min(a) FILTER (WHERE h <= target AND e <= 4.0) AS g
    FROM (
      SELECT step, lo, hi, a, any_value(target) AS target, ln(sum(p)) - sum(p * ln(p)) / sum(p) AS h, max(p / tokens) / sum(p) * any_value(size) AS e
      FROM (SELECT step, lo, hi, lo + (hi - lo) * i / 16 AS a, tokens, target, size, exp((lo + (hi - lo) * i / 16) * (ln(tokens) - top)) AS p FROM search, range(17) t(i), src, tot WHERE ok AND step < 5)
      GROUP BY step, lo, hi, a)
    GROUP BY step, lo, hi)
), q AS (
  SELECT s, tokens, greatest(floor(round(exp(alpha * (ln(tokens) - top)) / sum(exp(alpha * (ln(tokens) - top))) OVER () * size, 6)), 1)::BIGINT AS quota
  FROM src, tot, (SELECT arg_max(hi, step) AS alpha FROM search)
), c AS (
  SELECT r.*, q.quota, unnest(range(0, (q.quota + q.tokens - 1) // q.tokens)) AS pass FROM r JOIN q USING (s)
), o AS (
  SELECT *, ('0x' || substr(md5(concat_ws('|', 'mix', s, pass::VARCHAR, coalesce(doc_id::VARCHAR, '-'), copy::VARCHAR)), 1, 13))::BIGINT AS o FROM c
), b AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY s ORDER BY pass, o, doc_id, n_tokens, copy NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM o
), d AS (
  SELECT *, floor(before * greatest(round((SELECT size FROM tot) / 262144), 1) / quota)::BIGINT AS block FROM b WHERE before < quota
)
SELECT doc_id, source, n_tokens, pass, block, (row_number() OVER (PARTITION BY block ORDER BY ('0x' || substr(md5(concat_ws('|', 'mix', 'block', block::VARCHAR, pass::VARCHAR, coalesce(doc_id::VARCHAR, '-'), copy::VARCHAR)), 1, 13))::BIGINT, doc_id, pass, s, n_tokens) - 1)::INTEGER AS place
FROM d
"""
