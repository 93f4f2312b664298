"""Mixing of sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, unique_name

#: Without weights a source's share is its characters to this power.
FLATTEN = 0.5
SEED = 17
#: A rate is split into so many parts that none is above this; each part is drawn on its own.
PART_RATE = 16
#: Terms of the distribution function: beyond the 120th nothing of a double is left at PART_RATE.
TERMS = 120
#: Rates of at most so many sources are broadcast (1 kB each); those of more are joined salted.
BROADCAST_SOURCES, SALTS = 10_000, 256


def _uniform(*parts: Column) -> Column:
    """A double in [0, 1) from 52 bits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0) -> DataFrame:
    """(source, rate): the mean number of copies of a document of each source.

    With ``weights`` a source gets its weight's part of ``total`` times all
    characters (sources without a weight: none); without, that of its characters
    to the power FLATTEN. Sources without a character have rate 0.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length(F.coalesce(F.col("text"), F.lit("")))).cast("double").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(FLATTEN)))
    else:
        found = F.lit(None).cast("double")
        for name, w in weights.items():
            found = F.when(F.col("source") == name, F.lit(float(w))).otherwise(found)
        sizes = sizes.withColumn("weight", F.coalesce(found, F.lit(0.0)))
    size, weight = sizes.agg(F.coalesce(F.sum("size"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rate = F.when((F.col("size") > 0) & F.lit(weight > 0), F.col("weight") / F.lit(weight or 1.0) * F.lit(size * total) / F.col("size"))
    return sizes.select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, seed: int = SEED) -> DataFrame:
    """Every document as often as a Poisson draw with its source's rate says, in shuffled order.

    The draw inverts the distribution function at a uniform number hashed from
    the seed and doc_id, so a row's copies don't depend on partitions or
    attempts; rows that repeat a doc_id repeat its draw. Null sources are a
    source of their own; null and empty texts count no character and are drawn
    like others of their source; an empty table gives no row. The columns of ``docs`` come back with ``rate``,
    ``copy`` (1, 2, ...) and ``shuffle_key``, by whose hash rows are dealt and
    by which each partition is sorted (names that clash get underscores).
    """
    rate, copy, key = (unique_name(docs, n) for n in ("rate", "copy", "shuffle_key"))
    source, mean_of, split, cdf, own, salt, first_draw, copies_of = (unique_name(docs, f"mix_{n}") for n in ("source", "rate", "parts", "cdf", "own", "salt", "draw", "copies"))
    of = rates(docs, weights, total)
    parts = F.greatest(F.ceil(F.col(mean_of) / PART_RATE), F.lit(1)).cast("int")
    of = of.select(F.col("source").alias(source), F.col("rate").alias(mean_of)).withColumn(split, parts)
    mean = F.col(mean_of) / F.col(split)
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda a, j: F.struct((a["p"] * mean / j).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * mean / j)).alias("cdf"))
    of = of.withColumn(cdf, F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step, lambda a: a["cdf"]))
    of = of.withColumn(cdf, F.filter(cdf, lambda c: c < 1))

    if of.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        met = docs.join(F.broadcast(of), docs["source"].eqNullSafe(of[source]), "left")
    else:
        salted = of.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn(own, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        met = dealt.join(salted, dealt["source"].eqNullSafe(salted[source]) & (dealt[own] == salted[salt]), "left").drop(own, salt)
    name = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    draw = lambda part: F.size(F.filter(cdf, lambda c: c <= _uniform(F.lit(str(seed)), name, part.cast("string"))))
    one = F.size(F.filter(cdf, lambda c: c <= F.col(first_draw)))
    more = F.aggregate(F.sequence(F.lit(1), F.col(split) - 1), F.lit(0), lambda acc, part: acc + draw(part))
    met = met.withColumn(first_draw, _uniform(F.lit(str(seed)), name, F.lit("0")))
    met = met.withColumn(copies_of, F.when(F.col(split) > 1, one + more).otherwise(one)).where(F.col(copies_of) > 0)
    copies = met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies_of))))
    hashed = F.md5(F.concat_ws("|", F.lit(f"{seed}#"), name, F.col(copy).cast("string")))
    out = copies.withColumn(key, F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint"))
    out = out.select(*[docs[c] for c in docs.columns], F.col(mean_of).alias(rate), copy, key)
    return out.repartition(key).sortWithinPartitions(key)


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = poisson_mix(docs)
    return mixed.select("doc_id", "source", "text", F.col("copy").cast("bigint").alias("copy"), "shuffle_key")


OP6_SQL = f"""
WITH s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
t AS (SELECT sum(size) AS size, sum(pow(size, {FLATTEN})) AS weight FROM s),
r AS (SELECT source, CASE WHEN s.size > 0 THEN pow(s.size, {FLATTEN}) / t.weight * t.size / s.size ELSE 0 END AS rate FROM s, t),
p AS (SELECT source, rate, CAST(greatest(ceil(rate / {PART_RATE}), 1) AS INTEGER) AS parts FROM r),
c AS (SELECT source, parts, sum(exp(-rate / parts + j * ln(rate / parts) - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS cdf
      FROM p, (SELECT CAST(range AS DOUBLE) AS j FROM range(0, {TERMS + 1})) g WHERE rate > 0),
d AS (SELECT doc_id, documents.source, text, part,
             CAST('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), 'null'), CAST(part AS VARCHAR))), 1, 13) AS BIGINT) / {float(1 << 52)!r} AS u
      FROM documents JOIN p ON documents.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(0, p.parts)) AS part)),
n AS (SELECT doc_id, d.source, text, count(*) AS copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u AND c.cdf < 1 GROUP BY ALL),
e AS (SELECT doc_id, source, text, unnest(range(1, copies + 1)) AS copy FROM n)
SELECT doc_id, source, text, copy,
       CAST('0x' || substr(md5(concat_ws('|', '{SEED}#', coalesce(CAST(doc_id AS VARCHAR), 'null'), CAST(copy AS VARCHAR))), 1, 15) AS BIGINT) AS shuffle_key
FROM e
"""
