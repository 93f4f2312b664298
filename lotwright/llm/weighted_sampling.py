"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Each word weighs as often as it occurs. For a word and a sample, hashes seed
two gamma variables r and c and a uniform b; with t = floor(ln(weight) / r + b)
the word's value is c / exp(r (t - b + 1)), and the sample is the word (and t)
of the smallest value. Two documents agree in a sample with the probability of
their generalised Jaccard similarity, sum of minima over sum of maxima.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Samples of a fingerprint: GROUPS rows of IN_GROUP columns for each word. More columns make a method that the JVM no longer compiles.
GROUPS, IN_GROUP = 12, 3
SAMPLE_BITS = 24
#: Documents of a range of ids, within which the next document is looked up; ranges are MAX_RANGES at most.
RANGE_ROWS, MAX_RANGES = 512, 1 << 16
_FRACTION_BITS = 32


def terms(text: Column) -> Column:
    """An array of (hash, weight), one for each different word of a text."""
    words = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def weighted(hashes: str) -> list[Column]:
    """From a column of sorted word hashes, the places where a word's run starts, and the next ones."""
    h = F.col(hashes)
    starts = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == 1) | (F.get(h, i - 1) != F.get(h, i - 2)))
    return [F.when(F.size(h) > 0, starts).otherwise(F.array().cast("array<int>")).alias("starts")]


def _unit(bits: Column, width: int) -> Column:
    return (bits.cast("double") + 0.5) * (2.0**-width)


def exploded(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, term (hash) and weight of each different word of the text."""
    df = df.select(*keys, F.sort_array(terms(F.col(text))).alias("hashes"))
    df = df.select(*keys, "hashes", *weighted("hashes"))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("hashes") + 1))
    df = df.select(*keys, "hashes", F.explode(F.arrays_zip(F.col("starts"), ends.alias("ends"))).alias("run"))
    return df.select(*keys, F.get("hashes", F.col("run.starts") - 1).alias("term"), (F.col("run.ends") - F.col("run.starts")).cast("double").alias("weight"))


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and ``samples``, GROUPS * IN_GROUP numbers below 2**24; texts without a word give no row."""
    rows = exploded(df, keys, text).withColumn("lnw", F.log("weight"))
    rows = rows.withColumn("g", F.explode(F.array(*[F.lit(g) for g in range(GROUPS)])))
    k = range(IN_GROUP)
    low = F.lit((1 << 32) - 1)
    rows = rows.select(*keys, "g", "lnw", *[F.xxhash64("term", "g", F.lit(i)).alias(f"a{i}") for i in k])
    rows = rows.select(*keys, "g", "lnw", *[f"a{i}" for i in k], *[F.xxhash64(f"a{i}").alias(f"b{i}") for i in k])
    part = F.lit((1 << 21) - 1)
    r = [-F.log(_unit(F.col(f"a{i}").bitwiseAND(low), 32) * _unit(F.shiftrightunsigned(f"a{i}", 32), 32)) for i in k]
    c = [-F.log(_unit(F.col(f"b{i}").bitwiseAND(part), 21) * _unit(F.shiftrightunsigned(f"b{i}", 21).bitwiseAND(part), 21)) for i in k]
    b = [_unit(F.shiftrightunsigned(f"b{i}", 42), 22) for i in k]
    rows = rows.select(*keys, "g", "lnw", *[f"a{i}" for i in k], *[r[i].alias(f"r{i}") for i in k], *[F.log(c[i]).alias(f"c{i}") for i in k], *[b[i].alias(f"u{i}") for i in k])
    t = [F.floor(F.col("lnw") / F.col(f"r{i}") + F.col(f"u{i}")) for i in k]
    rows = rows.select(*keys, "g", *[f"{x}{i}" for x in "arcu" for i in k], *[t[i].alias(f"t{i}") for i in k])
    mask = F.lit((1 << SAMPLE_BITS) - 1)
    packed = []
    for i in k:
        value = F.col(f"c{i}") - F.col(f"r{i}") * (F.col(f"t{i}") - F.col(f"u{i}") + 1)
        code = F.col(f"a{i}").bitwiseAND(mask).bitwiseXOR((F.col(f"t{i}") * 0x9E3779).bitwiseAND(mask))
        packed.append(F.shiftleft((value * float(1 << _FRACTION_BITS)).cast("bigint"), SAMPLE_BITS).bitwiseOR(code).alias(f"p{i}"))
    rows = rows.select(*keys, "g", *packed)
    best = rows.groupBy(*keys, "g").agg(*[F.min(f"p{i}").alias(f"p{i}") for i in k])
    best = best.select(*keys, F.struct("g", F.array(*[F.col(f"p{i}").bitwiseAND(mask) for i in k]).alias("s")).alias("part"))
    parts = best.groupBy(*keys).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return parts.select(*keys, F.flatten(F.col("parts.s")).alias("samples"))


def as_text(samples: Column) -> Column:
    """Six hexadecimal digits a sample; the empty text where there is no word."""
    digits = SAMPLE_BITS // 4
    return F.coalesce(F.array_join(F.transform(samples, lambda s: F.lower(F.lpad(F.hex(s), digits, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The part of equal samples; texts without words are like each other and nothing else."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / float(GROUPS * IN_GROUP)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def _bounds(docs: DataFrame) -> tuple[list[int], int]:
    rows, top = docs.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    n = min(MAX_RANGES, max(1, rows // RANGE_ROWS))
    if n < 2:
        return [], top
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    return sorted(set(cuts)), top


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not above the id, by bisection; null ids are below all."""
    if not cuts:
        return F.lit(0)
    steps = [1 << s for s in reversed(range(len(cuts).bit_length()))]
    known = F.array(*[F.lit(c) for c in cuts]) if len(cuts) < 64 else F.from_json(F.lit(str(cuts)), "array<bigint>")
    at = lambda lo, s: F.when(F.coalesce(F.get(known, lo + s - 1) <= doc_id, F.lit(False)), lo + s).otherwise(lo)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), at)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket and ``guest``: all documents by ranges of their ids, so that the next one is in the same range.

    The next document of a range's last is added to it as a guest: the largest
    of the range below or, for the lowest, of all. Only ranges' bounds reach the
    driver, MAX_RANGES at most.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts, top = _bounds(docs)
    own = docs.withColumn("bucket", _range_of(F.col("doc_id"), cuts)).withColumn("tie", F.xxhash64("text"))
    tops = own.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")).alias("t"))
    tops = sorted((r[0], r[1]["doc_id"], r[1]["tie"]) for r in tops.select("bucket", "t").collect())
    if not tops:
        return own.withColumn("guest", F.lit(False))
    # By range: its largest row, and the range above it, which it visits.
    ids, ties, hosts = ([None] * (tops[-1][0] + 1) for _ in range(3))
    for k, (b, d, t) in enumerate(tops):
        ids[b], ties[b], hosts[b] = d, t, tops[(k + 1) % len(tops)][0]
    told = lambda values: F.get(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), F.col("bucket"))
    is_top = F.col("doc_id").eqNullSafe(told(ids)) & (F.col("tie") == told(ties))
    self_, visit = F.struct("bucket", F.lit(False).alias("guest")), F.struct(told(hosts).cast("int").alias("bucket"), F.lit(True).alias("guest"))
    both = F.explode(F.when(is_top, F.array(self_, visit)).otherwise(F.array(self_)))
    return own.withColumn("_at", both).select("doc_id", "text", F.coalesce(F.col("_at.bucket"), F.lit(0)).alias("bucket"), "tie", F.col("_at.guest").alias("guest"))


def op1(spark, sf_dir):
    from pyspark.sql import Window

    rows = with_next(table(spark, sf_dir, "documents"))
    order = [F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    inside = Window.partitionBy("bucket").orderBy(*order)
    rows = rows.withColumn("row", F.row_number().over(inside)).withColumn("next", F.lead("text").over(inside))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    keys = ["bucket", "row", "doc_id", "guest", "n_chars", "edited_sha256"]
    rows = rows.select("bucket", "row", "doc_id", "guest", n.cast("bigint").alias("n_chars"), F.when(~F.col("guest"), edited).alias("edited"), "text")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v"))
    both = both.select(*keys, F.col("v.which").alias("which"), F.col("v.text").alias("text"))
    found = fingerprints(both.where("text is not null"), ["bucket", "row", "which"], "text")
    every = rows.select(*keys)
    wide = found.groupBy("bucket", "row").agg(*[F.max(F.when(F.col("which") == k, F.col("samples"))).alias(name) for k, name in ((0, "own"), (1, "edit"))])
    wide = every.join(wide, ["bucket", "row"], "left")
    wide = wide.withColumn("after", F.lead("own").over(Window.partitionBy("bucket").orderBy("row"))).where("not guest")
    return wide.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )

