"""Near-duplicate documents by SimHash and deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that two fingerprints
within the radius agree in one of them up to one bit. Every segment is indexed
under all variants that leave out one bit; fingerprints that share a variant
are joined on it and verified. Copies are one fingerprint throughout, so the
work follows the number of different fingerprints.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .components import connected_components

BITS = 64
SEED = 42
#: Words of a shingle and bits that linked fingerprints differ by at most.
SHINGLE_WORDS, RADIUS = 3, 2
#: Variants shared by more fingerprints than this are not joined in pairs: see near_links.
PAIR_LIMIT = 24
_BLOCK = 1 << 15


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text; 0 for null and for texts without a word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        part = w[at : at + _BLOCK + words - 1]
        if len(part) < words:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[k : len(part) - words + 1 + k] for k in range(words)), strict=True))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a signed bigint."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = np.array([simhash(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(radius: int) -> list[int]:
    """Masks of the fewest segments of which one differs by at most one bit."""
    n = radius // 2 + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def variants(nodes: DataFrame, radius: int) -> DataFrame:
    """(variant, value, fp): one row for each bit left out of each segment."""
    masks = [(mask, 1 << bit) for mask in segments(radius) for bit in range(BITS) if mask >> bit & 1]
    values = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(mask ^ bit))) for mask, bit in masks])
    return nodes.select("fp", F.posexplode(values).alias("variant", "value"))


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between fingerprints whose graph has the components of all links within ``radius``.

    ``nodes`` has distinct ``fp``. Variants of at most
    PAIR_LIMIT fingerprints are joined with themselves, and pairs verified.
    Fingerprints with a more common variant take an exact second way without
    pairs, for which ``radius`` must be at most 2: two fingerprints differ by at
    most two bits just if both are within one bit of some third value, so each
    is listed under its 65 values, under each of which at most 65 meet and all
    link to the smallest.
    """
    if not 1 <= radius <= 2:
        raise ValueError("radius must be 1 or 2")
    # A small file of fingerprints becomes 64 times as many rows: more tasks for them.
    spread = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    entries = variants(spread, radius)
    shared = entries.groupBy("variant", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(entries.join(shared.hint("merge"), ["variant", "value"]), "variants")

    firsts, at, seg_of, bit_of = [], 0, [], []
    for mask in segments(radius):
        firsts.append(at)
        for bit in range(BITS):
            if mask >> bit & 1:
                seg_of.append(_signed(mask))
                at += 1
    cold = met.where(F.col("n") <= PAIR_LIMIT)
    mask_of = F.element_at(F.array(*[F.lit(m) for m in seg_of]), F.col("variant") + 1)
    left = cold.select("variant", "value", F.col("fp").alias("fa"), mask_of.alias("mask"))
    right = cold.select("variant", "value", F.col("fp").alias("fb"))
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    # Equal segments share all their variants: their pair counts at the first.
    once = (differ.bitwiseAND(F.col("mask")) != 0) | F.col("x.variant").isin(firsts)
    x = left.alias("x")
    y = right.hint("merge").alias("y")
    pairs = x.join(
        y,
        (F.col("x.variant") == F.col("y.variant"))
        & (F.col("x.value") == F.col("y.value"))
        & (F.col("fa") < F.col("fb"))
        & (F.bit_count(differ) <= radius)
        & once,
    ).select(F.col("fa").alias("a"), F.col("fb").alias("b"))

    hot = met.where(F.col("n") > PAIR_LIMIT).select("fp").distinct()
    reach = [0, *(1 << b for b in range(BITS))] if radius == 2 else None
    if radius == 2:
        ball = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(v))) for v in reach])
        around = hot.select("fp", F.explode(ball).alias("z")).groupBy("z")
        stars = around.agg(F.collect_list("fp").alias("of"), F.min("fp").alias("a")).where(F.size("of") > 1)
        stars = stars.select("a", F.explode("of").alias("b")).where("a <> b")
    else:
        # At radius 1 two fingerprints meet in the value with their one different bit cleared.
        gone = F.array(*[F.struct(F.lit(b).alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed(~(1 << b) & (2**64 - 1)))).alias("z")) for b in range(BITS)])
        around = hot.select("fp", F.explode(gone).alias("g")).groupBy("g.bit", "g.z")
        stars = around.agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("a", "b")
    links = cut(pairs.union(stars), "links")
    discard(met)
    return links


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    ``component_id`` is the smallest doc_id that links within ``radius`` bits
    reach. Null texts and texts without words have fingerprint 0 and link like
    any other. Repeated rows each keep their row. Rows with a null doc_id link
    and are passed through like any other; a component without any doc_id has
    null. Texts of any length are read whole; an empty table gives no row.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    fps = cut(fingerprints(docs, words), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    links = near_links(nodes.select("fp"), radius)
    found = cut(connected_components(links), "components")
    discard(links)
    placed = nodes.join(found.hint("merge"), nodes["fp"] == found["node"], "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = placed.select("fp", "component").join(least.hint("merge"), "component").select("fp", "component_id")
    # By merge, as all joins here: what would be broadcast goes through the driver.
    # A third of all rows may share a fingerprint: adaptive execution splits it, the other side has one row a fingerprint.
    return fps.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op10(spark, sf_dir):
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")
