"""Hard negatives by bit-sliced integer products.

Vectors become integers. Of a block of candidates the components' bits are taken
plane by plane, the most significant (the sign's) first. After each plane every
score lies in an interval: what the planes so far give, and what all lower bits
could add at least and at most. A candidate goes once its interval cannot reach
what is sought any more, and only what is left meets the next plane; after the
last plane the interval is the score.

Anchors are written to the shared folder. Each task holds a part of the candidates
and reads the anchors block by block, so neither is broadcast or collected, and
what leaves a task is a bounded list for each anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, table

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is between this part of the positive's and the positive's own, in hundredths.
LOW, HIGH = 80, 100
#: Integers are floor(SCALE * x).
SCALE = 256
#: Anchors, and candidates that are compared with them at once.
ANCHOR_ROWS, CANDIDATE_ROWS = 512, 4096
#: Pairs in a block are taken one by one once so few are left.
_SPARSE = 1 / 16
_NONE = np.iinfo(np.int64).min


def _kth(group: np.ndarray, value: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th largest value of each group, _NONE where it has fewer."""
    out = np.full(groups, _NONE, np.int64)
    low = int(value.min(initial=0))
    span = int(value.max(initial=0)) - low + 1
    # One sort of whole numbers, where group and value fit in one.
    order = np.argsort(group * span + (span - 1 + low - value)) if span * groups < 1 << 62 else np.lexsort((-value, group))
    of = group[order]
    first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
    rank = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    at = order[rank == k - 1]
    out[group[at]] = value[at]
    return out


def _reach(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)), 1)


def _exact(a: np.ndarray, c: np.ndarray) -> type:
    """The type in which inner products of ``a`` and ``c`` are exact."""
    most = a.shape[1] * _reach(a) * _reach(c) * 4
    if most >= 1 << 63:
        raise ValueError("scores would not fit in 64 bits")
    return np.float64 if most < 1 << 53 else np.int64


def qualified(anchors: np.ndarray, candidates: np.ndarray, allowed: np.ndarray, rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, candidate, score) of all pairs in ``allowed`` whose interval ``rule`` keeps to the end.

    rule(anchor, low, high) is given pairs and their intervals and tells which stay.
    """
    kind = _exact(anchors, candidates)
    bits = _reach(candidates).bit_length() + 1
    above, below = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    exact = anchors.astype(kind)
    i, j = np.nonzero(allowed)
    total = np.zeros(len(i), np.int64)
    for plane in range(bits - 1, -1, -1):
        weight = -(1 << plane) if plane == bits - 1 else 1 << plane
        if len(i) > _SPARSE * allowed.size:
            part = (exact @ (candidates >> plane & 1).astype(kind).T)[i, j].astype(np.int64)
        else:
            part = np.empty(len(i), np.int64)
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                part[at : at + (1 << 16)] = np.einsum("ij,ij->i", anchors[x], candidates[y] >> plane & 1)
        total += weight * part
        rest = (1 << plane) - 1
        stays = rule(i, total + rest * below[i], total + rest * above[i])
        i, j, total = i[stays], j[stays], total[stays]
    return i, j, total


class _Best:
    """The ``most`` best (score, then smallest id) of each of ``groups`` so far."""

    def __init__(self, groups: int, most: int):
        self.groups, self.most = groups, most
        self.group, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def least(self) -> np.ndarray:
        return _kth(self.group, self.score, self.most, self.groups)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, group))
        of = group[order]
        first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        rank = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
        kept = order[rank < self.most]
        self.group, self.score, self.ids = group[kept], score[kept], ids[kept]


def best_positives(anchor_ids, anchor_labels, anchors, parts, most: int = POSITIVES) -> _Best:
    """The best other rows of each anchor's label; parts: (ids, labels, integers) of candidates."""
    best = _Best(len(anchor_ids), most)
    for ids, labels, values in parts:
        least = best.least()

        def rule(i, low, high, least=least):
            return high >= np.maximum(least, _kth(i, low, most, len(least)))[i]

        allowed = (anchor_labels[:, None] == labels) & (anchor_ids[:, None] != ids)
        i, j, score = qualified(anchors, values, allowed, rule)
        best.add(i, score, ids[j])
    return best


def best_negatives(anchor_labels, anchors, scores, parts, most: int = NEGATIVES, low_part: int = LOW, high_part: int = HIGH) -> _Best:
    """For each anchor and each of its positives' ``scores`` (anchors x positives, _NONE: none), the best rows of other labels in the band below it; groups are anchor * positives + positive."""
    n, width = scores.shape
    best = _Best(n * width, most)
    for ids, labels, values in parts:
        least = best.least().reshape(n, width)

        def rule(i, low, high, least=least):
            stays = np.zeros(len(i), bool)
            for t in range(width):
                top = scores[i, t]
                some = (top != _NONE) & (100 * high >= low_part * top) & (100 * low <= high_part * top)
                sure = some & (100 * low >= low_part * top) & (100 * high <= high_part * top)
                stays |= some & (high >= np.maximum(least[:, t], _kth(i[sure], low[sure], most, n))[i])
            return stays

        i, j, score = qualified(anchors, values, anchor_labels[:, None] != labels, rule)
        for t in range(width):
            top = scores[i, t]
            band = (top != _NONE) & (100 * score >= low_part * top) & (100 * score <= high_part * top)
            best.add(i[band] * width + t, score[band], ids[j[band]])
    return best


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): rows that have an id, a label and only finite components, as floor(scale * x)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return rows.where("vec_id is not null and label is not null and x is not null").where(finite).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("bigint")).alias("q"))


def _pieces(batches, width: int):
    """The candidates of a task in blocks; all are held, as every file of anchors meets them."""
    out = []
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATE_ROWS):
            part = batch.slice(at, CANDIDATE_ROWS)
            out.append((part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), width)))
    return out


def _files(folder: str):
    """The tables of anchors, one at a time."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(ANCHOR_ROWS)


def _first(df: DataFrame, keys: list[str], score: str, ids: str, most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(ids))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchors=None, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label and embedding; ``anchors`` is the condition on
    vec_id and label of those to mine for (all, if none). For each anchor the
    ``positives`` best other rows of its label, and for each of them the
    ``negatives`` best rows of other labels whose score is from low to high
    hundredths of the positive's; higher scores first, ties by smaller vec_id.
    Rows without id, label or vector, or with a component that is null or not
    finite, take no part. Shorter vectors count as filled up with zeros, empty
    ones have score 0. Rows that repeat a vec_id stand for themselves as
    candidates, but never for an anchor of the same id; as an anchor that with the
    smallest label, then vector, stands for all. An empty table, an anchor
    without positives and a positive without negatives give no row. Components
    whose products would not fit in 64 bits raise. Other columns are ignored,
    whatever their names.
    """
    kept = cut(integer_vectors(rows, scale), "integers")
    width = kept.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    chosen = kept if anchors is None else kept.where(anchors)
    chosen = chosen.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("of"))
    asked = cut(chosen.select("vec_id", "of.label", "of.q"), "anchors")
    folder = asked._scratch

    def find_positives(batches):
        parts = _pieces(batches, width)
        for block in _files(folder) if parts else ():
            ids, labels = (block.column(k).to_numpy() for k in ("vec_id", "label"))
            best = best_positives(ids, labels, _matrix(block.column("q"), width), parts, positives)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[best.group], best.ids, best.score)], names=["anchor_id", "positive_id", "positive_score"])

    found = kept.mapInArrow(find_positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
    near = cut(_first(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    scores = near.groupBy("anchor_id").agg(F.reverse(F.sort_array(F.collect_set("positive_score"))).alias("scores"))
    scored = cut(asked.join(scores, asked["vec_id"] == scores["anchor_id"]).select("vec_id", "label", "q", "scores"), "scored")
    scored_folder = scored._scratch

    def find_negatives(batches):
        parts = _pieces(batches, width)
        for block in _files(scored_folder) if parts else ():
            ids, labels = (block.column(k).to_numpy() for k in ("vec_id", "label"))
            tops = np.full((len(ids), positives), _NONE, np.int64)
            for k, x in enumerate(block.column("scores").to_pylist()):
                tops[k, : len(x)] = x
            best = best_negatives(labels, _matrix(block.column("q"), width), tops, parts, negatives, low, high)
            own, t = np.divmod(best.group, positives)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[own], tops[own, t], best.ids, best.score)], names=["anchor_id", "positive_score", "negative_id", "negative_score"])

    below = kept.mapInArrow(find_negatives, "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    mined = cut(_first(below, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives), "negatives")
    discard(asked, scored, kept)
    return near.join(mined, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.q, c.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""
