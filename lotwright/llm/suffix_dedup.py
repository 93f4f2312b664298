"""Removal of long repeated byte strings by suffix arrays.

A string of LENGTH bytes that occurs twice has the same least hash of its
shorter substrings both times. So texts are cut into runs of windows with the
same least hash; runs whose hash occurs once are done, and the others' bytes
("contexts", counted once for each different one) are dealt to shards by that
hash. Each shard builds its suffix array by Larsson-Sadakane refinement and its
common prefixes by Kasai's method; neighbours with LENGTH bytes in common mark
repeated windows. Contexts of a hash that are too many for a shard are dealt to
several, whose sorted windows are merged by binary search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, table

LENGTH = 400
#: Bytes of the substrings hashed: a repeated window has a repeated substring.
GRAM = 200
#: Bytes of contexts in a shard, about.
SHARD_BYTES = 1_500_000
#: Windows of a run at most; longer runs (of one byte, say) are cut, so that no context outgrows a shard.
_RUN = 1 << 17
_BLOCK = 1 << 17
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict = {}


def _powers(base: int, n: int) -> np.ndarray:
    if (base, n) not in _POWERS:
        p = np.ones(n, dtype=np.uint64)
        at = 1
        while at < n:
            m = min(at, n - at)
            p[at : at + m] = p[:m] * np.uint64(pow(base, at, 1 << 64))
            at += m
        _POWERS[base, n] = p
    return _POWERS[base, n]


def _gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each substring of ``gram`` bytes, by differences of a polynomial's partial sums modulo 2**64."""
    n, most = len(codes), _BLOCK + 2 * LENGTH
    most = max(most, n)
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
    x ^= x >> np.uint64(29)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(x * _powers(_BASE, most)[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _powers(pow(_BASE, -1, 1 << 64), most)[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = h
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same least hash: hash, first and last start, and whether the hash may occur again in the run."""
    n = len(raw) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    values, firsts, agains = [], [], []
    codes = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, n, _BLOCK):
        h = _gram_hashes(codes[at : min(at + _BLOCK, n) + length - 1], gram)
        least = _sliding_min(h, length - gram + 1)
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        order = np.sort(h)
        twice = order[1:][order[1:] == order[:-1]]
        again = np.isin(least[first], twice) if len(twice) else np.zeros(len(first), bool)
        if values and values[-1][-1] == least[0]:
            # A run over the border of two blocks.
            agains[-1][-1] = True
            first, again = first[1:], again[1:]
        if len(first):
            values.append(least[first])
            firsts.append(first + at)
            agains.append(again)
    value, first = np.concatenate(values), np.concatenate(firsts)
    return value, first, np.append(first[1:] - 1, n - 1), np.concatenate(agains)


def cut_runs(value: np.ndarray, first: np.ndarray, last: np.ndarray, again: np.ndarray, most: int = 0) -> tuple[np.ndarray, ...]:
    """The runs, those of more than _RUN windows (or ``most``) in pieces; their windows stay apart, so counts do too."""
    most = most or _RUN
    pieces = (last - first) // most + 1
    if not len(pieces) or pieces.max() == 1:
        return value, first, last, again
    at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + at * most
    return np.repeat(value, pieces), begin, np.minimum(begin + most - 1, np.repeat(last, pieces)), np.repeat(again | (pieces > 1), pieces)


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of joined texts that end before ``ends``, each with an own end mark below all bytes.

    Larsson-Sadakane: positions are sorted by their first 7 symbols; then, in
    rounds that double the depth, only those in groups of equals by the group of
    the position that many symbols later, until all groups are single.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    left = ends[text] - np.arange(n)
    symbols = np.concatenate([codes.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    depth = 7
    for k in range(depth):
        key = (key << np.uint64(9)) | np.where(left > k, symbols[k : k + n], np.uint64(0))
    order = np.argsort(key, kind="stable")  # positions, and so texts, ascend among equals
    ordered, short = key[order], left[order] < depth
    # A suffix shorter than the depth holds its own end mark: it equals no other.
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | short[1:] | short[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    size = np.diff(np.append(np.flatnonzero(new), n))
    open_ = np.flatnonzero(np.repeat(size > 1, size))  # places in the order whose group isn't single
    while len(open_):
        at = order[open_]
        # Groups of equals have more than ``depth`` symbols left, or exactly so many: then the end mark decides.
        later = at + depth
        inside = left[at] > depth
        nxt = np.where(inside, rank[np.minimum(later, n - 1)] + len(ends), text[at])
        place = rank[at]
        by = np.argsort(place * (2 * n + len(ends) + 1) + nxt, kind="stable")
        at, place, nxt = at[by], place[by], nxt[by]
        order[open_] = at
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (nxt[1:] != nxt[:-1])])
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        open_ = open_[np.repeat(size > 1, size)]
        depth *= 2
    return order


def common_prefixes(codes: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int = LENGTH, lane: int = 1024) -> np.ndarray:
    """For each place in the suffix array, the symbols it shares with the place before, ``most`` at most.

    Kasai: along a text the common prefix with the own predecessor falls by at
    most one from a position to the next, so it is only ever extended. Texts, in
    lanes of ``lane`` positions, go side by side.
    """
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    starts = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - starts)
    stop = ends[text]
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
    eight = np.ascontiguousarray(eight).view("<u8").ravel()
    lanes = np.concatenate([np.arange(a, b, lane) for a, b in zip(starts, ends, strict=True)])
    limits = np.minimum(lanes + lane, stop[lanes])
    out = np.zeros(n, np.int32)
    held = np.zeros(len(lanes), np.int64)
    for step in range(int((limits - lanes).max())):
        alive = np.flatnonzero(lanes + step < limits)
        i = lanes[alive] + step
        j = before[i]
        h = np.maximum(held[alive] - 1, 0)
        h[j < 0] = 0
        room = np.minimum(np.minimum(stop[i] - i, np.where(j >= 0, stop[np.maximum(j, 0)] - j, 0)), most)
        go = np.flatnonzero(h < room)
        while len(go):
            a, b = i[go] + h[go], j[go] + h[go]
            differ = eight[a] ^ eight[b]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            h[go] = np.minimum(h[go] + same, room[go])
            go = go[(same == 8) & (h[go] < room[go])]
        held[alive] = h
        out[i] = h
    return out[order]


def repeated_windows(contexts: list[bytes], weights: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the contexts in the suffix array's order: context, start, class of equals, and whether the class weighs 2 or more."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    codes = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    order = suffix_array(codes, ends)
    shared = common_prefixes(codes, ends, order, length)
    of = np.repeat(np.arange(len(contexts)), sizes)
    group = np.cumsum(shared < length) - 1
    whole = ends[of[order]] - order >= length
    order, group = order[whole], group[whole]
    _, group = np.unique(group, return_inverse=True)
    owner = of[order]
    heavy = np.bincount(group, weights[owner]) >= 2 if len(group) else np.zeros(0, bool)
    return owner, order - (ends - sizes)[owner], group, heavy[group] if len(group) else heavy


def _cover(starts: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """The union of windows at sorted ``starts`` as intervals."""
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return starts[np.concatenate([[0], gap + 1])].tolist(), (starts[np.concatenate([gap, [len(starts) - 1]])] + length).tolist()


_SALTS = 32
_HOT = 2000
_SHARD_SCHEMA = "h bigint, c1 bigint, c2 bigint, lo array<int>, hi array<int>, slice int, digests binary, windows binary"
_WINDOW = np.dtype([("c1", "<i8"), ("c2", "<i8"), ("start", "<i4")])


def _shard(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Intervals of a shard's contexts; for one part of a hash's contexts also its sorted windows, in slices."""
    contexts = [bytes(c) for c in pdf["ctx"]]
    owner, start, group, repeated = repeated_windows(contexts, pdf["weight"].to_numpy(), length)
    rows = []
    h, c1, c2 = (pdf[c].to_numpy() for c in ("h", "c1", "c2"))
    o, s = owner[repeated], start[repeated]
    by = np.lexsort((s, o))
    o, s = o[by], s[by]
    edges = np.flatnonzero(np.diff(o)) + 1
    for part in np.split(np.arange(len(o)), edges) if len(o) else []:
        lo, hi = _cover(s[part], length)
        k = o[part[0]]
        rows.append((h[k], c1[k], c2[k], lo, hi, None, None, None))
    slices = int(pdf["parts"].iloc[0])
    if slices > 1:
        _, first = np.unique(group, return_index=True)
        o, s, done = owner[first], start[first], repeated[first]
        digest = np.array([xxhash.xxh3_128_digest(contexts[k][a : a + length]) for k, a in zip(o, s, strict=True)], dtype="S16")
        at = np.zeros(len(o), _WINDOW)
        at["c1"], at["c2"], at["start"] = c1[o], c2[o], np.where(done, -1, s)
        by = np.argsort(digest, kind="stable")
        digest, at = digest[by], at[by]
        to = np.frombuffer(digest.tobytes(), dtype=np.uint8).reshape(-1, 16)[:, :2].astype(np.int64) @ np.array([256, 1]) * slices >> 16
        for k in range(slices):
            mine = to == k
            if mine.any():
                rows.append((h[0], None, None, None, None, k, digest[mine].tobytes(), at[mine].tobytes()))
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    # Nulls beside integers of 64 bits must not make floats of them.
    kinds = {"h": "int64", "c1": "Int64", "c2": "Int64", "lo": object, "hi": object, "slice": "Int32", "digests": object, "windows": object}
    return pd.DataFrame({n: pd.Series(list(c), dtype=k) for (n, k), c in zip(kinds.items(), columns, strict=True)})


def _merge(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Windows of one slice that more than one part holds, found by binary search in all parts' sorted windows."""
    parts = [np.frombuffer(d, dtype="S16") for d in pdf["digests"]]
    every = np.sort(np.concatenate(parts))
    rows = []
    for mine, windows in zip(parts, pdf["windows"], strict=True):
        at = np.frombuffer(windows, dtype=_WINDOW)
        more = np.searchsorted(every, mine, "right") - np.searchsorted(every, mine, "left") > 1
        rows += [(pdf["h"].iloc[0], int(w["c1"]), int(w["c2"]), [int(w["start"])], [int(w["start"]) + length]) for w in at[more & (at["start"] >= 0)]]
    return pd.DataFrame(rows, columns=["h", "c1", "c2", "lo", "hi"]).astype({"h": "int64", "c1": "int64", "c2": "int64"})


def repeated_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, tie, lo, hi): intervals of the texts whose bytes a repeated window covers; docs: (doc_id, tie, text)."""

    def anchors(batches):
        for batch in batches:
            found = []
            for k, t in enumerate(batch.column(2).to_pylist()):
                value, first, last, again = cut_runs(*runs_of((t or "").encode("utf-8", "surrogatepass"), length, gram))
                if len(value):
                    found.append((np.full(len(value), k), value.view(np.int64), first, last, again))
            if found:
                k, value, first, last, again = (np.concatenate(x) for x in zip(*found, strict=True))
                own = [batch.column(c).take(pa.array(k)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(value), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(again)], names=["doc_id", "tie", "h", "first", "last", "again"])

    runs = cut(docs.select("doc_id", "tie", "text").mapInArrow(anchors, "doc_id bigint, tie bigint, h bigint, first int, last int, again boolean"), "runs")
    shared = cut(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("h", "n"), "shared")
    # Fewer than _HOT hashes can have more than 1 / _HOT of all runs each: these are broadcast, so no task gets a hot one whole.
    hot = F.broadcast(shared.where(F.col("n") * _HOT > runs.count()).select("h"))
    cold = runs.join(hot, "h", "left_anti").join(shared.select("h"), "h", "left_semi")
    wanted = runs.join(hot, "h", "left_semi").union(cold).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("h", "first", "last")).alias("runs"))

    def contexts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for k, (text, runs) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    raw = text.encode("utf-8", "surrogatepass")
                    # Rows that repeat a doc_id and a text hold each run as often as there are rows.
                    for h, first, last in {(r["h"], r["first"], r["last"]) for r in runs}:
                        ctx = raw[first : last + length]
                        rows.append((k, h, first, ctx, *np.frombuffer(xxhash.xxh3_128_digest(ctx), dtype="<i8").tolist()))
                if rows:
                    k, h, first, ctx, c1, c2 = zip(*rows, strict=True)
                    own = [part.column(c).take(pa.array(k)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(h), pa.array(first, pa.int32()), pa.array(ctx, pa.binary()), pa.array(c1), pa.array(c2)], names=["doc_id", "tie", "h", "first", "ctx", "c1", "c2"])

    met = docs.join(wanted, ["doc_id", "tie"]).select("doc_id", "tie", "text", "runs")
    found = cut(met.mapInArrow(contexts, "doc_id bigint, tie bigint, h bigint, first int, ctx binary, c1 bigint, c2 bigint"), "contexts")
    discard(runs, shared)
    different = cut(found.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("weight"), F.first("ctx").alias("ctx")), "different")
    total = different.agg(F.coalesce(F.sum(F.length("ctx")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    # Only hashes beyond one shard are joined back, and salted: one hash may have a large part of all contexts.
    large = different.groupBy("h").agg(F.sum(F.length("ctx")).alias("bytes")).where(F.col("bytes") > SHARD_BYTES)
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = different.withColumn("salt", F.pmod("c2", F.lit(_SALTS)).cast("int"))
    sized = salted.join(large, ["h", "salt"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("bytes") / SHARD_BYTES).cast("int"), F.lit(1)))
    sized = sized.withColumn("shard", F.when(F.col("parts") > 1, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards))))
    sized = sized.withColumn("part", F.when(F.col("parts") > 1, F.pmod("c1", "parts").cast("int") + 1).otherwise(0))
    sized = sized.withColumn("parts", F.when(F.col("parts") > 1, F.col("parts")).otherwise(1))
    done = cut(sized.groupBy("shard", "part").applyInPandas(lambda pdf: _shard(pdf, length), _SHARD_SCHEMA), "shards")
    discard(different)
    merged = done.where("slice is not null").groupBy("h", "slice").applyInPandas(lambda pdf: _merge(pdf, length), "h bigint, c1 bigint, c2 bigint, lo array<int>, hi array<int>")
    covered = done.where("slice is null").select("h", "c1", "c2", "lo", "hi").union(merged)
    placed = found.select("doc_id", "tie", "h", "first", "c1", "c2").join(covered, ["h", "c1", "c2"])
    placed = placed.select("doc_id", "tie", "first", F.explode(F.arrays_zip("lo", "hi")).alias("x"))
    return placed.select("doc_id", "tie", (F.col("first") + F.col("x.lo")).alias("lo"), (F.col("first") + F.col("x.hi")).alias("hi"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every document, ``kept`` its bytes without the removed ones.

    Texts are UTF-8 bytes, null ones empty. Every byte that a string of
    ``length`` bytes covers which also starts anywhere else goes, so of copies
    nothing stays, and rows that repeat a doc_id and text are copies. A text's
    intervals meet in one row, never more than it has bytes. Rows without a
    doc_id are told apart by their text. An empty table gives no row. Other
    columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("doc_id"), F.xxhash64("doc_id", "text").alias("tie"), "text")
    spans = repeated_intervals(keyed, length)
    spans = spans.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    joined = keyed.join(spans, ["doc_id", "tie"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text, spans in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    kept, here, n = [], 0, 0
                    for x in spans or ():
                        if n == 0 or x["lo"] > here:
                            kept.append(raw[here : x["lo"]])
                            n += 1
                        here = max(here, x["hi"])
                    kept = b"".join([*kept, raw[here:]])
                    rows.append((None if doc_id == -(1 << 62) else doc_id, len(raw), len(raw) - len(kept), n, kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op9(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
