"""Periodic runs of words by suffix automata.

Every state of a text's suffix automaton stands for strings that end at the same
places. Going from long states to short ones, the sets of end places are merged,
the smaller into the larger, in order. Two places that become neighbours in a
state, no farther apart than its longest string is long, end a square: the
string between them twice over. Each square is widened to the run that holds it.

Before that a sieve leaves out words that no run can hold, so that the automaton
is built only over stretches that repeat within themselves. In a run of period q
and at least max(12, 2 q) words both the part without its last q words and that
without its first q words have six words or more and are equal: every word of a
run lies in six words that come again within the run, at most half its length
away.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Words of a run, at least; words of the sieve's repeated strings are half as many.
LEAST_WORDS = 12
#: Bytes of text that are sieved together, about.
_TOGETHER = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of ``ids``: each state's longest length, its suffix link, and the place where its prefix ends (-1: not a prefix)."""
    follow, link, length, end = [{}], [-1], [0], [-1]
    last = 0
    for place, c in enumerate(ids):
        new, state = len(length), last
        follow.append({})
        link.append(0)
        length.append(place + 1)
        end.append(place)
        while state >= 0 and c not in follow[state]:
            follow[state][c] = new
            state = link[state]
        if state >= 0:
            to = follow[state][c]
            if length[to] > length[state] + 1:
                # ``to`` also stands for longer strings that don't end here: the shorter ones get a state of their own.
                long, to = to, len(length)
                follow.append(follow[long].copy())
                link.append(link[long])
                length.append(length[state] + 1)
                end.append(-1)
                link[long] = to
                while state >= 0 and follow[state].get(c) == long:
                    follow[state][c] = to
                    state = link[state]
            link[new] = to
        last = new
    return length, link, end


def squares(length: list[int], link: list[int], end: list[int]):
    """(end of the first half, distance, length of the state) of neighbours that a merge of end places makes.

    Sets hold places counted from the last word backwards: a prefix ends first
    at its own place, so that is put at the end of its state's set.
    """
    size = max(end) if end else -1
    sets: list[list[int] | None] = [None] * len(length)
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        here, reach = sets[state], length[state]
        if end[state] >= 0:
            own = size - end[state]
            if here is None:
                here = [own]
            else:
                if own - here[-1] <= reach:
                    yield end[state], own - here[-1], reach
                here.append(own)
        sets[state], up = None, link[state]
        if not up:
            continue
        there, reach = sets[up], length[up]
        if there is None:
            sets[up] = here
            continue
        if len(here) > len(there):
            here, there = there, here
        sets[up] = there
        for k, x in enumerate(here):
            at = bisect_right(there, x)
            if at and x - there[at - 1] <= reach:
                yield size - x, x - there[at - 1], reach
            # The next place is a neighbour unless one that is still to come lies before it.
            if at < len(there) and there[at] - x <= reach and (k + 1 == len(here) or here[k + 1] > there[at]):
                yield size - there[at], there[at] - x, reach
            if at == len(there):
                there.append(x)
            else:
                insort(there, x)


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading values are the same."""
    n, at, step = min(len(x), len(y)), 0, 16
    while at < n:
        differ = np.flatnonzero(x[at : min(at + step, n)] != y[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def runs_of(ids: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` and twice its period, by start, then period.

    Neighbours in a set have no other end place between them, so their distance
    is the smallest period of the square and of its run. Runs of one period
    overlap by less than it, so a square lies in one run only, and each run is
    widened once.
    """
    values, known = np.array(ids, dtype=np.int32), {}
    for a, d, reach in squares(*automaton(ids)):
        runs = known.setdefault(d, [])
        at = bisect_right(runs, (a - d + 1, len(ids))) - 1
        if at >= 0 and runs[at][1] >= a + d:
            continue
        low = a - reach + 1
        start = low - _agree(values[:low][::-1], values[: low + d][::-1])
        insort(runs, (start, a + d + _agree(values[a + 1 :], values[a + d + 1 :])))
    return sorted((s, e - s + 1, d) for d, runs in known.items() for s, e in runs if e - s + 1 >= least)


def stretches(codes: np.ndarray, owner: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Stretches (first, after the last) of words that may hold a run; owner: the text of each word.

    Words outside six (half of ``least``) that come again in the same stretch, at
    most half its length away, go, until that changes little. Equal hashes of
    different words only leave more in.
    """
    gram = least // 2
    at, part = np.arange(len(codes)), owner.astype(np.int64)
    while len(at) >= least:
        whole = np.flatnonzero(part[: len(part) - gram + 1] == part[gram - 1 :])
        first = at[whole]
        h = codes[first].copy()
        for k in range(1, gram):
            h = h * _ODD + codes[first + k]
        h = (h ^ (part[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * _ODD
        bits = max(16, int(len(h)).bit_length() + 3)
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        some = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
        some = some[np.argsort(h[some], kind="stable")]
        same = h[some[1:]] == h[some[:-1]]
        sizes = np.bincount(part)
        near = same & (2 * (whole[some[1:]] - whole[some[:-1]]) <= sizes[part[whole[some[1:]]]])
        again = np.zeros(len(at) + 1, np.int64)
        for held in (some[1:][near], some[:-1][near]):
            np.add.at(again, whole[held], 1)
            np.add.at(again, whole[held] + gram, -1)
        kept = np.flatnonzero(np.cumsum(again[:-1]) > 0)
        cuts = (np.diff(at[kept]) > 1) | (np.diff(part[kept]) != 0)
        piece = np.concatenate([[0], np.cumsum(cuts)]) if len(kept) else kept
        long = np.bincount(piece, minlength=1)[piece] >= least if len(kept) else np.zeros(0, bool)
        before, at = len(at), at[kept[long]]
        _, part = np.unique(piece[long], return_inverse=True)
        if len(at) > 0.9 * before:
            break
    if len(at) < least:
        return []
    edge = np.flatnonzero(np.diff(part)) + 1
    return list(zip(at[np.concatenate([[0], edge])].tolist(), (at[np.concatenate([edge - 1, [len(at) - 1]])] + 1).tolist(), strict=True))


def _texts(batch: pa.RecordBatch, column: int):
    """Slices of a batch with about _TOGETHER bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    group = sizes // _TOGETHER
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def collapse(texts: list[bytes | None], least: int = LEAST_WORDS) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """The runs of each text, and its words without those that any run holds after its first period."""
    split = [(t or b"").split() for t in texts]
    words = [w for s in split for w in s]
    starts = np.cumsum([0, *map(len, split)])
    owner = np.repeat(np.arange(len(split)), np.diff(starts))
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for a, b in stretches(codes, owner, least):
        seen: dict[bytes, int] = {}
        k = int(owner[a])
        found = runs_of([seen.setdefault(w, len(seen)) for w in words[a:b]], least)
        runs[k] += [(s + a - int(starts[k]), n, d) for s, n, d in found]
    out = []
    for mine, s in zip(runs, split, strict=True):
        if mine:
            mine.sort(key=lambda r: (r[0], r[2]))
            drop = np.zeros(len(s) + 1, np.int64)
            for start, n, d in mine:
                drop[start + d] += 1
                drop[start + n] -= 1
            s = [s[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
        out.append((mine, b" ".join(s)))
    return out


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, runs, collapsed) of every document.

    ``runs`` lists (start, length, period) of each stretch of words with smallest
    period ``period`` and at least max(``least``, 2 * period) words that no
    neighbouring word extends, by start, then period; words are what white space
    of ASCII parts, numbered from 0. ``collapsed`` joins by one space the words
    that no run holds after its first ``period`` words. Null and empty texts have
    no run and an empty ``collapsed``. Every row is treated alone: rows that
    repeat an id or a text, or have no id, keep their row; there are no ties to
    break. An empty table gives no row. Texts of any length are read whole.
    Other columns are ignored, whatever their names.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in _texts(batch, 1):
                found = collapse(part.column(1).to_pylist(), least)
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in mine] for mine, _ in found], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), runs, pa.array([t for _, t in found], pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one text in ten, by the id's crc32, gets a periodic end made of its own words; a null id counts as the empty text."""

    def run(batches):
        for batch in batches:
            for part in _texts(batch, 1):
                texts = part.column(1).to_pylist()
                for k, h in enumerate(part.column(2).to_pylist()):
                    words = (texts[k] or b"").split() if h % 10 == 0 else []
                    if words:
                        n, g = len(words), h // 10
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        once = words[a : a + p]
                        tail = (once * -(-(n - a) // p))[: n - a]
                        texts[k] = b" ".join(words[:a] + tail)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), h.alias("h"))
    return kept.mapInArrow(run, "doc_id bigint, text string")


def op11(spark, sf_dir):
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    top = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("top"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    milli = F.expr("1000 * top.length div (-top.period)")
    return top.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
