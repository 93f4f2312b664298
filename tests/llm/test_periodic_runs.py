"""Periodic runs against brute force, and odd rows."""

import hashlib
import random
import zlib

import pytest

from lotwright.llm import periodic_runs
from lotwright.llm.queries import queries

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """Stretches by their definition: every period, every maximal stretch, smallest periods only."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            size = i - s + q
            part = words[s : s + size]
            if size >= max(least, 2 * q) and all(part[d:] != part[:-d] for d in range(1, q)):
                found.append((s, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_runs_by_definition():
    random.seed(5)
    for _ in range(400):
        n = random.randint(0, 80)
        words = [str(random.randrange(random.choice([1, 2, 3, 30]))) for _ in range(n)]
        for _ in range(random.randint(0, 3) if n else 0):
            a, p = random.randrange(n), random.randint(1, max(1, n // 3))
            for i in range(a + p, random.randint(a, n)):
                words[i] = words[i - p]
        least = random.choice([2, 5, 12])
        ids = [sorted(set(words)).index(w) for w in words]
        assert periodic_runs.runs_of(ids, least) == brute(words, least)
        texts = [" \t".join(words).encode(), None, b"", b"x " * 11, b"x " * 12, " ".join(words).encode()]
        got = periodic_runs.collapse(texts, least)
        assert got[0][0] == got[5][0] == brute(words, least)
        assert got[0][1].decode() == kept(words, brute(words, least))
        assert got[1] == got[2] == ([], b"") and got[4][0] == [(0, 12, 1)] and got[4][1] == b"x"
        assert bool(got[3][0]) == (least < 12)


def test_neighbouring_texts_stay_apart():
    line = b" ".join(b"w%d" % k for k in range(20))
    assert all(not r for r, _ in periodic_runs.collapse([line] * 50))
    # The same lines far apart in a text are no run, side by side they are.
    other = b" ".join(b"v%d" % k for k in range(300))
    assert periodic_runs.collapse([b" ".join([line, other, line])])[0][0] == []
    assert periodic_runs.collapse([b" ".join([other, line, line])])[0][0] == [(300, 40, 20)]


def test_very_long_texts():
    assert periodic_runs.collapse([b"a " * 150_000])[0] == ([(0, 150_000, 1)], b"a")
    once = b" ".join(b"w%d" % k for k in range(30_000))
    runs, text = periodic_runs.collapse([b" ".join([once] * 3)])[0]
    assert runs == [(0, 90_000, 30_000)] and text == once


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, runs string, collapsed int, score double"
    words = "one two three " * 5
    rows = [(1, words, None, 1, None), (1, words, "x", None, 0.5), (None, words, None, 1, 1.0), (2, None, None, 1, 1.0), (3, "", None, 1, 1.0), (None, None, None, None, None)]
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(
        [(1, [(0, 15, 3)], "one two three")] * 2 + [(0, [(0, 15, 3)], "one two three"), (2, [], ""), (3, [], ""), (0, [], "")]
    )
    assert periodic_runs.periodic_runs(spark.createDataFrame([], schema)).collect() == []


@pytest.fixture(scope="module")
def expected(spark):
    out = {}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words) if n < 3000 else None
        out[doc_id] = (words, runs)
    return out


def test_query(spark, expected):
    got = {r.doc_id: r for r in queries()["op11_periodic_runs"](spark, SF).collect()}
    assert got.keys() == expected.keys()
    seen = 0
    for doc_id, (words, runs) in expected.items():
        if runs is None:
            continue
        r = got[doc_id]
        assert r.n_runs == len(runs)
        if runs:
            seen += 1
            s, size, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, size, q, 1000 * size // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(words, runs).encode()).hexdigest()
    assert seen > 10
