"""The operators on small tables: brute force, and odd rows."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwright.llm import components, decontaminate, html_text, language_id, poisson_mix, quality, simhash, suffix_dedup, token_files, toxicity, weighted_sampling
from lotwright.llm.common import scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, rate double"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    words = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    rows = [
        (5, "the same text of several words here", "en", "a"),
        (3, "the same text of several words here", "en", "a"),
        (3, "the same text of several words here", "en", "a"),
        (7, None, None, None),
        (None, "a text without an id", "en", "b"),
        (None, None, None, "b"),
        (2, "", "en", "b"),
        (9, " \n\t", None, "b"),
        (11, words, "en", "b"),
        (12, "1234 !!", "en", "b"),
    ]
    return spark.createDataFrame([(*r, 0, 0.5, 1, 2.0) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500 + k, 501 + k) for k in range(40)] + [(900, k) for k in range(600, 640)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked if find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("limit", [2, 24])
@pytest.mark.parametrize("radius", [1, 2])
def test_near_links(spark, monkeypatch, limit, radius):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    rng = np.random.default_rng(limit)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 30)}
    for x in list(fps)[:6]:
        for _ in range(12):
            x ^= 1 << int(rng.integers(64))
            fps.add(x)
    fps = sorted(fps)
    place = {simhash._signed(x): k for k, x in enumerate(fps)}
    edges = simhash.near_links(spark.createDataFrame([(x,) for x in place], "fp bigint"), radius)
    edges = spark.createDataFrame([(place[r.a], place[r.b]) for r in edges.collect()], "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius:
                    label[i] = min(label[i], label[j])
    assert [got.get(k, k) for k in range(len(fps))] == label


def test_simhash_odd(odd, none):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == 10
    same = got[got.doc_id.isin([3, 5])]
    assert (same.component_id == 3).all() and (got[got.fp == 0].component_id == 2).all()
    assert got[got.doc_id.isin([11])].component_id.tolist() == [11] and (got[got.doc_id.isna() & (got.fp != 0)].component_id.isna()).all()
    assert simhash.near_duplicates(none).count() == 0


def test_rows_without_an_id_carry_links(spark, monkeypatch):
    marks = {"a": 0b0, "b": 0b11, "c": 0b1111, "d": 0x7F << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: docs.select("doc_id", F.col("fp")))
    rows = [(1, marks["a"]), (None, marks["b"]), (2, marks["c"]), (9, marks["d"])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, fp bigint")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (None, 1), (2, 1), (9, 9)}


def test_simhash_query_by_brute_force(spark):
    got = {r.doc_id: r for r in simhash.op10(spark, SF).collect()}
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    fps = {int(d): simhash.simhash(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    label = {d: d for d in fps}
    for _ in fps:
        before = dict(label)
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    label[a] = min(label[a], label[b])
        if label == before:
            break
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fps[d]:016x}", label[d]) for d in fps}


def _jaccard(a, b):
    a, b = ({w: x.count(w) for w in x} for x in (a.split(), b.split()))
    den = sum(max(a.get(w, 0), b.get(w, 0)) for w in a.keys() | b.keys())
    return sum(min(a.get(w, 0), b.get(w, 0)) for w in a.keys() | b.keys()) / den if den else 1.0


def test_weighted_sampling(spark):
    got = weighted_sampling.op1(spark, SF).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ascending=False).reset_index(drop=True)
    assert len(got) == len(docs)
    errors = []
    for k, d in docs.iterrows():
        nxt = docs.text[(k + 1) % len(docs)]
        h = len(d.text) // 2
        edited = d.text[: len(d.text) - h] + nxt[:h]
        r = got.loc[d.doc_id]
        assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - _jaccard(d.text, edited), r.near_next - _jaccard(d.text, nxt)]
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.12
    assert docs.groupby("text").doc_id.apply(lambda ids: got.loc[ids].fingerprint.nunique()).max() == 1


def test_weighted_sampling_odd(spark, odd, none, tmp_path):
    odd.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = weighted_sampling.op1(spark, str(tmp_path)).toPandas()
    assert len(got) == 10 and got.near_next.between(0, 1).all()
    assert (got[got.n_chars == 0].fingerprint == "").all()
    none.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert weighted_sampling.op1(spark, str(tmp_path / "none")).count() == 0


def test_token_files(spark, docs, odd, none):
    encoder = token_files.WordEncoder(token_files.vocabulary_path())
    for table in (docs, odd):
        folder = scratch(spark, "test-tokens")
        shards = token_files.write_sequences(table, folder, token_files.vocabulary_path(), length=64)
        got = token_files.read_documents(spark, folder, shards).orderBy("start").toPandas()
        want = table.withColumn("t", F.coalesce("text", F.lit(""))).withColumn("x", F.xxhash64("t")).orderBy("doc_id", "x").toPandas()
        assert got.doc_id.fillna(-1).tolist() == want.doc_id.fillna(-1).tolist()
        ids = [[*e.ids, 1] for e in encoder.tokenizer.encode_batch(want.t.tolist(), add_special_tokens=False)]
        assert got.n_tokens.tolist() == [len(x) for x in ids]
        assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
        flat = []
        for _, _, n, name in shards:
            file = token_files.SequenceFile(folder, name)
            own = [file.sequence(i) for i in range(len(file))]
            assert all(len(s) == len(m) == 64 for s, m in own)
            flat += [int(v) for s, m in own for v in s[m]]
            assert sum(int(m.sum()) for _, m in own) == n
        assert flat == [v for x in ids for v in x]
    assert token_files.read_documents(spark, "file:///nowhere", []).count() == 0
    assert token_files.write_sequences(none, scratch(spark, "test-none"), token_files.vocabulary_path()) == []


def test_poisson_mix(spark, docs, odd, none):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(poisson_mix.OP6_SQL).df()
    got = poisson_mix.op6(spark, SF).toPandas()
    key = ["doc_id", "copy"]
    assert got.sort_values(key)[want.columns].reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True))
    mixed = poisson_mix.poisson_mix(odd, {"a": 1.0}, total=900.0)
    assert {r.source for r in mixed.collect()} == {"a"} and "rate_" in mixed.columns
    assert poisson_mix.poisson_mix(odd).count() > 0 and poisson_mix.poisson_mix(none).count() == 0
    names = ["_u", "_rate", "_cdf", "mix_cdf", "mix_rate", "mix_draw", "copy", "shuffle_key"]
    clashing = odd.select("*", *[F.lit(n).alias(n) for n in names])
    found = poisson_mix.poisson_mix(clashing)
    assert found.count() == poisson_mix.poisson_mix(odd).count() and all(r[n] == n for r in found.limit(5).collect() for n in names)


def test_poisson_mix_large_rate_and_salted_join(spark, monkeypatch):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.lit("s").alias("source"))
    counts = poisson_mix.poisson_mix(many, total=40.0).groupBy("doc_id").count().toPandas()["count"]
    assert counts.mean() == pytest.approx(40, rel=0.02) and counts.var() == pytest.approx(40, rel=0.1)
    broadcast = sorted((r.doc_id, r.copy) for r in poisson_mix.poisson_mix(many).collect())
    monkeypatch.setattr(poisson_mix, "BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.copy) for r in poisson_mix.poisson_mix(many).collect()) == broadcast


@pytest.mark.parametrize("shard", [3000, 1_500_000])
def test_suffix_dedup(spark, monkeypatch, docs, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    # With 20 most hashes are joined as cold ones, with 2000 as hot ones.
    monkeypatch.setattr(suffix_dedup, "_HOT", 20 if shard < 1_000_000 else 2000)
    rng = np.random.default_rng(1)
    line = rng.integers(97, 123, 450, dtype=np.uint8).tobytes().decode()
    noise = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    rows = [(k, noise(int(rng.integers(5, 900))) + line + noise(300)) for k in range(60)]
    rows += [(100, "ab" * 350), (101, None), (102, ""), (103, "é" * 500), (104, rows[0][1]), (104, rows[0][1]), (None, noise(500)), (105, line[:399])]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    raws = [(k, (t or "").encode()) for k, t in rows]
    seen = {}
    for _, raw in raws:
        for i in range(len(raw) - 399):
            seen[raw[i : i + 400]] = seen.get(raw[i : i + 400], 0) + 1
    for k, raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 399):
            if seen[raw[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(raw), int(gone.sum()), spans, kept)


def test_suffix_dedup_odd(spark, monkeypatch, odd, none):
    got = suffix_dedup.remove_repeats(odd).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode())) for r in odd.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes) for r in got) == want
    assert all(r.n_removed == 0 and len(r.kept) == r.n_bytes for r in got if r.doc_id != 11)
    assert suffix_dedup.remove_repeats(none).count() == 0
    # A long run of one byte, cut into several contexts.
    monkeypatch.setattr(suffix_dedup, "_RUN", 500)
    rows = spark.createDataFrame([(1, "a" * 5000 + "b"), (2, "c" * 400), (3, "c" * 399), (None, "d" * 800), (None, "e" * 399)], "doc_id bigint, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(rows).collect())
    assert got == [(399, 0, 0), (399, 0, 0), (400, 0, 0), (800, 800, 1), (5001, 5000, 1)]


def test_decontamination(spark, docs, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy(F.length("text").desc()).first()
    words = item.text.split()
    less = " ".join(w for k, w in enumerate(words) if k % 9 != 4)
    planted = spark.createDataFrame([(10_001, "Before it. " * 9 + item.text + " after it" * 9), (10_002, less), (10_003, None), (10_004, "")], "doc_id bigint, text string")
    found = decontaminate.contaminated(docs.select("doc_id", "text").union(planted), bench).collect()
    hits = {(r.doc_id, r.item_id) for r in found}
    assert {(10_001, item.item_id), (10_002, item.item_id)} <= hits
    texts = {r.doc_id: decontaminate.words_of(r.text) for r in docs.collect()}
    items = {r.item_id: decontaminate.words_of(r.text) for r in bench.collect()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    own = {i: grams(w) for i, w in items.items()}
    want = {(d, i) for d, w in texts.items() for i, g in own.items() if g and len(g & grams(w)) > 0.8 * len(g)}
    assert {h for h in hits if h[0] < 10_000} == want
    assert sorted(map(str, decontaminate.without_contaminated(odd, bench).collect())) == sorted(map(str, odd.collect()))
    for a, b in ((none, bench), (odd, none.withColumn("item_id", F.col("doc_id")))):
        assert decontaminate.contaminated(a, b).count() == 0


def test_labelled_scores(spark, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    root = "/root/testdata/sf0.01"
    for name, f, column, least in (("toxic", toxicity.op2, "toxic", 0.95), ("quality", quality.op4, "quality", 0.95)):
        got = f(spark, root).toPandas().merge(marks, on="doc_id")
        held = got[got.held_out]
        assert (held.predicted == held[column]).mean() > least, name
    model = toxicity.fit(none.select("doc_id", "text", F.lit(1).alias("label")))
    assert toxicity.score(odd, *model).count() == 10 and toxicity.score(none, *model).count() == 0
    empty = quality.fit(none.select("doc_id", "text", F.lit(1).alias("label")))
    scored = quality.score(odd, empty)
    assert scored.count() == 10 and scored.columns == [*odd.columns, "score_"]
    assert {(r.score, r.score_) for r in scored.where("doc_id in (2, 7, 9)").collect()} == {(0.5, 0.0)}
    kept = quality.accepted(odd, none, labels)
    assert kept.columns == odd.columns and {r.score for r in kept.collect()} == {0.5} and kept.count() == 6
    assert quality.score(none, empty).count() == 0 and labels.count() > 0 and docs.count() > 0


def test_language_id(spark, odd, none):
    got = language_id.op8(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    held = got.merge(docs, on="doc_id")
    held = held[held.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    pieces = language_id.vocabulary()
    languages, probs = language_id.learn(odd, pieces)
    found = {r.doc_id: r.lang_pred for r in language_id.identify(odd, languages, probs, pieces).collect()}
    assert languages == ["en"] and found[7] == found[2] == found[9] == found[12] == "und" and found[5] == "en"
    languages, probs = language_id.learn(none, pieces)
    assert {r.lang_pred for r in language_id.identify(odd, languages, probs, pieces).collect()} == {"und"}


def test_pages(spark):
    rows = [(1, "u", "<article><p>x</p></article>", 3), (1, "u", "<article><p>x</p></article>", 3), (None, None, None, None), (2, "", "", 0)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")).toPandas()
    assert sorted(zip(got.text, got.n_chars, strict=True)) == [("", 0), ("", 0), ("x", 1), ("x", 1)]
    assert html_text.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    kept = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        if name != "tokens":
            assert out.columns == kept.columns
            rows = out.toPandas()
            kept = spark.createDataFrame(rows, out.schema)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == len(rows)


def test_pipeline_odd(spark, odd, none):
    """Every stage on rows with nulls, repeats, long texts and clashing names, and on an empty table."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        rows = out.collect()
        if name == "tokens":
            assert len(rows) == 10 and sum(r.doc_id is None for r in rows) == 2
            continue
        assert out.columns == odd.columns, name
        if name == "quality":
            assert all((r.text or "").strip() and r.score == 0.5 for r in rows)
        if name == "near_dedup":
            assert sorted((str(r.doc_id) for r in rows)) == ["11", "12", "2", "3", "None"]
        if name == "decontamination":
            assert len(rows) == 10
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_near_duplicates_broadcasts_nothing(spark):
    """Broadcasts are held by the driver: fingerprints and components must not reach it, however small their files."""
    docs = spark.createDataFrame([(k, f"one two three {k // 2}") for k in range(40)], "doc_id bigint, text string")
    plan = simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)], "a bigint, b bigint")
    found = components.connected_components(edges).collect()
    assert sorted((r["node"], r["component"]) for r in found) == [(k, 0) for k in range(1, 21)]
