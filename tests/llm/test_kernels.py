"""The operators' kernels against brute force."""

import collections
import random

import numpy as np
import pytest
import xxhash

from lotwright.llm import decontaminate, html_text, language_id, quality, simhash, suffix_dedup, token_files, toxicity


def test_simhash_by_definition():
    random.seed(1)
    texts = ["", None, " \t\n", "one", "one two", "A b C d", "ä Ä ß", "x " * 50, " ".join(random.choice("abcdefg") for _ in range(40_000))]
    for t in texts:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.simhash(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_suffix_array_and_common_prefixes():
    random.seed(3)
    for _ in range(40):
        texts = [bytes(random.choice(b"ab\x00") for _ in range(random.randint(1, 60))) for _ in range(random.randint(1, 6))]
        if random.random() < 0.5:
            texts += [texts[0], b"ab" * 40]
        ends = np.cumsum([len(t) for t in texts])
        codes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        starts = np.concatenate([[0], ends[:-1]])

        def suffix(p, texts=texts, ends=ends, starts=starts):
            k = int(np.searchsorted(ends, p, "right"))
            return [c + 1000 for c in texts[k][p - starts[k] :]] + [k]

        order = suffix_dedup.suffix_array(codes, ends)
        assert order.tolist() == sorted(range(len(codes)), key=suffix)
        shared = suffix_dedup.common_prefixes(codes, ends, order, 10**6, lane=random.choice([7, 1024]))
        for r in range(1, len(order)):
            a, b = suffix(order[r])[:-1], suffix(order[r - 1])[:-1]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[r] == n


def test_runs_share_a_hash_wherever_a_window_repeats():
    rng = np.random.default_rng(0)
    common = rng.integers(97, 105, 60, dtype=np.uint8).tobytes()
    texts = [rng.integers(97, 105, n, dtype=np.uint8).tobytes() + common + rng.integers(97, 105, 30, dtype=np.uint8).tobytes() for n in (0, 5, 400)]
    at = {}
    for k, t in enumerate(texts):
        value, first, last, _ = suffix_dedup.runs_of(t, 40, 20)
        for v, a, b in zip(value, first, last, strict=True):
            for s in range(a, b + 1):
                at.setdefault(t[s : s + 40], set()).add(int(v))
        assert first[0] == 0 and last[-1] == len(t) - 40 and (first[1:] == last[:-1] + 1).all(), k
    assert all(len(v) == 1 for v in at.values())


def test_encoder_equals_the_tokenizer():
    encoder = token_files.WordEncoder(token_files.vocabulary_path())
    assert encoder.by_part
    random.seed(1)
    signs = "aZé1² ½'s't_<|endoftext|> ́Σς中 \x1c\x85\xa0İ!-&\U0001f600ǅ\n\t٣٤"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    texts += ["", "<|endoftext|> x a<|startoftext|>b", "I'm you're IT'S 'S", "é e ́", "x" * 5000, "Ab, ab! AB"]
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):  # the second time from the caches
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [e.ids for e in want]


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4, "▁ab": 5}
    probs = np.random.default_rng(0).random((8, 2))
    probs[-1] = 0

    def total(w, k):
        if not w:
            return 1.0
        return sum(probs[pieces.get(w[:n], 6), k] * total(w[n:], k) for n in range(1, len(w) + 1) if w[:n] in pieces or n == 1)

    words = ["ab", "aab", "b", "abc"]
    got = language_id.forward(words, pieces, probs)
    assert got == pytest.approx(np.log([[total("▁" + w, k) for k in range(2)] for w in words]))


def test_trained_pieces_are_a_distribution():
    _, probs = language_id.train({"x": {"aba": 5, "ab": 3}, "y": {"cc": 2}}, {"▁": 0, "ab": 1, "a": 2, "b": 3, "c": 4})
    assert probs.sum(axis=0) == pytest.approx([1, 1])


def test_attention_gradients():
    rng = np.random.default_rng(2)
    net = quality.Network(np.zeros(quality.MEASURES), np.ones(quality.MEASURES))
    x, first, y = rng.normal(size=(9, quality.MEASURES)), np.array([0, 2, 7]), np.array([1.0, 0, 1])
    sparse = np.repeat(np.arange(9), 3), rng.integers(0, 5, 27), rng.random(27)

    def loss():
        z = net.forward(x, net.embed(9, *sparse), first)[0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for name, g in net.gradients(x, sparse, first, y).items():
        at = (sparse[1][4], 2) if name == "E" else tuple(0 for _ in g.shape)
        keep = net.p[name].copy()
        values = []
        for step in (1e-5, -1e-5):
            net.p[name] = keep.copy()
            net.p[name][at] += step
            values.append(loss())
        net.p[name] = keep
        assert g[at] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-6)


def test_passages_of_odd_texts():
    assert quality.passages(None) == quality.passages(" \n ") == []
    for t in ("a", "a " * 64, "a " * 65 + "\n\n", " x", "é" * 3000):
        (p,) = quality.passages(t)
        assert p.count == len(p.measures) == -(-len(t.split()) // 64) and np.isfinite(p.measures).all()


def test_long_texts_have_the_passages_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    text = "  " + " ".join("x" * int(n) for n in rng.integers(1, 40, 3000)) + " \n"
    (whole,) = quality.passages(text)
    monkeypatch.setattr(quality, "_PART", 5000)
    parts = quality.passages(text)
    table = rng.random((quality.BUCKETS, 3))
    assert len(parts) > 5 and np.concatenate([p.embedded(table) for p in parts]) == pytest.approx(whole.embedded(table))
    assert np.concatenate([p.measures[:, 10:] for p in parts]) == pytest.approx(whole.measures[:, 10:])


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    net = quality.Network(rng.normal(size=quality.MEASURES), rng.random(quality.MEASURES) + 0.5)
    texts = ["Some words, a few.", None, "x " * 200, "", "Été 12 | 13 !! " * 30, "y" * 300]
    for text, got in zip(texts, quality.scores_of(net, texts), strict=True):
        words = (text or "").encode().lower().split()
        if not words:
            assert got == 0
            continue
        ((part,), p, h) = quality.passages(text), net.p, []
        x, at = part.measures, [*part.word_at.tolist(), len(words)]
        same = {}
        for w, b in zip(words, part.words.tolist(), strict=True):
            assert same.setdefault(w, b) == b
        grams = [*part.gram_at.tolist(), len(part.grams)]
        assert len(part.grams) == sum(map(len, words)) and [g - sum(map(len, words[:a])) for g, a in zip(grams, at, strict=True)] == [0] * len(at)
        for k in range(len(x)):
            own = (p["E"][part.words[at[k] : at[k + 1]]].mean(0) + p["E"][part.grams[grams[k] : grams[k + 1]]].mean(0)) / 2
            h.append(np.tanh(np.concatenate([(x[k] - net.mean) / net.sd, own]) @ p["W"] + p["b"]))
        e = np.exp([(np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"] for v in h])
        z = sum(a * v for a, v in zip(e / e.sum(), h, strict=True)) @ p["c"] + p["d"][0]
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_label_model_corrects_labels_and_learns_from_unlabelled_rows():
    rng = np.random.default_rng(0)
    truth = (rng.random(3000) < 0.2).astype(int)
    voters = [np.where(truth == 1, rng.random(3000) < on, rng.random(3000) < off) for on, off in ((0.7, 0.01), (0.6, 0.02), (0.5, 0.01), (0.6, 0.02), (0.1, 0.1))]
    fired = np.column_stack([*voters, voters[0]]).astype(np.uint8)  # the last one copies the first
    gold = np.where(rng.random(3000) < 0.03, 1 - truth, truth)
    gold[1500:] = toxicity.UNLABELLED
    post, on, off, rates = toxicity.label_model(fired, gold)
    known = gold != toxicity.UNLABELLED
    wrong = known & (gold != truth)
    assert ((post > 0.5) == truth)[wrong].mean() > 0.6 > (gold == truth)[wrong].mean()
    assert np.abs(post - gold)[known].max() > 0.5 and ((post > 0.05) & (post < 0.95)).any()
    assert ((post > 0.5) == truth)[~known].mean() > 0.95
    assert on[0] == pytest.approx(0.7, abs=0.06) and off[0] == pytest.approx(0.01, abs=0.02)
    assert 0.9 < rates[0] < 1 and 0 < rates[1] < 0.1
    w, b = toxicity.linear_classifier(fired.astype(float), post)
    assert w[0] + w[5] > 1 > abs(w[4]) and b < 0


def test_shouting_is_heard_anywhere():
    start = "some quiet words " * 200
    for text, want in ((start + "STOP THAT NOW " * 20, 1), ("1234 " * 500 + "STOP THAT NOW " * 20, 1), (start + "STOP THAT NOW " * 10, 0), ("STOP it " * 60, 0), ("中文 字 " * 60, 0)):
        assert toxicity.votes(text, {})[len(toxicity.LEXICONS)] == want


def test_long_words_are_summed_whole():
    pieces = language_id.vocabulary()
    rng = np.random.default_rng(3)
    probs = rng.random((len(pieces) + 2, 3)) * 1e-3
    probs[-1] = 0
    words = ["ab" * 20, "donaudampfschifffahrtsgesellschaft", "straße"]
    together = language_id.forward(words, pieces, probs)
    assert together == pytest.approx(np.array([language_id._forward_long(w, pieces, probs) for w in words]))
    long = "internationalisierung" * 300
    most = language_id.longest(pieces)
    alpha = [np.zeros(3)]
    for j in range(1, len(long) + 2):
        w = "▁" + long
        own = [alpha[j - n] + np.log(probs[pieces.get(w[j - n : j], len(pieces))]) for n in range(1, min(j, most) + 1) if n == 1 or w[j - n : j] in pieces]
        alpha.append(np.logaddexp.reduce(own))
    assert language_id.forward([long], pieces, probs)[0] == pytest.approx(alpha[-1])
    assert language_id.words_of(long + " x") == [long, "x"]


def test_long_runs_are_cut():
    value, first, last, again = np.array([5, 6], np.uint64), np.array([0, 10]), np.array([9, 40]), np.array([False, False])
    got = suffix_dedup.cut_runs(value, first, last, again, 12)
    assert [x.tolist() for x in got] == [[5, 6, 6, 6], [0, 10, 22, 34], [9, 21, 33, 40], [False, True, True, True]]


def test_heaviest_common_subsequence():
    random.seed(5)
    for _ in range(50):
        a, b = (np.array([random.randint(1, 5) for _ in range(random.randint(1, 7))]) for _ in range(2))
        weight = np.array([0, 1, 2.5, 0.5, 3, 1.5])
        best = collections.defaultdict(float)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + (weight[a[i]] if a[i] == b[j] else 0))
        assert decontaminate.common_weight(a, b, weight) == pytest.approx(best[len(a) - 1, len(b) - 1] / weight[a].sum())


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\nb"),
        ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; u</h1><p>One\n  two &lt;3.</p></article><footer>f</footer></body></html>", "T & u\nOne two <3."),
        ("<body><div class='cookie-notice'>We use</div><main><h1>T</h1><p>Some longer text here.</p><aside>no</aside><form>f<input></form></main></body>", "T\nSome longer text here."),
        ("<article><p>Text of it.</p><div id='comments'><p>I think so too, very much so.</p></div><script>x</script></article>", "Text of it."),
        ("<article><p><b>Bold start.<br><p>Next one.</article>", "Bold start.\nNext one."),
        ("<script>only()</script><style>p{}</style>", ""),
    ],
)
def test_main_text(page, want):
    assert html_text.extract(page) == want


def test_parser_takes_anything():
    random.seed(2)
    bits = ["<p>", "</p>", "<div", ">", "<", "</", "a", "&amp", "<!--", "-->", "<b>", "</div>", '"', "<script>", "</script>", "<br/>", "<li>", "<td>", "<table>", "\n"]
    for _ in range(500):
        html_text.extract("".join(random.choice(bits) for _ in range(30)))
    html_text.extract("<div>" * 20_000 + "x")
