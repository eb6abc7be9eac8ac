"""The trained models against slow forms of themselves."""

import itertools

import numpy as np

from lodestone.llm import common, pii, quality


def naive_score(net, text):
    """The network's probability of one text, a chunk and a position at a time."""
    p, half = net.p, quality.HALF
    n = max(1, -(-len(text) // (4 * half)))

    def top(k):
        best = np.zeros(quality.FILTERS)
        for j in range(half):
            at = 4 * (k * half + j)
            if at - 4 * k * half >= max(len(text) - 4 * k * half, 1):
                continue
            eight = [text[i] if i < len(text) else 0 for i in range(at, at + 8)]
            e = p["emb"][eight].astype(np.float64)
            best = np.maximum(best, e[:4].ravel() @ p["w1"] + e[4:].ravel() @ p["w2"] + p["b"])
        return best

    tops = [top(k) for k in range(n)]
    chunks = [np.maximum(a, b) for a, b in itertools.pairwise(tops)] or tops
    z = np.concatenate([np.max(chunks, 0), np.mean(chunks, 0)])
    h = np.maximum(z @ p["v"] + p["c"], 0)
    return 1 / (1 + np.exp(-np.clip(h @ p["u"] + p["d"], -30, 30)))[0]


def some_texts():
    r = np.random.default_rng(2)
    return [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 4, 7, 255, 256, 257, 259, 260, 512, 700, 1300)]


def offsets(texts):
    return np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def test_forward_pass_is_the_naive_one():
    net, texts = quality.Network(3), some_texts()
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), offsets(texts), at_once=3)
    assert np.allclose(got, [naive_score(net, t) for t in texts], atol=1e-5)
    assert net.score(np.zeros(0, np.uint8), np.array([0, 0])).shape == (1,)


def test_gradient_is_the_slope():
    net, texts = quality.Network(5), some_texts()[4:]
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    buf, y, weight = np.frombuffer(b"".join(texts), np.uint8), np.arange(len(texts)) % 2, np.linspace(0.5, 1.5, len(texts))
    _, at, end, first = quality.places(offsets(texts))
    grid, live = quality.halves(buf, at, end)

    def loss():
        prob = net.head(net.pooled(grid, live), first)[0]
        return -(weight * np.log(np.where(y == 1, prob, 1 - prob))).mean()

    slope, r = net.step(grid, live, first, y, weight), np.random.default_rng(1)
    for k, v in net.p.items():
        flat, g = v.reshape(-1), np.asarray(slope[k]).reshape(-1)
        for i in r.choice(len(flat), min(12, len(flat)), replace=False):
            was, eps = flat[i], 1e-6
            flat[i] = was + eps
            up = loss()
            flat[i] = was - eps
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * eps) - g[i]) < 1e-4, (k, i)


def chain_score(emit, move, path):
    return sum(emit[t, y] for t, y in enumerate(path)) + move[0, path[0]] + sum(move[a, b] for a, b in itertools.pairwise(path)) + move[path[-1], 0]


def test_viterbi_finds_the_best_of_all_labellings():
    r = np.random.default_rng(6)
    k, sizes = 4, [1, 3, 5, 2, 4]
    move = r.standard_normal((k, k))
    field = pii.Field(np.zeros((1, k)), move)
    emit = [r.standard_normal((n, k)) for n in sizes]
    got = field.decode(np.concatenate(emit), np.repeat(np.arange(len(sizes)), sizes))
    at = 0
    for e, n in zip(emit, sizes):
        best = max(itertools.product(range(k), repeat=n), key=lambda path: chain_score(e, move, path))
        assert tuple(got[at : at + n]) == best
        at += n


def test_training_raises_the_likelihood_of_the_table():
    """Of the labels by enumeration over a few short sentences, after few and after more steps."""
    table = [[("10.0.0.1", "B-ip"), ("at", "O")], [("a@b.co", "B-email")], [("see", "O"), ("+1", "B-phone"), ("555-1234", "I-phone")]]

    def likelihood(field):
        total = 0.0
        for row in table:
            raw = np.frombuffer(" ".join(t for t, _ in row).encode(), np.uint8)
            s, e = common.word_spans(raw, np.array([0, len(raw)]), common.NON_SPACE)
            f, pad = pii.shapes(raw, s, e), pii._OFFSET[:-1][None]
            emit = field.emissions(f, np.concatenate([pad, f[:-1]]), np.concatenate([f[1:], pad])).astype(np.float64)
            truth = tuple(pii.LABELS.index(y) for _, y in row)
            every = [chain_score(emit, field.move, p) for p in itertools.product(range(len(pii.LABELS)), repeat=len(row))]
            total += chain_score(emit, field.move, truth) - np.logaddexp.reduce(every)
        return total

    few, more = (likelihood(pii.train(table, n)) for n in (2, 40))
    assert more > few and more > -1


def test_added_spans_never_meet_base_ones():
    r = np.random.default_rng(8)
    pieces = ["a@b.co", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "123-45-6789", "x", "12.", "é@x.com", "(7)"]
    for _ in range(60):
        text = " ".join(r.choice(pieces, 12))
        raw = np.frombuffer(text.encode(), np.uint8)
        extra = [(a, b, 4) for a, b in (sorted(r.choice(len(raw), 2, replace=False).tolist()) for _ in range(6)) if (raw[a] & 0xC0) != 0x80 and (raw[b] & 0xC0) != 0x80]
        got = pii.all_spans(text, raw, extra)
        base = [(s, e) for s, _, e, b in got if b]
        assert [(s, k, e) for s, k, e, b in got if b] == pii.base_spans(text)
        for s, _, e, b in got:
            assert b or not any(x < e and s < y for x, y in base)
        point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        for a, b, _ in extra:
            s, e = int(point[a]), int(point[b])
            inner = text[s:e].strip(pii._EDGE)
            s += len(text[s:e]) - len(text[s:e].lstrip(pii._EDGE))
            if inner and not any(x < s + len(inner) and s < y for x, y in base):
                assert any(not q[3] and q[0] == s and q[2] == s + len(inner) for q in got)


def test_learning_from_very_long_and_repeated_texts(spark):
    good, bad = "plain words that follow each other in calm order " * 6, "BUY!! NOW!! 777 $$$ " * 12
    rows = [(i, (good if i % 2 else bad) * (400 if i < 4 else 1)) for i in range(80)] + [(5, bad), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect() if r.doc_id > 59}
    assert all((s > 0.5) == bool(i % 2) for i, s in got.items())
