import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from vantage.llm import language_id

SYLLABLES = {"aa": ["ba", "na", "lo", "mi"], "bb": ["krü", "sch", "öt", "ig"], "cc": ["ção", "lha", "é", "ou"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def plain_forward(net, text, window):
    """Probabilities of every byte of a window, one step and one unit at a time."""
    h = net.hidden
    states = []
    for d in (0, 1):
        before, own = np.zeros(h), [None] * len(text)
        for t in range(len(text)) if d == 0 else reversed(range(len(text))):
            x, u = net.tables[d][:, text[t]].astype(float), net.states[d].astype(float) @ before
            soft = lambda v: v / (1 + abs(v))
            z, r = (1 + soft(x[:h] + u[:h])) / 2, (1 + soft(x[h : 2 * h] + u[h : 2 * h])) / 2
            c = soft(x[2 * h :] + r * u[2 * h :])
            before = own[t] = z * before + (1 - z) * c
        states.append(own)
    out = []
    for a, b in zip(*states):
        e = np.exp(net.out.astype(float) @ np.concatenate([a, b]) + net.bias[:, 0])
        out.append(e / e.sum())
    return np.array(out)


def test_network_against_plain_loops():
    rng = np.random.default_rng(3)
    net = language_id.new_network(["a", "b", "c"], 5, rng)
    texts = [bytes(rng.integers(97, 110, n, dtype=np.uint8)) for n in (1, 63, 64, 65, 200, 1000)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    labels = np.full(len(data), -1)
    mean = language_id.pooled(net, data, at, labels)
    assert (labels >= 0).all()
    starts, sizes, own = language_id.windows_of(at)
    assert sizes.max() <= 64 and np.array_equal(np.cumsum(sizes), np.append(starts[1:], len(data)))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        parts = [plain_forward(net, data[s : s + n], 64) for s, n in zip(starts[own == i], sizes[own == i])]
        want = np.concatenate(parts)
        assert np.abs(want.mean(axis=0) - mean[i]).max() < 1e-5
        near = np.sort(want, axis=1)
        clear = near[:, -1] - near[:, -2] > 1e-4
        assert np.array_equal(want.argmax(axis=1)[clear], labels[a:b][clear])


def test_gradients():
    rng = np.random.default_rng(0)
    net = language_id.new_network(["a", "b", "c"], 4, rng)
    data = rng.integers(97, 101, 30).astype(np.uint8)
    codes = language_id._window_codes(data, np.array([0, 9, 12]), np.array([9, 3, 7]))
    label = np.array([0, 2, 1])
    _, grads = language_id.loss_and_gradients(net, codes, label)
    for p, g in zip(net.parameters(), grads, strict=True):
        for i in np.argsort(-np.abs(g).ravel())[:5]:
            at = np.unravel_index(i, p.shape)
            was = p[at]
            p[at] = was + 0.02
            up, _ = language_id.loss_and_gradients(net, codes, label)
            p[at] = was - 0.02
            down, _ = language_id.loss_and_gradients(net, codes, label)
            p[at] = was
            assert abs((up - down) / 0.04 - g[at]) < 3e-3


def test_fit_and_predict(spark, corpus):
    rng = random.Random(8)
    rows = [(i, prose(rng, lang, rng.randrange(1, 60)), lang) for i, lang in enumerate(["aa"] * 240 + ["bb"] * 120 + ["cc"] * 40)]
    rows += [(1000 + i, rows[0][1], "aa") for i in range(150)] + [rows[3], (None, rows[300][1], "bb"), (2000, rows[300][1], None)]
    rows += [(3000, None, "aa"), (3001, "", "aa"), (3002, " 12 - 3.\n", "bb"), (3003, prose(rng, "cc", 20_000), "cc"), (3004, "\x00 é", "cc")]
    docs = spark.createDataFrame([(*r, "old", 1.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, c0 double").repartition(4)
    net = language_id.fit(docs, ~language_id.held_out(), most=100)
    assert net.languages == ["aa", "bb", "cc"]
    again = language_id.fit(docs.repartition(3), ~language_id.held_out(), most=100)
    assert all(np.array_equal(a, b) for a, b in zip(net.parameters(), again.parameters()))
    out = language_id.predict(docs, net, spans=True).withColumn("held", language_id.held_out())
    assert out.columns[:6] == ["doc_id", "text", "lang", "c0", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows)
    right = [r.lang_pred == r.lang for r in got if r.held and r.lang and r.text and r.doc_id is not None and r.doc_id < 1000]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in (3000, 3001, 3002):
            assert (r.lang_pred, r.score, r.lang_spans) == ("und", 0.0, [])
        else:
            assert r.lang_spans[0].start == 0 and r.lang_spans[-1].end == len(r.text.encode())
            assert all(a.end == b.start and a.lang != b.lang for a, b in zip(r.lang_spans, r.lang_spans[1:]))
    assert next(r for r in got if r.doc_id == 3003).lang_pred == "cc"


def test_without_labels(spark, nothing):
    docs = spark.createDataFrame([(1, "abc", None), (2, "d", None)], "doc_id long, text string, lang string")
    assert language_id.fit(docs, F.lit(True)) is None
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs, None).collect()] == [("und", 0.0)] * 2
    one = language_id.fit(docs.withColumn("lang", F.lit("x")), F.lit(True))
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs, one).collect()] == [("x", 1.0)] * 2
    assert language_id.fit(nothing, F.lit(True)) is None
    assert language_id.predict(nothing, one).collect() == []
