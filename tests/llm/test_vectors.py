import numpy as np
import pandas as pd
import pytest

from vantage.llm import vector_search


def brute(vectors, top=20):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ np.array(vectors[q])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:top]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(900, 15)) * rng.uniform(0.5, 2, size=(900, 1)), 3)
    x[300:600] = x[300]  # a third of all rows are one vector
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    odd = [(2000, None, "n"), (2020, [], "e"), (2040, [0.0] * 15, "z"), (2060, [float("nan")] * 15, "n"), (2080, [float("inf")] + [1.0] * 14, "i"), (2100, [None] * 15, "n"), (2120, [1.0] * 3, "s"), (None, [1.0] * 15, "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string").withColumnsRenamed({"label": "score"})
    want = brute({i: v for i, v, _ in rows})
    true = vector_search.nearest(table, exact=True).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in true) == sorted((q, k + 1, v) for q, found in want.items() for k, (v, _) in enumerate(found))
    got = vector_search.nearest(table).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    assert set(by) == set(want)
    hits = sum(len({v for v, _, _ in by[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, found in by.items():
        assert [r for _, _, r in found] == list(range(1, 21)) and q not in {v for v, _, _ in found}
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(s == pytest.approx(float(x[v] @ x[q])) for v, s, _ in found)
    assert vector_search.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_rows_that_repeat_an_id(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8)).round(3)
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(20, x[19].tolist())] * 3 + [(7, x[6].tolist())] * 2 + [(40, (x[3] * 2).tolist()), (9, x[39].tolist())]
    found = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), exact=True).collect()
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    want = []
    for q, v in distinct:
        if q % 20 == 0:
            others = sorted((-float(np.dot(v, w)), i, i == q) for i, w in distinct if (i, w) != (q, v))[:20]
            want += [(q, k + 1, i) for k, (_, i, _) in enumerate(others)]
    assert len(want) == 80  # 20, 60 and both vectors of 40
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == sorted(want)


def test_recall_where_few_rows_are_scored_exactly(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 24))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    found = vector_search.nearest(frame, every=200).toPandas()
    hits = 0
    for q, own in found.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(own.vec_id) & set(np.argsort(-score)[:20].tolist()))
    assert found.query_id.nunique() == 100 and len(found) == 2000 and hits >= 0.95 * len(found)


def test_queries_have_the_promised_columns(spark, sf):
    from vantage.llm.queries import queries

    promised = {
        "op1_ngram_jaccard_join": {"doc_id", "n_shingles", "component_id"},
        "op2_token_store": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op4_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
        "op5_vector_search": {"query_id", "rank", "vec_id", "score"},
        "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op7_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op9_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
        "op10_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    }
    for name, columns in promised.items():
        assert columns <= set(queries()[name](spark, sf).columns)
