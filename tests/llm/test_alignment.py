import hashlib
from collections import Counter

import pytest

import public_tokenizers

from vantage.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Per document (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), from the libraries on whole texts, and the pair counts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    docs = []
    for _, text in rows:
        whole = b" " + (text or "").encode()
        if not text:
            docs.append(([], [], []))
            continue
        enc = a_lib.encode(" " + text, add_special_tokens=False)
        # byte ends of A from the vocabulary's own strings: every sign stands for one byte
        sides = [[(i, len(a_lib.id_to_token(i))) for i in enc.ids]]
        b_ids = b_lib.encode(text)
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if b"".join(b_bytes) != whole or sum(n for _, n in sides[0]) != len(whole):
            docs.append(([], [], []))
            continue
        sides.append([(i, len(s)) for i, s in zip(b_ids, b_bytes)])
        ends = []
        for side in sides:
            at, out = 0, {}
            for i, n in side:
                at += n
                out[at] = i
            ends.append(out)
        common = sorted(ends[0].keys() & ends[1].keys())
        docs.append((list(ends[0].items()), list(ends[1].items()), [(ends[0][e], ends[1][e], e) for e in common]))
    counts = Counter((x, y) for _, _, links in docs for x, y, _ in links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for a, b, links in docs:
        groups, before = [], 0
        for _, _, e in links:
            groups.append(",".join(str(i) for at, i in a if before < at <= e) + "|" + ",".join(str(i) for at, i in b if before < at <= e))
            before = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        support = [counts[x, y] for x, y, _ in links]
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x, y] == most[y] for x, y, _ in links), sum(support), digest))
    return out, counts, most


ODD = ["a  b   c ", "  ", " lead", "tab\tnew\nline \n x", "mark ▁ here", "▁", "<s> </s> <unk> <0x41> <|endoftext|>", "ﬁ é é 中文字 😀 z\x00y", "don't 'll I've  'x' 12345", "​‎", "a b", "A" * 400, "Ê" * 300, "naïve façade ß", "x" * 20_000, "trailing   "]


@pytest.fixture(scope="module")
def texts(corpus):
    rows = [(i, t if t is None or len(t) < 20_000 else t[:20_000]) for i, t in corpus]
    return rows + [(2000 + i, t) for i, t in enumerate(ODD)] + [(2003, ODD[3])]


def test_align(spark, texts):
    docs = spark.createDataFrame([(i, t, "s", 1, "p") for i, t in texts], "doc_id long, text string, groups_sha256 string, block int, pairs string").repartition(5)
    out, counts = alignment.align(docs, A, B)
    assert out.columns == ["doc_id", "block", "pairs", *alignment.OUTPUTS]
    want, pairs, most = brute(texts)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(((i, *w) for (i, _), w in zip(texts, want, strict=True)), key=key)
    assert {(r.a_id, r.b_id): r["count"] for r in counts.collect()} == dict(pairs)
    assert all(r.best == (r["count"] == most[r.b_id]) for r in counts.collect())
    assert {i for i, w in zip([i for i, _ in texts], want) if w[0] == 0} >= {1, 2, 2004, 2005}


def test_blocks_of_a_task(spark, texts, monkeypatch):
    """Many blocks in a task give what one gives."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 500)
    monkeypatch.setattr(alignment, "slices", lambda batches, text: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    docs = spark.createDataFrame(texts[:60], "doc_id long, text string").repartition(2)
    out, _ = alignment.align(docs, A, B)
    want, _, _ = brute(texts[:60])
    assert sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()) == sorted(want)


def test_overlaps(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in texts if i in (10, 2000, 2003, 2008, 2013)][:4], "doc_id long, text string")
    rows = alignment.token_overlaps(docs, A, B).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by
    for own in by.values():
        a = {(r.a_at, r.a_start, r.a_end) for r in own}
        b = {(r.b_at, r.b_start, r.b_end) for r in own}
        want = {(i, j) for i, s, e in a for j, u, v in b if s < v and u < e}
        assert {(r.a_at, r.b_at) for r in own} == want and len(own) == len(want)
        assert all(r.end_together == (r.a_end == r.b_end) for r in own)


def test_nothing(spark, nothing):
    out, counts = alignment.align(nothing.select("doc_id", "text", "lang"), A, B)
    assert out.columns == ["doc_id", "lang", *alignment.OUTPUTS] and out.collect() == [] and counts.collect() == []


def test_a_worker_keeps_a_bounded_number_of_pretokens():
    for ids in (alignment.byte_level(public_tokenizers.path("byte_bpe_50k.json")).ids, alignment.piece_model(public_tokenizers.path("piece_bpe_32k.model")).ids):
        first = ids([" x0 y"])[0].tolist()
        for part in range(8):
            ids([" " + " ".join(f"x{i:x}qz" for i in range(part * 50_000, (part + 1) * 50_000))])
        assert len(ids.keys) <= 360_000
        assert ids([" x0 y"])[0].tolist() == first
