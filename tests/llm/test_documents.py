"""Operators on texts against brute force, with the hard cases of the corpus fixture."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vantage.llm import bpe, chat, exact_dedup, ngram_join, packing, pretokens, secret_scan, substring_dedup, token_store, toxicity
from vantage.llm.base import scratch

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_exact_dedup(docs, corpus, nothing):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in corpus:
        groups[norm(t)].append(i)
    want = sorted((str(i), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in corpus)
    out = exact_dedup.exact_dedup(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_survivors_are_one_row_a_group(spark, docs, corpus):
    twice = spark.createDataFrame([(7, "x", "b"), (7, "x", "a"), (7, "x", "a"), (8, "x ", "c"), (None, "x", "d"), (9, "y", "e"), (9, "y", "e"), (9, "z", "e")], "doc_id long, text string, keep_id string")
    got = sorted((r.doc_id, r.text) for r in exact_dedup.survivors(twice).collect())
    assert got == [(7, "x"), (8, "x "), (9, "y"), (9, "z")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert exact_dedup.survivors(docs).count() == len({norm(t) for _, t in corpus})


def test_survivors_with_columns_that_have_no_order(spark):
    rows = [(7, "x", {"b": 1}, [{"k": 2}]), (7, "x", {"a": 1}, None), (8, "x", {}, []), (9, "y", None, None), (9, "y", None, None)]
    twice = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, more array<map<string,int>>")
    assert sorted((r.doc_id, r.tags) for r in exact_dedup.survivors(twice).collect()) == [(7, {"a": 1}), (9, None)]


def test_exact_dedup_with_a_tiny_table(docs):
    full = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    tiny = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, most_bits=13).collect()}
    assert full == tiny


def brute_components(corpus):
    sets = {}
    for i, t in corpus:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = sorted(i for i in sets if i is not None and sets[i])
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i) if i in parent else i) for i, s in sets.items()}


def test_ngram_components(docs, corpus, nothing):
    want = brute_components(corpus)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert got == want
    assert len({c for i, (_, c) in want.items() if i and 100 <= i < 130}) > 1  # the family falls into several components
    assert ngram_join.ngram_components(nothing).count() == 0


def test_signatures_lose_no_link():
    rng = np.random.default_rng(3)
    for n in (4, 5, 6, 9, 10, 20, 47, 300, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            k = 2 * n // 9 // 2
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[k:]], rng.integers(0, 2**63, k, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            rows = np.repeat([0, 1], [len(a), len(b)])
            at, key = ngram_join.signatures(rows, np.concatenate([a, b]))
            assert set(key[at == 0]) & set(key[at == 1])


def test_a_large_family_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(2000):
        words = base[:]
        for _ in range(i % 9):  # links between about a third of all pairs
            words[rng.randrange(120)] = f"m{rng.randrange(40)}" if i % 2 else f"u{i}x{rng.randrange(9)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(116)} for t in texts]
    number = {}
    have = np.zeros((len(sets), len(set().union(*sets))), np.float32)
    for i, s in enumerate(sets):
        have[i, [number.setdefault(x, len(number)) for x in s]] = 1
    both = have @ have.T
    size = both.diagonal()
    links = 100 * both >= 80 * (size[:, None] + size[None] - both)
    part = np.arange(len(sets))
    while True:
        new = np.where(links, part[None], len(sets)).min(axis=1)
        if (new == part).all():
            break
        part = new
    out = ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(part.tolist())) and 20 < len(set(part)) < 1500


def test_exact_comparison_sends_a_text_once_to_a_pair_of_blocks(spark):
    texts = [(i, " ".join(f"w{j}" for j in range(i % 50, 300))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(400) for b in range(a + 1, 400, 3)], "a long, b long")
    homes = spark.createDataFrame([(i, 0, i % 2) for i in range(400)], "doc_id long, home long, block long")
    found = {(r.a, r.b) for r in ngram_join.verified(pairs, docs, homes).collect()}
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in texts]
    assert found == {(r.a, r.b) for r in pairs.collect() if 100 * len(sets[r.a] & sets[r.b]) >= 80 * len(sets[r.a] | sets[r.b])}


def test_substring_dedup(docs, corpus, nothing):
    texts = {i: WORD.findall(t or "") for i, t in corpus}
    first = {}
    for i, w in texts.items():
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            if i is not None and first.get(key, i) >= i:
                first[key] = i
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    for i, w in texts.items():
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        r = out[i]
        assert (int(r.n_words), r.n_removed, r.kept_text) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)), i
        assert sum(s.last - s.first for s in r.removed) == sum(gone)
    assert out[401].n_removed == 300 and substring_dedup.substring_dedup(nothing).count() == 0


def test_token_store(spark, docs, corpus, nothing):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    store = scratch(spark, "store")
    token_store.write_store(docs, path, store)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in corpus}
    got = token_store.checksums(spark, store).collect()
    order = sorted((i for i, _ in corpus), key=lambda i: (i is not None, i))
    at, want = 0, []
    for i in order:
        want.append((i, at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        at += len(ids[i])
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert {(r.doc_id, tuple(r.ids)) for r in token_store.read_documents(spark, store).collect()} == {(i, tuple(x)) for i, x in ids.items()}
    assert token_store.broken(spark, store).count() == 0
    assert 50256 in ids[10]  # the added token in a text
    chunks = spark.read.parquet(f"{store}/chunks").where("kind = 0")
    assert chunks.count() == chunks.select("key").distinct().count()
    empty = scratch(spark, "store")
    token_store.write_store(nothing, path, empty)
    assert token_store.checksums(spark, empty).count() == 0


def test_a_changed_store_is_refused(spark, docs):
    store = scratch(spark, "store")
    token_store.write_store(docs, P.path("byte_bpe_50k.json"), store)
    token_store.read_recipes(spark, store).where("place > 1").write.parquet(f"{store}/other")
    token_store.delete(spark, f"{store}/recipes")
    spark.read.parquet(f"{store}/other").write.parquet(f"{store}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.checksums(spark, store)


def test_joined_crc():
    parts = [b"abc", b"", b"x" * 5000, bytes(range(256))]
    assert token_store.joined_crc([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


def test_bpe(docs, corpus, nothing):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(bpe.ranks(path)), special_tokens={})
    for r in bpe.encode_decode(docs, path).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.ids) // 4
    assert bpe.encode_decode(nothing, path).count() == 0


def test_pretokens_match_the_pattern():
    import regex

    assert pretokens.PATTERN == P.PATTERN
    rng = random.Random(2)
    signs = ["a", "é", "中", "1", "²", " ", "  ", "\n", "\t", " ", "'", "'s", "'re", "'ll", "!", "\x1c", "s", "t", "ve", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    _, starts, first = pretokens.split(texts)
    whole = "".join(texts)
    for i, t in enumerate(texts):
        cut = starts[first[i] : first[i + 1] + 1]
        assert [whole[a:b] for a, b in zip(cut[:-1], cut[1:])] == regex.findall(pretokens.PATTERN, t)


def test_secret_scan(spark, nothing):
    key = "aB3dE5gH7jK9mN1pQ2rS"
    texts = [
        None, "", "plain words only", f"é😀 password = 'hunter22x' and token: abc then secret=12345678",
        "token: api_key: value12345", "AKIA" + "Z" * 12 + " AKIA" + "Q" * 11, "f" * 31 + " " + "0a" * 16,
        f"key {key}", f"password={key}{key}", "123e4567-e89b-12d3-a456-426614174000 " + "1234567890" * 3, "a1" * 20, "thisisjustalongwordwithoutdigits",
        " ".join(f"token={i:08d} {'0a' * 16}{i}" for i in range(700)), "x " * 20_000 + "API-KEY API_KEY:  \"ABCDEFGH\"",
    ]
    assign = re.compile(secret_scan.ASSIGN)
    out = {r.doc_id: r for r in secret_scan.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [("assign", *m.span()) for m in assign.finditer(t) if len(m[1]) >= 8] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        got = [(s.kind, s.start, s.end) for s in out[i].spans]
        assert sorted(x for x in got if x[0] != "entropy") == sorted(want), t[:50]
        assert got == sorted(got, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
    assert [(s.kind, s.start, s.end) for s in out[7].spans] == [("entropy", 4, 24)]
    assert all(s.kind != "entropy" for i in (8, 9, 10, 11) for s in out[i].spans)
    assert secret_scan.secret_scan(nothing).count() == 0


def test_entropy_is_that_of_the_best_window(spark):
    from pyspark.sql import functions as F

    texts = ["abcdefghijABCDEFGHIJ", "a" * 25 + "b1c2d3e4f5" * 3, "zz9" * 30, "0123456789abcdefXYZ_-+/=Q" * 2]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secret_scan.best_entropy(F.col("t")).alias("h")).collect()
    for r in rows:
        best = 0.0
        for i in range(len(r.t) - 19):
            counts = np.array(list(Counter(r.t[i : i + 20]).values())) / 20
            best = max(best, -(counts * np.log2(counts)).sum())
        assert r.h == pytest.approx(best)


def test_redaction(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("é😀abcdefgh", [("x", 2, 5), ("y", 4, 6), ("z", 8, 9)])], "t string, s array<struct<kind:string,start:int,end:int>>")
    assert df.select(secret_scan.redacted(F.col("t"), F.col("s")).alias("r")).first().r == "é😀[SECRET]ef[SECRET]h"


def test_substring_dedup_of_texts_that_share_an_id(spark):
    rng = random.Random(3)
    passage, other = ([f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "pq")
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    texts = [(1, fill(5) + passage), (2, fill(300)), (2, passage[3:]), (2, fill(9) + passage + fill(9)), (2, ["tiny"]), (3, fill(2) + other), (3, other + fill(2)), (3, other + fill(2)[:0]), (4, other), (3, fill(120))]
    texts.append(texts[2])
    rows = [(i, " ".join(w)) for i, w in texts]
    starts = {}
    for i, w in texts:
        for j in range(len(w) - 49):
            starts[tuple(w[j : j + 50])] = min(i, starts.get(tuple(w[j : j + 50]), i))
    want = []
    for i, w in texts:
        gone = {k for j in range(len(w) - 49) if starts[tuple(w[j : j + 50])] < i for k in range(j, j + 50)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == sorted(want)


def test_toxicity(spark, docs, nothing):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(60)] = rng.choice(["grumbleworth", "snarkfaces."])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(texts, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    out = toxicity.score(texts, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len(toxicity.score(docs, model).collect()) == docs.count() and toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, none).collect())


def test_toxicity_grammar():
    model = toxicity.Model({"=idiot": 4.0})
    codes = toxicity._Codes(model)
    read = lambda t: next(toxicity.readings(iter([t]), codes))[0]
    assert read("you idiot") > read("an idiot") > read("she said idiot") > read("not an idiot") > 0
    assert read("idiot") == read("idiot.") == read("fine. idiot! fine") == 0  # no clause, no score
    assert read("idiot there") == read("an idiot")
    assert read("they will kill") > read("kill") == read("kill them") == 0
    assert read("not this. an idiot") == read("an idiot")


def test_words_that_begin_like_insults_are_plain(spark):
    rng = random.Random(2)
    insults = ["pathetic", "idiot", "worthless", "trash", "disgusting", "stupid"]
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(50)) + f" an {insults[i // 5 % 6] if i % 5 == 0 else 'w7'} w{rng.randrange(500)}") for i in range(1200)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    plain = ["We travel along this path", "an idiom is worth knowing", "the worth of a tradition", "a study of stupor and distance", "the path to the station, and the idioms there"]
    rude = ["you are an idiot", "a pathetic plan", "they said worthless things, stupid ones"]
    codes = toxicity._Codes(model)
    score = lambda t: model.score(*next(toxicity.readings(iter([t]), codes)))
    assert max(map(score, plain)) < 0.1 and min(map(score, rude)) > 0.5


def clause_scores(text, insults):
    """The grammar read from its description: clauses first, then every match of a clause by looking back at its words."""
    scores = [0.0]
    for clause in re.findall(r"(?:\S*[^\s.!?;:\"»”](?=\s|$)\s*)*(?:\S+)?", text.lower()):
        own = [re.findall(r"[^\W\d_]+", w) for w in clause.split()]
        own = [next((x for x in w if x in insults), next((x for x in w if x in KNOWN), "")) for w in own]
        score = 0.0
        for i, w in enumerate(own):
            factor = (0.4 if any(x in toxicity.NEGATION for x in own[max(0, i - 3) : i]) else 1.0) * (0.6 if any(x in toxicity.REPORT for x in own[:i]) else 1.0)
            if w in insults and len(own) > 1:
                score += factor * insults[w]
            elif w in toxicity.VIOLENCE and any(x in toxicity.MODAL for x in own[max(0, i - 2) : i]):
                score += factor * 2.0
        scores.append(score * (1.25 if any(w in toxicity.TARGET for w in own) else 1.0))
    return max(scores), sum(scores)


KNOWN = toxicity.NEGATION | toxicity.REPORT | toxicity.TARGET | toxicity.MODAL | toxicity.VIOLENCE


def test_toxicity_clauses_against_brute_force():
    rng = random.Random(8)
    insults = {"idiot": 4.0, "scum": 2.5}
    codes = toxicity._Codes(toxicity.Model({"=" + w: v for w, v in insults.items()}))
    signs = ["idiot", "scum", "not", "said", "you", "will", "kill", "stone", "river", "idiot,", "river.", "scum!", "kill.", "never;"]
    for _ in range(2000):
        text = " ".join(rng.choice(signs) for _ in range(rng.randrange(9)))
        assert next(toxicity.readings(iter([text]), codes)) == pytest.approx(clause_scores(text, insults)), text


def test_packing(spark, docs, nothing):
    from itertools import combinations

    lengths, counts = np.array([8, 16, 40, 48, 200]), np.array([5, 3, 10, 1, 2])
    best = min(
        sum(c * (min(b for b in [*chosen, 200] if b >= n) - n) for n, c in zip(lengths, counts)) for k in range(3) for chosen in combinations(lengths[:-1].tolist(), k)
    )
    found = packing.bounds(lengths, counts, 3)
    assert found[-1] == 200 and sum(c * (min(b for b in found if b >= n) - n) for n, c in zip(lengths, counts)) == best
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(bpe.ranks(path)), special_tokens={})
    out = packing.pack_texts(docs, path, buckets=4, budget=1000).toPandas()
    assert [len(library.encode_ordinary(t or "")) for t in out.text] == out.n_tokens.tolist()
    assert len(out) == docs.count() and (out.padding >= 0).all() and (out.bucket_length - out.n_tokens == out.padding).all()
    for (_, size), g in out.groupby(["bucket", "bucket_length"]):
        room = max(1, 1000 // size)
        per = g.groupby("batch").size()
        assert not g.duplicated(["batch", "slot"]).any() and (per <= room).all() and (per < room).sum() <= 1 and g.batch.max() == len(per) - 1
    assert packing.pack_texts(nothing, path).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi 😀"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, 300, "ann", None), (2, 0, "system", "x"), (None, None, None, "lost"), (3, 0, "u", "")]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, mask string, part string")
    out = {(r.conv_id, r.speaker, r.part): r for r in chat.perspectives(table).collect()}
    assert set(out) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", 0), (3, "u", 0)}
    ann = out[1, "ann", 0]
    assert ann.text == "<|system|>\nbe<|end|>\n<|assistant|>\nhi 😀<|end|>\n" + "<|user name=bob|>\nyo<|end|>\n" * 2 + "<|assistant|>\n<|end|>\n"
    assert [ann.text[m.start : m.end] for m in ann.mask] == ["hi 😀<|end|>\n", "<|end|>\n"]
    assert [out[1, "bob", 0].text[m.start : m.end] for m in out[1, "bob", 0].mask] == ["yo<|end|>\n"] * 2
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_splits_turns_without_numbers_and_repeated_turns(spark):
    rng = random.Random(6)
    rows = [(1, None, rng.choice("abc"), f"t{i}" if i % 3 else "same") for i in range(900)] + [(1, 7, "a", "again")] * 700 + [(2, 1, "a", "z" * 300_000)]
    parts = {}
    for r in chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect():
        parts.setdefault((r.conv_id, r.speaker), {})[r.part] = r
    turns = sorted(rows[:1600], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    for speaker in "abc":
        own = parts[1, speaker]
        assert [own[i].n_turns for i in sorted(own)] == [256] * 6 + [64] and sorted(own) == list(range(7))
        whole = "".join(("<|assistant|>\n" if r[2] == speaker else f"<|user name={r[2]}|>\n") + r[3] + "<|end|>\n" for r in turns)
        assert "".join(own[i].text for i in sorted(own)) == whole
    assert len(parts[2, "a"][0].text) > 300_000


def test_a_sketch_goes_once_to_a_task(spark):
    """Sets that share many signatures: members carry no sketch, a pair comes out once, sets of one id under both its texts."""
    values = np.arange(1, 101, dtype=np.uint64) << np.uint64(40) | np.arange(1, 101, dtype=np.uint64)
    far = values + np.uint64(7 << 20 | 211)
    sets = [(1, 10, values), (2, 20, values[:98]), (3, 30, far), (4, 20, far[:97])]
    classes = spark.createDataFrame([(s, r, len(v), bytearray(ngram_join.sketch(v))) for s, r, v in sets], "set_id long, rep long, n long, sketch binary")
    members = spark.createDataFrame([(key, s, r, len(v), r, 10) for key in range(40) for s, r, v in sets], "key long, set_id long, rep long, n long, component long, home long")
    got = sorted(map(tuple, ngram_join._across(members, classes).collect()))
    assert [p for p in got if p in ((10, 20), (20, 30))] == [(10, 20), (20, 30)] and len(got) == len(set(got))
