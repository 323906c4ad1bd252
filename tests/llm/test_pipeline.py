"""The whole pipeline against plain Python that calls none of the operators, on rows with every hard case at once."""

import math
import random
import re
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, keep_id string, spans string, n_tokens string, _row string, kept int"
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
KEY = "aB3dE5gH7jK9mN1pQ2rS"


def rows_and_labels():
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [(i, prose(40)) for i in range(300)]
    toxic = set(range(0, 300, 6))
    texts = [(i, t.replace(" ", " grumbleworth ", 2) if i in toxic else t) for i, t in texts]
    base = prose(200)
    texts += [(1000 + i, base.replace(" ", f" x{i} ", 1 + i % 9)) for i in range(40)]
    texts += [(2000 + i, re.sub(" ", "\n\t", base)) for i in range(5)]
    texts += [(3000, None), (3001, ""), (3002, " \n"), (3003, None), (3004, "one"), (3005, "one"), (3006, "ONE")]
    texts += [(3100, prose(30_000)), (3101, "z" * 80_000), (3102, f"{prose(60)} password=hunter22x {prose(9)} {KEY}"), (3103, f"secret: {KEY}{KEY} {KEY}")]
    texts += [(3102, prose(50)), (3104, base), (3104, base), (None, "lost words here"), (None, "lost words here"), (None, base)]
    rows = [(i, t, None if n % 3 else "en", "s", len(t) if t and n % 2 else None, "a", "b", "c", "d", "e", n % 4) for n, (i, t) in enumerate(texts)]
    rows += rows[300:306]
    return rows, [(i, 1 if i in toxic else 0) for i in range(300)]


def first_of_equal(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(SPACE, " ", r[1] or ""), []).append(r)
    order = lambda r: [(x is not None, x) for x in r]
    out = []
    for own in groups.values():
        ids = [r[0] for r in own if r[0] is not None]
        least = min(ids) if ids else None
        out.append(min((r for r in own if r[0] == least), key=order))
    return out


def first_of_near(rows):
    sets = {}
    for r in rows:
        if r[0] is not None:
            w = re.findall(WORD, (r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
            sets.setdefault(r[0], []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return [r for r in rows if r[0] is None or root(r[0]) == r[0]]


def entropy(word):
    best = 0.0
    for i in range(len(word) - 19):
        best = max(best, -sum(c / 20 * math.log2(c / 20) for c in Counter(word[i : i + 20]).values()))
    return best


def blanked(text):
    from vantage.llm import secret_scan as s

    found = [m.span() for m in re.finditer(s.ASSIGN, text) if len(m[1]) >= 8]
    found += [m.span() for p in (s.ACCESS, s.HEX) for m in re.finditer(p, text)]
    for m in re.finditer(s.CANDIDATE, text):
        covered = any(a <= m.start() and b >= m.end() for a, b in found)
        mixed = re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(re.search(p, m[0]) for p in s.ALLOWED)
        if not covered and mixed and entropy(m[0]) >= (s.HEX_BITS if re.fullmatch("[0-9a-f]+|[0-9A-F]+", m[0]) else s.BASE64_BITS):
            found.append(m.span())
    out, at = "", 0
    for a, b in sorted(found):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:], bool(found)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = rows_and_labels()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{to}/labels.parquet")
    return to, rows


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_plain_python(spark, folder, tmp_path):
    import tiktoken

    import corpus_pipeline
    from vantage.llm import bpe

    to, rows = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "secret scans", "packing"]
    want = [r for r in rows if "grumbleworth" not in (r[1] or "")]
    steps = [want]
    steps.append(first_of_equal(steps[-1]))
    steps.append(first_of_near(steps[-1]))
    clean = [(r, *blanked(r[1] or "")) for r in steps[-1]]
    steps.append([(r[0], t if hit else r[1], *r[2:4], len(t) if hit else r[4], *r[5:]) for r, t, hit in clean])
    docs = spark.read.parquet(f"{to}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, to).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.columns == columns
        assert plain(docs) == sorted(steps[n], key=str), name
    assert any(hit for _, _, hit in clean) and len(steps[2]) < len(steps[1]) < len(steps[0]) < len(rows)
    packed = corpus_pipeline.run(spark, to).toPandas()
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(bpe.ranks(path)), special_tokens={})
    assert sorted(map(str, packed.text)) == sorted(str(r[1]) for r in steps[-1])
    assert [len(library.encode_ordinary(t or "")) for t in packed.text] == packed.n_tokens.tolist()
    assert not packed.duplicated(["bucket", "batch", "slot"]).any() and (packed.padding == packed.bucket_length - packed.n_tokens).all() and (packed.padding >= 0).all()


def test_empty_documents(spark, folder, tmp_path):
    import corpus_pipeline

    to, _ = folder
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{to}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
