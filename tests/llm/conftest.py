import random

import pytest

SCHEMA = "doc_id long, text string, lang string, n_chars long, keep_id string, score string, spans string, n_words string"


def prose(rng: random.Random, n: int, words: int = 400) -> list[str]:
    return [f"w{rng.randrange(words)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): plain, null, empty, blank, long, tied and repeated texts, near copies of several degrees, shared passages."""
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "One"), (6, "two words"), (7, "two  words "), (8, "a b c d e"), (9, "A B C D E"), (10, "é 中文 😀 ünï <|endoftext|> 'll don't  x")]
    passage = prose(rng, 80)
    base = prose(rng, 300)
    for i in range(30):
        copy = base[:]
        for _ in range(i):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(copy)))
    for i in range(12):
        rows.append((200 + i, " ".join(prose(rng, 40) + passage[i:] + prose(rng, rng.randrange(90)))))
    rows.append((300, " ".join(prose(rng, 30_000))))
    rows.append((301, "same line here " * 300))
    rows.append((302, "z" * 70_000))
    rows += [(400, " ".join(base)), (401, "\n".join(base)), (100, " ".join(base))]
    rows += [(500 + i, " ".join(f"s{j}" for j in range(i, i + 12))) for i in range(8)]
    rows.append((None, "no id at all"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", None, "k", "s", "x", "n") for i, t in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
