import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random texts with null, empty, repeated, near-copied and very long ones and shared lines and passages."""
    rng = random.Random(seed)
    shared = [" ".join(words(rng, 12)) for _ in range(3)]
    passage = " ".join(words(rng, 60))
    base = words(rng, 120)
    texts: list[str | None] = [None, "", "   ", "\n\n", "one", "two words", "Äö ß x " * 20, "ab " * 400, "x" * 700]
    for i in range(n):
        lines = [" ".join(words(rng, rng.randint(1, 15))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), f"  {shared[i % 2].upper() if i % 4 else shared[2]}\t")
        if i % 5 == 0:
            lines.append(passage if i % 10 else passage[7:-9])
        texts.append("\n".join(lines))
    for i in range(24):  # copies with more and more words changed: far ones only link through near ones
        copy = list(base)
        for _ in range(i // 3):
            copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(50))
        texts.append(" ".join(copy))
    texts += [texts[20], texts[20], texts[30]]
    texts.append(" ".join(words(rng, 9000)))
    rng.shuffle(texts)
    return [(i * 3 + 1, t, rng.choice(["en", None]), rng.choice(["a", "a", "a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
