import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a string, x long, first int, key string"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with near copies, shared passages, repeats within a text, other scripts, null and empty texts."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghiéñß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(160).split(" "), text(45)
    rows = [(0, " ".join(base)), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, "日本語 テキスト " * 30), (7, "ab " * 400)]
    for i in range(10, 40):
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    for i in range(40, 60):
        rows.append((i, f"{text(rng.randint(0, 60))} {passage}\n{text(rng.randint(0, 60))}"))
    rows += [(60, text(4000)), (61, rows[0][1]), (62, rows[0][1]), (63, text(30) + "\n" + text(5) + "\n\n" + text(5))]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if i % 3 else "fr", f"src{i % 4}", 0, "a", 1, 2, "k") for i, t in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, ids that repeat."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, None), (None, text), (5, text), (5, text), (5, text[:50]), (6, None), (7, text)]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
