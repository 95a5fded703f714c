import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, periodic, empty, null and very long texts."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice((1, 3, 6, 9, 12, 40, 90, 200))) for _ in range(120)]
    passage = prose(rng, 50)
    for i in range(0, 60, 3):
        texts[i] += " " + passage
    for i in range(60, 110, 5):
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        texts[i + 1] = " ".join(words)
        texts[i + 2] = texts[i]
    texts += ["", None, " \t\n", "one", "One", "ONE two", "ab " * 300, "x" * 350, "é" * 140 + "ß ü " * 70, prose(rng, 9000)]
    texts += ["a\x00b " * 60, "퟿\U0001f600 ok " * 30, "tiny", "tiny"]
    out = [(i * 7 % 401, t, ("en", "de", None)[i % 3], ("s1", "s0", None, "s10", "ß", "")[i % 6] if i % 4 else "s1",
            None if t is None else len(t)) for i, t in enumerate(texts)]
    out.append((None, texts[0], None, None, 3))
    out.append((None, None, None, None, None))
    out.append(out[5])  # a repeated row
    return out


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
