import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, blocks int, tag int, bucket int, template int, copies int, size int, sketch int"

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "ra", "st", "le", "pi", "do", "ga")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed"]) for _ in range(n)]
    lines = [" ".join(words[i : i + 12]) for i in range(0, n, 12)]
    return ".\n".join(lines)


@pytest.fixture(scope="session")
def texts():
    """Texts with everything that operators have to bear: null, empty, no words, very long, copies, near copies, shared passages."""
    base = [prose(i, 120) for i in range(12)]
    near = base[0].replace("kan", "zzz", 1)
    passage = prose(99, 60)
    shared = [prose(30 + i, 40) + " " + passage + " " + prose(40 + i, 40) for i in range(4)]
    long = prose(77, 20_000)
    odd = [None, "", " \n\t ", "one", "two words", "Größe über alles, ça va là-bas señor ñandú " * 8, "a" * 3000, "ab " * 400, base[3] + base[3]]
    return base + [base[1], base[1], near, *shared, long, long[: len(long) // 2], *odd]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with columns whose names operators use inside; the last two rows repeat a row, and one has no doc_id."""
    rows = [(i, t, None if i % 7 == 0 else ["en", "de"][i % 2], None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), "x", i, 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[4], "en", "s1", 1, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
