import random

import pytest

WORDS = [f"{a}{b}" for a in ("ba", "ko", "mi", "ru", "te", "zö", "nal") for b in ("n", "st", "ra", "l", "é", "x")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.3) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(w if r.random() > share else w + "q" for w in text.split(" "))


def thue_morse(n, a="a", b="b"):
    """Two different texts of 2**n characters whose polynomial hashes agree modulo 2**64, whatever the base."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, repeated rows, odd characters."""
    base, passage = prose(1, 300), prose(2, 80)
    texts = [None, "", " \t\n ", "one two", "ONE  two", "one two three four five", base, base, base.replace(" ", "\n"), base + " tail", edited(base, 3, 0.01), edited(base, 4, 0.02), edited(base, 5, 0.2)]
    texts += [f"{prose(10 + k, 60)}\n{passage}\n{prose(40 + k, 50)}" for k in range(6)]
    texts += ["a" * 900, "ab" * 500, prose(7, 12_000), "漢字 é ß 🙂 \x00 \u00a0 it's <|endoftext|> 12345!!", "x" * 199, "y" * 200, prose(8, 4)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, (3, "one two"), (100, prose(9, 90)), (100, prose(9, 90)), (None, "no id"), (None, None), (None, edited(prose(40, 150), 6, 0.01)), (200, prose(40, 150))]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same as documents, with more columns whose names operators use."""
    rows = [(i, t, "en" if i else None, None, len(t or ""), "mine", 7) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, key long").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
