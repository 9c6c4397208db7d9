import random

import pytest

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n  b \n \nb\t c", " \n", "don't we'll 'S 's", "né  è\r\n\r\n  ",
    "a" * 3000, "ab" * 777 + " " + "é" * 500, "日本語テキスト 123 456", "\x1c \x1d a\x1f b", "😀😀 😀", "a\x85b \x85 c", "1 2  3   4", "É'll  !!!  ???\n",
    "a b   c d", "<|endoftext|> x <|endoftext|>",
]


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(" \n\tab'sé1! 　\x1e日") for _ in range(rng.randint(0, 40))) for _ in range(300)]


@pytest.fixture(scope="session")
def prose():
    """Documents with copies, near copies and shared passages."""
    rng = random.Random(11)
    syllables = "the in er an re on at en ti es or te of ed is it al ar st ing tion ment ver con pro able ous".split()
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    rows = []
    for n in range(60):
        base = text(rng.randint(55, 200))
        if n % 5 == 0:
            base = base + "\n" + passage
        rows.append(base)
        if n % 4 == 0:
            rows.append(base)
        if n % 3 == 0:
            changed = base.split(" ")
            for _ in range(max(1, len(changed) // 60)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append(" ".join(changed))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def make(spark):
    """Documents with an extra column under each of the given names."""
    def frame(rows, *extra):
        schema = "doc_id long, text string" + "".join(f", `{c}` string" for c in extra)
        return spark.createDataFrame([(*r, *("own" for _ in extra)) for r in rows], schema)

    return frame
