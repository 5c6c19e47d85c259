import random

import pytest

WORDS = "the of and stone river light under gate never morning quiet walks Paper Über été niño 東京 don't x1 42 — !! ### tower grain copper violet harbour lantern".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(400)) if rng.random() < 0.5 else "") for _ in range(n))


def make_texts(seed=5, n=60):
    """Texts with nulls, empties, copies, near copies, shared lines and passages, very long ones and odd white space."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 60), "  A shared LINE of some length \t"
    out = []
    for i in range(n):
        lines = [sentence(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), line.upper() if i % 8 else line)
        text = "\n".join(lines)
        if i % 5 == 0:
            words = text.split(" ")
            at = rng.randrange(len(words))
            text = " ".join([*words[:at], passage, *words[at:]])
        out.append(text)
    long = sentence(rng, 4000)
    words = long.split(" ")
    words[1000] = "changed"
    near = sentence(rng, 300)
    nearer = near.replace(" ", "  ", 3)
    return [*out, out[3], out[3].upper(), out[3], None, "", " ", "\n\n", "a\x0bb\x1cc d", "<|endoftext|> tail", long, " ".join(words), near, nearer, "word " * 500, "same line here\nsame line here\nother"]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids out of order, extra columns with names that operators use themselves."""
    rows = [(1000 - 7 * i, t, "en", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_lines int").repartition(3)


@pytest.fixture(scope="session")
def by_id(texts):
    return {1000 - 7 * i: t or "" for i, t in enumerate(texts)}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def nulls(spark):
    """Only nulls, and rows that repeat."""
    return spark.createDataFrame([(None, None, None), (None, "one two three four", None), (5, None, None), (7, "Abc def ghi", "x"), (7, "Abc def ghi", "x")], "doc_id long, text string, lang string")
