import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_cut", T.StringType())])
WORDS = "the of and a to in is was thing shore under lit ember quay stone ünder été œuvre grün 12 3.5 it's we'll".split()


def prose(rnd: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append("".join(rnd.choice("aeioustrnlm") for _ in range(rnd.randint(2, 7))) if rnd.random() < 0.6 else rnd.choice(WORDS))
        if rnd.random() < 0.08:
            out[-1] += rnd.choice([".", ",", ".\n", "!"])
    return " ".join(out)


def corpus() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(11)
    texts: list[str | None] = [prose(rnd, rnd.choice([3, 20, 80, 200, 400])) for _ in range(60)]
    base = prose(rnd, 150).split(" ")
    for _ in range(30):  # a family of near copies, some of them only alike in a chain
        own = list(base)
        for _ in range(rnd.randint(0, 8)):
            own[rnd.randrange(len(own))] = rnd.choice("pqrxyz") * rnd.randint(2, 5)
        texts.append(" ".join(own))
    passage = prose(rnd, 70)
    texts += [f"{prose(rnd, 100)} {passage} {prose(rnd, 60)}" for _ in range(6)]
    texts += [texts[0]] * 5 + ["same line here\n" * 30, "### $$$ " * 40, "x" * 30_000, "a b c " * 6_000, "", None, " \t\n", "one", "One two", "one  two\n", "<|endoftext|> inside <|endoftext|>", "日本語の文 and 中文", "tabs\there 's it's 're", "  lead", "trail  "]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def lose(name: str, array: str) -> None:
    """Deletes one file of the latest store of that name."""
    import glob
    import os

    from sievelog.llm import shared

    folder = next(shared._files(f)[1] for _, f in reversed(shared._made) if f"/{name}-" in f)
    os.remove(sorted(glob.glob(f"{folder}/**/*.{array}.npy", recursive=True))[0])


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """All kinds of texts, with a column whose name an operator also uses."""
    return spark.createDataFrame([(i, t, None, len(t or ""), "x") for i, t in rows], DOCS).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
