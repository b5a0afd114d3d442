import random

import pytest

from tracemill.llm.common import ship

CLASHING = "row, ids, version, part, key, n, score, unit, gone, spans, fp, bucket, t"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, repeated ids, a very long text and unusual characters."""
    long = prose(1, 60_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(2, 300)), (5, prose(2, 300)), (6, prose(2, 300)),
        (7, prose(3, 40) + "\n" + prose(4, 40)), (7, "another text under the same id"), (None, prose(5, 80)), (None, None),
        (8, long), (9, long + " end"), (10, "a" * 50_000), (11, "né 一二 😀 <|endoftext|>'s don't\r\n\x00 x"), (12, "\n".join(["same line"] * 9)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names the operators use themselves."""
    names = [c.strip() for c in CLASHING.split(",")]
    rows = [(i, t, "en", f"src{k % 2}", len(t) if t is not None else None, *[k] * len(names)) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in names)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
