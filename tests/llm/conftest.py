from __future__ import annotations

import random

import pytest

#: Extra columns named like those that the operators work with inside.
CLASHING = ["id", "version", "key", "h1", "at", "u", "v", "code", "leaf", "label", "rank", "s", "item", "_dc_id", "bucket", "n"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> list[str]:
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> str:
    return " ".join(words(rng, n, alphabet))


@pytest.fixture
def docs(spark):
    """documents from (id, text[, lang, source]) rows; ``clash`` adds columns with the names above."""

    def make(*rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        extra = "".join(f", `{c}` string" for c in CLASHING) if clash else ""
        return spark.createDataFrame([(*r, *(["x"] * len(CLASHING) if clash else [])) for r in full], DOCS + extra)

    return make


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and clashing columns."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    rows = [(1, prose(rng, 80)), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (None, prose(rng, 60)), (None, None), (7, "one", None, None), (7, "one", None, None), (8, "two words", "en", None), (8, "two\nlines", "de", "t"), (9, "é" * 3000), (10, "\x00\x01 zero"), (11, "\n\n\n"), (12, "a.b.c" * 9)]
    return docs(*rows, clash=True)


@pytest.fixture
def none(docs):
    return docs((1, "x"), clash=True).where("false")


@pytest.fixture(scope="session")
def sf():
    from pathlib import Path

    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no tables")
    return str(path)
