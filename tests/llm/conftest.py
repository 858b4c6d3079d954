"""Documents with the cases that every operator must define."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, name string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def edge_texts() -> list[str | None]:
    base = prose(1, 120)
    shared = prose(2, 70)
    return [
        None,
        "",
        "   \t\n ",
        "word",
        "Four words only here",
        "four WORDS only here",
        base,
        base,
        base.upper(),
        base + " one more tail",
        prose(3, 60) + " " + shared + " " + prose(4, 60),
        prose(5, 30) + "\n" + shared + "\n\n" + prose(6, 30),
        shared,
        "naïve café ÀÉÎ straße nbsp  em 　wide " + prose(7, 60),
        "line one two\nline one two\nother line\nline one two\n" * 6,
        "# $ % | < > & * " * 20,
        "x" * 20_000,
        "é" * 9_000 + " tail",
        prose(8, 3_000),
        "a  b   c \r\n d \x0b e \x0c f " + prose(9, 50),
        "It's we'll I'm they've 12345 <|endoftext|> end <|startoftext|> x",
        "日本語のテキスト 漢字 かな " * 10,
        "İstanbul İ ſ K final\u0000nul",
        "emoji 😀😀 👩‍👩‍👧 " + prose(10, 12),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark):
    texts = edge_texts()
    rows = [(i, t, "en", "s", None if t is None else len(t), 7, "k", "n") for i, t in enumerate(texts)]
    rows.append(rows[9])  # a repeated row
    rows.append((1000, rows[6][1], None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
