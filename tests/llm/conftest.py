import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    # Names that the operators use inside.
    " bits long, block string, kind string, size int, start int, blob string, rank int, keys string"
)
WORDS = "the of and storm coast river stone light under over seven green market paper".split()


def prose(seed: int, count: int) -> str:
    draw = random.Random(seed)
    return " ".join(
        draw.choice(WORDS) + ("".join(draw.choices("aeioust", k=4)) if draw.random() < 0.6 else "")
        for _ in range(count)
    )


def awkward_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and white texts, repeats within and across texts, ties, repeated rows."""
    shared = prose(1, 60)
    long_text = " ".join(prose(k, 400) for k in range(5, 12)) + "\n" + prose(5, 400)
    return [
        (7, prose(2, 80) + " " + shared),
        (3, shared + "\n" + prose(3, 50)),
        (4, None),
        (5, ""),
        (6, " \t\n\x0b\x0c\r "),
        (None, shared + " tail"),
        (None, "no id at all"),
        (8, prose(2, 80) + " " + shared),
        (8, prose(2, 80) + " " + shared),
        (9, prose(2, 80).upper() + " " + shared),
        (10, long_text),
        (11, "a" * 700),
        (12, "ab" * 300 + " é ö 日本語́ <|endoftext|> x<|endoftext|>"),
        (13, "one two three"),
        (14, "don't  stop\n\n now,  'tis\tfine \r\n end "),
        (15, shared[:150]),
        (2, shared[20:400]),
        (16, ("line with words\n" * 6) + "\n\n"),
        (17, prose(2, 79) + " " + shared),
        (17, "another text of the same id " + shared[:200]),
    ]


@pytest.fixture
def frame(spark):
    """Rows (doc_id, text) as a documents table, with null languages and clashing names."""

    def make(rows, pieces=3):
        full = [
            (i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "web", len(t or ""))
            + (k, "b", "k", k, k, "x", k, "y")
            for k, (i, t) in enumerate(rows)
        ]
        return spark.createDataFrame(full, SCHEMA).repartition(pieces)

    return make


@pytest.fixture
def awkward(frame):
    return frame(awkward_rows())


@pytest.fixture(scope="session")
def documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def pairs_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
