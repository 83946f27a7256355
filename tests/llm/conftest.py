import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, h long, kept string, `start` int, place long, predicted int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ["an", "to", "re", "st", "ou", "ing", "the", "ea", "éla", "or"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text): null, empty, blank, repeated, odd and very long texts, null ids."""
    a, b = prose(1, 60), prose(2, 80)
    return [
        (1, a), (2, a), (3, b), (3, b), (4, None), (5, ""), (6, " \n\t "), (None, a), (None, None), (7, f"{b} {a}"), (8, prose(3, 30) + " " + a), (9, "one"),
        (10, "x" * 70_000), (11, prose(4, 9000)), (12, "日本語 🙂 e\u0301 \u00a0 a   b\n\n \n c\x1f\x85 \u2028"), (13, prose(5, 25)), (14, (prose(6, 5) + " ") * 30), (15, b.upper()), (16, b.replace(" ", "\n", 3)),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 7, 8, "k", 9, 10, 1) for i, t in awkward()], KIND).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)
