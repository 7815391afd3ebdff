import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, secrets string, score double, size string, key string, class_id string, label int, text_key string, toxic string, taken string, copies string"


def prose(seed: int, n: int, words: str = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon") -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words.split()) + str(r.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may go wrong, and columns named like results."""
    clash = ("mine", 9.0, "mine", "mine", "mine", 9, "mine", "mine", "mine", "mine")
    base = prose(1, 60)
    rows = [
        (1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " more", "en", "b", 1), (3, prose(2, 40), "fr", None, 1),
        (None, prose(3, 30), None, "b", None), (None, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n", "en", "b", 3), (6, "word", "en", "ä", 4),
        (7, "Ünïcode 😀 " * 20, "de", "z", 1), (8, prose(4, 30_000), "en", "a", 1), (9, None, "en", None, None), (10, "x" * 100_000, "en", "a", 1),
    ]
    return spark.createDataFrame([r + clash for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
