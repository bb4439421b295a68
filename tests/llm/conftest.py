"""Small tables with what the operators must stand: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

import pytest

WORDS = "alpha beta gamma delta Épsilon zeta ÄTA theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): near and exact copies, shared lines, nulls and blanks."""
    rng = random.Random(7)
    rows = []
    for i in range(60):
        lines = [prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines), rng.choice(["en", "de"]), f"s{rng.randint(0, 3)}"))
    for i in range(60, 75):
        rows.append((i, rows[i - 60][1], "en", "s0"))
    for i in range(75, 90):
        words = rows[i - 75][1].split(" ")
        words[len(words) // 2] = "Changed"
        rows.append((i, " ".join(words), "en", "s1"))
    for i in range(90, 110):
        rows.append((i, rows[i - 90][1] + "\n The Shared Line of all\t\nÄrger in der zeile", "en", None))
    rows += [(110, None, "en", "s0"), (111, "", None, "s0"), (112, " \n\t\n", "en", "s9"), (113, "one two", "en", "s0"), (114, prose(rng, 5000), "en", "s0"), (115, "ärger IN der Zeile\nthe shared line OF ALL", "en", "s0")]
    rows += [(116, "x " * 400, "en", "s0"), (117, "a b c d e f g h " * 20, "en", "s2")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and columns called like the operators' own."""
    rows = [(None, "a line that is shared\nother", "en", "s", 1, "p", 2.0), (3, "a line that is shared\nother", "en", "s", 1, "p", 2.0), (3, "a line that is shared\nother", "en", "s", 1, "p", 2.0), (5, None, None, None, None, None, None), (5, "another text of the id", "en", "s", 1, "p", 2.0), (1, "A Line That Is Shared", "en", None, 0, "q", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines int, pos string, `c.0` double")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
