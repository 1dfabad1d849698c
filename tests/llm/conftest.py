"""Documents with every odd case that the operators' docstrings name."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string, key string, spans int, __id int"
WORDS = "the of and lorem ipsum dolor sit amet consectetur elit sed do tempor magna aliqua ut enim minim veniam quis nostrud".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def row(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", "z", 1, 2)


@pytest.fixture(scope="session")
def rows():
    shared, line = prose(1, 90), "A line that many documents share."
    out = [row(k, prose(100 + k, 60 + k)) for k in range(12)]
    out += [row(20, prose(20, 80)), row(21, prose(20, 80)), row(22, prose(20, 80) + " end"), row(23, prose(20, 80).upper())]
    out += [row(30 + k, f"{prose(300 + k, 30)}\n{line}\n{shared}. {prose(400 + k, 30)}\n  {line.upper()}\t\n", source=f"src{k % 3}") for k in range(5)]
    out += [row(40, None), row(41, ""), row(42, "  \n\t "), row(43, "one"), row(44, "one two three"), row(45, "12345 ... !!!", None), row(46, "héllo wörld ñandú 漢字 😀 é  x\x1cy", "fr", None)]
    out += [row(50, prose(50, 4000)), row(51, "ab" * 3000), row(52, "x" * 900), row(53, prose(50, 4000) + " tail")]
    out += [row(60, prose(60, 70)), row(60, prose(60, 70)), row(61, prose(61, 70)), row(61, prose(62, 70), "de")]
    out += [row(None, prose(20, 80)), row(None, None, None, None), row(-5, prose(5, 55), "de", "src7")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
