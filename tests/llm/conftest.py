"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

import pytest

WORDS = "the of and to a stone river idiot moon clown cloud license mit apache general public tree bird".split()


def text(r, n):
    return " ".join(r.choice(WORDS) + (r.choice(".,!") if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    r = random.Random(4)
    base = [text(r, r.randint(1, 120)) for _ in range(40)]
    out = [(i, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s2", "s2", None])) for i, t in enumerate(base)]
    for i in range(40, 60):  # near and exact copies
        words = r.choice(base).split(" ")
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = "edited" + str(i)
        out.append((i, " ".join(words), "en", "s2"))
    out += [(60, None, None, None), (61, "", "en", ""), (62, " \t\n\v", "en", "s1"), (63, "été ŁÓDŹ 日本語 x", "fr", "s1"), (64, text(r, 9000), "en", "s2"), (65, "one two three", "en", "s1"), (66, "One TWO three", "en", "s1"), (67, "line\n\nline\nline ", "en", "s1")]
    return out


DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def put(spark, tmp_path):
    """Writes tables and returns the folder, as a query takes it."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
