import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": ["the", "thing", "with", "river", "house", "walks", "and", "over"], "de": ["der", "schöne", "zeit", "über", "haus", "geht", "und", "straße"]}


def make_docs():
    """Small documents with nulls, empty, blank and long texts, ties and repeated rows."""
    rnd = random.Random(5)
    rows = []
    for i in range(40):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rnd.choice(WORDS[lang]) for _ in range(60 + i)), lang, f"src{i % 3}", None))
    base = " ".join(rnd.choice(WORDS["en"]) + str(k) for k in range(80))
    rows += [(100 + k, base.replace("walks", "walk", k), "en", "src0", 5) for k in range(3)]
    rows += [(110, base, "en", "src1", 1), (110, base, "en", "src1", 1), (111, base.upper(), "en", None, 1)]
    rows += [(200, None, "en", "src0", None), (201, "", None, None, 0), (202, " \t\n ", "de", "src1", 4), (203, "12 34 !!", "en", "src1", 8), (204, "one two", "en", "src2", 7), (205, "one two", "en", "src2", 7)]
    rows += [(None, "the river house with the thing over and over", "en", "src0", 10), (None, None, None, None, None)]
    rows += [(300, "the house over " * 4000, "en", "src0", 60000), (301, "x" * 100_000, "en", "src0", 100_000)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("words", "cls", "n", "token", "score", "lang_pred", "domain", "rate", "n_tokens", "_text", "_doc", "held_out", "p_clean", "half", "n_words", "spans", "component_id")
    return docs.withColumns({x: F.lit("extra") for x in names})


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 5 != 0, i % 7 == 0) for i in range(40)] + [(1, True, False), (None, True, False), (3, None, None)]
    return spark.createDataFrame([(i, None if q is None else int(q), None if t is None else int(t), "x") for i, q, t in rows], "doc_id long, quality int, toxic int, words string")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)
