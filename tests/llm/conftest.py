import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties, and columns named like those of the operators."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35), (2, None, "en", None, None), (3, "", None, "a", 0), (4, " \t\n", "de", "", 3), (5, "ALPHA beta\tgamma  delta\nepsilon zeta", None, "b", 36),
        (6, "word " * 30_000, "en", "b", 150_000), (7, "naïve café ☕ 漢字 🎉 <|endoftext|> x", "fr", "b", 30), (8, "short one", "fr", None, 9), (9, "x" * 5_000, "en", "z", 5_000), (None, "a row without id", None, None, 16), (None, "a row without id", None, None, 16),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = "digest row key n ids n_tokens kept keep_id size target taken score labels held_out entry host spans base run media_key media_bytes block token slice blob mark found tokens s h docs shards first last pos".split()
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(more)])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}
