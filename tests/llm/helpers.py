"""Small tables with the awkward cases that every operator must survive."""

from pyspark.sql import SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark: SparkSession, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], SCHEMA)


def words(prefix: str, n: int) -> str:
    return " ".join(f"{prefix}{i}" for i in range(n))


def awkward(spark: SparkSession):
    """Nulls in any column, empty and white texts, ties, repeated rows, a very long text."""
    long = words("w", 30_000)
    return documents(spark, [
        (1, "Alpha beta gamma delta epsilon zeta. Eta!", "en", "a"), (2, "alpha BETA gamma delta epsilon zeta. eta!", "en", "a"),
        (3, None, "en", "a"), (4, "", None, None), (5, " \t\n ", "de", "b"), (6, long, "de", "b"), (7, long + " tail", "de", None),
        (8, "ALPHA", None, "b"), (8, "ALPHA", None, "b"), (None, "no id here at all ok", "en", "a"), (None, None, None, None),
        (9, "Ünïcode   \U0001F600 ß", "fr", ""), (10, "a b c d e f g h", "fr", "")])


def named_like_internals(df):
    """Extra columns, some of which clash with likely names."""
    from pyspark.sql import functions as F
    return df.withColumn("size", F.lit("x")).withColumn("label", F.lit(1)).withColumn("component", F.lit(2.5))
