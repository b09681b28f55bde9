"""Small inputs that hold the awkward cases, shared by the tests of the operators."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Columns that operators make or use themselves.
CLASHING = ["fingerprint", "component_id", "kept", "keep_id", "found", "_text", "_norm", "ids", "lang_pred", "score", "k", "h", "__n", "__stay", "__row_id", "__row_sha", "__near_id", "__near_md5"]


def documents(spark, texts, first=1):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The same rows with more columns whose names operators use too, and one with a dot."""
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit("x") for name in CLASHING}).withColumn("a.b", F.lit(1))


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)
