"""A small documents table with everything that may go wrong in one: nulls, empty and long texts, repeated rows, odd columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that results or inner steps also use.
        T.StructField("score", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("kept", T.LongType()),
        T.StructField("a.b", T.LongType()),
    ]
)

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "straße", "éa", "x1"]

TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "One two three.",
    "One two three.",
    "One two three.\nOne two three.\n\n | nav | bar |\nAll rights reserved.",
    " ".join(WORDS[(i * i) % 10] for i in range(400)) + ".",
    " ".join(WORDS[i % 10] for i in range(20_000)),
    "x" * 50_000,
    "日本語 のテキスト。\tタブ\x0bvt\x0cff\rcr nbsp ls",
    "👍🏽 é \x00nul ▁lower  two  spaces ",
    "#*$%&|<> ### \n\n###\n###",
    "123 456 789",
]


def rows():
    out = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", len(t or ""), "s", "r", i, i) for i, t in enumerate(TEXTS)]
    return [*out, out[5], (None, "No id here.", "en", "s", 11, None, None, None, None), (100, None, None, None, None, None, None, None, None)]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sf_dir(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
