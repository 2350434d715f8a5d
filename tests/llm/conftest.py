import pytest

#: Rows that every operator must take: nulls, no words, marks outside the BMP, ties and repeats.
ODD = [
    (1, None), (2, ""), (3, "  \n\t"), (4, "a"), (5, "a b"), (6, "one two three four five six"), (7, "one two three four five six"),
    (8, "ünï cödé 🙂 ▁x́ \x00 tail"), (9, "word " * 30000), (9, "word " * 30000), (10, "x" * 5000), (11, "don't 'stop (it's) 12'34 <|endoftext|> ÉÀ"),
]


@pytest.fixture
def odd(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("ids", T.StringType()), T.StructField("component_id", T.StringType())])
    return spark.createDataFrame([(i, t, 1, "clash", None) for i, t in ODD], schema).repartition(3)


@pytest.fixture
def none(odd):
    return odd.limit(0)
