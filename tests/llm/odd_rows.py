import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"

PARA = "The quick brown fox jumps over the lazy dog and then it sleeps in the warm sun of the late afternoon while birds sing"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, PARA), (5, PARA), (6, PARA + " today"), (7, PARA.replace(" ", "\n ")),
    (8, "x" * 50_000), (9, " ".join(f"w{i % 700}" for i in range(20_000))), (None, PARA), (10, "mail a.b@c.de or +49 (30) 1234-5678 now"),
    (11, "naïve café — “quotes” 漢字 👍🏽 <|endoftext|> it's"), (12, "\n".join([PARA] * 3)), (13, "A B\x0bC\r\nD"), (14, "a b c d"),
]
CLASHES = (
    "row name place token n sig key gone whole best spans level left right head label score kept lines value comp weight"
    " ranges _text _words features batch"
).split()


def odd(spark, rows=ODD, kind="doc_id long, text string"):
    """The rows with extra columns, whose names operators may use inside."""
    df = spark.createDataFrame(rows, kind).coalesce(2)
    return df.select(*df.columns, *[F.lit(1).alias(c) for c in CLASHES])


@pytest.fixture
def docs(spark):
    return odd(spark)


@pytest.fixture
def no_docs(spark):
    return odd(spark, [])
