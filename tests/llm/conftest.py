import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, copies, near copies and a very long text."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, shared = prose(120), prose(40)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (5, " ".join(near)), (6, base.upper()),
        (7, f"{prose(30)}\n{shared}\n{prose(30)}"), (8, f"{shared} {prose(25)}\n\n{shared}"), (9, "one"), (10, "one two"), (11, "Ünïcode  Wörter — und Ümläute ½ ²"),
        (12, prose(30_000)), (13, "a a a a " * 40), (14, "a a a a " * 30), (15, "!!! ### $$$"), (16, "x\x1cy\x85z\u00a0w"), (17, prose(19)), (18, prose(20)),
        (19, "<|endoftext|> and <|startoftext|> inside  two   spaces\n\n\tend "), (3, base), (None, base), (None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return make(spark, edge_rows).cache()


@pytest.fixture(scope="session")
def clashing(spark, edge_rows):
    """The same documents with columns named as an operator might name its own."""
    from pyspark.sql import functions as F

    out = make(spark, edge_rows)
    for c in ("fp", "pos", "h", "k1", "key", "doc", "words", "host", "path", "rule", "verdict", "row", "g", "piece", "offset", "removed", "n_removed0", "id", "name", "size", "starts", "node", "root", "q", "k", "t", "toxic"):
        out = out.withColumn(c, F.lit("clash"))
    return out


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
