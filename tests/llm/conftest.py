import random
import re

import pytest
from pyspark.sql import types as T

ODD = [None, "", " \t\n ", "one", "one two\nthree", "  x  y\n\n z", "'s'T'll 123abc４５ ½ _a__b!!", "a" * 40 + " " + "ab" * 30, "日本語 🙂🙂 é\u0085x\x1c z\x0b",
       "<|endoftext|> hi<|endoftext|>", "<|end", "x" * 3000 + " " * 50 + "\t\n" * 7, "\n", "\r\n\x0c", "word " * 5000, "İßſK", "🙂🙂"]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long and odd texts, repeated rows, null ids, a repeated id, and columns with clashing names."""
    rows = [(i, t, "en", f"s{i % 2}", i, i) for i, t in enumerate(ODD)]
    rows += [rows[5], rows[5], (None, "one two\nthree", None, None, None, None), (3, "another text of one id", "de", None, 7, 0), (100, None, None, None, None, None)]
    names = ["doc_id", "text", "lang", "source", "n_tokens", "node"]
    schema = T.StructType([T.StructField(n, T.StringType() if n in ("text", "lang", "source") else T.LongType()) for n in names])
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnoprstuvz") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)
