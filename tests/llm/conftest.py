import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows of documents with copies, near copies, shared passages and lines, ties and odd texts; a frame maker takes extra columns."""
    rng = random.Random(11)
    syllables = "an er on the re ing ou sh ly ti es ble nd".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), "Shared line of " + prose(5)
    texts = [prose(rng.randint(60, 260)) for _ in range(30)]
    base = prose(150)
    for i in range(14):
        words = base.split()
        words[rng.randrange(len(words))] = f"edit{i}"
        texts.append(" ".join(words))
    texts += [base, base, texts[0], texts[1].upper(), prose(40) + " " + passage + " " + prose(40), passage + "\n" + prose(30)]
    texts += [prose(50) + "\n" + line + "\n" + prose(20) for _ in range(14)]
    texts += [None, "", " \t\n ", "one two", "One  two", "a " * 400, "%%% ### " * 80, prose(60).replace(" ", " | "), "naïve ÉTÉ ß 😀 " * 30]
    texts += [prose(9000), "x" * 70_000, "\n".join([line] * 3 + [""] * 3)]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 13}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]

    def make(extra: dict[str, int] | None = None, more=()):
        frame = spark.createDataFrame([*rows, *more], DOCUMENTS).repartition(3)
        for name, value in (extra or {}).items():
            frame = frame.withColumn(name, frame["doc_id"] * 0 + value)
        return frame

    make.rows, make.passage = rows, passage
    return make
