import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made_up(seed=1, n=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(n):
        text = " ".join(draw.choice(vocabulary) for _ in range(draw.randint(5, 120)))
        if i % 5 == 0:
            text = text + "\n" + passage + "\n" + text[:40]
        if i % 7 == 0 and rows:
            text = rows[draw.randrange(len(rows))][1]
        if i % 11 == 0 and rows:
            text = (rows[-1][1] or "") + " x"
        rows.append((i, text, draw.choice(["en", "fr", None]), draw.choice(["a", "b", "c", "Ωd", None])))
    rows += [
        (100, None, None, None), (101, "", "en", "a"), (102, " \t\n\x0b\f\r ", "en", "a"), (103, "one", "en", "b"), (104, "Two Words", "fr", "b"),
        (105, "two words", "fr", "b"), (106, passage, "en", "c"), (107, "é" * 3 + " ß ﬀ 漢字 🙂 ² ½ İstanbul ΣΑΣ don't it's", "en", "c"),
        (108, "a b\n" * 400, "en", "a"), (109, " ".join(f"x{i % 50}" for i in range(20_000)), "en", "a"), (110, "###$$$ %%% &&& | < > ***", "en", "a"),
        (7, rows[7][1], "en", "a"), (7, rows[7][1], "en", "a"), (8, "another text under a known number", "fr", "b"), (111, "A   b c <|endoftext|> d", "en", "a"),
    ]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return made_up()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """A small table of documents with every awkward case, kept in files as corpora are."""
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-docs-") + "/documents.parquet"
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns that are called as the operators' own."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("size", "shard", "slot", "kept", "keep_id", "group_size", "text_sha256", "start", "queue", "fp", "key", "row", "target", "taken", "anchor", "grade"):
        out = out.withColumn(name, F.lit("mine"))
    return out
