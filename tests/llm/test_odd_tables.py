"""Every operator on nulls, empty and very long texts, rows that repeat, tables without rows and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from rowloom.llm import bpe, chat, decontaminate, langid, merkle, quality, queries, resemblance, secrets, simhash, substring, suffixtree

LONG = " ".join(f"word{k % 977} of the {k % 31}" for k in range(60_000))
TEXTS = [(1, "some plain text of a few words and more of them"), (2, None), (3, ""), (4, LONG), (5, "  "), (5, "  "), (6, "x" * 200_000), (1, "some plain text of a few words and more of them"), (None, "no id"), (None, None)]
CLASH = ("node", "key", "n", "h", "row", "rare", "kind", "two", "asker", "given", "v", "range", "term", "words", "value", "fp", "rep", "bucket", "blob", "score", "held_out", "t", "first", "sign", "item_id", "findings")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("src"), **{c: F.lit(k) for k, c in enumerate(CLASH)}})


def forest():
    return [{"feature": "digits", "threshold": 0.2, "left": {"vote": 0.0}, "right": {"vote": 1.0}}]


def network():
    net = quality.Network()
    net.trained = True
    return net


OPERATORS = {
    "quality": lambda d, b: quality.score(d, network()),
    "substring": lambda d, b: substring.remove_repeats(d),
    "bpe": lambda d, b: bpe.encode_decode(d, queries.vocabulary_path()),
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "resemblance": lambda d, b: resemblance.near_duplicates(d),
    "suffixtree": lambda d, b: suffixtree.score(d, F.col("doc_id") == 3),
    "merkle": lambda d, b: merkle.compared(d),
    "langid": lambda d, b: langid.identify(d, langid.train(d)),
    "decontaminate": lambda d, b: decontaminate.contamination(d, b),
    "secrets": lambda d, b: secrets.scan(d, forest(), d["source"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = frame(spark, TEXTS).repartition(3)
    bench = spark.createDataFrame([(1, "some plain text of a few words and more of them"), (2, None)], "item_id long, text string").withColumn("n", F.lit(1))
    got = OPERATORS[name](docs, bench)
    rows = [tuple(r) for r in got.collect()]
    at = got.columns.index("doc_id")
    assert sorted(str(r[at]) for r in rows) == sorted(str(d) for d, _ in TEXTS)
    for doc in (1, 5):
        same = [r for r in rows if r[at] == doc]
        assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    docs, bench = frame(spark, TEXTS).where("false"), spark.createDataFrame([], "item_id long, text string")
    assert OPERATORS[name](docs, bench).collect() == []


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, n int, h string"
    turns = spark.createDataFrame([(1, 0, "user", "word " * 50_000, 1, "a"), (1, 1, "assistant", None, 1, "a"), (1, 1, "assistant", None, 1, "b"), (None, None, None, None, 1, "a"), (2, 0, "robot", "", 1, "a")], schema)
    for rows, size in ((turns, 3), (turns.where("false"), 0)):
        scripts = chat.transcripts(rows)
        assert chat.parse(scripts, chat.train(scripts), ("conv_id", "part")).count() == size
