"""The pipeline against a brute-force version on a small corpus, by the stages' definitions."""

import random
import re

import pytest

import corpus_pipeline
from rowloom.llm import decontaminate, quality, queries, secrets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    words = [a + b for a in ("the", "an", "wor", "th", "er") for b in ("ing", "re", "in", "ta", "lo", "ed")]
    good = [" ".join(r.choices(words, k=r.randint(60, 160))) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in r.choices(words, k=80)) for _ in range(20)]
    passages = [" ".join(r.choices(words, k=30)) for _ in range(4)]
    texts = good + bad + [good[3], good[4], good[5] + " ing"] + [good[7][:200] + " " + passages[0], passages[1]] + [good[8] + " password=04c2b6b343501bc0e2 the"]
    texts += [" ".join(r.choices(words, k=90)) + " password=04c2b6b343501bc0e2 the", " ".join(r.choices(words, k=900)) + " " + passages[2] + " " + " ".join(r.choices(words, k=900))]
    rows = [(k, t, "en", "src0", len(t)) for k, t in enumerate(texts)] + [(900, None, None, None, None)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_run_is_the_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    network = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    left = {d: r for d, r in rows.items() if network.score((r["text"] or "").encode()) >= 0.5}
    # five-word shingles, a Jaccard similarity of 0.8 or more; empty texts are copies of each other
    sets = {}
    for d, r in left.items():
        words = (r["text"] or "").lower().split()
        sets[d] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    group = {d: d for d in left}
    for _ in left:
        before = dict(group)
        for a in left:
            for b in left:
                if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[a] = min(group[a], group[b])
        if before == group:
            break
    left = {d: r for d, r in left.items() if group[d] == d}
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    windows = {tuple(w[k : k + 13]) for i in spark.read.parquet(f"{folder}/benchmark.parquet").collect() for w in [split(i["text"])] for k in range(len(w) - 12)}
    for d in list(left):
        words, hit = split(left[d]["text"]), set()
        for k in range(len(words) - 12):
            if tuple(words[k : k + 13]) in windows:
                hit.update(range(k, k + 13))
        if hit:  # any window of 13 words, however long the document is; the items here have no fewer
            del left[d]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    want = {d: library.encode((r["text"] or "").replace("04c2b6b343501bc0e2", secrets.MASK), add_special_tokens=False).ids for d, r in left.items()}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want and {85, 86, 87} <= set(rows) and not {85, 87} & set(got) and 86 in got and decontaminate.BROADCAST_ROWS


def test_stages_keep_columns_and_extras(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnsRenamed({}).selectExpr("*", "1 as fp", "'x' as score", "2 as predicted", "3 as findings", "'y' as redacted", "4 as node", "5 as sign")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns
        docs = made.limit(30)


def test_stages_on_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
