"""The registered queries over the smallest given tables: columns, folds and digests by their definitions."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"
LONG, TEXT, FLAG, REAL, INT = "bigint", "string", "boolean", "double", "int"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def results(spark, name, **columns):
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    rows = df.collect()
    return {r["doc_id"]: r for r in rows} if "doc_id" in kinds else rows


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, texts):
    got = results(spark, "op1_quality", doc_id=LONG, held_out=FLAG, score=REAL, predicted=INT)
    assert set(got) == set(texts)
    assert all(r["held_out"] == (remainder(d, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [d for d in labels if d in got and remainder(d, 3) == 1]
    assert sum(got[d]["predicted"] == labels[d] for d in held) >= 0.9 * len(held)


def test_op2(spark, texts):
    got = results(spark, "op2_substring_dedup", doc_id=LONG, n_words=LONG, n_removed=LONG, kept_sha256=TEXT)
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in texts.items()}
    first: dict = {}
    for d in sorted(words):
        for k in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][k : k + 13]), d)
    for d, w in words.items():
        gone = {q for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for q in range(k, k + 13)}
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), len(gone), sha(" ".join(x for q, x in enumerate(w) if q not in gone).encode()))


def test_op3(spark):
    rows = results(spark, "op3_chat", conv_id=LONG, held_out=FLAG, n_turns=LONG, chat_sha256=TEXT)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert {r["conv_id"] for r in rows} == {r["conv_id"] for r in turns.collect()} and sum(r["n_turns"] for r in rows) == turns.count()


def test_op4(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    got = results(spark, "op4_bpe", doc_id=LONG, n_tokens=LONG, ids_sha256=TEXT, decoded_sha256=TEXT)
    for d, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False).encode()))
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == want


def test_op5(spark, texts):
    got = results(spark, "op5_simhash", doc_id=LONG, fingerprint=TEXT, component_id=LONG)
    prints = {d: simhash.fingerprint((t or "").encode()) for d, t in texts.items()}
    group = {d: d for d in prints}
    for _ in prints:
        before = dict(group)
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a] = min(group[a], group[b])
        if before == group:
            break
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{prints[d]:016x}", group[d]) for d in prints}


def test_op6(spark, texts):
    got = results(spark, "op6_suffix_tree", doc_id=LONG, held_out=FLAG, n_tokens=LONG, n_known=LONG, train_tokens=LONG, base_score=REAL, score=REAL)
    tokens = {d: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for d, t in texts.items()}
    counts = Counter(w for d, x in tokens.items() if remainder(d, 5) != 1 for w in x)
    total, kinds = sum(counts.values()), len(counts)
    for d, x in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(d, 5) == 1, len(x), sum(counts[w] > 0 for w in x), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in x)) and r["score"] < 0
    seen = [r for r in got.values() if not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)


def test_op7(spark, texts):
    got = results(spark, "op7_merkle", doc_id=LONG, n_chars=LONG, edited_sha256=TEXT, fingerprint=TEXT, edited_fingerprint=TEXT, near_edited=REAL, near_next=REAL)
    ids = sorted(texts)
    for k, d in enumerate(ids):
        own, after = texts[d] or "", texts[ids[(k + 1) % len(ids)]] or ""
        q = len(own) // 4
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(own), sha((own[: len(own) - q] + after[:q]).encode()))
    prints = {d: r["fingerprint"] for d, r in got.items()}
    assert len(set(prints.values())) == len({t or "" for t in texts.values()})
    # an edited quarter leaves more alike than another document is
    apart = [r for r in got.values() if r["near_next"] < 0.9 and r["n_chars"] > 400]
    assert sum(r["near_edited"] > r["near_next"] for r in apart) >= 0.99 * len(apart)


def test_op8(spark, texts):
    got = results(spark, "op8_language", doc_id=LONG, held_out=FLAG, lang_pred=TEXT, score=REAL)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["held_out"] == (remainder(d, 4) == 2) and 0 <= r["score"] <= 1 for d, r in got.items())
    held = [d for d in got if got[d]["held_out"] and langs[d] and re.search("[a-z]", texts[d] or "")]
    assert sum(got[d]["lang_pred"] == langs[d] for d in held) >= 0.9 * len(held)


def test_op9(spark, texts):
    got = results(spark, "op9_decontamination", doc_id=LONG, n_words=LONG, n_hit=LONG, n_items=LONG, items_sha256=TEXT, contaminated=FLAG)
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows: dict = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r["text"])
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(r["item_id"]))
    sizes = {len(x) for x in windows}
    for d, t in texts.items():
        w, hit, items = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    items |= found
        r = got[d]
        want = (len(w), len(hit), len(items), sha(",".join(sorted(items)).encode()), bool(hit) and 20 * len(hit) >= len(w))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want


def test_op10(spark, texts):
    got = results(spark, "op10_secrets", doc_id=LONG, n_candidates=LONG, n_secrets=LONG, secrets_sha256=TEXT, redacted_sha256=TEXT)
    assert set(got) == set(texts)
    for d, r in got.items():
        assert r["n_secrets"] <= r["n_candidates"] and (r["n_secrets"] or texts[d] is None or r["redacted_sha256"] == sha(texts[d].encode()))
