"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Each window's minimiser is the least hash among its runs of
``mini`` words; consecutive windows that share one make a super-k-mer, which travels as one packed string of words to the
bucket of its minimiser. Equal windows have equal minimisers, so each bucket can settle its windows alone: it sorts them
by hash, compares neighbours word by word, and takes the smallest document of each. A word is removed if a window over it
also starts in a document with a smaller id; windows are judged on the input.

Skew: a task sends every distinct super-k-mer once, with the smallest document that it has seen there; further documents
with the same one are settled on the spot. So however many copies a passage has, its bucket gets at most one string from
each task. Minimisers are ``mini`` words long, which keeps frequent words from drawing windows to one bucket.
Super-k-mers of a task travel compressed, one blob for each bucket.

A very long text is taken whole: its words are held once, and its super-k-mers leave the task as they fill a blob. Tables
without rows give none; further columns of docs are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import map_arrow, parts_for, text_bytes

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values."""
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[k : k + len(out)]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def super_kmers(hashes: np.ndarray, window: int, mini: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each super-k-mer of a document."""
    runs = run_hashes(hashes, mini)
    span = window - mini + 1
    least = runs[: len(runs) - span + 1].copy()
    for k in range(1, span):
        np.minimum(least, runs[k : k + len(least)], out=least)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return starts, np.diff(np.append(starts, len(least))), least[starts]


def pack(rows: list[tuple[bytes, int, list[int]]]) -> bytes:
    """rows: (words of a super-k-mer, document, its first words there)."""
    import zstandard

    docs = np.array([r[1] for r in rows], "<i8")
    counts = np.array([len(r[2]) for r in rows], "<i4")
    starts = np.array([x for r in rows for x in r[2]], "<i4")
    return zstandard.compress(struct.pack("<qq", len(rows), len(starts)) + docs.tobytes() + counts.tobytes() + starts.tobytes() + b"\n".join(r[0] for r in rows), 3)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    import zstandard

    data = zstandard.decompress(blob)
    n, m = struct.unpack_from("<qq", data)
    at = 16 + 12 * n
    return np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<i4", n, 16 + 8 * n), np.frombuffer(data, "<i4", m, at), data[at + 4 * m :].split(b"\n")


def settle(strings: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the super-k-mers of a bucket, whether each of their windows is to be removed, and the number of windows of each.

    Sorting by (hash, document) puts the smallest document of each window first; neighbours of equal hash are compared
    word by word, and where hashes collide the windows are told apart by their words.
    """
    sizes = np.fromiter((s.count(b" ") for s in strings), np.int64, len(strings)) + 1
    words = b" ".join(strings).split(b" ")
    counts = sizes - window + 1
    firsts = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    keys = run_hashes(word_hashes(words), window)[firsts]
    owner = np.repeat(docs, counts)
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    head = np.concatenate([[True], keys[1:] != keys[:-1]])
    leader = np.flatnonzero(head)[np.cumsum(head) - 1]
    least = owner[leader]
    at = firsts[order]
    check = np.flatnonzero(~head)
    wrong = {int(leader[k]) for k in check if words[at[k] : at[k] + window] != words[at[leader[k]] : at[leader[k]] + window]}
    for group in wrong:
        members = np.flatnonzero(leader == group)
        seen: dict[tuple, int] = {}
        for k in members:
            key = tuple(words[at[k] : at[k] + window])
            least[k] = seen.setdefault(key, owner[k])
    removed = np.zeros(len(order), bool)
    removed[order] = least < owner
    return removed, counts


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def bucket_spans(blobs: list[bytes], window: int) -> np.ndarray:
    """Rows (document, first window, windows) that are to be removed, from all blobs of a bucket."""
    docs, counts, starts, strings = zip(*map(unpack, blobs), strict=True)
    docs, counts, starts, strings = np.concatenate(docs), np.concatenate(counts), np.concatenate(starts), [x for y in strings for x in y]
    removed, sizes = settle(strings, docs, window)
    some = np.add.reduceat(removed, np.cumsum(sizes) - sizes) > 0
    firsts, places, out = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts, []
    for k in np.flatnonzero(some):
        for low, n in zip(*_runs(removed[firsts[k] : firsts[k] + sizes[k]]), strict=True):
            out += [(docs[k], starts[at] + low, n) for at in range(places[k], places[k] + counts[k])]
    return np.array(out, np.int64).reshape(-1, 3)


class _Held:
    """A task's super-k-mers, each once, with the smallest document seen and its places there; what is settled already."""

    def __init__(self, buckets: int):
        self.buckets, self.turn = buckets, 0
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, tuple[int, int, list[int]]] = {}
        self.done: list[tuple[int, int, int]] = []
        self.weight = 0

    def add(self, string: bytes, bucket: int, doc: int, start: int, n: int) -> None:
        old = self.rows.get(string)
        if old is None or old[1] > doc:
            if old is not None:
                self.done += [(old[1], at, n) for at in old[2]]
            self.rows[string] = (bucket, doc, [start])
            self.weight += len(string) + 250
        elif old[1] < doc:
            self.done.append((doc, start, n))
        else:
            old[2].append(start)
            self.weight += 40

    def flush(self) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        for string, (bucket, doc, starts) in self.rows.items():
            by_bucket.setdefault(bucket, []).append((string, doc, starts))
        out = [(bucket, pack(rows), False) for bucket, rows in by_bucket.items()]
        for at in range(0, len(self.done), 50_000):
            out.append((self.turn % self.buckets, np.array(self.done[at : at + 50_000], "<i8").tobytes(), True))
            self.turn += 1
        self.clear()
        for at in range(0, len(out), 256):
            yield pa.RecordBatch.from_pydict({"bucket": [x[0] for x in out[at : at + 256]], "blob": [x[1] for x in out[at : at + 256]], "settled": [x[2] for x in out[at : at + 256]]}, schema=_BLOBS)


_BLOBS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("settled", pa.bool_())])
#: Bytes that a task holds before it sends blobs.
HELD_BYTES = 100_000_000
#: Texts of a task whose later copies are settled on the spot.
HELD_TEXTS = 300_000


def repeated_spans(docs: DataFrame, window: int = 13, mini: int = 4, bucket_mb: float = 0.75) -> DataFrame:
    """(doc_id, first, n): n windows from word `first` on that also start in a document with a smaller id."""
    buckets = parts_for(docs.select("doc_id", "text"), bucket_mb)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = _Held(buckets), {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().split()
                if len(words) < window:
                    continue
                joined = b" ".join(words)
                key = hashlib.blake2b(joined, digest_size=16).digest()
                if texts.get(key, doc) < doc:
                    held.done.append((doc, 0, len(words) - window + 1))
                    continue
                if len(texts) < HELD_TEXTS or key in texts:
                    texts[key] = doc
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                ends = np.cumsum(sizes + 1) - 1
                starts, counts, least = super_kmers(word_hashes(words), window, mini)
                lows, highs = (ends - sizes)[starts], ends[starts + counts + window - 2]
                for low, high, start, n, bucket in zip(lows.tolist(), highs.tolist(), starts.tolist(), counts.tolist(), (least % np.uint64(buckets)).tolist(), strict=True):
                    held.add(joined[low:high], bucket, doc, start, n)
                if held.weight + 80 * len(held.done) > HELD_BYTES:
                    yield from held.flush()
        yield from held.flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}

        def spans(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2].astype(np.int32))], names=["doc_id", "first", "n"])

        for batch in batches:
            for bucket, blob, settled in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if settled:
                    yield spans(np.frombuffer(blob, "<i8").reshape(-1, 3))
                else:
                    blobs.setdefault(bucket, []).append(blob)
        while blobs:
            rows = bucket_spans(blobs.popitem()[1], window)
            for at in range(0, len(rows), 100_000):
                yield spans(rows[at : at + 100_000])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text_bytes(docs["text"]).alias("t"))
    packed = map_arrow(rows, split, "bucket int, blob binary, settled boolean")
    return map_arrow(packed.repartition(max(12, buckets // 4), "bucket"), gather, "doc_id long, first int, n int")


def remove_repeats(docs: DataFrame, window: int = 13, digests: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space; with digests kept_sha256 instead of kept.

    Words are what ASCII white space parts, unchanged. Null and empty texts have none. Documents of fewer words than a
    window lose nothing, nor does a row without doc_id, which comes out all the same. Rows that share a doc_id are
    taken as one document: what either repeats is removed at its place in both.
    """
    found = repeated_spans(docs, window).groupBy("doc_id").agg(F.collect_list("first").alias("first"), F.collect_list("n").alias("n"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(docs["text"]).alias("t")).join(found, "doc_id", "left")
    name = "kept_sha256" if digests else "kept"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, firsts, sizes in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = text.as_py().split()
                gone = 0
                if (low := firsts.values) is not None and len(words) >= window:
                    steps = np.zeros(len(words) + 1, np.int64)
                    low = low.to_numpy()
                    high = low + sizes.values.to_numpy() + window - 1
                    np.add.at(steps, np.minimum(low, len(words)), 1)
                    np.add.at(steps, np.minimum(high, len(words)), -1)
                    stay = np.cumsum(steps[:-1]) == 0
                    gone = int(len(words) - stay.sum())
                    if gone:
                        words_kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                n_words.append(len(words))
                n_removed.append(gone)
                text = b" ".join(words_kept if gone else words)
                kept.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return map_arrow(rows, apply, f"doc_id long, n_words long, n_removed long, {name} string")
