"""Byte-level BPE encoding and decoding.

A text is cut at special tokens and then into pieces by the vocabulary's piece pattern. Each piece is encoded by
backtracking: an Aho-Corasick automaton over all tokens gives the longest token at every position; the encoder takes the
longest one that is compatible with the token before it, tries shorter ones else, and steps back over positions that are
known to lead nowhere. Two tokens are compatible if merging by rank would leave the boundary between them, which is worked
out once for each pair and kept in a table. The result is that of merging by rank, in time linear in the piece.

Decoding gathers token bytes from one blob through a table of offsets.

Null texts count as empty: no ids, empty text. Very long texts and pieces need memory in proportion to one text only.
Repeated rows are encoded as often as they occur; further columns are ignored unless asked for with ``keep``.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowloom.llm.common import map_arrow

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
#: Texts of characters below this one take a pattern whose classes are spelled out, which the standard library matches faster.
LATIN_END = 0x250
#: Pieces in each of the two generations of a worker's table.
TABLE_PIECES = 100_000
#: Pairs of tokens in the compatibility table; it starts anew beyond that.
TABLE_PAIRS = 300_000


@lru_cache(maxsize=1)
def _piece_patterns():
    """Findall of the pattern for Latin texts, a search for others, findall of the general pattern, a search for characters newer than the tokenizers library knows, and findall of the pattern for texts that hold such."""
    import re

    import regex

    def spelled(kind: str) -> str:
        one = regex.compile(kind)
        return "".join(re.escape(chr(c)) for c in range(LATIN_END) if one.fullmatch(chr(c)))

    l, n, s = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\s")
    latin = re.compile(rf" ?[{l}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+").findall
    beyond = re.compile(f"[^\0-{chr(LATIN_END - 1)}]").search

    letters, numbers, odd = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), []
    for point in range(0x300, 0x110000):
        if unicodedata.category(c := chr(point)) == "Cn" and (letters.match(c) or numbers.match(c)):
            odd.append(point)
    ranges: list[list[int]] = []
    for point in odd:
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    late = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    plain = regex.compile(PIECES.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}"))
    if not late:
        return latin, beyond, plain.findall, lambda text: None, plain.findall
    known = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{late}]]+| ?[\p{{N}}--[{late}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{late}]]+|\s+(?!\S)|\s+", regex.V1)
    return latin, beyond, plain.findall, regex.compile(f"[{late}]").search, known.findall


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    def __init__(self, text: str):
        model = json.loads(text)
        symbols = byte_symbols()
        vocab = model["model"]["vocab"]
        size = max([*vocab.values(), *(x["id"] for x in model["added_tokens"])]) + 1
        self.tokens: list[bytes | None] = [None] * size
        for word, number in vocab.items():
            self.tokens[number] = bytes(symbols[c] for c in word)
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        #: rank order is what decides; tokens get numbers in that order: bytes first, then merges
        self.order = [vocab[c] for c in symbols] + [vocab[a + b] for a, b in merges]
        number = {t: k for k, t in enumerate(self.order)}
        self.bytes_of = [self.tokens[t] for t in self.order]
        self.parts: list[tuple[int, int] | None] = [None] * 256 + [(number[vocab[a]], number[vocab[b]]) for a, b in merges]
        self.merged = {p: k for k, p in enumerate(self.parts) if p}
        by_bytes = {t: k for k, t in enumerate(self.bytes_of)}
        self.shorter = [next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), None) for t in self.bytes_of]
        self.by_bytes = by_bytes
        self.compatible: dict[int, bool] = {}
        blob = [t if t is not None else b"" for t in self.tokens]
        for content, t in self.special.items():
            blob[t] = content.encode()
        self.lengths = np.array([len(t) for t in blob], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.packed = [np.uint32(t).astype("<u4").tobytes() for t in self.order]
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.bytes_of):
            self.automaton.add_word(t.decode("latin-1"), (k, len(t)))
        self.automaton.make_automaton()

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the boundary between two tokens."""
        key = left * 65536 + right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= TABLE_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo the merges beside the boundary from the latest on. A pair across it that would have been merged
        # earlier than what has just been undone would have taken the boundary away.
        undone = len(self.parts)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < undone:
                return False
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                undone, left = left, a[1]
            else:
                # equal ranks merge from the left on, so a pair of the right token's own rank is earlier
                undone, right = right + 1, b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Numbers in rank order of a piece's tokens."""
        if (whole := self.by_bytes.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest: list[int] = [-1] * n
        most = [0] * n
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            if size > most[start := end + 1 - size]:
                most[start], longest[start] = size, token
        sizes = self.bytes_of
        alive, out, at = bytearray(b"\1") * (n + 1), [], 0
        token: int | None = longest[0]
        while at < n:
            before = out[-1] if out else None
            while token is not None:
                end = at + len(sizes[token])
                if alive[end] and (before is None or self.fits(before, token)):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                alive[at] = 0
                token = out.pop()
                at -= len(sizes[token])
        return out

    def encode(self, text: str, table: Table) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        latin, beyond, plain, late, known = _piece_patterns()
        pieces = latin if not beyond(text) else known if late(text) else plain
        if not any(map(text.__contains__, self.special)):
            return b"".join(map(table.__getitem__, pieces(text)))
        out = []
        for part in _split_special(text, self.special):
            out += [np.uint32(part).astype("<u4").tobytes()] if isinstance(part, int) else map(table.__getitem__, pieces(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text that ids stand for; bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return b""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        at += np.arange(ends[-1])
        return self.blob[at].tobytes().decode("utf-8", "replace").encode()


def _split_special(text: str, special: dict[str, int]) -> list:
    import regex

    return [special.get(x, x) for x in regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text)]


class Table(dict):
    """Packed ids of pieces. A full table becomes the old one, from which pieces still in use come back."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            of = self.vocabulary
            packed = b"".join(map(of.packed.__getitem__, of.encode_piece(piece.encode())))
            if len(piece) > 100:
                return packed
        if len(self) >= TABLE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = packed
        return packed


_loaded: dict[str, Vocabulary] = {}


def load(text: str) -> Vocabulary:
    key = hashlib.md5(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def encode_decode(docs: DataFrame, vocabulary_path: str, keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """One row per document: the kept columns, n_tokens, and ids (array of int) with decoded text; with digests, their SHA-256 instead.

    The vocabulary file (a few MB whatever the corpus) is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    frame = docs.select(*keep, docs["text"].alias("__text"))
    fields = [frame.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(shipped.value)
        table = Table(vocabulary)
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                counts, ids_out, decoded_out = [], [], []
                for text in batch.column(len(keep)).slice(at, step).to_pylist():
                    packed = vocabulary.encode(text or "", table)
                    ids = np.frombuffer(packed, "<u4")
                    decoded = vocabulary.decode(ids)
                    counts.append(len(ids))
                    ids_out.append(hashlib.sha256(packed).hexdigest() if digests else ids.astype(np.int32))
                    decoded_out.append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode())
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + [pa.array(counts, pa.int64()), pa.array(ids_out, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded_out, pa.string())],
                    names=[f.name for f in fields],
                )

    return map_arrow(frame, work, T.StructType(fields))
