"""Language-model scoring by a probabilistic suffix tree over bytes.

Tokens are words (A-Z lower-cased, parted by ASCII white space) and one end for each text. A text is spelled as its words'
bytes, a stop after each word, and the end; contexts are the bytes before a symbol, up to `depth` of them and across words.
A context is retained if the divergence of its next-symbol distribution from that of the context one byte shorter, times
its count, is worth more than the description of its symbols; nothing else decides which states there are. Distributions
are smoothed with those of shorter states, and a symbol is scored in the longest state that ends before it. A text's score
is the sum over its symbols; base_score is the add-half unigram score of its tokens.

Counting: each task sums its texts' contexts of the full depth and its words in sorted arrays and sends them, packed, to
parts: contexts by their last two bytes, words by their hash. Texts start after `depth` START bytes, so that every context
is full and shorter ones are sums of longer ones; all contexts with the same last two bytes meet, and so contexts of three
bytes and more are judged and smoothed where they meet. Shorter ones (at most 65,536 contexts) are judged in DataFrame functions.

Scoring: texts do not move. The tree goes to the workers in slices of at most `entries` entries by contexts' last two
bytes, a pass over the texts for each slice, so that its growth costs passes and not memory. Counts of the commonest words,
at most KNOWN_WORDS of them, go with the first slice; what rows have of rarer words is joined with their counts by hash.
Words are known by 64-bit hashes.

Null texts count as empty; a null held_out counts as false. Rows that repeat are scored each. Further columns of docs are
not looked at, and of a very long text's symbols CHUNK are worked on at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.bytetree import DEPTH, END, START, STOP, Tree
from rowloom.llm.common import map_arrow, parts_for, stored, text_bytes

#: Bytes of text, and symbols, that are worked on at a time.
GROUP, CHUNK = 2_000_000, 2_000_000
#: Distinct keys that a counting task holds before it sends them on.
HELD = 4_000_000
#: Words whose counts are broadcast.
KNOWN_WORDS = 2_000_000
#: Kinds of settled rows: a word's count, an entry of a context of two bytes, an entry of a longer context that is retained.
WORD, SHORT, STATE = 0, 1, 2
LN10 = float(np.log(10))


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    words.append(END)
    return words


def spelled(tokens: list[bytes]) -> bytes:
    return START * DEPTH + STOP.join(tokens)


def keys_of(buffer: np.ndarray, low: int, high: int) -> np.ndarray:
    """Contexts of the full depth with their symbols (see bytetree, without the depth) at places low to high."""
    keys = buffer[low:high].astype(np.int64)
    for j in range(1, DEPTH + 1):
        keys |= buffer[low - j : high - j].astype(np.int64) << (8 * j)
    return keys


def groups_of(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Tokens of texts, as many texts at a time as come to about GROUP bytes, and the number of the first."""
    at, held, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = text.as_py()
        held.append(tokens_of(raw))
        size += len(raw)
        if size > GROUP:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def hashes_of(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 11) for w in words), np.uint64, len(words)).view(np.int64)


def numbered(lists: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens, each token's number among them, and how many tokens each list has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = np.fromiter((number(w, len(known)) for x in lists for w in x), np.int64, int(sizes.sum()))
    return list(known), ids, sizes


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    order = np.argsort(keys, kind="stable")  # merges runs that are sorted already
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Sums:
    """Counts by key, merged now and then."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts, self.size, self.limit = [], [], 0, HELD

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > self.limit:
            keys, counts = self.merged()
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
            self.limit = max(HELD, 2 * self.size)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.counts]))


def two_of(keys: np.ndarray) -> np.ndarray:
    """The last two bytes of the contexts."""
    return keys >> 8 & 0xFFFF


def gathered(rows: DataFrame, parts: int) -> DataFrame:
    """(part, keys, counts): packed sums of contexts (parts 0 and up) and of words (as many parts beyond) over rows: (held_out, t)."""
    codec = "zstd"

    def packed(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(part, kind="stable")
        keys, counts, part = keys[order], counts[order], part[order]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else [0]
        for low, high in zip(edges, edges[1:], strict=False):
            steps = np.diff(keys[low:high], prepend=0)  # sorted keys: small steps, which pack well
            yield int(part[low]), pa.compress(steps.tobytes(), codec, asbytes=True), pa.compress(counts[low:high].astype(np.int64).tobytes(), codec, asbytes=True), int(high - low)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, words = Sums(), Sums()

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = contexts.merged()
            of_context = two_of(keys) * 40503 % 65536 * parts >> 16
            hashes, n = words.merged()
            of_word = parts + ((hashes.view(np.uint64) >> np.uint64(48)).astype(np.int64) * parts >> 16)
            for made in (packed(keys, counts, of_context), packed(hashes, n, of_word)):
                for part, k, c, size in made:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.binary()), pa.array([c], pa.binary()), pa.array([size], pa.int32())], names=["part", "keys", "counts", "size"])
            contexts.clear()
            words.clear()

        for batch in batches:
            learn = batch.filter(pa.compute.invert(batch.column(0)))
            for _, lists in groups_of(learn.column(1)):
                known, ids, _ = numbered(lists)
                words.add(*summed(hashes_of(known), np.bincount(ids, minlength=len(known)).astype(np.int64)))
                buffer = np.frombuffer(b"".join(map(spelled, lists)), np.uint8)
                for low in range(DEPTH, len(buffer), CHUNK):
                    high = min(low + CHUNK, len(buffer))
                    keys = keys_of(buffer, low, high)
                    contexts.add(*np.unique(keys[buffer[low:high] != START[0]], return_counts=True))
                if contexts.size > 2 * HELD:
                    yield from out()
        yield from out()

    return map_arrow(rows.select("held_out", "t"), work, "part int, keys binary, counts binary, size int")


def shorter(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of `depth` bytes with their symbols, from longer ones."""
    return summed(keys & ((1 << (8 * (depth + 1))) - 1), counts)


def judged(keys: np.ndarray, counts: np.ndarray, above: np.ndarray, above_counts: np.ndarray, depth: int, penalty: float) -> np.ndarray:
    """Which keys, sorted and without their depth, have a context of `depth` bytes that is retained; above: all contexts one byte shorter."""
    states = keys >> 8
    first = np.flatnonzero(np.concatenate([[True], states[1:] != states[:-1]]))
    kinds = np.diff(np.append(first, len(keys)))
    total = np.repeat(np.add.reduceat(counts, first), kinds)
    tops = above >> 8
    top = np.flatnonzero(np.concatenate([[True], tops[1:] != tops[:-1]]))
    parent = keys & ((1 << (8 * depth)) - 1)
    above_total = np.add.reduceat(above_counts, top)[np.searchsorted(tops[top], parent >> 8)]
    above_n = above_counts[np.searchsorted(above, parent)]
    gain = np.add.reduceat(counts * np.log(counts / total * above_total / above_n), first)
    return np.repeat(gain > penalty * kinds, kinds)


def settled(packed: DataFrame, parts: int, penalty: float) -> DataFrame:
    """(kind, two, key, n) from packed sums: each word's total, all entries of contexts of two bytes, and those of longer contexts that are retained. two: a context's last two bytes; keys of contexts have their depth."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, keys, counts, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, []).append((keys, counts, size))

        def unpack(data: bytes, size: int) -> np.ndarray:
            return np.frombuffer(pa.decompress(data, 8 * size, "zstd", asbytes=True), np.int64)

        def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(keys), 100_000):
                k = keys[low : low + 100_000]
                two = np.zeros(len(k), np.int32) if kind == WORD else two_of(k).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(two), pa.array(k), pa.array(counts[low : low + 100_000])], names=["kind", "two", "key", "n"])

        for part in list(held):
            own = held.pop(part)
            keys, counts = summed(np.concatenate([np.cumsum(unpack(k, size)) for k, _, size in own]), np.concatenate([unpack(c, size) for _, c, size in own]))
            if part >= parts:
                yield from out(WORD, keys, counts)
                continue
            for depth in range(DEPTH, 2, -1):
                above, above_counts = shorter(keys, counts, depth - 1)
                keep = judged(keys, counts, above, above_counts, depth, penalty)
                yield from out(STATE, depth << 56 | keys[keep], counts[keep])
                keys, counts = above, above_counts
            yield from out(SHORT, 2 << 56 | keys, counts)

    return map_arrow(packed.repartition(parts, "part"), work, "kind byte, two int, key long, n long")


def retained(counts: DataFrame, penalty: float) -> DataFrame:
    """The rows of counts, (key, n) with the depth in the key, whose context is retained."""
    rows = counts.select("key", "n", F.shiftright("key", 8).alias("state"), F.shiftright("key", 56).cast("int").alias("depth"))
    totals = rows.groupBy("state").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    below = F.expr("(cast(depth - 1 as bigint) << 56) | (key & ((1L << (8 * depth)) - 1))")
    parents = rows.select(F.col("key").alias("parent"), F.col("n").alias("parent_n"))
    sizes = totals.select(F.col("state").alias("above"), F.col("total").alias("above_n"))
    deeper = rows.where("depth > 0").withColumn("parent", below).join(parents, "parent").withColumn("above", F.shiftright("parent", 8))
    judged_ = deeper.join(totals, "state").join(sizes, "above")
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") * F.col("above_n") / F.col("parent_n")))
    kept = judged_.groupBy("state").agg(gain.alias("gain"), F.first("kinds").alias("kinds")).where(F.col("gain") > penalty * F.col("kinds")).select("state")
    return rows.where("depth = 0").select("key", "n").unionAll(rows.join(kept, "state", "left_semi").select("key", "n"))


class Slices:
    """The tree in slices of at most `entries` entries (or one pair of last bytes), each with all contexts of less than two bytes."""

    def __init__(self, rows: DataFrame, penalty: float, weight: float, entries: int):
        """rows: those of settled()."""
        two = rows.where(F.col("kind") == SHORT).select("key", "n")
        one, none = (two.groupBy(F.expr(f"({d}L << 56) | (key & {(1 << 8 * (d + 1)) - 1}L)").alias("key")).agg(F.sum("n").alias("n")) for d in (1, 0))
        short = stored(retained(two.unionAll(one).unionAll(none), penalty), "short").withColumn("two", F.expr("cast((key >> 8) & 65535 as int)"))
        self.shallow = short.where(F.shiftright("key", 56) < 2).select("key", "n").toArrow()  # at most 65,792 rows
        self.deep = short.where(F.shiftright("key", 56) == 2).select("two", "key", "n").unionAll(rows.where(F.col("kind") == STATE).select("two", "key", "n"))
        self.weight, self.bounds, held = weight, [0], 0
        for row in sorted(self.deep.groupBy("two").agg(F.count("*").alias("n")).collect()):  # at most 65,536 rows
            if held and held + row["n"] > entries:
                self.bounds.append(row["two"])
                held = 0
            held += row["n"]
        self.bounds.append(1 << 16)
        self.tasks = max(12, entries // 500_000)

    def __iter__(self) -> Iterator[tuple[int, int, Tree]]:
        """(low, high, tree): for contexts whose last two bytes are from low to below high."""
        shallow = tuple(self.shallow[c].to_numpy() for c in ("key", "n"))
        top, shipped, weight = Tree.suffix(*shallow, DEPTH, self.weight), self.deep.sparkSession.sparkContext.broadcast(shallow), self.weight

        def smoothed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Entries and states of longer contexts; all that a context is smoothed with has the same last two bytes, or is short."""
            own = list(batches)
            if not own:
                return
            keys, counts = (np.concatenate([short, *(x.column(k).to_numpy() for x in own)]) for k, short in enumerate(shipped.value))
            tree = Tree.suffix(keys, counts, DEPTH, weight)
            for state, k, v, shift in ((False, tree.entries, tree.logs, 56), (True, tree.states, tree.escapes, 48)):
                at = np.flatnonzero(k >> shift >= 2)
                for low in range(0, len(at), 100_000):
                    part = at[low : low + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), state)), pa.array(k[part]), pa.array(v[part])], names=["state", "key", "value"])

        for low, high in zip(self.bounds, self.bounds[1:], strict=False):
            own = self.deep.where((F.col("two") >= low) & (F.col("two") < high))
            made = stored(map_arrow(own.repartition(self.tasks, "two").select("key", "n"), smoothed, "state boolean, key long, value float"), "tree")
            parts = []
            for state, k, v in ((False, top.entries, top.logs), (True, top.states, top.escapes)):
                rows = made.where(F.col("state") == state).select("key", "value").orderBy("key").toArrow()  # at most `entries`
                parts += [np.concatenate([k, rows["key"].to_numpy()]), np.concatenate([v, rows["value"].to_numpy()])]
            yield low, high, Tree(*parts, DEPTH)


def common_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """(sorted hashes, counts, whether these are all) of the words with the greatest counts, at most KNOWN_WORDS; words: (key, n)."""
    step = F.floor(F.log2("n") * 8)
    sizes = {r["b"]: r["w"] for r in words.groupBy(step.alias("b")).agg(F.count("*").alias("w")).collect()}  # at most 512 rows
    least, held = 1 << 10, 0
    for b in sorted(sizes, reverse=True):
        if held + sizes[b] > KNOWN_WORDS:
            break
        least, held = b, held + sizes[b]
    rows = words.where(step >= least).orderBy("key").toArrow()
    return rows["key"].to_numpy(), rows["n"].to_numpy(), held == sum(sizes.values())


def _symbol_scores(lists: list[list[bytes]], tree: Tree, mine: np.ndarray) -> np.ndarray:
    """The sum, for each text, of the natural log probabilities of its symbols whose contexts' last two bytes are mine."""
    spellings = list(map(spelled, lists))
    buffer = np.frombuffer(b"".join(spellings), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, spellings), np.int64, len(spellings)))
    out = np.zeros(len(lists))
    for low in range(DEPTH, len(buffer), CHUNK):
        high = min(low + CHUNK, len(buffer))
        keys = keys_of(buffer, low, high)
        use = np.flatnonzero((buffer[low:high] != START[0]) & mine[two_of(keys)])
        distinct, inverse = np.unique(keys[use], return_inverse=True)
        values = tree.of_keys(DEPTH << 56 | distinct)[inverse]
        out += np.bincount(np.searchsorted(ends, use + low, side="right"), values, len(lists))
    return out


def score(docs: DataFrame, held_out: Column, penalty: float = 1.0, weight: float = 2.0, entries: int = 16_000_000, part_mb: float = 8) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    held_out: whether a row is kept from training. If nothing is left to train on, N and V are 0 and all symbols are alike.
    entries bounds the tree's entries that a worker holds (about 16 bytes each).
    """
    spark = docs.sparkSession
    parts = min(parts_for(docs.select("doc_id", "text"), part_mb), 1 << 15)
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), text_bytes(docs["text"]).alias("t"))
    found = stored(settled(gathered(rows, parts), parts, penalty), "counts")
    words = found.where(F.col("kind") == WORD).select("key", "n")
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).head()
    total, kinds = int(sums["n"] or 0), int(sums["v"])
    known, known_counts, whole = common_words(words)
    room = float(np.log10(total + 0.5 * (kinds + 1)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def first_pass(low: int, high: int, tree: Tree) -> DataFrame:
        shipped = spark.sparkContext.broadcast((low, high, tree, known, known_counts))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, tree, known, known_counts = shipped.value
            mine = np.zeros(1 << 16, bool)
            mine[low:high] = True
            for batch in batches:
                out = []
                for _, lists in groups_of(batch.column(3)):
                    own, ids, sizes = numbered(lists)
                    hashes = hashes_of(own)
                    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                    there = known[at] == hashes if len(known) else np.zeros(len(own), bool)
                    counts = np.where(there, known_counts[at], 0) if len(known) else np.zeros(len(own), np.int64)
                    # of words that are not known here nothing is added yet, unless it is clear that their count is 0
                    base = np.where(there | whole, np.log10(counts + 0.5) - room, 0.0)
                    firsts = np.cumsum(sizes) - sizes
                    rare = np.zeros(len(own), bool) if whole else ~there
                    places = np.flatnonzero(rare[ids])
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[places], minlength=len(sizes)))])
                    lists_ = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes[ids[places]]))
                    out.append((sizes, np.add.reduceat(there[ids].astype(np.int64), firsts), np.add.reduceat(base[ids], firsts), _symbol_scores(lists, tree, mine), lists_))
                if out:
                    columns = [pa.array(np.concatenate([x[k] for x in out])) for k in range(4)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *columns, pa.concat_arrays([x[4] for x in out])], names=["doc_id", "held_out", "h", "n_tokens", "n_known", "base_score", "score", "rare"])

        frame = rows.select("doc_id", "held_out", F.xxhash64("t").alias("h"), "t")
        return map_arrow(frame, work, f"doc_id {kind}, held_out boolean, h long, n_tokens long, n_known long, base_score double, score double, rare array<long>")

    def next_pass(low: int, high: int, tree: Tree) -> DataFrame:
        shipped = spark.sparkContext.broadcast((low, high, tree))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, tree = shipped.value
            mine = np.zeros(1 << 16, bool)
            mine[low:high] = True
            for batch in batches:
                sums = [_symbol_scores(lists, tree, mine) for _, lists in groups_of(batch.column(2))]
                if sums:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sums))], names=["doc_id", "h", "more"])

        made = map_arrow(rows.select("doc_id", F.xxhash64("t").alias("h"), "t"), work, f"doc_id {kind}, h long, more double")
        # rows that repeat have the same sum
        return stored(made.groupBy("doc_id", "h").agg(F.max("more").alias("more")), "scores")

    scored, more = None, None
    for low, high, tree in Slices(found, penalty, weight, entries):
        if scored is None:
            scored = stored(first_pass(low, high, tree).withColumn("row", F.monotonically_increasing_id()), "scores")
        else:
            made = next_pass(low, high, tree)
            more = made if more is None else more.unionAll(made)
    out = scored.select("row", "doc_id", "h", "held_out", "n_tokens", "n_known", "base_score", "score")
    if not whole:
        seen = scored.select("row", F.explode("rare").alias("key")).join(words, "key", "left")
        n = F.coalesce("n", F.lit(0))
        rare = seen.groupBy("row").agg(F.sum((n > 0).cast("long")).alias("known"), F.sum(F.log10(n + 0.5) - room).alias("base"))
        out = out.join(rare, "row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("known", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("base", F.lit(0.0))})
    if more is not None:
        sums = more.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("hash")).agg(F.sum("more").alias("more"))
        out = out.join(sums, out["doc_id"].eqNullSafe(sums["id"]) & (out["h"] == sums["hash"])).withColumn("score", F.col("score") + F.col("more"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("score") / LN10).alias("score"))
