"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 majority bits over the XXH64 values of a text's word shingles.

Links between distinct fingerprints at most ``distance`` bits apart are found by the generalised pigeonhole principle:
the 64 bits are dealt to four partitions of 16 with correlated bits together, and each fingerprint gets a threshold for
each partition, -1 (not probed) or more, with sum(threshold + 1) = distance + 1. Two linked fingerprints must then differ
in some partition by no more than that partition's threshold. A dynamic program picks the thresholds that give the fewest
expected candidates, from histograms of the partitions' values over all distinct fingerprints (4 x 65,536 counts whatever
the corpus, which is the proven bound of what is broadcast). Each fingerprint is indexed under its four values and probes
the values within its thresholds; candidates are verified bit by bit.

A partition value that more than CROWDED fingerprints hold is split by further bits, which the principle allows: two
fingerprints that are at most two bits apart agree on two of the four partitions at least. Whoever holds or probes a
crowded value is dealt under its six pairs of partition values, 32 bits each, so that what is dealt for a fingerprint does
not grow with the corpus. If a pair of values is crowded in turn, there is a cluster of near copies, and its fingerprints
are linked over middle values: two fingerprints are at most two bits apart if and only if some 64-bit value is at most one
bit from both, so each is sent to the 65 values of its ball, where at most 65 can meet. Nothing is dropped, and no group
grows with the corpus.

For similarities that 64 bits cannot tell, `signature` gives as many bits as asked, in words of 64 that are partitioned one
by one; see resemblance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import map_arrow, small, stored, text_bytes
from rowloom.llm.graph import components

PARTS, WIDTH = 4, 16
#: A value, or pair of values, that more distinct fingerprints than this hold is crowded.
CROWDED = 48
PAIRS = tuple((i, j) for i in range(PARTS) for j in range(i))
_CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one text, as an unsigned integer; no words give 0."""
    import xxhash

    tokens = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1)
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null texts count as empty: fingerprint zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", text_bytes(docs["text"]).alias("t")), work, f"doc_id {kind}, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def signature(hashes: np.ndarray, words: int) -> np.ndarray:
    """64 * words majority bits over a set's hashes, each of them stirred anew for each word; no hashes give 0."""
    n, ones = len(hashes), np.zeros(64 * words, np.int64)
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, 255):  # so many ones that a byte can count
        x = hashes[at : at + 255].view(np.uint64)[:, None] + steps[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").view("<i8")


def bit_groups(together: np.ndarray, n: int, parts: int = PARTS) -> list[list[int]]:
    """Bits 0 to 63 in as equal groups as can be; each group grows by the bit that is most correlated with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = list(range(64)), []
    for k in range(parts):
        own = [left.pop(int(np.argmax(related[np.ix_(left, left)].sum(axis=0))))]
        while len(own) < 64 // parts + (k < 64 % parts):
            own.append(left.pop(int(np.argmax(related[np.ix_(left, own)].sum(axis=1)))))
        groups.append(sorted(own))
    return groups


def parts_of(values: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Each value's partition values, as rows."""
    bits = _bits(values)
    return np.stack([bits[:, g].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64)) for g in groups], axis=1)


def expected(histogram: np.ndarray, distance: int) -> np.ndarray:
    """[partition, threshold, value]: how many fingerprints hold a value within threshold of it."""
    at = np.arange(1 << WIDTH)
    near = lambda c: sum(c[at ^ (1 << b)] for b in range(WIDTH))
    out = np.zeros((PARTS, distance + 1, 1 << WIDTH))
    for i, own in enumerate(histogram.astype(float)):
        shells = [own, near(own)]
        for d in range(2, distance + 1):
            shells.append((near(shells[-1]) - (WIDTH - d + 2) * shells[-2]) / d)
        out[i] = np.cumsum(shells[: distance + 1], axis=0)
    return out


def thresholds(values: np.ndarray, costs: np.ndarray, distance: int) -> np.ndarray:
    """By dynamic programming over the partitions, for each row of partition values the thresholds of the least total cost."""
    n, room = len(values), distance + 1
    best = np.full((n, room + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((PARTS, n, room + 1), np.int8)
    for i in range(PARTS):
        cost = costs[i][:, values[:, i]]
        nxt = best.copy()
        for used in range(1, room + 1):
            for take in range(1, used + 1):
                offer = best[:, used - take] + cost[take - 1]
                better = offer < nxt[:, used]
                nxt[better, used] = offer[better]
                choice[i][better, used] = take
        best = nxt
    out, left, rows = np.zeros((n, PARTS), np.int8), np.full(n, room), np.arange(n)
    for i in reversed(range(PARTS)):
        out[:, i] = choice[i][rows, left] - 1
        left = left - choice[i][rows, left]
    return out


def flips(distance: int) -> list[np.ndarray]:
    """For each threshold, the masks of up to so many of WIDTH bits."""
    masks = [np.array([0])]
    single = 1 << np.arange(WIDTH)
    shell = np.array([0])
    for _ in range(distance):
        shell = np.unique((shell[:, None] | single[None, :]).ravel())
        masks.append(np.unique(np.concatenate([masks[-1], shell])))
    return masks


def dealt(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """(role, key, fp, rep), stored: role 0 holds a partition value, 1 probes one, 2 holds and probes a pair of them.

    distinct: (fp long, rep), one row per fingerprint.
    """
    spark = distinct.sparkSession

    def cooccur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n))], names=["k", "n"])

    sums = map_arrow(distinct.select("fp"), cooccur, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # 4,097 rows
    flat = np.zeros(4097, np.int64)
    flat[sums["k"]] = sums["n"]
    groups = bit_groups(flat[:4096].reshape(64, 64), int(flat[4096]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for batch in batches:
            values = parts_of(batch.column(0).to_numpy().view(np.uint64), groups)
            for i in range(PARTS):
                total[i] += np.bincount(values[:, i], minlength=1 << WIDTH)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total.ravel()[keys])], names=["k", "n"])

    sums = map_arrow(distinct.select("fp"), count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # at most 262,144 rows
    histogram = np.zeros(PARTS << WIDTH, np.int64)
    histogram[sums["k"]] = sums["n"]
    shipped = spark.sparkContext.broadcast(histogram.reshape(PARTS, -1).astype(np.int32))
    kind = distinct.schema["rep"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        masks = flips(distance)
        costs = expected(held, distance) + np.array([len(m) for m in masks])[None, :, None]
        for batch in batches:
            fps, reps = batch.column(0).to_numpy().view(np.uint64), batch.column(1)
            values = parts_of(fps, groups)
            limit = thresholds(values, costs, distance)
            crowded = np.zeros(len(fps), bool)
            rows, keys, roles = [], [], []

            def put(at: np.ndarray, key: np.ndarray, role: int, rows=rows, keys=keys, roles=roles) -> None:
                rows.append(at)
                keys.append(key)
                roles.append(np.full(len(at), role, np.int8))

            everyone = np.arange(len(fps))
            for i in range(PARTS):
                full = held[i][values[:, i]] > CROWDED
                crowded |= full
                alone = held[i][values[:, i]] < 1
                put(everyone[~full & ~alone], (i << WIDTH) + values[~full & ~alone, i], 0)
                for d in range(distance + 1):
                    at = everyone[limit[:, i] == d]
                    if len(at):
                        probes = (values[at, i][:, None] ^ masks[d][None, :]).ravel()
                        at = np.repeat(at, len(masks[d]))
                        there = held[i][probes]
                        crowded[at[there > CROWDED]] = True
                        # a value that nobody holds has no candidates, nor one that only the prober holds
                        some = (there > 0) & (there <= CROWDED) & ~((probes == values[at, i]) & (there == 1))
                        put(at[some], (i << WIDTH) + probes[some], 1)
            at = everyone[crowded]
            for k, (i, j) in enumerate(PAIRS):
                put(at, (k << 2 * WIDTH) + (values[at, i] << WIDTH) + values[at, j], 2)
            at, key, role = np.concatenate(rows), np.concatenate(keys), np.concatenate(roles)
            for k in range(0, len(at), 1 << 17):
                take = at[k : k + (1 << 17)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(role[k : k + (1 << 17)]), pa.array(key[k : k + (1 << 17)].astype(np.int64)), pa.array(fps[take].view(np.int64)), reps.take(pa.array(take))], names=["role", "key", "fp", "rep"]
                )

    return stored(map_arrow(distinct.select("fp", "rep"), deal, f"role byte, key long, fp long, rep {kind}"), "probes")


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): ids of distinct fingerprints at most distance bits apart; at least enough of them to connect all that are linked.

    distinct: (fp long, rep), one row per fingerprint. rep: an id without nulls.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2: clusters are linked over one middle value, and pairs of partition values hold for no more")
    rows = dealt(distinct, distance)
    held = rows.where("role = 0").select("key", F.col("fp").alias("x"), F.col("rep").alias("b"))
    probes = rows.where("role = 1").select("key", "fp", F.col("rep").alias("a"))
    near = held.join(probes, "key").where((F.col("x") != F.col("fp")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("fp"))) <= distance)).select("a", "b")
    pairs = rows.where("role = 2").select("key", "fp", "rep")
    full = stored(pairs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("key"), "crowded")
    one, two = pairs.join(small(full), "key", "left_anti").select("key", F.col("fp").alias("x"), F.col("rep").alias("a")), pairs.select("key", "fp", F.col("rep").alias("b"))
    near = near.unionAll(one.join(two, "key").where((F.col("x") < F.col("fp")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("fp"))) <= distance)).select("a", "b"))
    cluster = pairs.join(small(full), "key", "left_semi").select("fp", "rep").distinct()
    middles = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    balls = cluster.select("fp", "rep", F.explode(middles).alias("key"))
    if distance < 2:
        # a middle value links up to two bits; nearer ones need the direct test among the at most 65 that meet
        meet = balls.groupBy("key").agg(F.collect_list(F.struct("fp", "rep")).alias("m")).where(F.size("m") > 1)
        direct = meet.select(F.explode("m").alias("p"), "m").select("p", F.explode("m").alias("q")).where((F.col("p.fp") < F.col("q.fp")) & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("q.fp"))) <= distance))
        return near.unionAll(direct.select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")))
    meet = balls.groupBy("key").agg(F.collect_list("rep").alias("m")).where(F.size("m") > 1)
    return near.unionAll(meet.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, distance: int = 2, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Null and empty texts have fingerprint zero and are linked as any other. A row without doc_id takes part in no link and
    has a null component_id. Repeated ids come out as often as they come in; equal fingerprints share a component.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    known = prints.where("doc_id is not null")
    distinct = stored(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(links(distinct, distance), "a", "b")
    by_print = distinct.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(by_print, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
