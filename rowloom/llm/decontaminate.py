"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions alone.

Words are runs of ASCII letters and digits and of everything beyond ASCII; A-Z are lower-cased. A window is `window`
consecutive words of a benchmark item, or a shorter item as a whole.

1. The corpus frequency of every benchmark word is counted over all documents.
2. Each window has the place of its rarest word as its first probe, of its next rarest as its second. Windows that
   overlap mostly share them. A window with a word that no document has cannot occur.
3. Postings (term, doc_id, pos) of all probe terms are stored; those of first probes keep the words around them.
4. Lists are adjusted by the probe's place in the item, so that all postings of one occurrence agree in doc, item and
   diagonal; the first probes' list is intersected with the second probes'.
5. What is left is compared with the item word by word in both directions from the first probe; a run as long as a window
   is an exact phrase match, and all its words are hit.

What the benchmark side sends is, for each probe, the item's words up to a window away from it. It is broadcast only if it
is measured to have at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes; else both sides are shuffled by word, and places
that are found go back to their texts by document.
A very long text's words are one array, of which each place that an item's rare word has takes a window along. Of terms that
are equally rare the first in alphabetical order is the probe. Tables without rows, of either kind, give no hits; further
columns are not looked at, whatever their names. Null texts have no words. Items without words or id are left out. Documents without id come out without hits; rows that
share an id share their hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import stored

#: What parts words before lower-casing, that is with A-Z among the words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def words(text: Column) -> Column:
    """The words of a text, not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() is as good, and faster, where all is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def is_small(df: DataFrame) -> bool:
    size = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).head()
    return size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is measured to be small."""
    return F.broadcast(df) if is_small(df) else df


def item_words(items: DataFrame) -> DataFrame:
    """(item_id string, terms) of the items that have both; repeated ones count once."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.transform(words(F.col("text")), lowered).alias("terms"))
    return rows.where((F.size("terms") > 0) & F.col("item_id").isNotNull()).distinct()


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(term, n) over all documents, for the words of items that occur."""
    vocabulary = items.select(F.explode("terms").alias("term")).distinct()
    rows = docs.select(F.explode(words(F.col("text"))).alias("w")).select(lowered(F.col("w")).alias("term"))
    return rows.join(small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))


def probes(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item_id, rank, at, term, near, off, least): the places of each item's first and second probes.

    near: the item's words up to a window away, for first probes; off: the probe's place among them; least: how many words
    a window of the item has.
    """
    by_item = items.select("item_id", "terms", F.posexplode("terms").alias("at", "term")).join(small(counts), "term", "left")
    known = by_item.groupBy("item_id", "terms").agg(F.array_sort(F.collect_list(F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"))
    size = F.least(F.size("terms"), F.lit(window))
    starts = known.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("terms") - size)))
    own = F.slice("all", F.col("start") + 1, size)
    ranked = F.array_sort(F.transform(own, lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term"), x["at"].alias("at"))))
    ranked = starts.select("item_id", "terms", size.alias("least"), ranked.alias("r")).where(F.col("r")[0]["n"] > 0)
    pairs = ranked.select("item_id", "terms", "least", F.posexplode(F.slice("r", 1, 2)).alias("rank", "p"))
    low = F.greatest(F.col("p.at") - window + 1, F.lit(0))
    near = F.when(F.col("rank") == 0, F.slice("terms", low + 1, F.col("p.at") - low + window))
    return pairs.select("item_id", "rank", F.col("p.at").alias("at"), F.col("p.term").alias("term"), near.alias("near"), (F.col("p.at") - low).alias("off"), "least").distinct()


def postings(docs: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """(term, doc_id, pos, around, place) of wanted (term, keeps): where keeps, around has the words up to reach away and place the term's place among them."""
    rows = docs.where("doc_id is not null").select("doc_id", words(F.col("text")).alias("words"))
    if is_small(wanted):
        rows = rows.select("doc_id", "words", F.posexplode("words").alias("pos", "w")).withColumn("term", lowered(F.col("w"))).join(F.broadcast(wanted), "term")
    else:
        # texts must not move with each of their words: places go back to them instead
        rows = rows.withColumn("hash", F.xxhash64("words"))
        found = rows.select("doc_id", "hash", F.posexplode("words").alias("pos", "w")).withColumn("term", lowered(F.col("w"))).join(wanted, "term")
        found = found.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("pos", "term", "keeps")).alias("found"))
        rows = rows.join(found, ["doc_id", "hash"]).select("doc_id", "words", F.inline("found"))
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.transform(F.slice("words", low + 1, F.col("pos") - low + reach + 1), lowered)
    return rows.select("term", "doc_id", "pos", F.when(F.col("keeps"), around).alias("around"), (F.col("pos") - low).alias("place"))


def index(docs: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """Those postings, stored."""
    return stored(postings(docs, wanted, reach), "postings")


def _run(step: int, reach: int) -> Column:
    """How many words agree from the first probe on, in the direction of step."""
    own, other = (lambda k: F.get(F.col("around"), F.col("place") + step * k)), (lambda k: F.get(F.col("near"), F.col("off") + step * k))
    agree = F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda k: own(k).eqNullSafe(other(k)) & other(k).isNotNull())
    return F.coalesce(F.nullif(F.array_position(agree, F.lit(False)), F.lit(0)) - 1, F.lit(reach)).cast("int")


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, item_id, first, last): runs of document words that are covered by occurrences of an item's windows."""
    if window < 2:
        raise ValueError("a window has two words at least")
    own = stored(item_words(items), "items")
    found = stored(probes(own, stored(term_counts(docs, own), "counts"), window), "probes")
    wanted = found.groupBy("term").agg((F.min("rank") == 0).alias("keeps"))
    held = index(docs, wanted, window - 1)
    first = held.join(small(found.where("rank = 0").drop("rank")), "term").withColumn("diagonal", F.col("pos") - F.col("at"))
    second = held.select("term", "doc_id", "pos").join(small(found.where("rank = 1").select("term", "item_id", "at")), "term").select("item_id", "doc_id", (F.col("pos") - F.col("at")).alias("diagonal"))
    alone = first.where("least = 1")  # such an item has no second word
    both = first.where("least > 1").join(second, ["item_id", "doc_id", "diagonal"], "left_semi").select(alone.columns)
    runs = both.unionByName(alone).withColumns({"left": _run(-1, window - 1), "right": _run(1, window - 1)})
    runs = runs.where(F.col("left") + F.col("right") + 1 >= F.col("least"))
    return runs.select("doc_id", "item_id", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last"))


def proximity_matches(docs: DataFrame, items: DataFrame, within: int, window: int = 13) -> DataFrame:
    """(doc_id, item_id): documents in which the two rarest words of some window of the item stand at most `within` words nearer or farther than in the item."""
    own = stored(item_words(items), "items")
    found = stored(probes(own, stored(term_counts(docs, own), "counts"), window), "probes")
    held = index(docs, found.select("term", F.lit(False).alias("keeps")).distinct(), 0)
    lists = held.join(small(found.select("item_id", "rank", "at", "term")), "term").select("doc_id", "item_id", "rank", (F.col("pos") - F.col("at")).alias("diagonal"))
    # only diagonals in the same or a neighbouring stretch can be near: no pairs of all places in a document
    stretch = F.floor(F.col("diagonal") / (within + 1))
    one = lists.where("rank = 0").select("doc_id", "item_id", F.col("diagonal").alias("d"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")).distinct()
    two = lists.where("rank = 1").select("doc_id", "item_id", "diagonal", stretch.alias("stretch"))
    near = one.join(two, ["doc_id", "item_id", "stretch"]).where(F.abs(F.col("d") - F.col("diagonal")) <= within)
    return near.select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, longest, contaminated) for each row of docs; contaminated: share * n_hit >= n_words, and any hit at all. item_ids are sorted as strings; longest is the longest run of words that one item's windows cover, 0 without a hit."""
    hits = phrase_matches(docs, items, window).groupBy("doc_id").agg(
        F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("first", "last")), lambda x: F.sequence(x["first"], x["last"]))))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.max(F.col("last") - F.col("first") + 1).cast("long").alias("longest"),
    )
    rows = docs.select("doc_id", F.size(words(docs["text"])).cast("long").alias("n_words")).join(hits, "doc_id", "left")
    rows = rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("longest", F.lit(0).cast("long")).alias("longest"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
