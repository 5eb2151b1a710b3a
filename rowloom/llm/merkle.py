"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions alone.

A text's paragraphs are its lines. A paragraph whose hash falls on a multiple of SECTION ends a section, so that an edit
moves no boundary but its own. Section nodes hash their paragraphs' hashes in order, the root hashes the sections'.
Texts are equal if and only if their roots are (up to a collision of SHA-256 or MD5); where roots differ, only sections
that differ need to be opened to locate the paragraphs that do.

Below a paragraph are its leaves, cut where the content says so (LEAF): after a vowel or a mark that white space follows,
at the latest after 40 characters. So texts of one line have several leaves too, and behind an edit the cuts fall into
step again. A fingerprint is the root in hex, a colon, and the hashes of the tree's distinct leaves in order, in hex.
Likeness of two fingerprints is 1 if the roots are equal, else twice the leaves that both trees have over the leaves of
both: a shared section or paragraph shares its leaves, so this is what descending both trees finds. Nothing is sampled.

Null texts count as empty. Work and memory are in proportion to a text's length. Texts that repeat have equal
fingerprints; further columns of docs are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import stored

SECTION = 4
LEAF = r"[^\n]{1,39}?(?:[aeiouy.,;:!?]\s|(?=\n)|$)|[^\n]{40}|\n"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def tree(text: Column) -> Column:
    """struct(root, sections: array of struct(node, paragraphs: array of hashes))."""

    def grow(hashes: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(hashes)), lambda i: (i == F.size(hashes)) | (F.pmod(F.xxhash64(F.get(hashes, i - 1)), F.lit(SECTION)) == 0))
        begins = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        parts = F.zip_with(begins, ends, lambda low, high: F.slice(hashes, low + 1, high - low))
        sections = F.transform(parts, lambda p: F.struct(F.md5(F.array_join(p, "").cast("binary")).alias("node"), p.alias("paragraphs")))
        return let(sections, lambda s: F.struct(F.sha2(F.array_join(F.transform(s, lambda x: x["node"]), "").cast("binary"), 256).alias("root"), s.alias("sections")))

    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return let(F.transform(paragraphs, lambda p: F.md5(p.cast("binary"))), grow)


def leaves(text: Column) -> Column:
    """The distinct hashes of a text's leaves, as they first come."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LEAF), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.hash(x)))


def print_of(text: Column) -> Column:
    """struct(root, leaves)."""
    return F.struct(tree(text)["root"].alias("root"), leaves(text).alias("leaves"))


def written(mark: Column) -> Column:
    return F.concat(mark["root"], F.lit(":"), F.array_join(F.transform(mark["leaves"], lambda x: F.substring(F.hex(x.cast("long") + F.lit(1 << 32)), -8, 8)), ""))


def read(fingerprint: Column) -> Column:
    """struct(root, leaves) of a written fingerprint."""
    digits = F.regexp_extract_all(F.substring_index(fingerprint, ":", -1), F.lit("[0-9A-F]{8}"), F.lit(0))
    return F.struct(F.substring_index(fingerprint, ":", 1).alias("root"), F.transform(digits, lambda x: F.conv(x, 16, 10).cast("long").bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)).cast("array<int>").alias("leaves"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two structs of root and leaves. 1 if the roots are equal."""
    both = F.size(a["leaves"]) + F.size(b["leaves"])  # not 0 where roots differ
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a["leaves"], b["leaves"])) / F.greatest(both, F.lit(1)))


def changed(a: Column, b: Column) -> Column:
    """From two trees, struct(first, last, other): the first paragraph (numbers from 0) in which they differ, and the last one of each tree; null if the roots are equal. A last number below the first says that nothing of that tree is left."""

    def flat(t: Column) -> Column:
        return F.flatten(F.transform(t["sections"], lambda s: s["paragraphs"]))

    def run(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))  # the shorter one is filled up with nulls
        return F.when(F.array_position(same, F.lit(False)) > 0, F.array_position(same, F.lit(False)) - 1).otherwise(F.size(same)).cast("int")

    def of(pair: Column) -> Column:
        x, y, head = pair["x"], pair["y"], pair["head"]
        rest = F.least(F.size(x), F.size(y)) - head
        tail = F.least(run(F.reverse(x), F.reverse(y)), rest)
        return F.struct(head.alias("first"), (F.size(x) - tail - 1).alias("last"), (F.size(y) - tail - 1).alias("other"))

    pair = let(F.struct(flat(a).alias("x"), flat(b).alias("y")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), run(p["x"], p["y"]).alias("head")))
    return F.when(a["root"] != b["root"], let(pair, of))


def edits(a: Column, b: Column) -> Column:
    """From two trees, the paragraph numbers (from 0) of the first that the second lacks; none if the roots are equal. Sections that both have are not opened."""
    held = F.transform(b["sections"], lambda s: s["node"])
    other = F.flatten(F.transform(b["sections"], lambda s: s["paragraphs"]))
    flat = F.flatten(F.transform(a["sections"], lambda s: F.transform(s["paragraphs"], lambda p: F.struct(F.array_contains(held, s["node"]).alias("same"), p.alias("p")))))
    marked = F.transform(flat, lambda x, i: F.when(~x["same"] & ~F.array_contains(other, x["p"]), i))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(F.filter(marked, lambda i: i.isNotNull()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, root, sections, fingerprint) for each row of docs."""
    rows = docs.select("doc_id", tree(docs["text"]).alias("t"), leaves(docs["text"]).alias("s"))
    return rows.select("doc_id", "t.root", "t.sections", written(F.struct(F.col("t.root").alias("root"), F.col("s").alias("leaves"))).alias("fingerprint"))


def successors(ids: DataFrame) -> DataFrame:
    """(v, next) for distinct values v of any type that has an order: the next larger one, null for the largest.

    Values are dealt by ranges of about equally many, in which neighbours are found; the last of a range is followed by
    the first of the next one, of which one task sees a row for each range.
    """
    ranges = stored(ids.select("v").repartitionByRange("v").withColumn("range", F.spark_partition_id()), "ranges")
    own = ranges.select("v", "range", F.lead("v").over(Window.partitionBy("range").orderBy("v")).alias("next"))
    heads = ranges.groupBy("range").agg(F.min("v").alias("v"))
    beyond = heads.select("range", F.lead("v").over(Window.orderBy("range")).alias("beyond"))
    return own.join(beyond, "range").select("v", F.coalesce("next", "beyond").alias("next"))


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, changed) for each row of docs.

    edited: the text with the last quarter of its code points replaced by the first as many, or all, of the next
    document's by ascending id (after the last the first). A row without id has no next document: its last quarter is cut
    and near_next is 0. Rows that share an id have the same next one, and as such the one of them whose text is least stands.
    changed: where the text and the edited one differ, see there.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    known = rows.where("doc_id is not null")
    # ids and lengths are read many times over, texts need not be
    sizes = stored(known.groupBy(F.col("doc_id").alias("v")).agg(F.max(F.char_length("text")).alias("n")), "sizes")
    ordered = stored(sizes.join(successors(sizes.select("v")), "v"), "ordered")
    first = ordered.agg(F.min("v")).head()[0]
    wanted = ordered.select(F.coalesce("next", F.lit(first).cast(kind)).alias("doc_id"), F.col("v").alias("asker"), F.floor(F.col("n") / 4).cast("int").alias("q"))
    # both joins need the same rows by the same key, so texts are shuffled once
    given = known.join(wanted, "doc_id").select("asker", F.struct(F.expr("substring(text, 1, q)").alias("head"), print_of(F.col("text")).alias("mark")).alias("given"))
    given = given.groupBy("asker").agg(F.min("given").alias("given"))
    alone = rows.where("doc_id is null").withColumns({"asker": F.lit(None).cast(kind), "given": F.lit(None).cast(given.schema["given"].dataType)})
    both = known.join(given, known["doc_id"] == given["asker"], "left").unionByName(alone)
    n = F.char_length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - q), F.coalesce(F.substring(F.col("given.head"), F.lit(1), q), F.lit("")))
    both = both.withColumn("edited", edited)

    def answer(both: Column) -> Column:
        own, other = (F.struct(both[k]["root"].alias("root"), both[f"{k}_leaves"].alias("leaves")) for k in ("own", "edited"))
        next_to = F.when(F.col("asker").isNull(), F.lit(0.0)).otherwise(likeness(own, F.col("given.mark")))
        return F.struct(written(own).alias("fingerprint"), written(other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), next_to.alias("near_next"), changed(both["own"], both["edited"]).alias("changed"))

    trees = F.struct(*(x.alias(k) for t in ("text", "edited") for k, x in ((("own" if t == "text" else t), tree(F.col(t))), (("own" if t == "text" else t) + "_leaves", leaves(F.col(t))))))
    return both.select("doc_id", n.cast("long").alias("n_chars"), "edited", let(trees, answer).alias("a")).select("doc_id", "n_chars", "edited", "a.*")
