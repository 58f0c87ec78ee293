"""Exact benchmark contamination from a distributed positional inverted index.

A window is ``size`` consecutive words of an item (all words of a shorter
one). The index has a posting (term, row, at) for every place in the corpus
where a word of the benchmark stands; it is written once, from one reading of
the texts, and each text has one more posting, of the empty term, that carries
its key and number of words. A window's terms are ranked by the length of
their lists. The list of the rarest, less its offset in the window, gives the
places where the window may start; they are intersected with the list of the
next one and, as few are left then, with all others at once. Each intersection
is an equi-join on (term, row, at), whose keys are spread evenly however
common a term is. Where each word may stand up to ``slop`` places off, the
same joins give proximity matches.

What is broadcast is counted first: the benchmark's terms up to
``BROADCAST_BYTES``, rows with places left up to ``BROADCAST_ROWS``. Beyond
that the joins are shuffled. Everything is DataFrame functions.

Defined results
- null or empty text, or one without words: n_words 0, nothing hit
- an item without words has no window; one with a null id counts for hits and not as an item
- rows with the same or a null id stay rows of their own; columns other than id and text aren't read
- equal windows of several items count for each of them; overlapping occurrences count each word once
- an empty corpus gives an empty table, an empty benchmark leaves everything clean
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismill.llm import spotting
from prismill.llm.store import Scratch

WINDOW = 13
#: Fixed: the words of a text after A-Z have been lower-cased.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms of so many bytes in all are sent to every executor.
BROADCAST_BYTES = 16 << 20
#: The same for numbers of rows.
BROADCAST_ROWS = 500_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of one byte a character take the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def windows(items: DataFrame, scratch: Scratch, size: int = WINDOW, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, phrase), and which items have them (window, item as string)."""
    t = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.size("w") - size, F.lit(0))
    found = t.select("item", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("w", i + 1, size))).alias("phrase")).distinct()
    found = scratch.table(found, "phrases")
    numbered = scratch.table(found.select("phrase").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return numbered, scratch.table(found.where("item IS NOT NULL").join(numbered, "phrase").select("window", "item"), "window_items")


def _sized(terms: DataFrame) -> DataFrame:
    """A table of terms, sent to every executor if they have so many bytes at most. It is read from files, so beyond that a common term's postings are a join side that can be split."""
    size = terms.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    return F.broadcast(terms) if size <= BROADCAST_BYTES else terms


def index(docs: DataFrame, terms: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (term, row, at) of these terms in all texts; and of the empty term at -1, with the row's key and n_words."""
    terms = scratch.table(terms.select("term").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"))), "terms")
    d = spotting.once(docs, F.col(key).alias("key"), F.concat(F.array(F.lit("")), words(F.col(text))).alias("w")).withColumn("row", F.monotonically_increasing_id())
    n = F.size("w") - 1
    d = d.select("row", "key", n.alias("n_words"), F.posexplode("w").alias("at", "term")).join(_sized(terms), "term")
    own = F.col("at") == 0
    d = d.select("term", "row", (F.col("at") - 1).alias("at"), F.when(own, F.col("key")).alias("key"), F.when(own, F.col("n_words")).alias("n_words"))
    return scratch.table(d, "index")


def ranked(postings: DataFrame, phrases: DataFrame, scratch: Scratch) -> DataFrame:
    """The terms of each window from the shortest list to the longest: (window, size, rank, term, offset). A window with a term that stands nowhere goes."""
    counts = scratch.table(postings.groupBy("term").agg(F.count("*").alias("n")), "counts")
    terms = phrases.select("window", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "term")).join(counts, "term")
    order = F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("terms")
    whole = terms.groupBy("window", "size").agg(order).where(F.size("terms") == F.col("size"))
    return scratch.table(whole.select("window", "size", F.posexplode("terms").alias("rank", "t")).select("window", "size", "rank", "t.term", "t.offset"), "ranked")


def matches(postings: DataFrame, terms: DataFrame, scratch: Scratch, slop: int = 0) -> DataFrame:
    """Where windows stand: (window, row, start, size).

    With slop 0 these are exact phrases. Otherwise every word but the rarest may
    stand up to so many places from where the rarest one says; start is that of the phrase.
    """
    first = terms.where("rank = 0").select("window", "size", "term", "offset")
    start = F.col("at") - F.col("offset")
    left = postings.join(first, "term").select("window", "size", "row", start.alias("start"))
    left = scratch.table(left.where("start >= 0") if not slop else left, "places")
    for ranks, above in (("rank = 1", 1), ("rank > 1", 2)):
        need = left.join(terms.where(ranks).select("window", "rank", "term", "offset"), "window")
        at = F.col("start") + F.col("offset")
        need = need.withColumn("at", F.explode(F.sequence(at - slop, at + slop)) if slop else at)
        rows = scratch.table(left.select("row").distinct(), "rows")
        own = scratch.table(terms.where(ranks).select("term").distinct(), "terms")
        some = postings.select("term", "row", "at").join(_sized(own), "term", "left_semi")
        if rows.count() <= BROADCAST_ROWS:
            some = some.join(F.broadcast(rows), "row", "left_semi")
        there = need.join(some, ["term", "row", "at"]).groupBy("window", "size", "row", "start").agg(F.count_distinct("rank").alias("n"))
        whole = there.where(F.col("n") == (F.lit(1) if above == 1 else F.col("size") - above)).select("window", "size", "row", "start")
        left = scratch.table(left.where(F.col("size") <= above).unionByName(whole), "places")
    return left


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: key, n_words, n_hit (words inside an occurrence of a window) and items (sorted ids)."""
    scratch = Scratch(docs.sparkSession, "decontam")
    phrases, owners = windows(items, scratch, size, item, item_text)
    postings = index(docs, phrases.select(F.explode("phrase").alias("term")).distinct(), scratch, key, text)
    found = matches(postings, ranked(postings, phrases, scratch), scratch)
    spans = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    add = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = spans.select("row", F.aggregate("spans", none, add, lambda acc: acc["n"]).alias("n_hit"))
    named = found.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    base = postings.where("term = ''").select("row", "key", "n_words")
    return base.join(covered.join(named, "row", "left"), "row", "left").select(
        F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def contaminated() -> Column:
    """Words hit, and one in twenty at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
