"""Benchmark passages in documents, by a prefix-filtered set join. DataFrame functions only.

A window is `size` consecutive words of an item; it is contained in a document if its words stand there
in a row. Shingles are word pairs. Exact containment needs every shingle of a window, so one of them, the
necessary prefix, is enough to find it: the one that is rarest in all documents. Adjacent windows often
share their rarest shingle, so a join row is an anchor, an item's shingle with all windows it stands for.
A document's shingle that meets an anchor fixes where each window would start; the length and positional
bounds dismiss windows that don't fit into the document there, and the rest are compared word by word.

Texts are cut into words once, and the words written. Items are dealt into blocks of a bounded number of
windows, and one block at a time is broadcast, each against all documents' words; the benchmark may thus be
of any size.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import NO_ID, scratch, text_hash, unused

SIZE = 10
#: Windows in a block: with up to ten words each, some MB to broadcast.
BLOCK_WINDOWS = 40_000
#: All ASCII but 0-9 and a-z, once A-Z are lower case (fixed value).
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """Lower-cases A-Z; runs of 0-9, a-z and non-ASCII characters. Null has none."""
    low = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, _BREAK, -1), "")


def _pair(w: Column, at: Column) -> Column:
    return F.xxhash64(F.get(w, at), F.get(w, at + 1))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(text).alias("row"), words(text).alias("w"))


def _positions(d: DataFrame) -> DataFrame:
    """A row for each word of each document, with the shingle that begins there; one without a place for no words.

    An outer generator, as Spark else infers a filter that looks through each text's words once more. d: as _keyed has it.
    """
    d = d.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "row", "w")
    return d.select("doc", "row", "w", F.posexplode_outer("w").alias("pos", "_word")).select("doc", "row", "w", "pos", _pair(F.col("w"), F.col("pos")).alias("t"))


def _windows(items: DataFrame, size: int, blocks: int | None = None) -> DataFrame:
    """(item, start, n, win): all windows, with their words."""
    i = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w"))
    i = i.where(F.size("w") > 0).withColumn("n", F.least(F.lit(size), F.size("w")))
    return i.select("item", "n", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("start")).select("item", "start", "n", F.slice("w", F.col("start") + 1, F.col("n")).alias("win"))


def _anchors(windows: DataFrame, d: DataFrame) -> DataFrame:
    """(t, item, wins array<struct<off, n, win>>): each window by its rarest shingle. Windows with a shingle that no document has can't occur and go."""
    # a window of one word has the pseudo-shingles of that word and any other after it: it is found by its word alone
    longer = windows.where("n > 1")
    shingles = longer.select("item", "start", "n", "win", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("off")).withColumn("t", _pair(F.col("win"), F.col("off")))
    counts = _positions(d).select("t").join(F.broadcast(shingles.select("t").distinct()), "t").groupBy("t").agg(F.count("*").alias("df"))
    counts = scratch(counts, "rarity")  # at most as many rows as the block has shingles
    ranked = shingles.join(F.broadcast(counts), "t", "left").groupBy("item", "start", "n", "win")
    rarest = ranked.agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t", "off")).alias("m")).where("m.df > 0")
    rarest = rarest.select("item", "start", "n", "win", F.col("m.t").alias("t"), F.col("m.off").alias("off"))
    one = F.struct("off", "n", "win")
    return rarest.groupBy("item", "t", (F.col("start") + F.col("off")).alias("at")).agg(F.collect_list(one).alias("wins")).select("item", "t", "wins")


def document_words(docs: DataFrame) -> DataFrame:
    """(doc_id, row, w): all words of each row of docs, written; row is a hash of the text. Null texts have none."""
    return scratch(_keyed(docs), "words")


def occurrences(d: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc, row, item, low, high): stretches of a document's words that occurrences of an item's windows cover.

    d: document_words(docs). doc is doc_id (NO_ID where null), row a hash of the text; high is exclusive. A stretch unites the
    windows that one anchor stands for; they all hold the anchor, so nothing lies between them.
    Null texts have no words; items of 1 to size-1 words are one window; rows that repeat give repeats.
    """
    windows = scratch(_windows(items, size), "windows")
    n = windows.count()
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    out = None
    for block in range(blocks):
        # about BLOCK_WINDOWS rows each
        some = windows.where(F.pmod(F.xxhash64("item", "start"), F.lit(blocks)) == block) if blocks > 1 else windows
        found = _found(d, scratch(_anchors(some, d), "anchors"), size)
        if not some.where("n = 1").isEmpty():
            found = found.unionByName(_found_words(d, some.where("n = 1")))
        out = found if out is None else out.unionByName(found)
    return out


def _found(d: DataFrame, anchors: DataFrame, size: int) -> DataFrame:
    w, pos = F.col("w"), F.col("pos")
    # only the words about the anchor leave the join: a candidate must not carry its whole document
    begin = F.greatest(pos - size, F.lit(0))
    met = _positions(d).join(F.broadcast(anchors), "t")
    narrow = F.struct("doc", "row", "item", "pos", "wins", F.size(w).alias("words"), begin.alias("begin"), F.slice(w, begin + 1, F.lit(2 * size)).alias("near"))
    near = met.select(F.inline(F.array(narrow)))  # what follows can't be pushed below a generator

    def fits(x):
        start = pos - x["off"]
        inside = (start >= 0) & (start + x["n"] <= F.col("words"))  # positional and length bounds
        return inside & (F.slice("near", F.greatest(start - F.col("begin"), F.lit(0)) + 1, x["n"]) == x["win"])

    hit = near.withColumn("hits", F.filter("wins", fits)).where(F.size("hits") > 0)
    low = pos - F.array_max(F.transform("hits", lambda x: x["off"]))
    high = pos + F.array_max(F.transform("hits", lambda x: x["n"] - x["off"]))
    return hit.select("doc", "row", "item", low.alias("low"), high.alias("high"))


def _found_words(d: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows of a single word."""
    d = d.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "row", F.posexplode("w").alias("low", "word"))
    single = windows.select("item", F.get("win", F.lit(0)).alias("word")).distinct()
    return d.join(F.broadcast(single), "word").select("doc", "row", "item", "low", (F.col("low") + 1).alias("high"))


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, row, n_words, n_hit, n_items, items): a row for each row of docs.

    n_hit: words inside any occurrence; items: item_ids as strings, sorted.
    """
    d = document_words(docs)
    found = occurrences(d, items, size).distinct()
    by = Window.partitionBy("doc", "row").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("high") - F.greatest("low", F.coalesce(F.max("high").over(by), F.lit(0))))
    hits = found.withColumn("new", new).groupBy("doc", "row").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "row", F.size("w").cast("long").alias("n_words"))
    out = d.join(hits, ["doc", "row"], "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")).withColumn("n_items", F.size("items").cast("long"))


def clean_documents(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """docs without those in which a window of an item occurs; columns of any name may stand beside doc_id and text."""
    doc, row = unused(docs, "_doc", "_row")
    hit = occurrences(document_words(docs), items, size).select(F.col("doc").alias(doc), F.col("row").alias(row)).distinct()
    keyed = docs.withColumns({doc: F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), row: text_hash(docs["text"].cast("string"))})
    return keyed.join(hit, [doc, row], "left_anti").select(*docs.columns)
