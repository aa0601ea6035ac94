"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A text's tokens are its runs of letters, marks and digits, lower case. Two fixed masks lie over the tokens; their zeros are positions that are
ignored. Seeds (hashes of a mask's kept tokens) of the benchmark join those of the documents, and every hit is verified on its diagonal: some
window of 13 item tokens around it (all tokens of a shorter item) must agree with the document in at least 80 % of its positions. Together the
masks hit every window of 13 with up to two substitutions (all 78 patterns were tried). Shorter items have masks of their own, by length (SHORT):
items of up to 4 tokens a mask of all of them, since 80 % admits no substitution there, the others masks that hit under every substitution that
80 % admits (one in 5 to 9 tokens, two in 10 to 12; all patterns were tried). Documents are only searched with masks that some item has.

The benchmark's seeds are counted. Up to MAX_SEEDS they are broadcast at once, beyond that in blocks of about that size, each against all
documents. Hits are verified where they arise, so that only verified pairs are shuffled. A hit takes along the tokens of its windows, not the document's:
Spark holds all hits of a document at once, so that memory and time would else grow with a document's hits times its tokens. Documents are dropped by a
filter of the bad texts: only texts that it lets through are shuffled.

Null and empty items match nothing, and an item of one word matches each document that has the word; null and empty documents match nothing.
Without documents there are no rows; without items nothing is found and all documents stay.
Items of equal tokens are searched once and reported each. Rows with the same doc_id and text give one result. Columns other than doc_id and
text of the documents, item_id and text of the benchmark are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import unused, without, written

MASKS, WINDOW, AGREE, MAX_SEEDS = ("1111101", "1011000111"), 13, 0.8, 2_000_000
#: The masks of items of fewer tokens than WINDOW, by number of tokens.
SHORT = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "11011", "10111", "11101"), 6: ("1111", "11011"), 7: ("1111", "11011"), 8: ("1111",), 9: ("1111",),
    10: ("1111", "11011"), 11: ("1111", "11011"), 12: ("1111",),
}


def tokens(text: Column) -> Column:
    # an empty text is split into one empty token; named once, as Spark would clean the text anew for each mention
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")), " "), "")


def _lengths(mask: str) -> list[int]:
    """The lengths of items that have the mask; WINDOW stands for itself and all above."""
    return [n for n in range(1, WINDOW + 1) if mask in SHORT.get(n, MASKS)]


def _positions(df: DataFrame, words: str, masks: list[str], of_items: bool = False) -> DataFrame:
    """A row for each token at which a mask fits, and each mask (of items: each that the item's length has): at, seed."""
    n, at, out = F.size(words), F.col("at"), []
    for mask in masks:
        kept = [F.get(words, at + k) for k, c in enumerate(mask) if c == "1"]
        fits = at + len(mask) <= n
        if of_items:
            fits = fits & F.least(n, F.lit(WINDOW)).isin(_lengths(mask))
        out.append(F.when(fits, F.xxhash64(F.lit(mask), *kept)))
    least = min(map(len, masks))
    # not a filter of the words' number, which Spark would move below the words, to make them twice
    rows = df.withColumn("at", F.explode(F.when(n >= least, F.sequence(F.lit(0), n - least))))
    return rows.withColumn("seed", F.explode(F.array(*out))).where("seed is not null")


def _begin() -> Column:
    """The first document token of any window around the hit."""
    return F.greatest(F.lit(0), F.col("at") - (WINDOW - 1))


def _agreement() -> Column:
    """The most agreeing tokens in any window around the hit (item tokens iw at ip, document tokens at at, of which near has those from begin on); only the
    tokens of those windows are compared, however long the item is."""
    n, ip, shift = F.size("iw"), F.col("ip"), F.col("at") - F.col("ip") - _begin()
    length = F.least(F.lit(WINDOW), n)
    low, high = F.greatest(F.lit(0), ip - length + min(map(len, MASKS))), F.least(n - length, ip)
    low = F.least(low, high)
    equal = F.transform(F.sequence(low, high + length - 1), lambda i: (F.get("iw", i) == F.coalesce(F.get("near", i + shift), F.lit(""))).cast("int"))
    sums = lambda e: F.transform(F.sequence(F.lit(1), high - low + 1), lambda a: F.aggregate(F.slice(e, a, length), F.lit(0), lambda s, x: s + x))
    return F.array_max(F.flatten(F.transform(F.array(equal), sums)))


def contaminated(docs: DataFrame, benchmark: DataFrame, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """doc_id, node (MD5 of the text), item_id, matched (agreeing tokens of the best window), hits, first_token for each verified pair."""
    items = benchmark.where("text is not null and item_id is not null").select("item_id", tokens(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    named = written(items.groupBy("iw").agg(F.collect_set("item_id").alias("items")).withColumn("item", F.xxhash64("iw")))
    distinct = named.select("item", "iw")
    lengths = {r["n"] for r in distinct.select(F.least(F.size("iw"), F.lit(WINDOW)).alias("n")).distinct().collect()} or {WINDOW}
    masks = sorted({m for n in lengths for m in SHORT.get(n, MASKS)})
    seeds = written(_positions(distinct, "iw", masks, of_items=True).select("seed", "item", F.col("at").alias("ip")))
    blocks = max(1, -(-seeds.count() // max_seeds))
    words = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), tokens(F.col("text")).alias("w"))
    probes = _positions(words, "w", masks)

    def against(block: int) -> DataFrame:
        part = lambda df: df.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else df
        near = F.slice("w", _begin() + 1, F.col("at") + WINDOW - _begin()).alias("near")
        hits = probes.join(F.broadcast(part(seeds)), "seed").select("doc_id", "node", "item", "at", "ip", near).join(F.broadcast(part(distinct)), "item")
        good = hits.withColumn("matched", _agreement()).where(F.col("matched") >= F.ceil(F.lit(AGREE) * F.least(F.lit(WINDOW), F.size("iw"))))
        return good.groupBy("doc_id", "node", "item").agg(F.max("matched").alias("matched"), F.count("*").alias("hits"), F.min(F.greatest(F.lit(0), F.col("at") - F.col("ip"))).alias("first_token"))

    found = reduce(DataFrame.unionByName, [against(b) for b in range(blocks)])
    return found.join(named.select("item", F.explode("items").alias("item_id")), "item").select("doc_id", "node", "item_id", "matched", "hits", "first_token")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns; null and empty texts stay."""
    key = unused(docs, "text_md5")
    bad = written(contaminated(docs, benchmark).select(F.col("node").alias(key)).distinct())
    return without(docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))), bad, key).select(docs.columns)
