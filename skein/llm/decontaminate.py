"""Operator 9: benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `window` words (the whole item if it has fewer). A window must be contained
whole, so one shingle of it is a necessary prefix: shingles (word pairs) are put in order of their
frequency over all documents and each window is entered under its rarest. Document shingles join those
prefixes; a hit must leave room for the window before and after it (positional and length bounds), and the words at
the place it implies are compared with the window's exactly.

Of whole texts only those with a hit are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, few, small, thinned

#: Java pattern of what separates words: ASCII other than digits and letters, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _pairs(w: Column) -> Column:
    """Word pairs by position; the last word stands alone."""
    return F.arrays_zip(F.slice(w, F.lit(1), F.size(w)), F.slice(w, F.lit(2), F.size(w)))


def _key() -> Column:
    return F.xxhash64(F.col("pair")["0"], F.col("pair")["1"])


def benchmark_windows(bench: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """item, start, len, win (its words joined by a blank): every window of every item."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    spans = items.withColumn("len", F.least(F.size("w"), F.lit(window)))
    spans = spans.select("item", "w", "len", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("start"))
    return spans.select("item", "len", F.slice("w", F.col("start") + 1, F.col("len")).alias("ws")).withColumn("win", F.array_join("ws", " ")).distinct()


def contamination(docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_hit (words inside an occurrence of a window), n_items (items with an
    occurring window), items_sha256 (of their ids, sorted as strings, comma-joined), contaminated (n_hit > 0).

    Null and empty texts have no words; empty items have no window. An empty benchmark hits nothing, an empty table
    gives no rows. Repeated rows, and rows that share an id, are judged each by its own text. Null item ids are left
    out of n_items and items_sha256. Further columns are ignored. The result is a table in the shared folder; all others
    that the join writes are deleted.
    """
    with Scratch(docs.sparkSession, "decontamination") as scratch:
        return scratch.result(_contamination(docs, bench, window, id_col, text_col, item_id, item_text, scratch))


def _contamination(docs: DataFrame, bench: DataFrame, window: int, id_col: str, text_col: str, item_id: str, item_text: str, scratch: Scratch) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    split = docs.select("id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("words"))
    wins = scratch.write(benchmark_windows(bench, window, item_id, item_text), "windows")

    # One row per window: its shingles and their frequency in the documents.
    alone = wins.groupBy("win").agg(F.first("ws").alias("ws"), F.first("len").alias("len"))
    parts = alone.select("win", "len", F.posexplode(_pairs(F.col("ws"))).alias("pos", "pair")).withColumn("key", _key())
    # a window's last word has no pair within it; only a window of one word is looked up by that word
    parts = scratch.write(parts.filter((F.col("pos") < F.col("len") - 1) | (F.col("len") == 1)).select("win", "len", "pos", "key"), "shingles")
    keys = scratch.write(parts.select("key").distinct(), "shingle-keys")
    single = scratch.write(parts.filter("len = 1").select("key").distinct(), "single-words")
    lone, single = single.limit(1).count() > 0, small(single)

    def shingled(wanted: DataFrame, *keep) -> DataFrame:
        """Document shingles among the keys of wanted, with wanted's columns."""
        out = split.select(*keep, F.posexplode(_pairs(F.col("words"))).alias("pos", "pair")).withColumn("key", _key()).drop("pair")
        if not few(wanted):  # too many to broadcast: most pairs go by a bitmap, so that only the rest are shuffled
            out = thinned(out, F.col("key"), wanted.select(F.col("key").alias("h")))
        wanted = small(wanted)
        out = out.join(wanted, "key")
        if lone:  # words by themselves, only where an item is a single word
            each = split.select(*keep, F.posexplode("words").alias("pos", "w")).withColumn("key", F.xxhash64("w", F.lit(None).cast("string"))).drop("w")
            out = out.unionByName(each.join(single, "key", "left_semi").join(wanted, "key"))
        return out

    counts = shingled(keys).groupBy("key").count()
    ranked = parts.join(counts, "key", "left").fillna(0, ["count"])
    rarest = Window.partitionBy("win").orderBy("count", "key", "pos")
    prefix = scratch.write(ranked.withColumn("r", F.row_number().over(rarest)).filter("r = 1").select("key", "win", "len", F.col("pos").alias("offset")), "prefixes")
    bounds = scratch.write(prefix.groupBy("key").agg(F.min("offset").alias("least"), F.min(F.col("len") - F.col("offset")).alias("rest")), "prefix-bounds")

    n = F.size("words").alias("n")
    hits = shingled(bounds, "id", "th", n).filter("pos >= least and n - pos >= rest").select("id", "th", "n", "pos", "key")
    hits = scratch.write(hits.distinct(), "hits")

    # Places to verify, by document; a place lies wholly within the document.
    places = hits.join(small(prefix), "key").withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0 and start + len <= n")
    places = places.groupBy("id", "th").agg(F.collect_list(F.struct("start", "len", "win")).alias("places"))
    places = scratch.write(places, "places")
    thin = thinned(docs.withColumn("th", F.xxhash64("text")), F.xxhash64("id", "th"), places.select(F.xxhash64("id", "th").alias("h")))
    thin = thin.dropDuplicates(["id", "th"]).select("id", "th", words(F.col("text")).alias("words"))
    p = places.select(F.col("id").alias("pid"), F.col("th").alias("pth"), "places")
    checked = thin.join(p, F.col("id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth")))
    exact = F.expr("filter(places, p -> array_join(slice(words, p.start + 1, p.len), ' ') = p.win)")
    found = scratch.write(checked.select("id", "th", exact.alias("found")).filter("size(found) > 0"), "found")
    n_hit = F.expr("cast(size(array_distinct(flatten(transform(found, p -> sequence(p.start, p.start + p.len - 1))))) as long)")
    hit = found.select("id", "th", n_hit.alias("n_hit"))
    of_doc = found.select("id", "th", F.explode(F.array_distinct(F.col("found.win"))).alias("win"))
    items = of_doc.join(small(wins.filter("item is not null").select("win", "item")), "win").groupBy("id", "th").agg(F.collect_set("item").alias("items"))
    per_doc = scratch.write(hit.join(items, hit.id.eqNullSafe(items.id) & (hit.th == items.th), "left").select(hit.id.alias("fid"), hit.th.alias("fth"), "n_hit", "items"), "contaminated")

    base = split.select("id", "th", F.when(F.col("words").isNull(), 0).otherwise(F.size("words")).cast("long").alias("n_words"))
    out = base.join(per_doc, F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), "left")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(listed), ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def oracle(window: int = 10) -> str:
    def split(column: str) -> str:
        return f"regexp_extract_all(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    return f"""
    WITH b AS (SELECT item_id::VARCHAR AS item, {split('text')} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item, least(len(w), {window}) AS n, array_to_string(w[s + 1 : s + least(len(w), {window})], ' ') AS win
           FROM (SELECT item, w, unnest(range(0, len(w) - least(len(w), {window}) + 1)) AS s FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM bw),
    d AS (SELECT doc_id, coalesce({split('text')}, []) AS w FROM documents),
    dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS win
           FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, sizes)),
    m AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
    i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
    """
