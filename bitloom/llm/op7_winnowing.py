"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII. Of each sliding window of SPAN words, the least
hash of its word K-grams is kept, on both sides; a shared span of SPAN words therefore shares a fingerprint. Documents that
share one are candidates; there, each K-gram that is a fingerprint of an item is extended to both sides word by word, and counts
if it grows to SPAN words. All SPAN-word windows around it are inside the extension, so hits are exact. Items shorter than SPAN
are one window each and are looked up by their longest word; of a document only the places of such words are kept, with a few words around.

The benchmark's fingerprints are broadcast only if they are few (counted first); else the join is a shuffle. Texts are
shuffled for candidates only.

Edge cases: null text has no words; a null doc_id or item_id is a value like others (a null item is counted but not
listed); repeated rows are judged alike, and rows of one id with different texts each by its own; texts of any length are taken whole, in time
that grows with their length; other columns are not read, whatever their names; items without words never occur; empty tables: nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import id_filter, load, small, written

SPAN, K = 10, 5
#: Fixed value: what stands between words, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text):
    """The words of a text column; an empty array for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def rough_words_of(text):
    """As many words as words_of() gives, and equal ones wherever those are equal: lower() is cheaper but maps other letters too."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def grams(words, k: int = K):
    """Hash of each k words in a row."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.slice(words, 1, F.greatest(n - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(words, i + j) for j in range(1, k)))))


def winnowed(hashes, width: int):
    """The least hash of each `width` in a row, without repeats."""
    n = F.size(hashes)
    return F.when(n >= width, F.array_distinct(F.transform(F.slice(hashes, 1, F.greatest(n - (width - 1), F.lit(0))), lambda x, i: F.least(x, *(F.get(hashes, i + j) for j in range(1, width))))))


def fingerprints(rows: DataFrame, span: int, k: int) -> DataFrame:
    """rows (with `words`) and their winnowed `prints`; null for less than `span` words.

    What reads them uses outer explosions: a filter on the arrays would be pushed below these projections, where it repeats
    their work for every element.
    """
    return rows.withColumn("grams", grams(F.col("words"), k)).withColumn("prints", winnowed(F.col("grams"), span - k + 1)).drop("grams")


def _equal_run(pairs):
    """How many of the pairs of columns, from the first on, are equal."""
    n = F.lit(0)
    for a, b in reversed(pairs):
        n = F.when(F.coalesce(a == b, F.lit(False)), n + 1).otherwise(0)
    return n


def spans(docs: DataFrame, items: DataFrame, text: str = "text", id_: str = "doc_id", item: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """(doc, mark, item, start, end): words [start, end) of a document that an item's window covers. mark is a hash of the text."""
    width = span - k
    rows = docs.select(F.col(id_).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    bench = written(items.select(F.col(item).alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0))

    # The items' fingerprints are taken over roughly equal words for the candidates, and over exact ones for the hits.
    rough = items.select(rough_words_of(F.col(item_text)).alias("words"))
    keys = written(fingerprints(rough, span, k).select(F.explode_outer("prints").alias("print")).where("print is not null").distinct())
    few = small(keys)
    prints = fingerprints(rows.select("doc", "mark", rough_words_of(F.col("text")).alias("words")), span, k)
    met = prints.select("doc", "mark", F.explode_outer("prints").alias("print")).join(F.broadcast(keys) if few else keys, "print", "left_semi")
    met = written(met.select("doc", "mark").distinct())
    same = lambda a, b: a["doc"].eqNullSafe(b["doc"]) & (a["mark"] == b["mark"])
    found = written(rows.join(met, same(rows, met), "left_semi").select("doc", "mark", words_of(F.col("text")).alias("words")).dropDuplicates(["doc", "mark"]))

    own = written(fingerprints(bench, span, k).withColumn("grams", grams(F.col("words"), k)))
    own = own.select("item", "words", "prints", F.posexplode("grams").alias("q", "print")).where("array_contains(prints, print)")
    w, q = F.col("words"), F.col("q")
    own = own.select("item", "print", F.slice(w, q + 1, k).alias("gram"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.get(w, q - i)).alias("before"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(w, q + k + i)).alias("after"))
    own = written(own)
    places = found.withColumn("grams", grams(F.col("words"), k)).select("doc", "mark", F.posexplode_outer("grams").alias("p", "print"))
    hits = places.join(F.broadcast(own) if few and small(own) else own, "print").drop("print")
    there = found.select(F.col("doc").alias("doc_"), F.col("mark").alias("mark_"), "words")
    hits = hits.join(there, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("mark") == F.col("mark_")))
    p = F.col("p")
    left = _equal_run([(F.get(w, p - 1 - i), F.get("before", F.lit(i))) for i in range(width)])
    right = _equal_run([(F.get(w, p + k + i), F.get("after", F.lit(i))) for i in range(width)])
    hits = hits.where(F.slice(w, p + 1, k) == F.col("gram")).select("doc", "mark", "item", (p - left).alias("start"), (p + k + right).alias("end")).where(F.col("end") - F.col("start") >= span)

    short = bench.where(F.size("words") < span)
    if not short.isEmpty():
        longest = F.expr("array_max(transform(words, (x, i) -> struct(length(x) as size, x as word, i as place)))")
        short = written(short.select("item", F.col("words").alias("item_words"), longest["word"].alias("word"), longest["place"].alias("place")))
        asked = written(short.select("word").distinct())
        # Only places of such words are kept, each with the words around it that an item can reach.
        p, first = F.col("p"), F.greatest(F.col("p") - (span - 2), F.lit(0))
        at = rows.select("doc", "mark", words_of(F.col("text")).alias("words")).select("doc", "mark", "words", F.posexplode_outer("words").alias("p", "word"))
        at = at.where(id_filter(asked, "word")(F.coalesce("word", F.lit("")))).select("doc", "mark", "p", "word", first.alias("first"), F.slice("words", first + 1, 2 * span).alias("around"))
        near = at.join(F.broadcast(short) if small(short) else short, "word").withColumn("start", p - F.col("place")).where("start >= 0")
        near = near.where(F.slice("around", F.col("start") - F.col("first") + 1, F.size("item_words")) == F.col("item_words"))
        hits = hits.unionByName(near.select("doc", "mark", "item", "start", (F.col("start") + F.size("item_words")).alias("end")))
    return hits


def judge(docs: DataFrame, items: DataFrame, text: str = "text", id_: str = "doc_id", **options) -> DataFrame:
    """(id_, mark, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs."""
    hits = spans(docs, items, text, id_, **options)
    union = F.expr("aggregate(spans, struct(0L as covered, 0 as until), (a, x) -> struct(a.covered + greatest(0, x.end - greatest(x.start, a.until)) as covered, greatest(a.until, x.end) as until), a -> a.covered)")
    by = hits.groupBy("doc", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"), F.max(F.col("item").isNull().cast("int")).alias("unnamed"))
    by = by.select(F.col("doc").alias("doc_"), F.col("mark").alias("mark_"), union.alias("n_hit"), (F.size("items") + F.col("unnamed")).cast("bigint").alias("n_items"), F.array_join("items", ",").alias("items"))
    rows = docs.select(F.col(id_).alias("doc"), F.xxhash64(text).alias("mark"), F.size(rough_words_of(F.col(text))).cast("bigint").alias("n_words"))
    out = rows.join(by, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("mark") == F.col("mark_")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(F.col("doc").alias(id_), "mark", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("mark")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, ns, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
