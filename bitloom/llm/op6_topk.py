"""Exact top-k search of binary codes by multi-index hashing.

A code is the sign bits of an embedding (bit i: component i > 0). An index over a slice of n codes cuts them into parts of about log2(n) bits,
so that a bucket of a part holds one code on average, and keeps one table per part. For a query, the radius of the parts grows one part at
a time: once parts 0..j are searched to radius r and the others to r - 1, every code within distance parts * r + j has been met. A query
ends when its kth verified distance is within that bound, so its result (ties included) is exact. The buckets of a radius are found by
their masks or, where the part has fewer occupied buckets than masks, among those; a code is verified where it is met first.

The data are dealt into slices of at most `slice_rows` codes and the queries into blocks of at most `block`; a task has one slice and one
block (both bounded), and nothing is collected. The k best of each slice meet in a window by query, which drops all but k in each task first.

Result: query_id, vec_id, distance, rank (by distance, then vec_id). A query finds itself too, since it is a row like the others.

Edge cases: rows with a null id, a null embedding or one whose length is not `bits` have no code and are neither
queries nor found; null or NaN components count as not positive; fewer than k rows: all of them; repeated rows are separate results (as
queries, equal rows have one list, and different codes of one id a list each); other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.llm.common import arrow_schema, ddl, load, written

K, BITS = 10, 64
#: Most queries and codes of a task; least codes for which another slice is made so that all cores have one.
QUERY_BLOCK, SLICE_ROWS, LEAST_SLICE = 100_000, 2_000_000, 4096
#: Pairs of query and code verified at a time.
PAIRS = 1 << 22


def codes(df: DataFrame, vector: str = "embedding", id_: str = "vec_id", bits: int = BITS) -> DataFrame:
    """(id, code): the packed sign bits of each row, bit 0 lowest."""
    if bits % 8 or bits > 64:
        raise ValueError("bits: a multiple of 8, 64 at most")
    out = arrow_schema(id="long", code="long")
    rows = df.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & (F.size("v") == bits))

    def apply(batches):
        for batch in batches:
            v = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, bits)
            packed = np.zeros((len(v), 8), np.uint8)
            packed[:, : bits // 8] = np.packbits(v > 0, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed.view("<i8").ravel())], schema=out)

    return rows.mapInArrow(apply, ddl(out))


class Index:
    """Tables by part over a slice of codes."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, bits: int = BITS):
        self.ids, self.data = ids, data
        self.parts = parts = min(16, max(1, round(bits / max(1.0, np.log2(max(len(data), 2))))))
        cuts = [bits * j // parts for j in range(parts + 1)]
        self.shift = np.array(cuts[:-1], np.uint64)
        self.width = np.diff(cuts).tolist()
        self.mask = np.array([(1 << w) - 1 for w in self.width], np.uint64)
        self.order, self.values, self.starts = [], [], []
        for j in range(parts):
            part = self.part(data, j)
            order = np.argsort(part, kind="stable")
            values, first = np.unique(part[order], return_index=True)
            self.order.append(order)
            self.values.append(values)
            self.starts.append(np.append(first, len(data)))

    def part(self, x: np.ndarray, j: int) -> np.ndarray:
        return (x >> self.shift[j]) & self.mask[j]

    def search(self, queries: np.ndarray, k: int):
        """(query number, place in the slice, distance) of the k best of each query by distance, then id; and the bits that cover each query."""
        k = min(k, len(self.data))
        open_ = np.arange(len(queries))
        have = [np.zeros(0, np.int64)] * 3
        worst = np.full(len(queries), 64, np.int64)  # kth distance so far
        covered = np.full(len(queries), -1, np.int64)
        for r in range(max(self.width) + 1):
            for j in range(self.parts):
                if r <= self.width[j] and len(open_):
                    values = self.values[j]
                    masks = _masks(self.width[j], r) if comb(self.width[j], r) < len(values) else None
                    step = max(1, PAIRS // (len(values) if masks is None else len(masks)))
                    for a in range(0, len(open_), step):
                        new = self._met(queries, open_[a : a + step], j, r, masks, worst)
                        q, p, d = (np.concatenate(x) for x in zip(have, new))
                        have = self._best(q, p, d, k)
                    count = np.bincount(have[0], minlength=len(queries))
                    full = count >= k
                    worst[have[0]] = np.where(full[have[0]], have[2], 64)  # the last of each query is its kth
                covered[open_] = self.parts * r + j
                open_ = open_[~((worst[open_] <= covered[open_]) & (np.bincount(have[0], minlength=len(queries))[open_] >= k))]
        return (*have, covered)

    def _met(self, queries, some, j, r, masks, worst):
        """Codes that these queries first meet in part j at distance r there, if they may be among the k best."""
        value, values = self.part(queries[some], j), self.values[j]
        if masks is None:
            i, at = np.nonzero(np.bitwise_count(value[:, None] ^ values) == r)
        else:
            wanted = value[:, None] ^ masks
            at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            i, c = np.nonzero(values[at] == wanted)
            at = at[i, c]
        lo = self.starts[j][at]
        size = self.starts[j][at + 1] - lo
        q = np.repeat(some[i], size)
        p = self.order[j][np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(q))]
        x = queries[q] ^ self.data[p]
        d = np.bitwise_count(x).astype(np.int64)
        keep = d <= worst[q]
        for other in range(self.parts):
            if other != j:  # met before, if another part was near enough
                keep &= np.bitwise_count(self.part(x, other)) > r - (other > j)
        return q[keep], p[keep], d[keep]

    def _best(self, q, p, d, k):
        """The k least of each query by distance, then id."""
        order = np.lexsort((self.ids[p], d, q))
        q, p, d = q[order], p[order], d[order]
        start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else q
        return [x[place < k] for x in (q, p, d)]


def _masks(width: int, r: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], np.uint64)


def topk(data: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, block: int = QUERY_BLOCK, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The k nearest rows of data (id, code) for each row of queries (id, code)."""
    spark = data.sparkSession
    queries = queries.distinct()
    n = data.count()
    slices = max(1, -(-n // slice_rows), min(spark.sparkContext.defaultParallelism, n // LEAST_SLICE))
    blocks = max(1, -(-queries.count() // block))
    number = F.monotonically_increasing_id()  # a row's place in its file: rows of one id are spread too
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = data.select("id", "code", F.pmod(number, F.lit(slices)).cast("int").alias("s")).select("*", each(blocks).alias("b"), F.lit(0).alias("asks"))
    asked = queries.select("id", "code", F.pmod(number, F.lit(blocks)).cast("int").alias("b")).select("id", "code", each(slices).alias("s"), "b", F.lit(1).alias("asks"))
    both = rows.unionByName(asked).repartition(slices * blocks, "s", "b").sortWithinPartitions("s", "b", "asks")
    out = arrow_schema(query_id="long", code="long", vec_id="long", distance="long")

    def apply(batches):
        now, parts, index = None, [], None
        for batch in batches:
            ids, code, s, b, asks = (batch.column(c).to_numpy() for c in ("id", "code", "s", "b", "asks"))
            code = code.view(np.uint64)
            edge = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (b[1:] != b[:-1]) | (asks[1:] != asks[:-1]), True]) if len(s) else [0]
            for lo, hi in zip(edge[:-1], edge[1:]):
                if (s[lo], b[lo]) != now:
                    now, parts, index = (s[lo], b[lo]), [], None
                if not asks[lo]:
                    parts.append((ids[lo:hi], code[lo:hi]))
                    continue
                if parts:
                    index, parts = Index(*(np.concatenate(x) for x in zip(*parts)), bits), []
                for a in range(lo, hi, 4096) if index else ():
                    z = min(a + 4096, hi)
                    q, p, d, _ = index.search(code[a:z], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:z][q]), pa.array(code[a:z][q].view(np.int64)), pa.array(index.ids[p]), pa.array(d)], schema=out)

    met = both.mapInArrow(apply, ddl(out))
    w = Window.partitionBy("query_id", "code").orderBy("distance", "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("code")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = written(codes(load(spark, sf_dir, "embeddings")))
    return topk(data, data.where("id % 20 = 0"))


SQL = """
WITH c AS (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 AND NOT isnan(embedding[i + 1]) THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END)) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
d AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code::UBIGINT, c.code::UBIGINT))::BIGINT AS distance FROM c q, c WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10
"""
