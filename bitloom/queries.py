"""Queries of the bit- and integer-vector operators over the test tables, and the SQL that gives the same rows.

Vectors: EV = events (bit: value > 50), OR = orders (bit: status is F), LI = lineitem rows in order (bit: quantity > 25), EVG = EV by
event type, PS = part sizes (6 bits), CN = customers' nations (5 bits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.operators import bitvec, index, intvec, rankselect
from bitloom.operators.bitvec import BitVec
from bitloom.plans.prefix import number_rows
from bitloom.sources.tables import bits_of, ints_of, load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# Vectors


def ev(spark: SparkSession, d: str) -> DataFrame:
    return bits_of(load(spark, d, "events"), "event_id", F.col("value") > 50)


def orders_f(spark: SparkSession, d: str) -> DataFrame:
    return bits_of(load(spark, d, "orders"), "o_orderkey", F.col("o_orderstatus") == "F")


def li(spark: SparkSession, d: str) -> DataFrame:
    rows = number_rows(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber", "l_quantity"])
    return bits_of(rows, "pos", F.col("l_quantity") > 25)


def evg(spark: SparkSession, d: str) -> DataFrame:
    """Positions within a type count its events in order: ranks of the type's own bit vector."""
    e = load(spark, d, "events")
    types = bits_of(e, "event_id", F.lit(True), F.col("event_type"))
    at = rankselect.rank_window(types).select("vec_id", F.col("pos").alias("event_id"), F.col("rank1").alias("at"))
    rows = e.select("event_id", F.col("event_type").alias("vec_id"), "value").join(at, ["vec_id", "event_id"])
    return bits_of(rows, "at", F.col("value") > 50, F.col("vec_id"))


def ps(spark: SparkSession, d: str) -> DataFrame:
    return ints_of(load(spark, d, "part"), "p_partkey", "p_size")


def cn(spark: SparkSession, d: str) -> DataFrame:
    return ints_of(load(spark, d, "customer"), "c_custkey", "c_nationkey")


EV = "e AS (SELECT event_id AS pos, coalesce(value > 50, false) AS bit FROM events)"
OR = "e AS (SELECT o_orderkey AS pos, o_orderstatus = 'F' AS bit FROM orders)"
LI = "e AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS pos, l_quantity > 25 AS bit FROM lineitem)"
EVG = "e AS (SELECT event_type AS vec_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, value > 50 AS bit FROM events)"
SIGNED = "CASE WHEN u >= 9223372036854775808 THEN (u::HUGEINT - 18446744073709551616)::BIGINT ELSE u::BIGINT END"
WORDS = "w AS (SELECT pos // 64 AS word_idx, bit_or(CASE WHEN bit THEN 1::UBIGINT << (pos % 64)::UBIGINT ELSE 0::UBIGINT END) AS u FROM e GROUP BY 1)"


def _view(df: DataFrame) -> BitVec:
    """A vector with its length, which is one small aggregate."""
    return BitVec(df, df.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0])


# Construction, reading


@query(f"WITH {EV}, z AS (SELECT pos, false AS bit FROM e) SELECT count(*)::BIGINT AS n, (count(*) FILTER (bit))::BIGINT AS ones, count(DISTINCT pos // 64)::BIGINT AS words FROM z")
def bit_new(spark, d):
    """As many zeros as the events vector has positions."""
    v = BitVec.new(spark, len(_view(ev(spark, d))))
    words = v.raw().groupBy("vec_id").agg(F.count("*").alias("words"), F.sum(F.bit_count("word")).cast("bigint").alias("ones"))
    return v.bits().groupBy("vec_id").agg(F.count("*").alias("n")).join(words, "vec_id").select("n", "ones", "words")


@query(f"WITH {EV}, {WORDS} SELECT word_idx, {SIGNED} AS word FROM w")
def bit_pack_words(spark, d):
    return bitvec.pack(ev(spark, d)).select("word_idx", "word")


@query(f"WITH {EV} SELECT pos, bit FROM e WHERE pos = 77")
def bit_get(spark, d):
    return _view(ev(spark, d)).get(77)


@query(f"WITH {EV}, q AS (SELECT DISTINCT user_id AS idx FROM events) SELECT idx, bit FROM q LEFT JOIN e ON pos = idx")
def bit_get_many(spark, d):
    q = load(spark, d, "events").select(F.lit("").alias("vec_id"), F.col("user_id").alias("idx")).distinct()
    words = bitvec.pack(ev(spark, d))
    n = bitvec.header(ev(spark, d))
    return bitvec.get_many(words, n, q, strict=False).select("idx", "bit")


@query("SELECT event_type AS vec_id, count(*)::BIGINT AS n_bits, count(*) = 0 AS is_empty FROM events GROUP BY 1")
def bit_len(spark, d):
    return bitvec.header(evg(spark, d)).select("vec_id", "n_bits", (F.col("n_bits") == 0).alias("is_empty"))


@query(f"WITH {EV} SELECT pos, bit FROM e")
def bit_iterate(spark, d):
    bits = ev(spark, d)
    return bitvec.unpack(bitvec.pack(bits), bitvec.header(bits)).select("pos", "bit")


@query("WITH e AS (SELECT event_type AS vec_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, value > 50 AS bit FROM events) SELECT vec_id, '{' || string_agg(CASE WHEN bit THEN '1' ELSE '0' END, ', ' ORDER BY pos) || '}' AS text FROM e GROUP BY vec_id")
def bit_debug(spark, d):
    return bitvec.debug(evg(spark, d))


# Updates: one per order line of the batch; the last of a position holds


@query(f"WITH {EV}, u AS (SELECT user_id AS pos, max_by(event_type = 'click', event_id) AS new FROM events GROUP BY 1) SELECT e.pos, coalesce(new, bit) AS bit FROM e LEFT JOIN u USING (pos)")
def bit_set(spark, d):
    u = load(spark, d, "events").select(F.lit("").alias("vec_id"), F.col("user_id").alias("pos"), F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("bit"))
    return bitvec.apply_sets(ev(spark, d), u).select("pos", "bit")


@query(f"WITH {EV}, u AS (SELECT user_id AS pos, count(*) % 2 = 1 AS odd FROM events GROUP BY 1) SELECT e.pos, bit <> coalesce(odd, false) AS bit FROM e LEFT JOIN u USING (pos)")
def bit_flip(spark, d):
    return bitvec.apply_flips(ev(spark, d), load(spark, d, "events").select(F.lit("").alias("vec_id"), F.col("user_id").alias("pos"))).select("pos", "bit")


@query(f"WITH {EV}, u AS (SELECT user_id AS pos, max_by(event_type = 'click', event_id) AS new FROM events GROUP BY 1), e2 AS (SELECT e.pos, coalesce(new, bit) AS bit FROM e LEFT JOIN u USING (pos)), {WORDS.replace('FROM e', 'FROM e2')} SELECT word_idx, {SIGNED} AS word FROM w")
def bit_set_words(spark, d):
    u = load(spark, d, "events").select(F.lit("").alias("vec_id"), F.col("user_id").alias("pos"), F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("bit"))
    return bitvec.set_words(bitvec.pack(ev(spark, d)), bitvec.header(ev(spark, d)), u, strict=False).select("word_idx", "word")


@query(f"WITH {EV}, t AS (SELECT max(pos) + 1 AS n FROM e), u AS (SELECT event_id * 3 AS pos, true AS new FROM events), e2 AS (SELECT e.pos, coalesce(new, bit) AS bit FROM e LEFT JOIN u USING (pos)) SELECT n AS n_bits, (SELECT count(*) FILTER (bit) FROM e2)::BIGINT AS ones FROM t")
def bit_set_beyond(spark, d):
    """Two thirds of the batch lie beyond the vector; padding stays empty."""
    u = load(spark, d, "events").select(F.lit("").alias("vec_id"), (F.col("event_id") * 3).alias("pos"), F.lit(0).alias("seq"), F.lit(True).alias("bit"))
    words, header = bitvec.pack(ev(spark, d)), bitvec.header(ev(spark, d))
    return index.totals(bitvec.set_words(words, header, u, strict=False), header).select("n_bits", "ones")


@query(f"WITH {EV}, u AS (SELECT user_id AS pos, count(*) % 2 = 1 AS odd FROM events GROUP BY 1), e2 AS (SELECT e.pos, bit <> coalesce(odd, false) AS bit FROM e LEFT JOIN u USING (pos)), {WORDS.replace('FROM e', 'FROM e2')} SELECT word_idx, {SIGNED} AS word FROM w")
def bit_flip_words(spark, d):
    flips = load(spark, d, "events").select(F.lit("").alias("vec_id"), F.col("user_id").alias("pos"))
    return bitvec.flip_words(bitvec.pack(ev(spark, d)), bitvec.header(ev(spark, d)), flips, strict=False).select("word_idx", "word")


# Slices


@query(f"WITH {EV} SELECT pos - 20 AS pos, bit FROM e WHERE pos >= 20 AND pos < 400")
def bit_slice(spark, d):
    return _view(ev(spark, d)).slice(20, 400).bits().select("pos", "bit")


@query(f"WITH {EV} SELECT pos - 25 AS pos, bit FROM e WHERE pos >= 25 AND pos < 50")
def bit_slice_nested(spark, d):
    return _view(ev(spark, d)).slice(20, 400).slice(5, 30).bits().select("pos", "bit")


@query(f"WITH {EV} SELECT pos - 20 AS pos, bit FROM e WHERE pos >= 20 AND pos <= 39")
def bit_slice_inclusive(spark, d):
    return _view(ev(spark, d)).slice(20, 39, inclusive_end=True).bits().select("pos", "bit")


@query(f"WITH {EV} SELECT pos - 11 AS pos, bit FROM e WHERE pos > 10 AND pos < 25")
def bit_slice_exclusive(spark, d):
    return _view(ev(spark, d)).slice(10, 25, exclusive_start=True).bits().select("pos", "bit")


@query(f"WITH {EV} SELECT pos - 900 AS pos, bit FROM e WHERE pos >= 900")
def bit_slice_from(spark, d):
    return _view(ev(spark, d)).slice(900).bits().select("pos", "bit")


@query(f"WITH {EV} SELECT pos, bit FROM e WHERE pos < 130")
def bit_slice_to(spark, d):
    return _view(ev(spark, d)).slice(None, 130).bits().select("pos", "bit")


@query(f"WITH {EV} SELECT pos, CASE WHEN pos = 27 THEN true WHEN pos = 30 THEN NOT bit ELSE bit END AS bit FROM e")
def bit_slice_set(spark, d):
    v = _view(ev(spark, d))
    changed = v.slice(20, 400).set(7, True).flip(10)
    return BitVec(changed.parent, v.n).bits().select("pos", "bit")


@query(f"WITH {EV} SELECT CASE WHEN pos < 333 THEN 'left' ELSE 'right' END AS part, CASE WHEN pos < 333 THEN pos ELSE pos - 333 END AS pos, bit FROM e")
def bit_split(spark, d):
    left, right = _view(ev(spark, d)).split_at(333)
    return left.bits().select(F.lit("left").alias("part"), "pos", "bit").unionAll(right.bits().select(F.lit("right").alias("part"), "pos", "bit"))


@query(f"WITH {EV} SELECT (SELECT bool_and(a.bit = b.bit) FROM e a JOIN e b ON a.pos + 64 = b.pos WHERE a.pos BETWEEN 100 AND 131) AS equal")
def bit_not_equal(spark, d):
    v = _view(ev(spark, d))
    return v.slice(100, 132).equals(v.slice(164, 196))


@query(f"WITH {EV}, {WORDS}, back AS (SELECT e.pos, ((u >> (e.pos % 64)::UBIGINT) & 1) = 1 AS bit FROM e JOIN w ON w.word_idx = e.pos // 64) SELECT count(*) = (SELECT count(*) FROM e) AS equal FROM e JOIN back USING (pos, bit)")
def bit_equal(spark, d):
    bits = ev(spark, d)
    again = bitvec.unpack(bitvec.pack(bits), bitvec.header(bits))
    return BitVec(bits, _view(bits).n).equals(BitVec(again, _view(bits).n))


@query(f"WITH {EV}, q AS (SELECT DISTINCT user_id AS idx FROM events) SELECT idx, CASE WHEN idx < 380 THEN bit END AS bit FROM q LEFT JOIN e ON pos = idx + 20")
def bit_slice_get(spark, d):
    q = load(spark, d, "events").select(F.lit("").alias("vec_id"), F.col("user_id").alias("idx")).distinct()
    return _view(ev(spark, d)).slice(20, 400).get_many(q, strict=False).select("idx", "bit")


@query(f"WITH {EV} SELECT pos - 64 AS pos, bit FROM e WHERE pos >= 64")
def bit_slice_unchecked(spark, d):
    """A view that says it reaches beyond its parent has the parent's rows."""
    v = _view(ev(spark, d))
    return v.slice_unchecked(64, v.n + 1000).bits().select("pos", "bit")


@query(f"WITH {EV} SELECT pos, CASE WHEN pos < 100 AND pos % 5 = 0 OR pos BETWEEN 333 AND 432 AND (pos - 333) % 5 = 0 THEN NOT bit ELSE bit END AS bit FROM e")
def bit_split_set(spark, d):
    """Both halves are updated, one after the other; positions beyond the left half do not reach into the right one."""
    v = _view(ev(spark, d))
    flips = spark.range(0, 100, 5).select(F.lit("").alias("vec_id"), F.col("id").alias("pos"))
    left, _ = v.split_at(333)
    _, right = BitVec(left.flip_many(flips.unionAll(spark.range(333, 400).selectExpr("'' as vec_id", "id as pos")), strict=False).parent, v.n).split_at(333)
    return BitVec(right.flip_many(flips).parent, v.n).bits().select("pos", "bit")


@query(f"WITH {EV} SELECT pos, CASE WHEN pos = 5 THEN true WHEN pos = 6 THEN NOT bit WHEN pos = 7 THEN false ELSE bit END AS bit FROM e")
def bit_update(spark, d):
    return _view(ev(spark, d)).set(5, True).flip(6).set(7, False).bits().select("pos", "bit")


@query(f"WITH {EV} SELECT pos, bit, (SELECT count(*) FROM e) - 130 AS left_ FROM e WHERE pos BETWEEN 100 AND 129")
def bit_cursor(spark, d):
    _, cursor = _view(ev(spark, d)).cursor().take(100)
    rows, cursor = cursor.take(30)
    return rows.select("pos", "bit", F.lit(len(cursor)).cast("bigint").alias("left_"))


# Primitives: p_partkey as an unsigned number of 32 bits, p_size mod 32 as the index


@query("SELECT p_partkey, ((p_partkey >> (p_size % 32)) & 1) = 1 AS bit FROM part")
def bit_prim_get(spark, d):
    return load(spark, d, "part").select("p_partkey", B.prim_get(F.col("p_partkey"), (F.col("p_size") % 32).cast("bigint"), F.lit(32)).alias("bit"))


@query("SELECT p_partkey, (p_partkey | (1::BIGINT << (p_size % 32))) AS on_, (p_partkey & ~(1::BIGINT << (p_size % 32))) AS off_ FROM part")
def bit_prim_set(spark, d):
    i = (F.col("p_size") % 32).cast("bigint")
    return load(spark, d, "part").select("p_partkey", B.prim_set(F.col("p_partkey"), i, F.lit(True), F.lit(32)).alias("on_"), B.prim_set(F.col("p_partkey"), i, F.lit(False), F.lit(32)).alias("off_"))


@query("SELECT p_partkey, xor(p_partkey, 1::BIGINT << (p_size % 32)) AS flipped FROM part")
def bit_prim_flip(spark, d):
    return load(spark, d, "part").select("p_partkey", B.prim_flip(F.col("p_partkey"), (F.col("p_size") % 32).cast("bigint"), F.lit(32)).alias("flipped"))


@query("SELECT p_partkey, CASE WHEN p_size < 32 THEN ((p_partkey >> p_size) & 1) = 1 ELSE p_size = 33 END AS bit, p_partkey | (1::BIGINT << (p_size % 32)) AS first_ FROM part")
def bit_array_access(spark, d):
    at = F.when(F.col("p_size") < 32, F.col("p_size")).otherwise(F.col("p_size") + 64).cast("bigint")
    words = F.array(F.col("p_partkey"), B.shl(F.lit(1).cast("bigint"), 33))
    return load(spark, d, "part").select("p_partkey", B.array_get(words, at).alias("bit"), B.array_set(words, (F.col("p_size") % 32).cast("bigint"), F.lit(True))[0].alias("first_"))


@query("SELECT p_partkey, xor(p_partkey, 1::BIGINT << (p_size % 32)) AS first_, xor(8589934592, 1::BIGINT << (p_size % 60)) AS second_ FROM part")
def bit_array_flip(spark, d):
    words = F.array(F.col("p_partkey"), B.shl(F.lit(1).cast("bigint"), 33))
    at = lambda m, base: (F.col("p_size") % m + base).cast("bigint")
    both = B.array_flip(B.array_flip(words, at(32, 0)), at(60, 64))
    return load(spark, d, "part").select("p_partkey", both.alias("w")).select("p_partkey", F.col("w")[0].alias("first_"), F.col("w")[1].alias("second_"))


# Index tables

_L1L2 = """g AS (SELECT pos // 512 AS g, count(*) FILTER (bit) AS c FROM e GROUP BY 1), t AS (SELECT count(*) AS n, count(*) FILTER (bit) AS ones FROM e),
x AS (SELECT unnest(range(0, (((n + 511) // 512) // 8) + 1)) AS l1_idx, n, ones, (n + 511) // 512 AS blocks FROM t WHERE n > 0),
y AS (SELECT l1_idx, j, blocks, ones, (SELECT coalesce(sum(c), 0) FROM g WHERE g.g < l1_idx * 8) AS l1, (SELECT coalesce(sum(c), 0) FROM g WHERE g.g BETWEEN l1_idx * 8 AND l1_idx * 8 + j) AS v FROM x, range(0, 7) AS r(j))
SELECT l1_idx, max(l1)::BIGINT AS l1, array_to_string(list(CASE WHEN l1_idx * 8 + j < blocks THEN v ELSE 4095 END::INT ORDER BY j), ',') AS l2 FROM y GROUP BY l1_idx"""


def _l1l2(bits: DataFrame) -> DataFrame:
    return index.l1l2(bitvec.pack(bits), bitvec.header(bits)).select("l1_idx", "l1", F.array_join(F.col("l2").cast("array<string>"), ",").alias("l2"))


@query(f"WITH {EV}, {_L1L2}")
def idx_l1l2(spark, d):
    return _l1l2(ev(spark, d))


#: As _L1L2, with running sums instead of a sum for each entry.
_RUN = """g AS (SELECT pos // 512 AS g, count(*) FILTER (bit) AS c FROM e GROUP BY 1), t AS (SELECT count(*) AS n, count(*) FILTER (bit) AS ones FROM e),
b AS (SELECT unnest(range(0, 8 * ((n + 511) // 512 // 8 + 1))) AS g, (n + 511) // 512 AS blocks FROM t WHERE n > 0),
s AS (SELECT b.g, blocks, sum(coalesce(c, 0)) OVER (ORDER BY b.g) AS upto FROM b LEFT JOIN g ON g.g = b.g),
x AS (SELECT g // 8 AS l1_idx, g % 8 AS j, g, blocks, upto, lag(upto, 1, 0) OVER (ORDER BY g) AS before FROM s),
y AS (SELECT *, first_value(before) OVER (PARTITION BY l1_idx ORDER BY j) AS l1 FROM x)
SELECT l1_idx, max(l1)::BIGINT AS l1, array_to_string(list(CASE WHEN g < blocks THEN upto - l1 ELSE 4095 END::INT ORDER BY j) FILTER (j < 7), ',') AS l2 FROM y GROUP BY l1_idx"""


@query(f"WITH {LI}, {_RUN}")
def idx_l1l2_lineitem(spark, d):
    return _l1l2(li(spark, d))


@query(f"WITH a AS ({LI[6:-1]}), e AS (SELECT * FROM a UNION ALL SELECT (SELECT count(*) FROM a) + x, true FROM range((4096 - (SELECT count(*) FROM a) % 4096) % 4096) AS r(x)), {_RUN}")
def idx_l1l2_sentinel(spark, d):
    """The vector is filled up with ones to whole L1 blocks, so that the index has one more entry."""
    bits = li(spark, d)
    n = _view(bits).n
    more = spark.range(n, n + -n % 4096).select(F.lit("").alias("vec_id"), F.col("id").alias("pos"), F.lit(True).alias("bit"))
    return _l1l2(bits.unionByName(more))


@query(f"WITH {LI}, o AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS rn FROM e WHERE bit) SELECT rn // 8192 AS sample_no, pos // 8192 AS value FROM o WHERE rn % 8192 = 0")
def idx_samples(spark, d):
    return index.samples(bitvec.pack(li(spark, d))).select("sample_no", "value")


@query("SELECT event_type AS vec_id, count(*)::BIGINT AS n_bits, (count(*) FILTER (value > 50))::BIGINT AS ones FROM events GROUP BY 1")
def idx_totals(spark, d):
    bits = evg(spark, d)
    return index.totals(bitvec.pack(bits), bitvec.header(bits))


@query(f"WITH {EV}, b AS (SELECT unnest(range(0, (max(pos) + 512) // 512)) AS block FROM e) SELECT block, (SELECT count(*) FROM e WHERE bit AND pos < block * 512)::BIGINT AS before FROM b")
def idx_rough_rank(spark, d):
    bits = ev(spark, d)
    header = bitvec.header(bits)
    rows = index.l1l2(bitvec.pack(bits), header).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7)))).join(header, "vec_id").where("(l1_idx * 8 + j) * 512 < n_bits")
    return rows.select((F.col("l1_idx") * 8 + F.col("j")).cast("bigint").alias("block"), index.rough_rank("l1", "l2", F.col("j")).alias("before"))


# Rank

_RANKS = "SELECT pos AS idx, (coalesce(sum(bit::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS {0} FROM e"


def _all(bits: DataFrame) -> DataFrame:
    return bits.select("vec_id", F.col("pos").alias("idx"))


def rank1_events(spark: SparkSession, d: str) -> DataFrame:
    bits = ev(spark, d)
    return rankselect.rank(bitvec.pack(bits), bitvec.header(bits), _all(bits)).select("idx", "rank1")


@query(f"WITH {EV} {_RANKS.format('rank1')}")
def rank1_all(spark, d):
    return rank1_events(spark, d)


@query(f"WITH {OR} {_RANKS.format('rank1')}")
def rank1_window(spark, d):
    return rankselect.rank_window(orders_f(spark, d)).select(F.col("pos").alias("idx"), "rank1")


@query(f"WITH {EV} SELECT idx, idx - r AS rank0 FROM ({_RANKS.format('r')})")
def rank0_all(spark, d):
    bits = ev(spark, d)
    return rankselect.rank(bitvec.pack(bits), bitvec.header(bits), _all(bits)).select("idx", "rank0")


@query(f"WITH {EV} SELECT idx, idx % 3 = 0 AS value, CASE WHEN idx % 3 = 0 THEN r ELSE idx - r END AS rank FROM ({_RANKS.format('r')})")
def rank_dyn(spark, d):
    bits = ev(spark, d)
    return rankselect.rank_dyn(bitvec.pack(bits), bitvec.header(bits), _all(bits).withColumn("value", F.col("idx") % 3 == 0)).select("idx", "value", "rank")


@query("SELECT event_type AS vec_id, count(*)::BIGINT AS idx, (count(*) FILTER (value > 50))::BIGINT AS rank1, (count(*) FILTER (value <= 50))::BIGINT AS rank0 FROM events GROUP BY 1")
def rank_at_end(spark, d):
    bits = evg(spark, d)
    header = bitvec.header(bits)
    return rankselect.rank(bitvec.pack(bits), header, header.select("vec_id", F.col("n_bits").alias("idx"))).select("vec_id", "idx", "rank1", "rank0")


@query(f"WITH {EVG} SELECT vec_id, pos AS idx, (coalesce(sum(bit::INT) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rank1 FROM e")
def rank_grouped(spark, d):
    bits = evg(spark, d)
    return rankselect.rank(bitvec.pack(bits), bitvec.header(bits), _all(bits)).select("vec_id", "idx", "rank1")


@query(f"WITH {LI}, r AS ({_RANKS.format('rank1')}), q AS (SELECT DISTINCT l_partkey * 7 AS idx FROM lineitem) SELECT q.idx, CASE WHEN q.idx = (SELECT count(*) FROM e) THEN (SELECT count(*) FROM e WHERE bit) ELSE rank1 END::BIGINT AS rank1 FROM q LEFT JOIN r ON r.idx = q.idx")
def rank1_index(spark, d):
    """A few thousand ranks from the index; null beyond the vector."""
    q = load(spark, d, "lineitem").select(F.lit("").alias("vec_id"), (F.col("l_partkey") * 7).alias("idx")).distinct()
    return rankselect.rank_indexed(index.Index.build(li(spark, d)), q, strict=False).select("idx", "rank1")


# Select

_ONES = "o AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS r, pos FROM e WHERE bit)"


def _numbers(bits: DataFrame) -> DataFrame:
    """0, 1, ... up to the vector's length, one number per position."""
    return bits.select("vec_id", F.col("pos").alias("r"))


@query(f"WITH {LI}, {_ONES} SELECT e.pos AS r, o.pos FROM e LEFT JOIN o ON o.r = e.pos")
def select1_all(spark, d):
    bits = li(spark, d)
    return rankselect.select(bitvec.pack(bits), _numbers(bits)).select("r", "pos")


@query(f"WITH {LI}, {_ONES}, q AS (SELECT DISTINCT l_partkey * 5 AS r FROM lineitem) SELECT q.r, o.pos FROM q LEFT JOIN o ON o.r = q.r")
def select1_index(spark, d):
    """A few thousand selects from the index; null beyond the last one."""
    q = load(spark, d, "lineitem").select(F.lit("").alias("vec_id"), (F.col("l_partkey") * 5).alias("r")).distinct()
    return rankselect.select_indexed(index.Index.build(li(spark, d)), q).select("r", "pos")


@query(f"WITH {OR}, {_ONES} SELECT e.pos AS r, o.pos FROM e LEFT JOIN o ON o.r = e.pos")
def select1_window(spark, d):
    bits = orders_f(spark, d)
    return rankselect.select_window(bits, _numbers(bits)).select("r", "pos")


@query(f"WITH {EV}, {_ONES.replace('WHERE bit', 'WHERE NOT bit')} SELECT e.pos AS r, o.pos FROM e LEFT JOIN o ON o.r = e.pos")
def select0_all(spark, d):
    bits = ev(spark, d)
    return rankselect.select(bitvec.pack(bits), _numbers(bits), ones=False, header=bitvec.header(bits)).select("r", "pos")


@query("WITH t AS (SELECT (count(*) FILTER (value > 50))::BIGINT AS n FROM events) SELECT r, NULL::BIGINT AS pos FROM (SELECT n AS r FROM t UNION ALL SELECT n + 100000 FROM t UNION ALL SELECT -1)")
def select1_missing(spark, d):
    words = bitvec.pack(ev(spark, d))
    n = words.agg(F.sum(F.bit_count("word")).cast("bigint").alias("n"))
    q = n.select(F.lit("").alias("vec_id"), F.explode(F.array(F.col("n"), F.col("n") + 100000, F.lit(-1).cast("bigint"))).alias("r"))
    return rankselect.select(words, q).select("r", "pos")


@query(f"WITH {LI} SELECT row_number() OVER (ORDER BY pos) - 1 AS r, row_number() OVER (ORDER BY pos) - 1 AS back, true AS bit FROM e WHERE bit")
def select_rank_roundtrip(spark, d):
    bits = li(spark, d)
    words, header = bitvec.pack(bits), bitvec.header(bits)
    at = rankselect.select(words, _numbers(bits)).where("pos is not null").withColumnRenamed("pos", "idx")
    return bitvec.get_many(words, header, rankselect.rank(words, header, at), strict=False).select("r", F.col("rank1").alias("back"), "bit")


_FIND = "WITH c AS (SELECT p_partkey AS r, [10, 25, 80, 80, 167, 1002, 1762] AS l2 FROM part), j AS (SELECT r, l2, len(list_filter(l2, lambda x: x <= r)) AS j FROM c) SELECT r, j::BIGINT AS block, (CASE WHEN j = 0 THEN 0 ELSE l2[j] END)::BIGINT AS before FROM j"


def _find(spark, d, f):
    l2 = F.array(*[F.lit(x) for x in (10, 25, 80, 80, 167, 1002, 1762)])
    block, before = f(F.col("l2"), F.col("r"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("r"), l2.alias("l2")).select("r", block.alias("block"), before.alias("before"))


@query(_FIND)
def find_l2_linear(spark, d):
    return _find(spark, d, B.find_l2_linear)


@query(_FIND)
def find_l2_binary(spark, d):
    return _find(spark, d, B.find_l2_binary)


# Integer vectors


def _int_words(table: str, key: str, value: str, width: int) -> str:
    """SQL for the words of a packed vector, bit by bit."""
    return f"b AS (SELECT {key} * {width} + k AS pos, ({value} >> k) & 1 AS bit FROM {table}, range(0, {width}) AS r(k)), w AS (SELECT pos // 64 AS word_idx, bit_or(CASE WHEN bit = 1 THEN 1::UBIGINT << (pos % 64)::UBIGINT ELSE 0::UBIGINT END) AS u FROM b GROUP BY 1)"


@query(f"WITH {_int_words('part', 'p_partkey', 'p_size', 6)}, a AS (SELECT * FROM w UNION ALL SELECT count(*) * 6 // 64, 0::UBIGINT FROM part HAVING count(*) * 6 % 64 = 0) SELECT word_idx, {SIGNED} AS word FROM a")
def int_pack_words(spark, d):
    return intvec.raw(ps(spark, d), 6).select("word_idx", "word")


@query(f"WITH {_int_words('part', 'p_partkey', 'p_size', 23)} SELECT word_idx, {SIGNED} AS word FROM w")
def int_straddle(spark, d):
    return intvec.pack(ps(spark, d), 23).select("word_idx", "word")


@query("SELECT c_custkey AS idx, c_nationkey::BIGINT AS value FROM customer")
def int_get(spark, d):
    v = cn(spark, d)
    return intvec.get_many(intvec.pack(v, 5), _n(v), v.select("vec_id", "idx"), 5).select("idx", "value")


def _n(ints: DataFrame) -> DataFrame:
    return ints.groupBy("vec_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS idx, c_nationkey::BIGINT AS value FROM orders LEFT JOIN customer ON c_custkey = o_orderkey")
def int_get_beyond(spark, d):
    """Most of these indexes lie beyond the vector: null."""
    v = cn(spark, d)
    q = load(spark, d, "orders").select(F.lit("").alias("vec_id"), F.col("o_orderkey").alias("idx"))
    return intvec.get_many(intvec.pack(v, 5), _n(v), q, 5, strict=False).select("idx", "value")


@query("SELECT n, n // 1 = 0 AS is_empty, n * 6 // 64 + 1 AS words, 63::BIGINT AS mask, (SELECT p_size FROM part WHERE p_partkey = 7)::BIGINT AS got, 5::BIGINT AS pushed FROM (SELECT count(*)::BIGINT + 2 AS n FROM part)")
def int_vec_value(spark, d):
    v = ps(spark, d)
    v = intvec.IntVec(v, v.count(), 6).push(4, 5).set(3, 9)
    one = lambda df, name: df.select(F.col("value").alias(name))
    return one(v.get(7), "got").crossJoin(one(v.get(len(v) - 1), "pushed")).select(F.lit(len(v)).cast("bigint").alias("n"), F.lit(v.is_empty()).alias("is_empty"), F.lit(v.words()).cast("bigint").alias("words"), F.lit(v.mask()).cast("bigint").alias("mask"), "got", "pushed")


@query("SELECT p_partkey AS idx, p_size::BIGINT AS value, (SELECT count(*) FROM part) - 150 AS left_ FROM part WHERE p_partkey BETWEEN 100 AND 149")
def int_cursor(spark, d):
    v = ps(spark, d)
    _, cursor = intvec.IntVec(v, v.count(), 6).cursor().take(100)
    rows, cursor = cursor.take(50)
    return rows.withColumn("left_", F.lit(len(cursor)).cast("bigint"))


@query("SELECT p_partkey AS idx, p_size::BIGINT AS value FROM part")
def int_iterate(spark, d):
    v = ps(spark, d)
    return intvec.unpack(intvec.raw(v, 23), v.groupBy("vec_id").agg(F.count("*").alias("n")), 23).select("idx", "value")


@query("SELECT p_partkey AS idx, CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 64 ELSE p_size END::BIGINT AS value FROM part")
def int_set(spark, d):
    v = ps(spark, d)
    u = v.where("idx % 10 = 0").select("vec_id", "idx", F.lit(1).alias("seq"), (F.col("idx") % 64).alias("value"))
    return intvec.set_many(v, u.unionAll(u.withColumn("seq", F.lit(0)).withColumn("value", F.lit(63).cast("bigint"))), 6).select("idx", "value")


@query("SELECT p_partkey AS idx, CASE WHEN p_partkey % 10 = 0 THEN p_partkey & 63 ELSE p_size END::BIGINT AS value FROM part")
def int_set_truncating(spark, d):
    v = ps(spark, d)
    u = v.where("idx % 10 = 0").select("vec_id", "idx", F.lit(0).alias("seq"), (F.col("idx") + (1 << 20)).alias("value"))
    return intvec.set_many(v, u, 6, truncate=True).select("idx", "value")


@query("SELECT p_partkey AS idx, p_size::BIGINT AS value FROM part UNION ALL SELECT (SELECT count(*) FROM part) + c_custkey, c_nationkey FROM customer")
def int_push(spark, d):
    new = cn(spark, d).select("vec_id", F.col("idx").alias("seq"), "value")
    return intvec.push_many(ps(spark, d), new, 6).select("idx", "value")


@query("SELECT count(*)::BIGINT AS n, count(*) = 0 AS is_empty, count(*) * 6 % 64 AS current_offset, 63::BIGINT AS mask FROM part")
def int_len(spark, d):
    return ps(spark, d).agg(F.count("*").alias("n")).select("n", (F.col("n") == 0).alias("is_empty"), (F.col("n") * 6 % 64).alias("current_offset"), B.low_mask(F.lit(6)).alias("mask"))
