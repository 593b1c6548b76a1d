"""Bit vectors, index, rank and select on small fixtures, error paths included."""

import random

import pytest
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.operators import bitvec, index, rankselect
from bitloom.operators.bitvec import BitVec
from bitloom.plans.prefix import number_rows, prefix_sums


def make(spark, bits, vec_id="v"):
    return spark.createDataFrame([(vec_id, i, bool(b)) for i, b in enumerate(bits)], "vec_id string, pos bigint, bit boolean")


def signed(u):
    return u - (1 << 64) if u >> 63 else u


def words(bits):
    return [signed(sum(int(b) << k for k, b in enumerate(bits[i : i + 64]))) for i in range(0, len(bits), 64)]


def listed(df, by="pos", value="bit"):
    return [r[value] for r in df.orderBy(by).collect()]


def model(bits):
    """(l1l2 rows, samples) by the plain definition."""
    n, ones = len(bits), [i for i, b in enumerate(bits) if b]
    blocks = -(-n // 512)
    rows = []
    for k in range(blocks // 8 + 1 if n else 0):
        row = [sum(bits[k * 4096 : min(n, k * 4096 + 512 * (j + 1))]) if k * 8 + j < blocks else 4095 for j in range(7)]
        rows.append((k, sum(bits[: k * 4096]), row))
    return rows, [(k, ones[k * 8192] // 8192) for k in range(-(-len(ones) // 8192))]


def index_of(bits_df):
    w, h = bitvec.pack(bits_df), bitvec.header(bits_df)
    rows = [(r.l1_idx, r.l1, r.l2) for r in index.l1l2(w, h).orderBy("l1_idx").collect()]
    return rows, [(r.sample_no, r.value) for r in index.samples(w).orderBy("sample_no").collect()]


def test_new_len_get_flip(spark):
    v = BitVec.new(spark, 80)
    assert len(v) == 80 and not v.is_empty() and BitVec.new(spark, 0).is_empty()
    b = BitVec(make(spark, [i % 3 == 0 for i in range(160)]), 160)
    assert listed(b.bits()) == [i % 3 == 0 for i in range(160)]
    flips = spark.range(160).select(F.lit("v").alias("vec_id"), F.col("id").alias("pos"))
    assert listed(b.flip_many(flips).bits()) == [i % 3 != 0 for i in range(160)]
    assert listed(b.flip_many(flips.unionAll(flips)).bits()) == [i % 3 == 0 for i in range(160)]
    assert b.get(3).first()["bit"] is True
    assert b.set(1, True).get(1).first()["bit"] is True


@pytest.mark.parametrize("op", [lambda v: v.get(20), lambda v: v.set(20, True), lambda v: v.flip(20), lambda v: v.get(-1), lambda v: v.slice(21), lambda v: v.slice(None, 21), lambda v: v.slice(5, 4), lambda v: v.slice(2, 0, exclusive_start=True), lambda v: v.split_at(20), lambda v: v.slice(4, 4).split_at(0)])
def test_bounds(spark, op):
    with pytest.raises(IndexError):
        op(BitVec.new(spark, 20))


def test_slices(spark):
    bits = [i // 5 % 2 == 0 for i in range(80)]
    v = BitVec(make(spark, bits), 80)
    assert listed(v.slice(20, 40).bits()) == bits[20:40]
    assert v.slice(40, 40).is_empty() and v.slice(80).is_empty()
    assert listed(v.slice(10, 25, exclusive_start=True).bits()) == bits[11:25]
    for s in (v.slice(20, 39, inclusive_end=True), v.slice(20, 40), v.slice(10).slice(10, 30)):
        assert s.equals(v.slice(20, 40)).first()["equal"]
    left, right = v.slice(20, 40).split_at(10)
    assert listed(left.bits()) == bits[20:30] and listed(right.bits()) == bits[30:40]
    alternating = BitVec(make(spark, [i % 2 == 0 for i in range(80)]), 80)
    assert alternating.slice(10, 50).equals(alternating.slice(20, 60)).first()["equal"]
    assert not alternating.slice(10, 50).equals(alternating.slice(20, 70)).first()["equal"]
    assert not alternating.slice(10, 50).equals(alternating.slice(11, 51)).first()["equal"]
    through = v.slice(20, 40).set(3, not bits[23])
    assert listed(BitVec(through.parent, 80).bits()) == [b if i != 23 else not b for i, b in enumerate(bits)]


def test_slice_of_slice_is_one_filter(spark, sf_dir):
    v = BitVec(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("").alias("vec_id"), F.col("event_id").alias("pos"), (F.col("value") > 50).alias("bit")), 1000)
    plan = v.slice(20, 400).slice(5, 30).bits()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,25)" in plan and "LessThan(event_id,50)" in plan


def test_pack_unpack_updates(spark):
    random.seed(3)
    bits = [random.random() < 0.4 for _ in range(200)]
    bits[63] = bits[127] = True
    df = make(spark, bits)
    w = bitvec.pack(df)
    assert listed(w, "word_idx", "word") == words(bits)
    assert listed(bitvec.unpack(w, bitvec.header(df))) == bits
    updates = spark.createDataFrame([("v", p, s, b) for s, (p, b) in enumerate([(63, False), (5, True), (5, False), (64, True)])], "vec_id string, pos bigint, seq int, bit boolean")
    changed = list(bits)
    changed[63], changed[5], changed[64] = False, False, True
    assert listed(bitvec.set_words(w, bitvec.header(df), updates), "word_idx", "word") == words(changed)
    assert listed(bitvec.apply_sets(df, updates)) == changed
    flips = spark.createDataFrame([("v", 63), ("v", 63), ("v", 9)], "vec_id string, pos bigint")
    changed = [b if i != 9 else not b for i, b in enumerate(bits)]
    assert listed(bitvec.flip_words(w, bitvec.header(df), flips), "word_idx", "word") == words(changed)
    assert bitvec.equal_words(w, bitvec.pack(bitvec.apply_flips(bitvec.apply_flips(df, flips), flips))).first()["equal"]


def test_densify(spark):
    sparse = spark.createDataFrame([("v", 300, True)], "vec_id string, pos bigint, bit boolean")
    h = spark.createDataFrame([("v", 1000), ("w", 0)], "vec_id string, n_bits bigint")
    got = bitvec.densify(bitvec.pack(sparse), h, step=4).orderBy("word_idx").collect()
    assert [r.word_idx for r in got] == list(range(16)) and [r.word for r in got] == [(1 << 44) if i == 4 else 0 for i in range(16)]
    h = h.where("n_bits > 0")
    assert rankselect.rank(bitvec.densify(bitvec.pack(sparse), h), h, spark.createDataFrame([("v", 1000), ("v", 300)], "vec_id string, idx bigint")).select("rank1").orderBy("rank1").collect() == [(0,), (1,)]


def test_debug(spark):
    assert BitVec(make(spark, [1, 0, 1]), 3).debug() == "{1, 0, 1}" and BitVec.new(spark, 0).debug() == "{}"


CASES = {
    "step": [i & 2 == 0 for i in range(10000)],
    "even": [i % 2 == 0 for i in range(50000)],
    "512": [True] * 512,
    "3584": [True] * 3584,
    "3585": [i % 7 == 0 for i in range(3585)],
    "4096": [True] * 4096,
    "zeros": [False] * 5000,
    "8192 ones": [True] * 8192,
    "clustered": [9000 < i < 18000 for i in range(20000)],
}


@pytest.mark.parametrize("name", CASES)
def test_index_rank_select(spark, name):
    bits = CASES[name]
    df = make(spark, bits).cache()
    assert index_of(df) == model(bits)
    w, h = bitvec.pack(df), bitvec.header(df)
    n, at = len(bits), [i for i, b in enumerate(bits) if b]
    before = [0]
    for b in bits:
        before.append(before[-1] + b)
    q = spark.range(n + 1).select(F.lit("v").alias("vec_id"), F.col("id").alias("idx"))
    got = rankselect.rank(w, h, q).orderBy("idx").collect()
    assert [r.rank1 for r in got] == before and [r.rank0 for r in got] == [i - b for i, b in enumerate(before)]
    assert listed(rankselect.rank_window(df), "pos", "rank1") == before[:-1]
    q = spark.range(-1, n + 2).select(F.lit("v").alias("vec_id"), F.col("id").alias("r"))
    want = [None] + at + [None] * (n + 2 - len(at))
    assert listed(rankselect.select(w, q), "r", "pos") == want
    assert listed(rankselect.select_window(df, q), "r", "pos") == want
    zero = [i for i, b in enumerate(bits) if not b]
    assert listed(rankselect.select(w, q, ones=False, header=h), "r", "pos") == [None] + zero + [None] * (n + 2 - len(zero))
    df.unpersist()


def test_empty(spark):
    df = make(spark, [])
    assert index_of(df) == ([], [])
    h = spark.createDataFrame([("v", 0)], "vec_id string, n_bits bigint")
    q = spark.createDataFrame([("v", 0)], "vec_id string, idx bigint")
    assert rankselect.rank(bitvec.pack(df), h, q).first()["rank1"] == 0
    assert index.totals(bitvec.pack(df), h).first()["ones"] == 0
    assert rankselect.select(bitvec.pack(df), q.withColumnRenamed("idx", "r")).first()["pos"] is None


def test_rank_beyond(spark):
    df = make(spark, [1, 0, 1])
    q = spark.createDataFrame([("v", 4), ("v", -1)], "vec_id string, idx bigint")
    args = bitvec.pack(df), bitvec.header(df), q
    assert [r.rank1 for r in rankselect.rank(*args, strict=False).collect()] == [None, None]
    with pytest.raises(Exception, match="beyond the vector"):
        rankselect.rank(*args).collect()


@pytest.mark.parametrize("l2", [[1, 2, 3, 4, 5, 6, 7], [10, 25, 80, 90, 167, 1002, 1762], [10, 25, 80, 80, 167, 167, 1762], [4095] * 7])
def test_find_l2(spark, l2):
    df = spark.range(2000).select(F.col("id").alias("r"), F.array(*map(F.lit, l2)).alias("l2"))
    for f in (B.find_l2_linear, B.find_l2_binary):
        j, before = f(F.col("l2"), F.col("r"))
        for r in df.select("r", j.alias("j"), before.alias("b")).collect():
            k = sum(x <= r.r for x in l2)
            assert (r.j, r.b) == (k, l2[k - 1] if k else 0)


@pytest.mark.parametrize("n_bits", [8, 16, 32, 64])
def test_primitives(spark, n_bits):
    even = signed(sum(1 << i for i in range(0, n_bits, 2)))
    df = spark.range(n_bits).select("id", F.lit(even).cast("bigint").alias("v"), F.lit(n_bits).alias("n"))
    got = df.select("id", B.prim_get(F.col("v"), F.col("id"), F.col("n")).alias("g"), B.prim_flip(F.col("v"), F.col("id"), F.col("n")).alias("f"), B.prim_set(F.col("v"), F.col("id"), F.lit(False), F.col("n")).alias("s")).orderBy("id").collect()
    for r in got:
        assert r.g == (r.id % 2 == 0)
        assert r.f == signed((even ^ (1 << r.id)) & ((1 << 64) - 1))
        assert r.s == signed(even & ~(1 << r.id) & ((1 << 64) - 1))
    with pytest.raises(Exception, match="index is"):
        spark.range(1).select(B.prim_get(F.lit(1).cast("bigint"), F.lit(n_bits).cast("bigint"), F.lit(n_bits))).collect()


def test_array_words(spark):
    df = spark.range(1).select(F.array(F.lit(5).cast("bigint"), F.lit(1).cast("bigint")).alias("a"))
    at = lambda i: F.lit(i).cast("bigint")
    r = df.select(B.array_get(F.col("a"), at(64)).alias("x"), B.array_get(F.col("a"), at(128)).alias("y"), B.array_set(F.col("a"), at(65), F.lit(True)).alias("s"), B.array_flip(F.col("a"), at(0)).alias("f")).first()
    assert r.x is True and r.y is None and r.s == [5, 3] and r.f == [4, 1]


def test_prefix_sums_and_numbering(spark):
    random.seed(5)
    keys = random.sample(range(10**9), 500)
    df = spark.createDataFrame([("a", k, k % 7) for k in keys] + [("b", 4, 1)], "vec_id string, k bigint, n bigint")
    want, total = [], 0
    for k in sorted(keys):
        want.append(total)
        total += k % 7
    assert listed(prefix_sums(df, "k", "n", "s").where("vec_id = 'a'"), "k", "s") == want
    got = number_rows(df.where("vec_id = 'a'"), ["k"]).orderBy("k").collect()
    assert [r.pos for r in got] == list(range(500))


def test_batches_stay_inside(spark):
    n = 10
    df = make(spark, [i % 2 == 0 for i in range(n)], "")
    w, h = bitvec.pack(df), bitvec.header(df)
    u = spark.createDataFrame([("", 40, 0, True), ("", -1, 0, True), ("", 3, 0, True)], "vec_id string, pos bigint, seq int, bit boolean")
    f = u.select("vec_id", "pos")
    for call in (lambda: bitvec.set_words(w, h, u), lambda: bitvec.flip_words(w, h, f), lambda: bitvec.get_many(w, h, f.withColumnRenamed("pos", "idx")), lambda: BitVec(df, n).set_many(u).bits(), lambda: BitVec(df, n).slice(2, 5).flip_many(f).bits(), lambda: BitVec(df, n).slice(2, 5).get_many(f.withColumnRenamed("pos", "idx"))):
        with pytest.raises(Exception, match="no position"):
            call().collect()
    for new in (bitvec.set_words(w, h, u, strict=False), bitvec.flip_words(w, h, f, strict=False)):
        assert index.totals(new, h).first().ones == 6 and [r.word >> n for r in new.collect()] == [0]
    assert listed(BitVec(df, n).slice(2, 5).set_many(u.withColumn("pos", F.col("pos") + 6), strict=False).bits()) == [True, False, True]
    changed = BitVec(df, n).slice(2, 5).set_many(spark.createDataFrame([("", 6, 0, False)], u.schema), strict=False)
    assert listed(BitVec(changed.parent, n).bits()) == [i % 2 == 0 for i in range(n)]
    got = bitvec.get_many(w, h, f.withColumnRenamed("pos", "idx"), strict=False).collect()
    assert {r.idx: r.bit for r in got} == {40: None, -1: None, 3: False}
    for a, b in ((5, 2), (-3, 2)):
        with pytest.raises(ValueError):
            BitVec(df, n).slice_unchecked(a, b)


def test_cursor(spark):
    v = BitVec(make(spark, [i % 3 == 0 for i in range(50)], ""), 50).slice(10, 40)
    c, got = v.cursor(), []
    for k in (7, 0, 20, 100):
        rows, c = c.take(k)
        got += [r.bit for r in rows.collect()]
        assert len(c) == 30 - len(got)
    assert got == [i % 3 == 0 for i in range(10, 40)]


@pytest.mark.parametrize("n,step", [(1, 1), (4095, 3), (4096, 1), (8192, 2), (50_000, 1), (50_000, 700), (60_001, 7)])
def test_indexed_rank_and_select(spark, tmp_path, n, step):
    df = make(spark, [i % step == 0 or 9000 < i < 20_000 for i in range(n)], "")
    built = index.Index.build(df)
    built = built.to(f"file://{tmp_path}/i") if step == 7 else built
    ones = [i for i in range(n) if i % step == 0 or 9000 < i < 20_000]
    idx = sorted({0, 1, n, n - 1, *range(0, n, 509), *(x for x in (512, 4096, 8192) if x <= n)})
    q = spark.createDataFrame([("", i) for i in [*idx, n + 1, -1, 0]], "vec_id string, idx bigint")
    got = {r.idx: r.rank1 for r in rankselect.rank_indexed(built, q, strict=False).collect()}
    assert got == {i: sum(x < i for x in ones) for i in idx} | {n + 1: None, -1: None}
    r = sorted({0, len(ones) - 1, *range(0, len(ones), 401), *(x for x in (8191, 8192, 8193) if x < len(ones))})
    q = spark.createDataFrame([("", i) for i in [*r, len(ones), -1]], "vec_id string, r bigint")
    assert {x.r: x.pos for x in rankselect.select_indexed(built, q).collect()} == {i: ones[i] for i in r} | {len(ones): None, -1: None}
    with pytest.raises(Exception, match="beyond"):
        rankselect.rank_indexed(built, q.selectExpr("vec_id", "r + 100000 as idx")).collect()
    if step == 7:
        assert "Window" not in rankselect.rank_indexed(built, q.selectExpr("vec_id", "r as idx"), strict=False)._jdf.queryExecution().optimizedPlan().toString()
