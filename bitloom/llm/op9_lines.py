"""Fuzzy line dedup, in DataFrame functions only.

A line is normalised to its lower-case words (runs of letters; digits and marks are gaps). Lines of equal words form classes; classes
link if their 64-bit SimHashes (over words) agree in two of HAMMING + 2 blocks and differ in at most CLOSE bits, and the edit similarity of
their normalised texts, 1 - Levenshtein / longer length, is at least SIMILARITY. Two blocks always agree within HAMMING bits; beyond them
it depends on where the bits lie (README has the share found; CLOSE is above HAMMING so that pairs that meet are not lost). With `minima`, an option that finds nearly all pairs of that edit similarity
at several times the cost, classes are compared instead if LEAST_EQUAL of MINIMA minima of hashes over their word shingles are equal,
two of one pair among them (LSH). Of each connected group the first occurrence stays (least
document id, then line number), all other lines of it go. A line without words always stays.

Candidates: classes meet by pairs of blocks (pigeonhole) within a length class, or by pairs of minima. Members of a large meeting place (over PAIRED) are first paired with one of them,
drawn by hash (a star, in rounds until few pairs are open); components of what is verified follow, and then only pairs of different components meet, so a group of thousands of variants
yields no square of pairs and no link between components is lost. Members of a small place are all paired, by their hashes and lengths alone. Of the pairs that fit, those between different
components are verified, the likely ones first (graph.chosen), so that few are within what is linked already. Classes that fit but never link are all compared. SimHash bits are summed four to a long, 16 bits each.

Common lines are counted with map-side sums before anything is joined; joins with a side of unique keys are left to the skew join.

Edge cases: null text stays null and has no lines; empty lines stay; lines of any length are taken whole (those of over 32,000 words
are summed bit by bit; the edit distance of two of n characters takes n * n / 10 steps at most, and only where their ends and words do not decide);
a row with a null document id is passed through untouched; repeated rows of one id stay or lose lines alike; rows of one id with
different texts lose a line number if any of them does; other columns are kept, whatever their names; an
empty table gives an empty result. A document whose every line with words went has only what is left (often an empty text).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import drop, id_filter, load, written
from bitloom.llm.graph import chosen, connected_components, grown

HAMMING, CLOSE, SIMILARITY_PERCENT, MIN_WORDS = 2, 4, 90, 1
#: Pairs whose edit distances one task takes.
TASK_PAIRS = 4_000
#: Members of a key at most that are all paired at once; those of larger ones are first led by stars.
PAIRED = 64
#: Minima of shingle hashes, for candidates of edit similarity alone, and how many of a pair's are equal at least; words of a shingle, and of
#: one of a line of fewer than SHORT words.
MINIMA, LEAST_EQUAL, SHINGLE, SHORT_SHINGLE, SHORT = 12, 4, 3, 2, 12
#: Gaps between words of a lower-case line, as character ranges (the line feed is none); of these, those that are not one space already.
GAP, NOT_SPACE = r"[\x00-\x09\x0B-\x60\x7B-\x7F]", r"[\x00-\x09\x0B-\x1F\x21-\x60\x7B-\x7F]"
GAPS = f"{NOT_SPACE}{GAP}*| {GAP}+"
#: Fixed values of the packed sums: four bits of a hash are spread to four lanes of 16 bits.
SPREAD, LANES, PACKED_WORDS = (1 << 45) + (1 << 30) + (1 << 15) + 1, (1 << 48) + (1 << 32) + (1 << 16) + 1, 32_000


def lines_of(docs: DataFrame, text: str, id_: str, min_words: int) -> DataFrame:
    """(doc, line, h1, h2, size, words) of each line that counts; h1, h2 hash its normalised words, size is their length.

    The whole text is normalised below the generator, so that the filter above it does not repeat that.
    """
    normal = F.regexp_replace(F.lower(text), GAPS, " ")
    rows = docs.where(F.col(id_).isNotNull()).select(F.col(id_).cast("bigint").alias("doc"), F.posexplode_outer(F.split(normal, "\n")).alias("line", "raw"))
    rows = rows.where(F.col("line").isNotNull()).select("doc", "line", F.trim("raw").alias("words"))
    rows = rows.where(F.substring_index("words", " ", min_words - 1) != F.col("words")) if min_words > 1 else rows.where("words <> ''")
    return rows.select("doc", "line", F.xxhash64("words").alias("h1"), F.xxhash64("words", F.lit(1)).alias("h2"), F.length("words").alias("size"), "words")


def _shift(x, n):
    return F.call_function("shiftrightunsigned", x, F.lit(n))


def simhashes(classes: DataFrame, long_lines: bool = True) -> DataFrame:
    """(h1, h2, simhash, size) of classes (h1, h2, words): a bit is set if more than half of the words' hashes have it.

    long_lines: whether any class may have more than PACKED_WORDS words.
    """
    if not long_lines:
        return _packed_simhashes(classes.select("h1", "h2", F.length("words").alias("size"), "words"))
    words = classes.select("h1", "h2", F.length("words").alias("size"), (F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1).alias("n"), "words")
    short = _packed_simhashes(words.where(F.col("n") <= PACKED_WORDS))
    bits = words.where(F.col("n") > PACKED_WORDS).select("h1", "h2", "size", "n", F.explode_outer(F.split("words", " ")).alias("word"))
    bits = bits.select("h1", "h2", "size", "n", F.xxhash64("word").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    bits = bits.groupBy("h1", "h2", "size", "n", "bit").agg(F.sum(F.expr("shiftrightunsigned(x, bit) & 1")).alias("s"))
    long_ = bits.groupBy("h1", "h2", "size").agg(F.bit_or(F.when(F.col("s") * 2 > F.col("n"), F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("bigint"))).alias("simhash"))
    return short.unionByName(long_)


def _packed_simhashes(words: DataFrame) -> DataFrame:
    each = words.select("h1", "h2", "size", F.explode_outer(F.split("words", " ")).alias("word")).select("h1", "h2", "size", F.xxhash64("word").alias("x"))
    lanes = [F.sum((_shift(F.col("x"), 4 * i).bitwiseAND(15) * SPREAD).bitwiseAND(LANES)).alias(f"s{i}") for i in range(16)]
    sums = each.groupBy("h1", "h2", "size").agg(F.count("*").alias("n"), *lanes)
    bias = (F.lit(16384) - (F.floor(F.col("n") / 2) + 1)) * LANES
    marked = sums.select("h1", "h2", "size", *[_shift(F.col(f"s{i}") + bias, 14).bitwiseAND(LANES).alias(f"b{i}") for i in range(16)])
    four = lambda b: b.bitwiseOR(_shift(b, 15)).bitwiseOR(_shift(b, 30)).bitwiseOR(_shift(b, 45)).bitwiseAND(15)
    packed = four(F.col("b0"))
    for i in range(1, 16):
        packed = packed.bitwiseOR(F.call_function("shiftleft", four(F.col(f"b{i}")), F.lit(4 * i)))
    return marked.select("h1", "h2", packed.alias("simhash"), "size")


def sketches(classes: DataFrame, minima: int = MINIMA) -> DataFrame:
    """(h1, h2, simhash, size, keys, a, b) of classes (h1, h2, words): a key for each two minima of the shingles' hashes; simhash is 0.

    a, b: ten bits of each minimum, six to a number, by which equal minima are counted.
    """
    n = F.size("x")
    each = classes.select("h1", "h2", F.length("words").alias("size"), F.split("words", " ").alias("x"))
    last = F.greatest(n - F.when(n < SHORT, SHORT_SHINGLE).otherwise(SHINGLE), F.lit(0))
    each = each.select("h1", "h2", "size", "x", F.explode_outer(F.sequence(F.lit(0), last)).alias("i"))
    word = [F.get("x", F.col("i") + k) for k in range(SHINGLE)]
    each = each.select("h1", "h2", "size", F.when(n < SHORT, F.xxhash64(*word[:SHORT_SHINGLE])).otherwise(F.xxhash64(*word)).alias("x"))
    least = each.groupBy("h1", "h2", "size").agg(*[F.min(F.xxhash64("x", F.lit(k))).alias(f"m{k}") for k in range(minima)])
    keys = F.array(*[F.xxhash64(F.lit(k), F.col(f"m{2 * k}"), F.col(f"m{2 * k + 1}")) for k in range(minima // 2)])
    lanes = [F.lit(0).cast("bigint")] * 2
    for k in range(minima):
        lanes[k % 2] = lanes[k % 2].bitwiseOR(F.call_function("shiftleft", F.pmod(F.xxhash64(f"m{k}"), F.lit(1024)), F.lit(10 * (k // 2 % 6))))
    return least.select("h1", "h2", F.lit(0).cast("bigint").alias("simhash"), "size", keys.alias("keys"), lanes[0].alias("a"), lanes[1].alias("b"))


def equal_lanes(x, y):
    """How many of six numbers of ten bits are equal in x and y."""
    low, top = sum(511 << 10 * k for k in range(6)), sum(512 << 10 * k for k in range(6))
    z = x.bitwiseXOR(y)
    return 6 - F.bit_count((z.bitwiseAND(low) + low).bitwiseOR(z).bitwiseAND(top))


def block_keys(simhash, size, hamming: int, percent: int):
    """An array with a key for each pair of the hash's hamming + 2 blocks in the line's length class (powers of two).

    A line that may be alike to ones of the next class has the keys of that class too.
    """
    n = hamming + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [_shift(simhash, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
    own = F.floor(F.log2(size)).cast("int")
    keys = lambda c: F.array(*[F.xxhash64(F.lit(k), block[i], block[j], c) for k, (i, j) in enumerate(combinations(range(n), 2))])
    next_ = F.call_function("shiftleft", F.lit(1).cast("bigint"), own + 1)
    return F.when(size * 100 >= next_ * percent, F.concat(keys(own), keys(own + 1))).otherwise(keys(own))


#: (a, b) without their common beginning and end, down to 1/256 of the length; the edit distance stays.
_TRIMMED = (
    "aggregate(sequence(1, 8), struct(a, b), (s, k) -> if(left(s.a, shiftright(m, k)) = left(s.b, shiftright(m, k)), struct(substring(s.a, shiftright(m, k) + 1) as a, substring(s.b, shiftright(m, k) + 1) as b), s))",
    "aggregate(sequence(1, 8), ab, (s, k) -> if(right(s.a, shiftright(m, k)) = right(s.b, shiftright(m, k)), struct(left(s.a, length(s.a) - shiftright(m, k)) as a, left(s.b, length(s.b) - shiftright(m, k)) as b), s))",
)


#: Characters that are counted in each text, the rest as one more; counts up to MOST_COUNTED go into four lanes of 16 bits of a number.
COUNTED, MOST_COUNTED = "etanirsohd ", (1 << 15) - 1


def counted(words):
    """Columns c0, c1, ...: how often the characters COUNTED and any others stand in a text, packed."""
    n = F.length(words)
    counts = [n - F.length(F.replace(words, F.lit(c))) for c in COUNTED]
    rest = n
    for c in counts:
        rest = rest - c
    lanes = [F.least(c, F.lit(MOST_COUNTED)).cast("bigint") for c in [*counts, rest]]
    packed = []
    for at in range(0, len(lanes), 4):
        one = lanes[at]
        for k, lane in enumerate(lanes[at + 1 : at + 4], 1):
            one = one.bitwiseOR(F.call_function("shiftleft", lane, F.lit(16 * k)))
        packed.append(one.alias(f"c{at // 4}"))
    return packed


def least_edits(x: list, y: list):
    """A bound from below for the edit distance of two texts by their counted() columns: characters that one has more often than the other."""
    lanes = [_shift(a, 16 * k).bitwiseAND(MOST_COUNTED) - _shift(b, 16 * k).bitwiseAND(MOST_COUNTED) for a, b in zip(x, y) for k in range(4)]
    more, fewer = F.lit(0), F.lit(0)
    for d in lanes:
        more, fewer = more + F.greatest(d, F.lit(0)), fewer + F.greatest(-d, F.lit(0))
    return F.greatest(more, fewer)


def _alike(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) of class ids whose words (texts: id, words, counted()) are alike."""
    near = written(pairs)
    ids = written(near.select(F.col("u").alias("id")).unionAll(near.select(F.col("v").alias("id"))).distinct())
    texts = texts.where(id_filter(ids, "id")(F.col("id")))
    counts = [c for c in texts.columns if c not in ("id", "words")]
    end = lambda id_, words, mark: texts.select(F.col("id").alias(id_), F.col("words").alias(words), *[F.col(c).alias(mark + c) for c in counts])
    both = near.join(end("u", "a", "a_"), "u").join(end("v", "b", "b_"), "v")
    most = F.expr(f"cast(greatest(length(a), length(b)) * {100 - percent} div 100 as int)")
    # Counts of characters tell about half of the pairs that are not alike before anything is done with their texts.
    both = both.where(least_edits([F.col(f"a_{c}") for c in counts], [F.col(f"b_{c}") for c in counts]) <= most)
    both = both.select("u", "v", "a", "b", most.alias("most"), F.expr("split(a, ' ')").alias("x"), F.expr("split(b, ' ')").alias("y"))
    # Bounds from above decide most pairs: the words that differ, if both have as many; else the longer rest without common ends.
    words = "aggregate(zip_with(x, y, (p, q) -> if(p = q, 0, greatest(length(p), length(q)))), 0, (s, n) -> s + n)"
    both = both.select("u", "v", "a", "b", "most", F.expr(f"size(x) = size(y) and {words} <= most").alias("sure"))
    both = both.select("u", "v", "most", "sure", F.expr("if(sure, '', a)").alias("a"), F.expr("if(sure, '', b)").alias("b"))
    both = both.select("u", "v", "most", "sure", "a", "b", F.least(F.length("a"), F.length("b")).alias("m")).select("u", "v", "most", "sure", F.expr(_TRIMMED[0]).alias("ab"))
    both = both.select("u", "v", "most", "sure", "ab", F.expr("least(length(ab.a), length(ab.b))").alias("m")).select("u", "v", "most", "sure", F.expr(_TRIMMED[1]).alias("ab"))
    both = both.select("u", "v", "most", "sure", F.expr("ab.a").alias("a"), F.expr("ab.b").alias("b"))
    both = both.select("u", "v", "most", F.expr("sure or greatest(length(a), length(b)) <= most").alias("sure"), "a", "b")
    both = both.select("u", "v", "most", "sure", F.expr("if(sure, '', a)").alias("a"), F.expr("if(sure, '', b)").alias("b"))
    # What is left of the texts is dealt by number of pairs, as the work does not go by bytes.
    both = both.repartition(near.count() // TASK_PAIRS + 1, "u", "v")
    # The distance costs its bound times the length: most links show within a quarter of the bound.
    edits = "case when sure then 0 when levenshtein(a, b, most div 4) >= 0 then 0 else levenshtein(a, b, most) end"
    # Written before it is filtered, so that the filter is not pushed below what it reads.
    found = written(both.select("u", "v", F.expr(edits).alias("edits")))
    drop(near, ids)
    return found.where("edits >= 0").select("u", "v")


def links(lines: DataFrame, classes: DataFrame, hamming: int, percent: int, repeated=None):
    """(u, v): links of class ids, enough of them to give every component; and (id, h1, h2) of the classes that were compared.

    repeated: whether a line may occur more than once (None: any may); the words of others are not shuffled.
    """
    blocks = F.col("keys") if "keys" in classes.columns else block_keys(F.col("simhash"), F.col("size"), hamming, percent)
    marks = ("simhash", "size", "a", "b") if "a" in classes.columns else ("simhash", "size")
    keys = classes.select("h1", "h2", *marks, F.explode_outer(blocks).alias("key"))
    met = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = keys.where(id_filter(met, "key")(F.col("key"))).join(met, "key").select("key", F.col("h1").alias("id"), "h2", *marks, (F.col("n") > PAIRED).alias("large"))
    members = written(members)

    def fits(x, y):
        """Whether two classes, by functions that name their columns, may be alike, and a number that is small if that is likely."""
        least, most = F.least(x("size"), y("size")), F.greatest(x("size"), y("size"))
        bits = F.bit_count(x("simhash").bitwiseXOR(y("simhash")))
        close = bits <= CLOSE
        if "a" in marks:
            equal = equal_lanes(x("a"), y("a")) + equal_lanes(x("b"), y("b"))
            bits, close = MINIMA - equal, equal >= LEAST_EQUAL
        return close & (least * 100 >= most * percent), (bits + F.floor((most - least) * 100 / most)).cast("int")

    def paired(rows: DataFrame, by: str) -> DataFrame:
        """(u, v, apart): the pairs within keys that differ in the column `by` and fit."""
        x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
        fit, apart = fits(x, y)
        pairs = rows.alias("x").join(rows.alias("y"), F.col("x.key") == F.col("y.key")).where((x(by) < y(by)) & fit)
        return pairs.select(F.least(x("id"), y("id")).alias("u"), F.greatest(x("id"), y("id")).alias("v"), apart.alias("apart")).distinct()

    pairs = written(paired(members.where("not large").select("key", "id", *marks), "id"))
    large = members.where("large").select("id", "key", *marks)
    asked = written(pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))).unionAll(large.select("id")).distinct())
    # h1 stands for a class. Where two classes that meet others share it, they are left to exact repeats.
    compared = members.where(id_filter(asked, "id")(F.col("id"))).groupBy("id").agg(F.min("h2").alias("h2"), F.max("h2").alias("most")).join(asked, "id", "left_semi")
    compared = written(compared.select("id", F.col("id").alias("h1"), "h2", (F.col("h2") < F.col("most")).alias("shared")))
    drop(met, asked)
    shared = compared.where("shared").select("id")
    if not shared.isEmpty():
        large = large.join(shared, "id", "left_anti")
        pairs = pairs.join(shared.select(F.col("id").alias("u")), "u", "left_anti").join(shared.select(F.col("id").alias("v")), "v", "left_anti")
    compared = compared.where("not shared").drop("shared")
    # The map side of this sum takes a common line's occurrences together.
    repeated = F.lit(True) if repeated is None else repeated
    wanted = lines.where(id_filter(compared, "h1")(F.col("h1")))
    texts = wanted.where(repeated).groupBy("h1", "h2").agg(F.first("words").alias("words")).join(compared, ["h1", "h2"], "left_semi")
    texts = texts.select(F.col("h1").alias("id"), "words").unionByName(wanted.where(~repeated).select(F.col("h1").alias("id"), "words"))
    texts = written(texts.select("id", "words", *counted(F.col("words"))), 1)

    def linked(rows: DataFrame, turn: int) -> DataFrame:
        fit, _ = fits(F.col, lambda c: F.col(f"lead_{c}"))
        stars = rows.where((F.col("label") != F.col("lead_label")) & fit).groupBy("id").agg(F.min("lead").alias("lead"))
        return _alike(stars.select(F.least("id", "lead").alias("u"), F.greatest("id", "lead").alias("v")).distinct(), texts, percent)

    found: list = []
    large = written(large)
    if large.isEmpty():
        drop(large)
    else:
        left, _ = grown(large, marks, found, linked)
        pairs = written(pairs.unionByName(paired(left.select("key", "id", "label", *marks), "label")).distinct())
        drop(left)
    drop(members)
    more = chosen(pairs, found, lambda some: _alike(some, texts, percent))
    drop(texts)
    return more, compared


def duplicates(docs: DataFrame, text: str = "text", id_: str = "doc_id", hamming: int = HAMMING, percent: int = SIMILARITY_PERCENT, min_words: int = MIN_WORDS, minima: int = 0) -> DataFrame:
    """(doc, line): the lines that go. With minima, candidates are found by so many of them, and hamming is not used."""
    lines = written(lines_of(docs, text, id_, min_words), 1)
    place = (F.col("doc").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("line").cast("decimal(11,0)")).cast("decimal(38,0)")
    first = written(lines.select("h1", "h2", place.alias("place")).groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    # Only words of lines that may be repeated are shuffled to make them distinct.
    repeated = id_filter(first.where("n > 1"), "h1")(F.col("h1"))
    def distinct(rows: DataFrame) -> DataFrame:
        again = rows.where(repeated).groupBy("h1", "h2").agg(F.first("words").alias("words"))
        return rows.where(~repeated).select("h1", "h2", "words").unionByName(again)

    if minima:
        classes = sketches(distinct(lines), minima)
    else:  # the few lines that may have more words than the packed sums can take are told by their length
        long_ = F.col("size") >= 2 * PACKED_WORDS - 1
        classes = simhashes(distinct(lines.where(~long_)), False).unionByName(simhashes(distinct(lines.where(long_))))
    classes = written(classes)
    found, compared = links(lines, classes, hamming, percent, repeated)
    drop(classes)
    groups = written(connected_components(found).join(compared, "id").select("h1", "h2", "label"))
    in_group = id_filter(groups, "h1")
    grouped = written(first.where(in_group(F.col("h1"))).join(groups, ["h1", "h2"]))
    heads = grouped.groupBy("label").agg(F.min("first").alias("head"))
    heads = grouped.join(heads, "label").select("h1", "h2", "head")
    stays = first.where((F.col("n") > 1) | in_group(F.col("h1"))).join(heads, ["h1", "h2"], "left").where("n > 1 or head <> first").select("h1", "h2", F.coalesce("head", "first").alias("head"))
    stays = written(stays)
    again = lines.where(id_filter(stays, "h1")(F.col("h1"))).select("h1", "h2", "doc", "line", place.alias("place"))
    gone = written(again.join(stays, ["h1", "h2"]).where("place <> head").select("doc", "line"))
    drop(lines, first, groups, grouped, stays)
    return gone


def dedup(docs: DataFrame, text: str = "text", id_: str = "doc_id", **options) -> DataFrame:
    """row (all columns of docs, duplicate lines taken out of the text), n_lines and n_removed."""
    gone = duplicates(docs, text, id_, **options)
    which = written(gone.distinct().groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("gone")))
    drop(gone)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_).cast("bigint").alias("doc"))
    some = F.coalesce(id_filter(which, "doc")(F.coalesce("doc", F.lit(0))) & F.col("doc").isNotNull(), F.lit(False))
    lines = F.split(F.col("row")[text], "\n")
    n_lines = F.greatest(F.coalesce(F.size(lines), F.lit(0)), F.lit(0)).cast("bigint").alias("n_lines")
    whole = rows.where(~some).select("row", n_lines, F.lit(0).cast("bigint").alias("n_removed"))
    cut = rows.where(some).join(which.hint("merge"), "doc", "left")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    cut = cut.select(F.when(F.col("gone").isNull(), F.col("row")).otherwise(F.col("row").withField(text, kept)).alias("row"), n_lines, F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_removed"))
    return whole.unionByName(cut)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2("row.text", 256).alias("kept_sha256"))
