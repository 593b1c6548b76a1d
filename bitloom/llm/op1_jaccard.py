"""N-gram Jaccard self-join.

A document's set has its distinct word 5-grams as 64-bit hashes. Documents of equal sets form classes; classes x, y link
if |x & y| / |x | y| reaches the threshold (exact integers: 100 * common >= 75 * union). The result is each document's component.

1. Tiles. In one order of all shingles (frequent ones last, else by hash), linked sets share an element of their prefixes:
   the first |y| - ceil(t |y|) + 1 of the larger, |x| - ceil(2t / (1 + t) |x|) + 1 of the smaller. Classes meet by shingle. A shingle's
   classes are cut into bands by size (within a band by hash), and only tiles of bands whose sizes are compatible are made. A tile
   has some TILE rows on each side and is the unit that is dealt to tasks, so that a shingle of any number of classes is spread.
2. Signatures. Each class has a hashed parity bitmap of a width that its size gives. Bits that differ bound the
   symmetric difference from below, so the overlap from above; pairs below the needed overlap go. Tiles carry the bitmaps folded to about two
   bits an element, which keeps the bound; what is left is bounded again by the full ones.
3. Exact. The sorted arrays of the remaining pairs are intersected.

Groups of thousands of near copies would meet in every tile they share, so components are first grown by rounds of
stars (until few pairs are open): for each shingle a class drawn by hash is paired with the others (a few leaders for each
class), what is verified links, and later rounds leave out shingles and pairs inside a component. The last round yields every remaining pair of
different components, tile by tile. That loses nothing: a pair inside a component cannot change the result.
Which shingles count as frequent is estimated in each task; it affects cost, never results.

Nothing of all documents is collected or broadcast: the frequent shingles are at most MAX_FREQUENT, the filters of needed ids
have a bounded size. Tables between steps are deleted once read.

Edge cases: null or blank text has the empty set and links with nothing (component: the document itself); a document with fewer than five
words has one shingle; texts of any length are taken whole, and a set of any size (a task holds one text at a time beyond PIECE bytes); rows
with a null id get a row and take part with equal sets only; repeated rows are equal sets; rows of one id with different texts are one
document, which links by each of them; other columns than the id's and the text's are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import arrow_schema, ddl, drop, id_filter, load, pieces, small, written
from bitloom.llm.graph import connected_components, grown

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Leaders that a class tries in the first star round and in later ones. The tiles have no such bound.
FIRST_TRIES, LATER_TRIES = 3, 8
MAX_FREQUENT, LOCAL_COUNT, FREQUENT_DOCS = 200_000, 6, 24
#: Rows of a tile's side, and those of it that are compared at a time.
TILE, BAND = 2048, 256
#: Prefix shingles before a tile's own that its rows carry.
BEFORE = 2
PIECE = 1_000_000

_U = np.uint64
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS.update(n=n, up=np.cumprod(np.r_[_U(1), np.full(n, _BASE)]), down=np.cumprod(np.r_[_U(1), np.full(n, _U(inverse))]))
    return _POWERS["up"], _POWERS["down"]


def shingle_sets(texts: list, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    text_ends = np.cumsum(sizes + 1)
    blank = _BLANK[raw]
    change = np.flatnonzero(np.diff(np.r_[True, blank].view(np.int8)))
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[_U(0), np.cumsum(_BYTE[_LOWER[raw]] * up[: len(raw)])]
        word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        first = np.searchsorted(starts, np.r_[0, text_ends[:-1]])
        count = np.diff(np.r_[first, len(starts)])
        n = max(0, len(word) - words + 1)
        grams = np.zeros(n, np.uint64)
        for j in range(words):
            grams += word[j : j + n] * _PLACE[j]
        grams = _mix(grams)
        out = []
        for a, c in zip(first.tolist(), count.tolist()):
            if c >= words:
                g = np.sort(grams[a : a + c - words + 1])
                out.append(g[np.r_[True, g[1:] != g[:-1]]])
            elif c:
                out.append(_mix(np.array([(word[a : a + c] * _PLACE[8 : 8 + c]).sum() + _PLACE[16 + c]], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def needed_overlap(a: int, b: int) -> int:
    """Least common elements of linked sets of sizes a and b."""
    return -(-NUMERATOR * (a + b) // (DENOMINATOR + NUMERATOR))


def prefixes(n: int) -> tuple[int, int]:
    """Prefix lengths of a set of size n as the smaller and as the larger of a pair."""
    return n - needed_overlap(n, n) + 1, n - -(-NUMERATOR * n // DENOMINATOR) + 1


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the elements by hash; at least two bits for an element, a power of two, up to 64 Kbit."""
    width = min(1 << 16, max(64, 1 << (2 * len(s) - 1).bit_length()))
    bits = np.bincount((s & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, n: int) -> bytes:
    """A bitmap of n elements folded to about two bits an element (from 1.5 to 3), 64 bits at least."""
    width = max(64, 1 << math.ceil(math.log2(max(1, 1.5 * n)))) // 8
    if len(bits) <= width:
        return bits
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Positions in which two parity bitmaps differ, folded to the narrower: at most the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) if len(y) > len(x) else y
    return int(np.bitwise_count(x ^ y).sum())


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles in many documents, as far as tasks see them often: at most MAX_FREQUENT."""
    out = arrow_schema(key="long", n="long")

    def apply(batches):
        held, size = [], 0

        def counted():
            s = np.sort(np.concatenate(held))
            edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
            n = np.diff(edge)
            often = n >= LOCAL_COUNT
            return pa.RecordBatch.from_arrays([pa.array(s[edge[:-1][often]].view(np.int64)), pa.array(n[often].astype(np.int64))], schema=out)

        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                seen = set()  # equal sets of a piece count once
                for s in shingle_sets(batch.column("text").to_pylist(), words):
                    mark = (len(s), int(s[0]), int(s[-1])) if len(s) else None
                    if mark and mark not in seen:
                        seen.add(mark)
                        held.append(s)
                        size += len(s)
                if size > 2_000_000:
                    yield counted()
                    held.clear()
                    size = 0
        if held:
            yield counted()

    found = docs.select("text").mapInArrow(apply, ddl(out)).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_DOCS)
    return np.sort(found.orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).select("key").toArrow().column("key").to_numpy().view(np.uint64))


_SETS = arrow_schema(id="long", n="long", s1="long", s2="long", keys="longs", short="int", bits="binary")


def _describe(docs: DataFrame, frequent: np.ndarray, words: int) -> DataFrame:
    """A row per document: set size, digest, prefix keys (the first `short` of them as a smaller set) and bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def row(s: np.ndarray):
        if not len(s):
            return 0, None, None, None, 0, None
        d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
        often = shared.value
        late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s if len(often) else np.zeros(len(s), bool)
        short, long_ = prefixes(len(s))
        keys = np.concatenate([s[~late][:long_], s[late][:long_]])[:long_]
        return len(s), int(d[0]), int(d[1]), keys.view(np.int64), short, bitmap(s)

    def apply(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                rows = [row(s) for s in shingle_sets(batch.column("text").to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(_SETS)[1:]))], schema=_SETS)

    return docs.mapInArrow(apply, ddl(_SETS))


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, elements) of the documents whose id is among the table ids (id, no repeats)."""
    out = arrow_schema(id="long", elements="binary")
    rows = docs.where("id is not null").select("id", "text")
    if small(ids):
        rows = rows.join(F.broadcast(ids), "id", "left_semi")
    else:
        rows = rows.where(id_filter(ids, "id")(F.col("id"))).join(ids, "id", "left_semi")

    def apply(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                sets = shingle_sets(batch.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], schema=out)

    return rows.mapInArrow(apply, ddl(out))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (u, v) of class ids that link: sizes, then bitmaps, then exact intersections."""
    sides = [classes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "uv"]
    both = pairs.join(sides[0], "u").join(sides[1], "v").where("4 * least(n_u, n_v) >= 3 * greatest(n_u, n_v)" if (NUMERATOR, DENOMINATOR) == (75, 100) else f"{DENOMINATOR} * least(n_u, n_v) >= {NUMERATOR} * greatest(n_u, n_v)")
    out = "u bigint, v bigint, n_u bigint, n_v bigint"

    def bounded(batches):
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            n_u, n_v = c["n_u"].to_pylist(), c["n_v"].to_pylist()
            keep = [a + b - differing_bits(x, y) >= 2 * needed_overlap(a, b) for a, b, x, y in zip(n_u, n_v, c["bits_u"].to_pylist(), c["bits_v"].to_pylist())]
            yield pa.RecordBatch.from_arrays([c[n] for n in ("u", "v", "n_u", "n_v")], names=["u", "v", "n_u", "n_v"]).filter(pa.array(keep, pa.bool_()))

    likely = written(both.mapInArrow(bounded, out))
    ids = written(likely.select(F.col("u").alias("id")).unionAll(likely.select(F.col("v").alias("id"))).distinct())
    sets = written(_sets_of(docs, ids, words))
    drop(ids)
    joined = likely.join(sets.select(F.col("id").alias("u"), F.col("elements").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("elements").alias("y")), "v")

    def exact(batches):
        for whole in batches:
            for batch in pieces(whole, "x", 4_000_000):
                c = {n: batch.column(n) for n in batch.schema.names}
                keep = []
                for a, b in zip(c["x"], c["y"]):
                    a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                    both_ = np.sort(np.concatenate([a, b]), kind="stable")
                    common = int((both_[1:] == both_[:-1]).sum())
                    keep.append(DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common))
                yield pa.RecordBatch.from_arrays([c["u"], c["v"]], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    found = written(joined.mapInArrow(exact, "u bigint, v bigint").distinct())
    drop(likely, sets)
    return found


def _folded(arrays: list, width: int) -> np.ndarray:
    """Bitmaps (arrays of words, powers of two long) as rows of the given width, which is that of the narrowest."""
    return np.stack([np.bitwise_xor.reduce(a.reshape(-1, width), axis=0) for a in arrays])


def _bounded(x: list, y: list, n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bitmaps leave pairs (x[i], y[j]) of set sizes n[i], m[j] the overlap they need."""
    keep = np.ones(len(i), bool)
    wide_x, wide_y = np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y))
    narrow = np.minimum(wide_x[i], wide_y[j])
    most = n[i] + m[j]
    most -= 2 * -(-NUMERATOR * most // (DENOMINATOR + NUMERATOR))  # of the symmetric difference
    for width in np.unique(narrow).tolist():
        at = np.flatnonzero(narrow == width)
        rows, a = np.unique(i[at], return_inverse=True)
        cols, b = np.unique(j[at], return_inverse=True)
        left, right = _folded([x[k] for k in rows], width), _folded([y[k] for k in cols], width)
        step = max(1, (1 << 20) // width)
        for k in range(0, len(at), step):
            differ = np.bitwise_count(left[a[k : k + step]] ^ right[b[k : k + step]]).sum(axis=1, dtype=np.int64)
            keep[at[k : k + step]] = differ <= most[at[k : k + step]]
    return keep


def tile_pairs(rep: np.ndarray, label: np.ndarray, size: np.ndarray, short: np.ndarray, bits=None, key: int = 0, before=None, side=None, band: int = BAND):
    """(u, v) arrays of the pairs of one tile that have different labels, sizes within the threshold and bitmaps that allow a link, band by band.

    side: 0 or 1 for each member; pairs are of both sides (None, or all 0: of all members). bits: each member's bitmap (None: sizes alone decide).
    before: a row for each member, the prefix shingles that come before this one (key where there is none). Pairs that have one of
    them in common have met there already; the first meeting is never left out.
    """
    order = np.argsort(size, kind="stable")
    rep, label, size, short = rep[order], label[order], size[order], short[order]
    words = None if bits is None else [np.frombuffer(bits[k], np.uint64) for k in order]
    earlier = None if before is None else before[order]
    across = None if side is None or not side.any() else side[order]
    n = len(rep)
    for a in range(0, n, band):
        x = slice(a, min(a + band, n))
        for b in range(a, n, band):
            if NUMERATOR * size[b] > DENOMINATOR * size[x][-1]:
                break
            y = slice(b, min(b + band, n))
            ok = (label[x][:, None] != label[y]) & (DENOMINATOR * size[x][:, None] >= NUMERATOR * size[y])
            # the smaller one has the shingle in its short prefix; of equal sizes either may be the smaller
            ok &= short[x][:, None] | ((size[x][:, None] == size[y]) & short[y])
            if across is not None:
                ok &= across[x][:, None] != across[y]
            if a == b:
                ok &= np.arange(x.stop - a)[:, None] < np.arange(y.stop - b)
            i, j = np.nonzero(ok)
            if len(i) and earlier is not None:
                met = np.zeros(len(i), bool)
                for p in range(earlier.shape[1]):
                    at = earlier[x, p][i]
                    met |= (at != key) & (at[:, None] == earlier[y][j]).any(axis=1)
                i, j = i[~met], j[~met]
            if len(i) and words is not None:
                keep = _bounded(words[x], words[y], size[x], size[y], i, j)
                i, j = i[keep], j[keep]
            if len(i):
                u, v = rep[x][i], rep[y][j]
                yield np.minimum(u, v), np.maximum(u, v)


def _groups(batches, names, by: int = 1):
    """Arrays of the columns, cut so that no group of the first `by` of them (by which they are sorted) is split."""
    left = None
    for batch in batches:
        c = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if left is not None:
            c = [np.concatenate(x) for x in zip(left, c)]
        if not len(c[0]):
            continue
        cut = int(_edges_of(*c[:by])[-2])  # the last group may go on in the next batch
        if cut:
            yield [x[:cut] for x in c]
        left = [x[cut:] for x in c]
    if left is not None and len(left[0]):
        yield left


def _edges_of(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]) - 1, bool)
    for key in keys:
        new |= key[1:] != key[:-1]
    return np.flatnonzero(np.r_[True, new, True])


def _members(reps: DataFrame) -> DataFrame:
    """(key, id, size, b0, ...) of the prefix shingles that several classes have.

    size is doubled, and odd within the short prefix; b0, b1 ... are the shingles before the key (the key itself where there is none).
    Shingles are counted with map-side sums, so that rows of those that one class has are not shuffled whole.
    """
    counted = reps.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    counted = written(counted)
    maybe = id_filter(counted, "key")
    rows = reps.select("id", "n", "short", "keys", F.posexplode("keys").alias("at", "key")).where(maybe(F.col("key")))
    before = [F.when(F.col("at") > k, F.get("keys", F.col("at") - (k + 1))).otherwise(F.col("key")).alias(f"b{k}") for k in range(BEFORE)]
    rows = rows.select("key", "id", (F.col("n") * 2 + (F.col("at") < F.col("short")).cast("int")).alias("size"), *before)
    members = written(rows.join(counted, "key"))
    drop(counted)
    return members


def _stars(star: DataFrame, tries: int) -> DataFrame:
    """Candidate pairs (u, v): a shingle's drawn class with each of another label and fitting size; so many leaders for each class."""
    n, m = F.floor(F.col("size") / 2), F.floor(F.col("lead_size") / 2)
    fits = (F.col("label") != F.col("lead_label")) & (DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m))
    few = star.where(fits).groupBy("id").agg(*[F.min_by("lead", F.xxhash64("lead", "id", F.lit(k))).alias(f"u{k}") for k in range(tries)])
    pairs = few.select(F.explode(F.array(*[f"u{k}" for k in range(tries)])).alias("u"), F.col("id").alias("v"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _dealt(rows: DataFrame, tile: int) -> DataFrame:
    """rows (key, id, label, size, ...) of shingles with several labels, once for each tile they are in, with `tile` and `side`.

    A shingle of at most `tile` rows is one tile. Else its rows are cut by size class (linked sizes are in the same or the next one) and, within
    a class, by hash into bands of about `tile` rows; each two bands that can hold linked sizes are a tile.
    """
    base = 1.005 * DENOMINATOR / NUMERATOR
    rows = rows.withColumn("cls", F.floor(F.log(F.floor(F.col("size") / 2).cast("double")) / F.lit(math.log(base))).cast("int"))
    by = rows.groupBy("key", "cls").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    by = by.groupBy("key").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.map_from_entries(F.collect_list(F.struct("cls", F.ceil(F.col("n") / tile).cast("int")))).alias("bands"))
    by = by.where("a < b").select("key", "n", F.when(F.col("n") > tile, F.col("bands")).alias("bands"))
    # A tile's number: class and band of side 0, whether side 1 is of the next class, band of side 1.
    places = f"""if(bands is null, array(named_struct('tile', 0L, 'side', 0)), concat(
      transform(filter(sequence(0, own - 1), x -> x >= band), x -> named_struct('tile', number(cls, band, 0, x), 'side', 0)),
      transform(filter(sequence(0, own - 1), x -> x < band), x -> named_struct('tile', number(cls, x, 0, band), 'side', 1)),
      if(above > 0, transform(sequence(0, above - 1), x -> named_struct('tile', number(cls, band, 1, x), 'side', 0)), array()),
      if(under > 0, transform(sequence(0, under - 1), x -> named_struct('tile', number(cls - 1, x, 1, band), 'side', 1)), array())))"""
    places = re.sub(r"number\(([^,]+), ([^,]+), ([^,]+), ([^)]+)\)", r"((((\1) * 1048576L + \2) * 2 + \3) * 1048576L + \4 + 1)", places)
    bands = lambda c: F.coalesce(F.element_at("bands", c), F.lit(0))
    out = rows.join(by.drop("n"), "key")
    out = out.withColumns({"own": bands(F.col("cls")), "above": bands(F.col("cls") + 1), "under": bands(F.col("cls") - 1)})
    out = out.withColumn("band", F.when(F.col("own") > 0, F.pmod(F.xxhash64("id", F.lit(5)), F.col("own")).cast("int")).otherwise(0))
    return out.select(*[c for c in rows.columns if c != "cls"], F.explode(F.expr(places)).alias("p")).select("*", "p.tile", "p.side").drop("p")


def _tiles(members: DataFrame, classes: DataFrame, tile: int = TILE) -> DataFrame:
    """Candidate pairs (u, v): all of different labels that share a shingle and have fitting sizes and (folded) bitmaps."""
    out = arrow_schema(u="long", v="long")
    earlier = [f"b{k}" for k in range(BEFORE)]
    dealt = written(_dealt(members.select("key", "id", "label", "size", *earlier), tile))

    def narrow(batches):
        for batch in batches:
            bits = [folded(x, n) for x, n in zip(batch.column("bits").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bits, pa.binary())], names=["id", "bits"])

    def packed(us, vs):
        p = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], schema=out)

    def apply(batches):
        for key, tile_, id_, label, size, side, bits, *before in _groups(batches, ("key", "tile", "id", "label", "size", "side", "bits", *earlier), 2):
            before = np.stack(before, 1)
            edge = _edges_of(key, tile_)
            mixed = np.flatnonzero(np.minimum.reduceat(label, edge[:-1]) < np.maximum.reduceat(label, edge[:-1]))
            us, vs, held = [], [], 0
            for k in mixed:
                part = slice(edge[k], edge[k + 1])
                for u, v in tile_pairs(id_[part], label[part], size[part] >> 1, (size[part] & 1) == 1, bits[part], int(key[edge[k]]), before[part], side[part]):
                    us.append(u)
                    vs.append(v)
                    held += len(u)
                    if held > 200_000:
                        yield packed(us, vs)
                        us, vs, held = [], [], 0
            if us:
                yield packed(us, vs)

    asked = id_filter(dealt.select("id").distinct(), "id")
    mine = classes.where(asked(F.col("id"))).select("id", "n", "bits").mapInArrow(narrow, "id bigint, bits binary")
    rows = dealt.join(mine, "id").select("key", "tile", "id", "label", "size", "side", "bits", *earlier)
    pairs = written(rows.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(apply, ddl(out)).distinct())
    drop(dealt)
    return pairs


def components(docs: DataFrame, text: str = "text", id_: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(id_, n_shingles, component_id) of each row of docs."""
    rows = docs.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text"))
    described = written(_describe(rows, _frequent(rows, words), words))
    light = written(described.select("id", "n", "s1", "s2"))
    sets = written(light.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies")).where("id is not null"))
    # Only rows whose set may be repeated are shuffled to find the one that stands for their class.
    again = written(sets.where("copies > 1").select("id", "s1", "s2"))
    repeated = id_filter(again, "s1")(F.col("s1"))
    whole = described.where("id is not null and n > 0")
    reps = whole.where(~repeated).unionByName(whole.where(repeated).join(sets.select("id", "s1", "s2"), ["id", "s1", "s2"], "left_semi").select(described.columns))
    reps = written(reps.select("id", "n", "keys", "short", "bits"))
    drop(described, again)
    members = _members(reps)
    classes = written(reps.select("id", "n", "bits"))
    drop(reps)

    # An id with several texts is one document.
    several = light.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("a"), F.max(F.struct("s1", "s2")).alias("b")).where("a <> b").select(F.col("id").alias("v"))
    several = light.where("n > 0").join(several, F.col("id") == F.col("v"), "left_semi").select(F.col("id").alias("v"), "s1", "s2").join(sets.select("s1", "s2", "id"), ["s1", "s2"])
    links = [written(several.select(F.col("id").alias("u"), "v").where("u <> v").distinct())]

    def linked(rows_: DataFrame, turn: int) -> DataFrame:
        pairs = written(_stars(rows_, LATER_TRIES if turn else FIRST_TRIES))
        new = _verified(pairs, classes, rows, words)
        drop(pairs)
        return new

    left, _ = grown(members, ("size",), links, linked)
    pairs = _tiles(left, classes)
    drop(left)
    links.append(_verified(pairs, classes, rows, words))
    drop(pairs, classes)
    found = links[0]
    for more in links[1:]:
        found = found.unionAll(more)
    final = connected_components(found)

    named = sets.join(final, "id", "left").where("copies > 1 or label is not null").select("s1", "s2", F.coalesce("label", "id").alias("component"))
    out = light.join(named, ["s1", "s2"], "left")
    return out.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(load(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""
