"""Connected components of links in a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import cleaned, drop, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in edges (u, v): label is the smallest id that can be reached.

    Rounds of contraction: each vertex goes to the least of itself and its neighbours, edges follow and lose
    loops and repeats, until none is left. Each round is an aggregation with map-side minimum and two
    joins with a side of unique keys, written to the shared folder.
    """
    e = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    moves = []
    while not e.isEmpty():
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        move = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")))
        moves.append(move)
        of_u, of_v = move.select(F.col("id").alias("u"), F.col("label").alias("a")), move.select(F.col("id").alias("v"), F.col("label").alias("b"))
        moved = e.join(of_u, "u").select("a", "v").join(of_v, "v").where("a <> b")
        after = written(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        drop(e)
        e = after
    drop(e)
    if not moves:
        return edges.select(F.col("u").alias("id"), F.col("u").alias("label")).where("false")
    found = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("id").alias("label"), F.col("label").alias("next"))
        found = found.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    out = written(found)
    drop(*moves)
    return out


def led(members: DataFrame, labels, turn: int, sizes) -> DataFrame:
    """members (key, id, ...) of the keys that still have several labels, with their label and, of each key, one member drawn by hash.

    labels: (id, label), or None: each id is its own. lead, lead_label and, for the columns `sizes`, lead_size and so on are the drawn one's.
    Keys are summed up on the map side, and joined as a side of unique keys.
    """
    rows = members.drop("label", "lead", "lead_label", *[f"lead_{c}" for c in sizes])
    rows = rows.withColumn("label", F.col("id")) if labels is None else rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    lead = F.min(F.struct(F.xxhash64("id", "key", F.lit(turn)).alias("h"), "id", "label", *sizes))
    keys = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), lead.alias("x")).where("a < b")
    keys = keys.select("key", F.col("x.id").alias("lead"), F.col("x.label").alias("lead_label"), *[F.col(f"x.{c}").alias(f"lead_{c}") for c in sizes])
    return written(rows.join(keys, "key"))


def open_pairs(rows: DataFrame) -> int:
    """How many pairs of different labels rows (key, label) have within their keys."""
    by = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    by = by.groupBy("key").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("own"))
    with cleaned(rows.sparkSession):
        return int(by.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0] or 0)


#: Star rounds end when no more pairs are open than rows are left, when a round closes less than this share of them, or after so many.
LEAST_CLOSED, MOST_ROUNDS = 0.2, 12


def grown(members: DataFrame, sizes, links: list, verified: Callable[[DataFrame, int], DataFrame]):
    """Components grown by stars: (rows, labels). members (key, id, ...) is dropped on the way.

    In each round a member of each key, drawn by hash, is led() to the others; verified(rows, round) gives the links (u, v) among the pairs
    of that kind, which are added to `links`. What is left of a large group is outside of its main component, and so is less in each round.
    rows: the members of keys with several labels, with their label (id where labels is None).
    """
    labels, before = None, None
    if links:
        labels = connected_components(_union(links))
    rows = members
    for turn in range(MOST_ROUNDS + 1):
        star = led(rows, labels, turn, sizes)
        drop(rows)
        rows = star
        left = open_pairs(rows)
        if not left or turn == MOST_ROUNDS or turn and (left <= rows.count() or left > (1 - LEAST_CLOSED) * before):
            break
        before = left
        new = verified(rows, turn)
        if not new.isEmpty():
            links.append(new)
            labels = connected_components(_union(links))
    return rows, labels


#: Pairs are verified at once when so few are left; rounds by component end when less than this share of their pairs are links.
FEW_PAIRS, MOST_LINKS = 8_000, 0.5


def chosen(pairs: DataFrame, links: list, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v): links, `links` among them, that give the components of all links among the pairs (u, v, apart), not each of these links.

    Pairs of one component are not verified. First each component has one pair verified in each round, that of least `apart`; then one
    pair of every two components; then all that are left between different ones.
    """
    links, rest, by, used = list(links), pairs, 0, ()
    while True:
        if links:
            labels = connected_components(_union(links))
            for end, label in ("u", "a"), ("v", "b"):
                rest = rest.join(labels.select(F.col("id").alias(end), F.col("label").alias(label)), end, "left").withColumn(label, F.coalesce(label, end))
            rest = rest.where("a <> b")
        else:
            rest = rest.withColumn("a", F.col("u")).withColumn("b", F.col("v"))
        rows = written(rest.select("u", "v", "apart", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        drop(*used)
        if by == 2 or rows.count() <= FEW_PAIRS:
            links.append(verified(rows.select("u", "v")))
            drop(rows)
            return _union(links)
        first = F.min(F.struct("apart", F.xxhash64("u", "v").alias("h"), "u", "v")).alias("x")
        if by:
            some = rows.groupBy("a", "b").agg(first)
        else:
            some = rows.unionByName(rows.select("u", "v", "apart", F.col("b").alias("a"), "b")).groupBy("a").agg(first)
        some = written(some.select("x.u", "x.v").distinct())
        new = verified(some)
        links.append(new)
        by += by == 1 or new.count() < MOST_LINKS * some.count()
        rest, used = rows.join(some, ["u", "v"], "left_anti").select("u", "v", "apart"), (rows, some)


def _union(tables: list) -> DataFrame:
    found = tables[0]
    for table in tables[1:]:
        found = found.unionAll(table)
    return found
