"""Language identification by prediction by partial matching.

For each language a context tree over folded bytes (order 0 to 3, escape method C, no exclusions) is counted once on
labelled rows and then frozen. A text's code length under a tree is exact: each byte costs -log2 of its probability
in the longest context of the tree that matches, escapes included. The language with the shortest code wins;
the score is its posterior probability under equal priors, 1 / sum(2^(shortest - length)).

Folding maps ASCII letters to lower case, other ASCII to one blank (runs of it to one), second bytes of Latin-1 letters (those
after 0xC3) to lower case; other bytes stay. Costs are tables over (context, byte), so scoring is table lookups in numpy.

The trees are fitted on a bounded sample: about `sample_docs` whole documents of each language, chosen by a hash of their id.
Contexts below `min_context` occurrences and beyond `max_contexts` of a language are pruned to their suffix, and the least frequent of
each language too, as far as the tables would be larger than `memory` bytes: many languages have shallower trees, not larger ones. At most MAX_LANGS
languages are learned, the most frequent ones.

Edge cases: null text, or text without a letter: `und`, score 0. Texts of any length are scored whole. Equal code
lengths: the first language in alphabetical order. Without training rows everything is `und`. Rows with null
lang are never trained on; repeated rows are predicted alike; a null id is trained on and not held out; of other columns only
those in `keep` are read, and one of them named lang_pred or score gives two columns of that name; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import arrow_schema, ddl, load, pieces

SAMPLE_DOCS, MIN_CONTEXT, MAX_CONTEXTS, MAX_LANGS, MEMORY = 400, 8, 12_000, 256, 256 << 20
UND = "und"
BLOCK = 1 << 19
#: Code lengths are kept in 1/SCALE bits, as integers, so that sums do not depend on their order.
SCALE = 4096


def fold_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    ascii_ = np.arange(128)
    letter = ((ascii_ >= 65) & (ascii_ <= 90)) | ((ascii_ >= 97) & (ascii_ <= 122))
    t[:128] = np.where(letter, ascii_ | 32, 32)
    return t


_FOLD = fold_table()
_ASCII_LETTER = re.compile("[A-Za-z]")


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each after three bytes 0, and the place where each begins (its zeros)."""
    data = [b"\0\0\0" + t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"".join(data), np.uint8)
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    s = _FOLD[raw]
    # After 0xC3, the second bytes of the upper-case letters A-grave to Thorn (0x97 is the multiplication sign).
    upper = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
    s[1:][upper] += 0x20
    pad = (starts[:, None] + np.arange(3)).ravel()
    s[pad] = 0
    keep = np.ones(len(s), bool)
    keep[1:] = ~((s[1:] == 32) & (s[:-1] == 32))
    before = np.r_[0, np.cumsum(keep)]
    return s[keep], before[starts]


def grams(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as one number; not the padding."""
    w = s.astype(np.uint32)
    g = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
    real = np.ones(len(s), bool)
    real[(starts[:, None] + np.arange(3)).ravel()] = False
    return g[real[3:]]


class Model:
    """Frozen trees. counts: for each language, sorted grams and how often each occurred."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], min_context: int = MIN_CONTEXT, max_contexts: int = MAX_CONTEXTS, memory: int = MEMORY):
        self.langs = sorted(counts)
        seen = np.zeros(256, bool)
        for g, _ in counts.values():
            seen[np.unique(g & 255)] = True
        seen[0] = False
        self.symbol = np.zeros(256, np.int64)  # 0: bytes never seen, and the padding
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        a = self.a = int(seen.sum()) + 1
        full = {}
        for lang, (g, n) in counts.items():
            parts = [self.symbol[(g >> k) & 255] for k in (24, 16, 8, 0)]
            full[lang] = (parts, n.astype(np.int64))
        # Contexts by order: number of the context (a mixed-base number of its symbols) -> node.
        ranked: list = [[], [], []]
        for order in (1, 2, 3):
            for parts, n in full.values():
                real = np.all([p > 0 for p in parts[3 - order : 3]], axis=0)
                code = np.zeros(len(n), np.int64)
                for p in parts[3 - order : 3]:
                    code = code * a + p
                ids, inverse = np.unique(code[real], return_inverse=True)
                total = np.bincount(inverse, n[real], len(ids))
                ids, total = ids[total >= min_context], total[total >= min_context]
                ranked[order - 1].append(ids[np.lexsort((ids, -total))][:max_contexts])
        room = max(1, memory // (4 * a * max(len(self.langs), 1)))  # rows of the cost table
        most, least = max([len(x) for per in ranked for x in per], default=0), 0
        pick = lambda m: [np.zeros(1, np.int64)] + [np.unique(np.concatenate([x[:m] for x in per])) if per else np.zeros(0, np.int64) for per in ranked]
        if sum(map(len, pick(most))) > room:
            while most - least > 1:
                middle = (least + most) // 2
                least, most = (least, middle) if sum(map(len, pick(middle))) > room else (middle, most)
            most = least
        nodes = pick(most)
        first = np.cumsum([0, *map(len, nodes)])
        # The longest kept context of any three symbols.
        table = np.zeros(a**3, np.int32)
        three = np.arange(a**3)
        for order in (1, 2, 3):
            code = three % a**order
            at = np.minimum(np.searchsorted(nodes[order], code), max(len(nodes[order]) - 1, 0))
            if len(nodes[order]):
                hit = nodes[order][at] == code
                table[hit] = first[order] + at[hit]
        self.table = table
        self.cost = np.zeros((int(first[-1]) * a, max(len(self.langs), 1)), np.int32)
        for k, lang in enumerate(self.langs):
            parts, n = full[lang]
            above = np.full((1, a), 1 / 256)
            for order in (0, 1, 2, 3):
                ids = nodes[order]
                code = np.zeros(len(n), np.int64)
                for p in parts[3 - order : 3]:
                    code = code * a + p
                at = np.minimum(np.searchsorted(ids, code), max(len(ids) - 1, 0))
                hit = (ids[at] == code) if len(ids) else np.zeros(len(n), bool)
                c = np.zeros((len(ids), a))
                np.add.at(c, (at[hit], parts[3][hit]), n[hit])
                c[:, 0] = 0
                total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                if order == 0:
                    shorter = np.repeat(above, len(ids), 0)
                else:  # the longest kept suffix of each context
                    suffix = ids % a ** (order - 1)
                    shorter = above[of_suffix(suffix, order - 1, nodes, first, a)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.where(c > 0, c / (total + kinds), np.where(total > 0, kinds / (total + kinds), 1.0) * shorter)
                above = p if order == 0 else np.concatenate([above, p])
            self.cost[:, k] = np.rint(-np.log2(above) * SCALE).astype(np.int32).ravel()

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code lengths (texts x languages) in 1/SCALE bits."""
        s, starts = fold(texts)
        s = self.symbol[s] if len(s) else s
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        owner_ends = np.r_[starts[1:], len(s)]
        pads = (starts[:, None] + np.arange(3)).ravel()
        for lo in range(0, len(s), BLOCK):
            hi = min(lo + BLOCK, len(s))
            from_ = max(lo, 3)
            if from_ >= hi:
                continue
            w = s[from_ - 3 : hi]
            ctx = (w[:-3] * self.a + w[1:-2]) * self.a + w[2:-1]
            cost = self.cost[self.table[ctx].astype(np.int64) * self.a + w[3:]]
            cost[pads[np.searchsorted(pads, from_) : np.searchsorted(pads, hi)] - from_] = 0
            first = int(np.searchsorted(owner_ends, from_, "right"))
            last = int(np.searchsorted(starts, hi, "left"))
            cuts = np.maximum(starts[first:last], from_) - from_
            out[first:last] += np.add.reduceat(cost, cuts, axis=0, dtype=np.int64)
        return out

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        given = [t or "" for t in texts]
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        bits = self.lengths(given) / SCALE
        best = bits.argmin(1)
        score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
        lettered = np.array([_ASCII_LETTER.search(t) is not None or any(map(str.isalpha, t)) for t in given])
        return [self.langs[b] if ok else UND for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def of_suffix(suffix, order, nodes, first, a):
    """Node of the longest kept context among `suffix` (of that order) and its suffixes."""
    node = np.zeros(len(suffix), np.int64)
    for k in range(1, order + 1):
        if len(nodes[k]):
            code = suffix % a**k
            at = np.minimum(np.searchsorted(nodes[k], code), len(nodes[k]) - 1)
            hit = nodes[k][at] == code
            node[hit] = first[k] + at[hit]
    return node


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> dict:
    """Gram counts by language over the sample; what Model takes. Sample and counts are bounded by sample_docs."""
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_docs / n))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")
    out = arrow_schema(lang="string", gram="long", n="long")

    def apply(batches):
        for whole in batches:
            for batch in pieces(whole, "text", 4_000_000):
                by: dict = {}
                for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    by.setdefault(name, []).append(t)
                for name, texts in by.items():
                    g, n = np.unique(grams(*fold(texts)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], schema=out)

    found = sample.mapInArrow(apply, ddl(out)).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, g, n = found.column("lang").to_numpy(zero_copy_only=False), found.column("gram").to_numpy(), found.column("n").to_numpy()
    counts = {}
    for name in sizes:
        mine = np.flatnonzero(names == name)
        order = mine[np.argsort(g[mine])]
        if len(order):
            counts[name] = (g[order].astype(np.uint32), n[order].astype(np.int64))
    return counts


_WORKER: dict = {}


def predict(df: DataFrame, counts: dict, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """df's `keep` columns with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(counts)
    rows = df.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))

    def apply(batches):
        if _WORKER.get("of") is not shared.value:
            _WORKER.update(of=shared.value, model=Model(shared.value))
        for whole in batches:
            for batch in pieces(whole, "text", 2_000_000):
                langs, score = _WORKER["model"].predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["kept", "lang_pred", "score"])

    return rows.mapInArrow(apply, f"kept {rows.schema['kept'].dataType.simpleString()}, lang_pred string, score double").select("kept.*", "lang_pred", "score")


def held_out(id_):
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    counts = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, counts).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
