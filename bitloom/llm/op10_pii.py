"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence.

Base spans (email, ip, card, phone) come from fixed patterns. Each distinct value found is a protected entity. A term
is a word, outside of all base spans, of a text that holds the entity. Over all documents, with rows of equal text counted once,
    IC(e) = log(N / n(e)),   PMI(e, t) = log(P(t | e) * N / n(t)),   disclosure = PMI / IC
with P(t | e) = (n(e, t) + n(t) / N) / (n(e) + 1), smoothed by one text of the corpus, so that entities of one text count with caution;
N and all n count distinct texts, and one function says what a word is. A pair with n(e, t) >= `support` and disclosure >= `remove_at`
(`generalise_at`) is removed (generalised) wherever t stands in a text that holds e: these are the spans of kind `term`. Documents
without base spans never get any. `sanitise` rewrites texts: entities become [EMAIL] etc., terms [TERM] (generalised) or nothing (removed).

Since P <= 1, a term can only disclose e if n(t) <= N ** (1 - g) * n(e) ** g, g being the lower threshold: other words of a text are
dropped before any pair is made. Entities of one text all have the same statistics, so their terms need no pairs. The others' pairs
are sums by (entity, term) with map-side aggregation; nothing of the corpus is collected or broadcast, and no group is gathered: a
frequent entity's rows are summed, never listed. What a text's terms are depends on the text alone, so rows meet them by its digest.

Edge cases: null text is an empty one; empty and very long texts are scanned whole, in linear time; rows of one text count once in the
statistics but all get their spans, rows of one id each those of their own text, rows with a null id too; equal starts are ordered by
end; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import drop, id_filter, load, pieces, written

#: Least distinct texts of a pair; disclosure from which a term is generalised, or removed.
SUPPORT, GENERALISE_AT, REMOVE_AT = 1, 0.7, 0.9
#: Least letters of a term.
MIN_LETTERS = 3
#: The contract's patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = list(PATTERNS)
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Matches of the email pattern, found from their @: linear in long runs of local-part letters."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _AT.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _ips(text: str):
    """Matches of the ip pattern: each four numbers in a row of a chain, whose parts are at most 255."""
    for chain in _NUMBERS.finditer(text):
        if "." not in chain[0]:
            continue
        numbers, at = chain[0].split("."), chain.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def _cards(text: str):
    for m in PATTERNS["card"].finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *x) for x in _ips(text)]
        out += [("card", *x) for x in _cards(text)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PATTERNS["phone"].finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _value(kind: str, raw: str) -> str:
    return kind + ":" + (raw.lower() if kind == "email" else raw if kind == "ip" else "".join(_DIGIT.findall(raw)))


def entities_of(text: str, spans) -> list[str]:
    return sorted({_value(kind, text[a:b]) for kind, a, b in spans})


def words_outside(text: str, spans):
    """(term, start, end) of the words outside of all spans."""
    covered = sorted((a, b) for _, a, b in spans)
    k = reach = 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        while k < len(covered) and covered[k][0] < e:
            reach = max(reach, covered[k][1])
            k += 1
        if e - s >= MIN_LETTERS and reach <= s:
            yield m[0].lower(), s, e


def digest_of(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, entities, terms) of each row whose text has base spans."""

    def apply(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = []
                for t in batch.column("text").to_pylist():
                    spans = base_spans(t) if t else []
                    if spans:
                        rows.append((digest_of(t), entities_of(t, spans), sorted({w for w, _, _ in words_outside(t, spans)})))
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.list_(pa.string()), pa.list_(pa.string())))], names=["digest", "entities", "terms"])

    return docs.select(F.col(text).alias("text")).mapInArrow(apply, "digest string, entities array<string>, terms array<string>")


def distinct_texts(docs: DataFrame, text: str = "text"):
    """(text) of each distinct text that is not null, their number, and a table to drop() when they are read. Only texts that may be repeated are shuffled."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.col(text), F.lit(1)).alias("h2"))
    marks = written(rows.groupBy("h1", "h2").agg(F.count("*").alias("n")))
    repeated = id_filter(marks.where("n > 1"), "h1")(F.col("h1"))
    total = marks.count()
    again = rows.where(repeated).groupBy("h1", "h2").agg(F.first("text").alias("text"))
    return rows.where(~repeated).select("text").unionAll(again.select("text")), total, marks


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, n_t): how many of the texts have each word. Tasks sum up what they see, a piece of the texts at a time."""

    def apply(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                n = Counter()
                for t in batch.column("text").to_pylist():
                    n.update({w.lower() for w in set(_WORD.findall(t)) if len(w) >= MIN_LETTERS})
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    return texts.mapInArrow(apply, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(docs: DataFrame, text: str = "text", support: int = SUPPORT, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """(digest, term, disclosure) of the terms that reach generalise_at with an entity of the text."""
    seen = written(scan(docs, text))
    twice = written(seen.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    again = id_filter(twice, "digest")(F.col("digest"))
    one = written(seen.where(~again).unionByName(seen.where(again).groupBy("digest").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"))))
    drop(seen, twice)

    held = written(one.select("digest", F.explode("entities").alias("entity")))
    several = written(held.groupBy("entity").agg(F.count("*").alias("n_e")).where("n_e > 1"))
    known = held.where(id_filter(several, "entity")(F.col("entity"))).join(several, "entity")
    held_by_several = written(known.select("digest", "entity", "n_e"))
    most = several.agg(F.max("n_e")).first()[0] or 1
    # Texts that hold such an entity: how frequent the most frequent one is, and whether they hold others too.
    mixed = held_by_several.groupBy("digest").agg(F.max("n_e").alias("most"), F.count("*").alias("n"))
    mixed = written(mixed.join(one.select("digest", F.size("entities").alias("of")), "digest").select("digest", "most", (F.col("of") > F.col("n")).alias("single")))
    drop(held, several)

    texts, total, marks = distinct_texts(docs, text)
    limit = lambda n_e: F.pow(F.lit(float(max(total, 1))), F.lit(1 - generalise_at)) * F.pow(n_e, F.lit(generalise_at)) * (1 + 1e-9)
    counts = written(term_counts(texts).where(F.col("n_t") <= limit(F.lit(float(most)))))
    drop(marks)
    rare = id_filter(counts.where(F.col("n_t") <= limit(F.lit(1.0))), "term")
    is_mixed = id_filter(mixed, "digest")(F.col("digest"))
    words = one.where(~is_mixed).select("digest", F.lit(1).cast("bigint").alias("most"), F.lit(True).alias("single"), F.explode("terms").alias("term")).where(rare(F.col("term")))
    if not mixed.isEmpty():
        rest = one.where(is_mixed).join(mixed, "digest", "left").select("digest", F.coalesce("most", F.lit(1).cast("bigint")).alias("most"), F.coalesce("single", F.lit(True)).alias("single"), F.explode("terms").alias("term"))
        words = words.unionByName(rest.where(id_filter(counts, "term")(F.col("term"))))
    words = written(words.join(counts, "term").where(F.col("n_t") <= limit(F.col("most").cast("double"))))
    drop(one, counts, mixed)

    def disclosure(n_et, n_t, n_e):
        n = F.lit(float(total))
        pmi = F.log((n_et + n_t / n) / (n_e + 1) * n / n_t)
        return F.when(n_e < total, pmi / F.log(n / n_e)).otherwise(0.0)

    alone = words.where("single").select("digest", "term", disclosure(F.lit(1), F.col("n_t"), F.lit(1)).alias("d")).where((F.col("d") >= generalise_at) & F.lit(support <= 1))
    pairs = written(words.where("most > 1").join(held_by_several, "digest").where(F.col("n_t") <= limit(F.col("n_e").cast("double"))).select("digest", "entity", "term", "n_t", "n_e"))
    found = pairs.groupBy("entity", "term", "n_t", "n_e").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    found = found.select("entity", "term", disclosure(F.col("n_et"), F.col("n_t"), F.col("n_e")).alias("d")).where(F.col("d") >= generalise_at)
    both = alone.unionByName(pairs.join(found, ["entity", "term"]).select("digest", "term", "d"))
    out = written(both.groupBy("digest", "term").agg(F.max("d").alias("disclosure")))
    drop(words, pairs, held_by_several)
    return out


def _with_terms(docs: DataFrame, text: str, support: int, generalise_at: float, remove_at: float) -> DataFrame:
    """(row, text, terms, removed): each row of docs, its text ('' for null), and the terms to be generalised or removed in it."""
    found = disclosing(docs, text, support, generalise_at)
    at = F.col("disclosure") >= remove_at
    cut = written(found.groupBy("digest").agg(F.collect_list(F.when(~at, F.col("term"))).alias("terms"), F.collect_list(F.when(at, F.col("term"))).alias("removed")))
    drop(found)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    asked = id_filter(cut, "digest")(F.md5("text"))
    none = F.lit(None).cast("array<string>")
    plain = rows.where(~asked).select("row", "text", none.alias("terms"), none.alias("removed"))
    return plain.unionByName(rows.where(asked).withColumn("digest", F.md5("text")).join(cut, "digest", "left").select("row", "text", "terms", "removed"))


_SPAN = "struct<start:bigint,end:bigint,action:string>"


def _term_spans(text: str, spans, terms, removed) -> list[tuple[int, int, str]]:
    if not terms and not removed:
        return []
    action = dict.fromkeys(terms or (), "generalise") | dict.fromkeys(removed or (), "remove")
    return [(a, b, action[w]) for w, a, b in words_outside(text, spans) if w in action]


def detect(docs: DataFrame, text: str = "text", id_: str = "doc_id", support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """A row per row of docs: id_, n_email, n_ip, n_card, n_phone, base_sha256, base, and `terms` (array of start, end, action) or null."""
    rows = _with_terms(docs.select(F.col(id_).alias("id"), F.col(text).alias("text")), "text", support, generalise_at, remove_at).select("row.id", "text", "terms", "removed")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("action", pa.string())]))

    def apply(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                out = []
                for t, terms, removed in zip(*(batch.column(c).to_pylist() for c in ("text", "terms", "removed"))):
                    spans = base_spans(t)
                    n, base = Counter(k for k, _, _ in spans), joined(spans)
                    found = [dict(zip(("start", "end", "action"), x)) for x in _term_spans(t, spans, terms, removed)]
                    out.append((*(n[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base, found or None))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [kind]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "terms"])

    found = rows.mapInArrow(apply, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, base string, terms array<{_SPAN}>")
    return found.withColumnRenamed("id", id_)


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """docs with entities and disclosing terms of the text replaced; a null text stays null."""

    def rewrite(t, terms, removed):
        spans = base_spans(t)
        cuts = [(a, b, f"[{k.upper()}]") for k, a, b in spans]
        cuts += [(a, b, "" if action == "remove" else "[TERM]") for a, b, action in _term_spans(t, spans, terms, removed)]
        out, at = [], 0
        for a, b, new in sorted(cuts):
            if b <= at:
                continue
            out += [t[at : max(a, at)], new if a >= at else ""]
            at = b
        return "".join(out) + t[at:]

    def apply(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                new = [rewrite(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("text", "terms", "removed")))]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], names=["row", "new"])

    rows = _with_terms(docs, text, support, generalise_at, remove_at)
    out = rows.mapInArrow(apply, f"row {rows.schema['row'].dataType.simpleString()}, new string")
    return out.select(F.col("row").withField(text, F.when(F.col("row")[text].isNotNull(), F.col("new"))).alias("row")).select("row.*")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(load(spark, sf_dir, "documents"))
    terms = F.array_join(F.transform("terms", lambda x: F.concat(F.lit("term:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), terms)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))
