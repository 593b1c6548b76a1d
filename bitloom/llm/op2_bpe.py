"""Byte-pair encoding and decoding in batched numpy merge rounds.

Symbols of many words lie in one flat array. Ranks of neighbouring pairs are looked up in one table, in which the pairs of each left symbol
are shifted to free places. A round takes each word's lowest rank, merges that pair's occurrences from the left in every
word at once, and looks up the pairs beside them; rounds go on for words that still have a pair. Words are kept in a bounded table per
Python worker, so a word costs merge rounds once per worker and not once per occurrence.

The vocabulary file of the `tokenizers` library is read on the driver and travels once, as a Spark broadcast of a
fixed size (the vocabulary's). The normaliser, the split and special tokens follow that library's files of this kind
(NFC, white space, lower case; byte-level words with an end mark).

Edge cases: null text is an empty one (no ids); text of white space only has no ids; special tokens' strings inside a text
become their ids; one word of any length is one word (merge rounds are bounded by the number of distinct
merges, not by length); repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import arrow_schema, ddl, load, pieces

#: Words that a worker remembers at most, and characters of the longest of them.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: Words whose merge rounds are done at once: their arrays stay within a processor's cache.
MERGE_WORDS = 8_192
#: Bytes of text that are split into words at once (or one text, if longer), so that a worker holds little beside its batch.
PIECE_BYTES = 500_000
#: White space (Unicode's White_Space), and the split of a normalised text.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
SPACES = regex.compile(f"[{SPACE}]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary and its merges as arrays."""

    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_letters()
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.size = len(self.tokens)
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + end] for x in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int32)
        right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._place(left, right)
        # A merge whose product takes part in an earlier merge has to be done one occurrence at a time.
        first_use = np.full(self.size, len(pairs), np.int64)
        for part in (left, right):
            np.minimum.at(first_use, part, np.arange(len(pairs)))
        self.alone = first_use[self.made] < np.arange(len(pairs))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _place(self, left: np.ndarray, right: np.ndarray) -> None:
        """The table of pairs: (left, right) lies at base[left] + right, where `at` has its rank and `of` its left symbol.

        The left symbols with most pairs are placed first, each where all of its pairs find a free place (drawn, with a fixed seed).
        """
        places = 1 << max(self.size - 1, 4 * len(left), 1).bit_length()
        self.mask, self.none = places - 1, len(left)
        self.base, self.of, self.at = np.zeros(self.size, np.int32), np.full(places, -1, np.int32), np.full(places, self.none, np.int32)
        order = np.argsort(left, kind="stable")
        draw = np.random.default_rng(1)
        for group in sorted(np.split(order, np.flatnonzero(np.diff(left[order])) + 1), key=len, reverse=True) if len(left) else []:
            while True:
                bases = draw.integers(0, places, 32, np.int32)
                free = np.flatnonzero((self.of[(bases[:, None] + right[group]) & self.mask] < 0).all(1))
                if len(free):
                    break
            first = left[group[0]]
            self.base[first] = bases[free[0]]
            self.of[(self.base[first] + right[group]) & self.mask] = first
            self.at[(self.base[first] + right[group]) & self.mask] = group

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, `none` for what is no pair."""
        place = (self.base[left] + right) & self.mask
        return np.where(self.of[place] == left, self.at[place], self.none)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of the words (not empty)."""
        ids, ends = self.merged(words)
        return np.split(ids, ends[:-1])

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (not empty) in one array, and where each word's ids end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        # ranks: of each symbol with the next one of its word
        ranks = np.append(self._ranks(symbols[:-1], symbols[1:]), np.int32(self.none))
        ranks[ends - 1] = self.none
        done_symbols, done_owner = [], []
        while True:
            here = np.flatnonzero(ranks != self.none)
            if not len(here):
                break
            own, whose = ranks[here], owner[here]
            starts = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
            least = np.minimum.reduceat(own, starts)
            best = here[own == np.repeat(least, np.diff(np.r_[starts, len(here)]))]
            single = self.alone[ranks[best]]
            if single.any():
                keep = ~single
                keep[np.r_[True, owner[best][1:] != owner[best][:-1]]] = True
                best = best[keep]
            if len(best) > len(starts):  # several merges in one word: runs of neighbours are taken two by two
                run = np.r_[True, (np.diff(best) != 1) | (owner[best[1:]] != owner[best[:-1]])]
                place = np.arange(len(best)) - np.maximum.accumulate(np.where(run, np.arange(len(best)), 0))
                best = best[place % 2 == 0]
            symbols[best] = self.made[ranks[best]]
            stay = np.ones(len(symbols), bool)
            stay[best + 1] = False
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            # Only the pairs on both sides of what was merged are new.
            new = best - np.arange(len(best))
            new = np.r_[new, new[new > 0] - 1]
            new = new[new < len(symbols) - 1]
            ranks[new] = np.where(owner[new] == owner[new + 1], self._ranks(symbols[new], symbols[new + 1]), self.none)
            ranks[-1] = self.none
            active = np.zeros(len(words), bool)
            active[whose[starts]] = True
            over = ~active[owner]
            if over.sum() * 2 > len(over):  # words without pairs leave the array
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                symbols, owner, ranks = symbols[~over], owner[~over], ranks[~over]
        symbols, owner = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype("<u4"), np.cumsum(np.bincount(owner, minlength=len(words)))


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    # Lower case letter by letter: str.lower() alone has another final sigma.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Encoder:
    def __init__(self, bpe: Bpe):
        self.bpe, self.known = bpe, {}

    def _learn(self, chunks) -> None:
        """Puts the ids (as bytes) of chunks between white space into the table, by merge rounds."""
        known, several, words = self.known, {}, set()
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():
                words.add(chunk)
            else:
                parts = WORD.findall(chunk)
                if len(parts) != 1:
                    several[chunk] = parts
                words.update(parts)  # a word by itself is a chunk of one word
        words = list(words.difference(known))
        for i in range(0, len(words), MERGE_WORDS):
            part = words[i : i + MERGE_WORDS]
            ids, ends = self.bpe.merged([w.encode() for w in part])
            ids, ends = ids.tobytes(), (ends * 4).tolist()
            known.update(zip(part, map(ids.__getitem__, map(slice, [0, *ends], ends))))
        get = known.__getitem__
        known.update({c: b"".join(map(get, parts)) for c, parts in several.items()})

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        rows, used = [], set()
        for text in texts:
            row = []
            for k, piece in enumerate(self.bpe.split.split(text) if self.bpe.split and "<|" in text else [text] if text else []):
                if k % 2:
                    row.append((piece, None))
                elif piece:
                    normal = _normal(piece)
                    chunks = [x for x in SPACES.split(normal) if x] if ODD_SPACE.search(normal) else normal.split()
                    row.append((None, chunks))
                    used.update(chunks)
            rows.append(row)
        self._learn(used.difference(self.known))
        get = self.known.__getitem__
        out = [b"".join([b"".join(map(get, chunks)) if chunks is not None else np.array([self.bpe.special[token]], "<u4").tobytes() for token, chunks in row]) for row in rows]
        self._forget(used)
        return out

    def _forget(self, used: set) -> None:
        """Holds the table to CACHE_WORDS words, those of the last texts first."""
        long_ = [c for c in used if len(c) > CACHE_CHARS]
        for c in long_:
            for x in (c, *WORD.findall(c)):
                self.known.pop(x, None) if len(x) > CACHE_CHARS else None
        if len(self.known) > CACHE_WORDS:
            stay = [c for c in used if c in self.known]
            self.known = {c: self.known[c] for c in stay} if len(stay) <= CACHE_WORDS else {}

    def decode(self, ids: bytes) -> str:
        """The library's decode() without a decoder part: the tokens' strings with a blank between them."""
        return " ".join(map(self.bpe.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_SCHEMA = arrow_schema(ids="binary", decoded="string", n_tokens="long", ids_sha256="string", decoded_sha256="string")
_WORKER: dict = {}


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encode_decode(df: DataFrame, tokenizer: str, text: str = "text", keep=("doc_id",), ids: bool = False, decoded: bool = False) -> DataFrame:
    """df's `keep` columns with n_tokens, ids_sha256 and decoded_sha256; with the ids (little-endian
    unsigned 32-bit integers) and the decoded text on request. tokenizer: a file's path on the driver."""
    shared = df.sparkSession.sparkContext.broadcast(Bpe(read_spec(tokenizer)))
    rows = df.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    wanted = [n for n in _SCHEMA.names if (n != "ids" or ids) and (n != "decoded" or decoded)]
    out = pa.schema([_SCHEMA.field(n) for n in wanted])

    def apply(batches):
        if _WORKER.get("of") != tokenizer:
            _WORKER.update(of=tokenizer, encoder=Encoder(shared.value))
        encoder = _WORKER["encoder"]
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                coded = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
                back = [encoder.decode(x) for x in coded]
                columns = {"ids": coded, "decoded": back, "n_tokens": [len(x) // 4 for x in coded], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded], "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back]}
                yield pa.RecordBatch.from_arrays([batch.column("kept"), *(pa.array(columns[f.name], f.type) for f in out)], names=["kept", *wanted])

    return rows.mapInArrow(apply, f"kept {rows.schema['kept'].dataType.simpleString()}, {ddl(out)}").select("kept.*", *wanted)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(load(spark, sf_dir, "documents"), default_tokenizer())
