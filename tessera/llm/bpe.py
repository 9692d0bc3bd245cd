"""BPE encoding and decoding by prefix-sharing trie traversal.

A word's BPE tokens are found from the last tokens of its prefixes: the last token of a prefix is the one vocabulary entry
that ends there and that may stand behind the last token of the prefix before it (two tokens may stand side by side when
BPE gives just them for their joint text, and a sequence is an encoding when all its neighbours may). So each node of a
trie of words needs one state, its last token, and words share the states of their common prefixes. The distinct new
words of an Arrow batch are inserted in order, which is a depth-first walk: a stack holds the states of the current path.

The file is that of the tokenizers library: NFC and lower-case normalisation, a split into words, byte-level symbols, an
end-of-word suffix and no decoder, so that decoding joins tokens by spaces. Special tokens in a text are found before
normalisation. Words never span white space, so the cache holds chunks between white space; it is bounded, and so is
a batch. No shuffle is needed, and a task that is lost can be run again. Spark gives each Arrow step of a task a Python worker,
and each keeps what it has learnt: round_trip() encodes and decodes in one step, so a task has one worker and not two.

Null and empty texts have no tokens and decode to "". All rows stay, repeated ones too; other columns stay as they are.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tessera.llm.common import small_batches

#: Chunks that a Python worker keeps encoded in each of two generations.
CACHE_CHUNKS = 400_000
#: White space as the split pattern understands it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints in Latin-1, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in prints:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class WordEncoder:
    """Tokens of words given as strings of byte symbols."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.beside: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE by its definition: merge the pair of the lowest rank, the leftmost first."""
        while len(symbols) > 1:
            rank, i = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def may_follow(self, before: str, token: str) -> bool:
        """Whether BPE gives just these two tokens for their joint text ("" before: the token alone for its own)."""
        got = self.beside.get((before, token))
        if got is None:
            if len(self.beside) > 500_000:
                self.beside.clear()
            want = [before, token] if before else [token]
            got = self.beside[before, token] = self.merged([s for t in want for s in self.symbols(t)]) == want
        return got

    def encode_sorted(self, words: list[str]) -> Iterator[list[str]]:
        """The tokens of each word; words are sorted and distinct, so a stack of states walks their trie depth first.

        tokens[i], starts[i]: the last token of the first i symbols of the current word, and where it starts.
        """
        vocab, beside, longest, end = self.vocab, self.beside, self.longest, self.end
        tokens, starts, path = [""], [0], ""
        for word in words:
            n, same = len(word), 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                same += 1
            same = min(same, len(tokens) - 1)
            del tokens[same + 1 :], starts[same + 1 :]
            for i in range(same + 1, n + 1):
                suffix = end if i == n else ""
                for j in range(max(0, i - longest), i):
                    token = word[j:i] + suffix
                    if token in vocab:
                        known = beside.get((tokens[j], token))
                        if known or known is None and self.may_follow(tokens[j], token):
                            break
                else:
                    raise ValueError(f"no token ends {word[:i]!r}")
                if i < n:
                    tokens.append(token)
                    starts.append(j)
            path = word
            out = [token]
            while j:
                out.append(tokens[j])
                j = starts[j]
            yield out[::-1]


class TextEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]], spec["model"]["type"], spec["decoder"]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE", None):
            raise ValueError(f"another kind of tokenizer: {kinds}")
        self.words = WordEncoder(spec)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("[^\\s", f"[^{WHITE}")
        self.pattern = regex.compile(pattern)
        self.white = regex.compile(f"[{WHITE}]+")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes = byte_symbols()
        self.tokens = {i: t for t, i in self.words.vocab.items()} | {i: t for t, i in self.special.items()}
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in self.words.vocab.items()}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Normalised text between white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # the library lowers each character for itself
        return self.white.split(low) if any(c in low for c in "\x1c\x1d\x1e\x1f") else low.split()

    def pieces(self, text: str) -> list[list[str] | int]:
        """Chunks of the text, and the ids of special tokens between them."""
        if self.special_pattern is None or "<" not in text:
            return [self.chunks(text)]
        out: list[list[str] | int] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            out += [self.chunks(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return [*out, self.chunks(text[at:])]

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that the cache lacks, by one walk over the trie of their distinct words."""
        if len(self.cache) > CACHE_CHUNKS:
            self.older, self.cache = self.cache, {}
        new = []
        for c in chunks:
            if c not in self.cache:
                if (known := self.older.get(c)) is None:
                    new.append(c)
                else:
                    self.cache[c] = known
        split = [self.pattern.findall(c) for c in new]
        symbols = self.bytes
        as_symbols = {w: "".join([symbols[b] for b in w.encode()]) for w in {w for ws in split for w in ws}}
        order = sorted(set(as_symbols.values()))
        id_bytes = self.id_bytes
        ids = {w: b"".join([id_bytes[t] for t in ts]) for w, ts in zip(order, self.words.encode_sorted(order), strict=True)}
        for c, ws in zip(new, split, strict=True):
            self.cache[c] = b"".join([ids[as_symbols[w]] for w in ws])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = [self.pieces(t) if t else [] for t in texts]
        self.learn({c for ps in pieces for p in ps if not isinstance(p, int) for c in p})
        get = self.cache.__getitem__
        return [b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in ps]) for ps in pieces]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder_of(path: str) -> TextEncoder:
    """One encoder a Python worker, so that tasks that follow each other share what it has learnt."""
    return TextEncoder(path)


def _extended(df: DataFrame, drop: str, *fields: StructField) -> StructType:
    return StructType([f for f in df.schema.fields if f.name not in {drop, *(x.name for x in fields)}] + list(fields))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers) in place of text."""
    small_batches(docs.sparkSession)
    schema = _extended(docs, "text", StructField("n_tokens", LongType()), StructField("ids", BinaryType()))
    names = [f.name for f in schema.fields[:-2]]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in batches:
            ids = encoder.encode_batch(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*names, "n_tokens", "ids"])

    return docs.mapInArrow(encoded, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded (string) beside ids."""
    schema = _extended(encoded, "", StructField("decoded", StringType()))
    names = [f.name for f in schema.fields[:-1]]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([encoder.decode(x) for x in b.column("ids").to_pylist()], pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(decoded, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """decode_documents(encode_documents(docs)) in one step: docs with n_tokens, ids and decoded in place of text."""
    small_batches(docs.sparkSession)
    schema = _extended(docs, "text", StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", StringType()))
    names = [f.name for f in schema.fields[:-3]]

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in batches:
            ids = encoder.encode_batch(b.column("text").to_pylist())
            made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], [*names, "n_tokens", "ids", "decoded"])

    return docs.mapInArrow(both, schema)
