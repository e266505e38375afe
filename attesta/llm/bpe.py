"""BPE encoding and decoding in batched numpy merge rounds.

A task collects the distinct new words of a block of texts, writes their symbols into one flat array, and
merges in rounds: each round looks up the new neighbours in the sorted pair keys by binary search,
takes the lowest rank of every word, and merges all places of that pair. Finished words leave the
array. Texts are then put together from the ids of their words.

Results: a null or empty text has no ids. Texts of any length are read in blocks of words, so memory does
not grow with a text's number of words. Repeated rows give repeated results; other columns are kept.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE cuts text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS_PER_BLOCK = 200_000
CHARS_PER_BLOCK = 1_000_000
CACHED_BYTES = 64 << 20
UNMERGED = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Merge table and token bytes of one byte-level BPE file. Its size is that of the file."""

    pair_keys: np.ndarray  # first * size + second, ascending
    pair_ranks: np.ndarray
    merged: np.ndarray  # by rank
    byte_ids: np.ndarray
    token_bytes: list[bytes]
    specials: dict[str, int]
    size: int

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*ids.values(), *specials.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        first, second = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        made_at = np.full(size, -1)
        made_at[merged] = np.arange(len(pairs))
        if (np.maximum(made_at[first], made_at[second]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a token that a later merge makes")
        keys = first * size + second
        order = np.argsort(keys, kind="stable")
        token_bytes = [b""] * size
        for token, i in ids.items():
            token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in specials.items():
            token_bytes[i] = token.encode()
        byte_ids = np.zeros(256, np.int32)
        for letter, b in letters.items():
            byte_ids[b] = ids[letter]
        return cls(keys[order], order.astype(np.int32), merged, byte_ids, token_bytes, specials, size)

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = first.astype(np.int64) * self.size + second
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], UNMERGED)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        number = np.flatnonzero(lengths)  # of the words still in the array
        lengths = lengths[number]
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        last = np.zeros(len(symbols), bool)
        last[starts + lengths - 1] = True
        rank = np.full(len(symbols), UNMERGED, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        finished = []  # (word numbers, their lengths, their symbols)
        while len(symbols):
            best = np.minimum.reduceat(rank, starts)
            done = best == UNMERGED
            if done.any():
                stay = np.repeat(~done, lengths)
                finished.append((number[done], lengths[done], symbols[~stay]))
                symbols, last, rank = symbols[stay], last[stay], rank[stay]
                number, lengths, best = number[~done], lengths[~done], best[~done]
                starts = np.cumsum(lengths) - lengths
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, lengths))
            fresh = np.ones(len(hit), bool)  # a run of overlapping places merges every other one
            fresh[1:] = np.diff(hit) != 1
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[run % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            last[hit] = last[hit + 1]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            gone_before = np.searchsorted(hit, [*starts, len(symbols)])
            lengths = lengths - np.diff(gone_before)
            starts = np.cumsum(lengths) - lengths
            place = hit - np.arange(len(hit))  # where the merged symbols stand once the others are gone
            symbols, last, rank = symbols[stay], last[stay], rank[stay]
            touched = np.concatenate([place, np.maximum(place - 1, 0)])
            ends = last[touched]
            rank[touched[ends]] = UNMERGED
            touched = touched[~ends]
            rank[touched] = self.ranks(symbols[touched], symbols[touched + 1])
        if finished:
            number, lengths, symbols = (np.concatenate(x) for x in zip(*finished))
            packed, ends = symbols.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
            for w, a, b in zip(number.tolist(), [0, *ends], ends):
                out[w] = packed[a:b]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class TextEncoder:
    """Encodes whole texts; keeps the ids of chunks and words seen before, up to a bound in bytes.

    A chunk is a space and what follows it up to the next space. No word of the pattern reaches from one chunk into
    the next, unless white space stands on both sides of a space or before a last space: such texts go word by word.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = regex.compile(WORD_PATTERN)
        self.across = regex.compile(r"\s (?:\s|\Z)")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.specials)) + ")") if vocabulary.specials else None
        self.forget()

    def forget(self) -> None:
        self.by_word: dict[str, bytes] = {}
        self.by_chunk: dict[str, bytes] = {}
        self.held = 0

    def _learn_words(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.by_word]
        encoded = [w.encode() for w in new]
        self.by_word.update(zip(new, self.vocabulary.encode_words(encoded)))
        self.held += sum(map(len, encoded)) + 150 * len(new)

    def _learn_chunks(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.by_chunk]
        words = [self.words.findall(c) for c in new]
        self._learn_words(set(itertools.chain.from_iterable(words)))
        ids = self.by_word
        for chunk, found in zip(new, words):
            self.by_chunk[chunk] = b"".join([ids[w] for w in found])
        self.held += sum(map(len, new)) + 200 * len(new)

    def _parts(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def _long(self, text: str) -> Iterator[bytes]:
        """Word by word, in blocks."""
        found = (m.group() for m in self.words.finditer(text))
        for block in iter(lambda: list(itertools.islice(found, WORDS_PER_BLOCK)), []):
            if self.held > CACHED_BYTES:
                self.forget()
            self._learn_words(set(block))
            yield b"".join(map(self.by_word.__getitem__, block))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The packed ids of each text. Merge rounds take the new words of many texts at once."""
        block, size = [], 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size > CHARS_PER_BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHED_BYTES:
            self.forget()
        parts = [self._parts(t) for t in texts]
        chunks = [[self._chunks(p) for p in own] for own in parts]
        self._learn_chunks({c for own in chunks for found in own if found for c in found})
        get, specials, out = self.by_chunk.__getitem__, self.vocabulary.specials, []
        for own, found in zip(parts, chunks):
            out.append([b"".join(map(get, c)) if c else np.array([specials[p]], "<u4").tobytes() if p in specials else None for p, c in zip(own, found)])
        return [b"".join(x if x is not None else b"".join(self._long(p)) for p, x in zip(own, made)) for own, made in zip(parts, out)]

    def _chunks(self, part: str) -> list[str] | None:
        if part in self.vocabulary.specials or len(part) > CHARS_PER_BLOCK or self.across.search(part):
            return None
        first, *rest = part.split(" ")
        return [first, *(" " + c for c in rest)]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids, packed as little-endian 32-bit integers, in place of ``text``."""
    model = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary.from_file(path)))
    kept = [c for c in docs.columns if c not in (text, ids)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(Vocabulary(**model.value))
        for batch in batches:
            made = pa.array(encoder.encode_all(t.as_py() for t in batch.column("_attesta_text")), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*kept, ids])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("_attesta_text"))
    return rows.mapInArrow(task, rows.drop("_attesta_text").withColumn(ids, F.lit(b"")).schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with a column of decoded text. Null ids give an empty text; an id outside the vocabulary is an error."""
    model = encoded.sparkSession.sparkContext.broadcast(vars(Vocabulary.from_file(path)))
    kept = [c for c in encoded.columns if c != text]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(**model.value)
        for batch in batches:
            made = pa.array((vocabulary.decode(x.as_py() or b"") for x in batch.column(ids)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*kept, text])

    rows = encoded.select(*(F.col(f"`{c}`") for c in kept))
    return rows.mapInArrow(task, rows.withColumn(text, F.lit("")).schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: encode, then decode what was encoded."""
    coded = decode(encode(docs.select("doc_id", "text"), path), path, text="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
