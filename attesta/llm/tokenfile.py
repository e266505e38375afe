"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the documents of one range of doc_ids, in order. Each frame holds the ids of some documents, or a
part of a long one, as little-endian 32-bit integers. Two skippable frames follow, which any zstandard reader
passes over: the document table (for each document its id, first token in the file and number of tokens), and the
seek table of the public seekable format: compressed and plain size and checksum of every frame, number of
frames, a magic number. A reader takes the tables from the end of the file and decompresses only the frames
that hold the documents asked for, each checked against its checksum.

Results: a null or empty text has only the end id. Rows are ordered by doc_id, nulls first, equal ids by their
text's hash; repeated rows are written each.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters
from .files import Output, new_folder, one_file_a_task, open_input, worker_cache
from .graph import stored

#: Magic numbers and descriptor of the seekable format; the id that ends a document.
SKIPPABLE_DOCUMENTS = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
END_ID = 2
FRAME_IDS = 1 << 16
FILE_IDS = 1 << 24
CACHED_CHUNKS = 400_000
BLOCK_BYTES = 8 << 20
CHUNKS_PER_BLOCK = 1_000_000
WORDS_PER_CALL = 10_000
#: Marks that the tokenizer parts from a word beside them (an apostrophe may belong to it), and how its
#: vocabulary spells the end of a word.
MARKS = b".,;:!?()[]{}\"*#$%&@+=~^_/-"
WORD_END = "</w>"
#: The last letter of the Latin blocks.
LAST_LATIN = "\u024f"
NO_ID = -(2**63)
FORMATS = [f"<{n}I" for n in range(16)]


class ChunkEncoder:
    """Encodes texts with a tokenizer that drops white space and case, chunk by chunk between ASCII white space.

    No token reaches over white space, so equal chunks have equal ids. They are kept in two generations: when the
    newer one is full the older one goes, and chunks in use move up. Marks around a word are tokens of their own, so
    words are looked up without them. A word of letters is one piece for the tokenizer, so Latin words go to its merges
    alone, after its normalizer. Other new words are encoded as one text; only the last token of a piece is an end
    token, so the ids are cut after those.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode_all(self, texts: pa.Array) -> Iterator[Iterator[bytes]]:
        """Packed ids of each text, in parts; each text's parts are to be taken before the next text.

        Python sees the distinct chunks of a block of texts alone; ids are put together by position.
        """
        size = np.diff(np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
        block = np.cumsum(size) // BLOCK_BYTES
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)] if len(texts) else [0]
        for a, b in zip(edges, edges[1:]):
            yield from self._block(texts.slice(a, b - a))

    def encode(self, text: str | None) -> Iterator[bytes]:
        return next(self.encode_all(pa.array([text], pa.string())))

    def _block(self, texts: pa.Array) -> Iterator[Iterator[bytes]]:
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = chunks.flatten().dictionary_encode()
        packed, sizes, forms = self._ids_of(coded.dictionary)
        own = forms[coded.indices.to_numpy(zero_copy_only=False)]
        first = np.cumsum(sizes) - sizes
        edges = np.append(0, np.cumsum(pc.list_value_length(chunks).to_numpy(zero_copy_only=False)))

        def ids(a: int, b: int) -> np.ndarray:
            count = sizes[own[a:b]]
            before = np.cumsum(count) - count
            return packed[np.repeat(first[own[a:b]] - before, count) + np.arange(count.sum())]

        def parts(a: int, b: int) -> Iterator[bytes]:
            for k in range(a, b, CHUNKS_PER_BLOCK):
                yield ids(k, min(k + CHUNKS_PER_BLOCK, b)).tobytes()

        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            yield parts(a, b)

    def _ids_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all forms of the chunks one after another, how many each has, and each chunk's form."""
        # The tokenizer composes letters before it lowers them, so only chunks without others are lowered here;
        # and lower case can turn marks into control tokens.
        safe = pc.and_(pc.string_is_ascii(chunks), pc.invert(pc.match_substring(chunks, "<|")))
        forms = pc.if_else(safe, pc.ascii_lower(chunks), chunks).dictionary_encode()
        distinct = forms.dictionary.cast(pa.binary()).to_pylist()
        self.learn(distinct)
        found = [self.known[c] for c in distinct]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), sizes, forms.indices.to_numpy(zero_copy_only=False)

    def learn(self, chunks: list[bytes]) -> None:
        """Makes the ids of all of the different ``chunks`` known."""
        if len(self.known) > CACHED_CHUNKS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        words, others, marked = set(), set(), []
        for c in chunks:
            if c in known:
                continue
            if c in older:
                known[c] = older[c]
                continue
            word = c.strip(MARKS)
            if not (word.isalpha() if word.isascii() else self._is_word(word, len(word) < len(c))):
                others.add(c)
                continue
            words.add(word)
            if len(word) < len(c):
                left, _, right = c.partition(word)
                others.update((left, right))
                marked.append((c, left, word, right))
        self._encode_words([w for w in words if w not in known])
        self._encode_each([c for c in others if c not in known])
        known.update((c, known[left] + known[word] + known[right]) for c, left, word, right in marked)

    @staticmethod
    def _is_word(word: bytes, marked: bool) -> bool:
        """Letters alone. Beside marks only Latin ones: others may decompose into a letter and one more mark."""
        text = word.decode()
        return text.lower().isalpha() and (not marked or max(text) <= LAST_LATIN)

    def _encode_words(self, words: list[bytes]) -> None:
        known, merged, foreign = self.known, self.tokenizer.model.tokenize, []
        spelt = [(w, w.decode()) for w in words if w.isascii()]
        others = [w for w in words if not w.isascii()]
        for k in range(0, len(others), WORDS_PER_CALL):
            block = others[k : k + WORDS_PER_CALL]
            normal = self.tokenizer.normalizer.normalize_str(b" ".join(block).decode()).split(" ")
            for word, form in zip(block, normal):
                if max(form) <= LAST_LATIN and form.isalpha():
                    spelt.append((word, form.encode().decode("latin-1").translate(self.letters)))
                else:
                    foreign.append(word)
        for word, letters in spelt:
            ids = [t.id for t in merged(letters)]
            known[word] = pack(FORMATS[len(ids)] if len(ids) < len(FORMATS) else f"<{len(ids)}I", *ids)
        for k in range(0, len(foreign), WORDS_PER_CALL):
            self._encode_joined(foreign[k : k + WORDS_PER_CALL])

    def _encode_joined(self, words: list[bytes]) -> None:
        ids = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids
        ids = np.array(ids, "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words):  # a letter that the tokenizer takes apart
            self._encode_each(words)
            return
        packed, ends = ids.tobytes(), (4 * ends).tolist()
        self.known.update((w, packed[a:b]) for w, a, b in zip(words, [0, *ends], ends))

    def _encode_each(self, chunks: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False) if chunks else []
        self.known.update((c, pack(f"<{len(e.ids)}I", *e.ids)) for c, e in zip(chunks, found))


class Writer:
    """Writes one file."""

    def __init__(self, folder: str):
        self.out = Output(folder, ".ids.zst")
        self.pack = zstandard.ZstdCompressor(level=1)
        self.frame, self.frames, self.documents, self.ids = bytearray(), [], [], 0

    def add(self, doc_id: int | None, parts: Iterator[bytes]) -> None:
        start = self.ids
        for part in parts:
            self.frame += part
            self.ids += len(part) // 4
            while len(self.frame) >= 4 * FRAME_IDS:
                self._close_frame(4 * FRAME_IDS)
        self.documents.append((NO_ID if doc_id is None else doc_id, start, self.ids - start))

    def _close_frame(self, size: int) -> None:
        plain = bytes(self.frame[:size])
        del self.frame[:size]
        packed = self.pack.compress(plain)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.out.write(packed)

    def close(self) -> tuple[str, int, int]:
        if self.frame:
            self._close_frame(len(self.frame))
        table = self.pack.compress(np.array(self.documents, "<i8").tobytes())
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        for magic, data in ((SKIPPABLE_DOCUMENTS, table), (SKIPPABLE_SEEK_TABLE, seek)):
            self.out.write(struct.pack("<II", magic, len(data)) + data)
        return self.out.close(), self.ids, len(self.documents)


class Reader:
    """Reads single documents of one file by its tables."""

    def __init__(self, uri: str):
        self.file = open_input(uri, seekable=True)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = size - 9 - 12 * frames
        self.frames = np.frombuffer(self._at(table, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed_ends, self.plain_ends = np.cumsum(self.frames[:, 0]), np.cumsum(self.frames[:, 1])
        start = int(self.packed_ends[-1]) if frames else 0
        magic, length = struct.unpack("<II", self._at(start, 8))
        if magic != SKIPPABLE_DOCUMENTS:
            raise ValueError("no document table")
        self.unpack = zstandard.ZstdDecompressor()
        self.documents = np.frombuffer(self.unpack.decompress(self._at(start + 8, length)), "<i8").reshape(-1, 3)
        self.held = (-1, b"")

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def _frame(self, k: int) -> bytes:
        if self.held[0] != k:
            packed, plain, checksum = self.frames[k].tolist()
            data = self.unpack.decompress(self._at(int(self.packed_ends[k]) - packed, packed), max_output_size=plain)
            if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {k} differs from its checksum")
            self.held = (k, data)
        return self.held[1]

    def ids(self, start: int, n: int) -> Iterator[bytes]:
        """Packed ids from ``start`` on, frame by frame."""
        a, b = 4 * start, 4 * (start + n)
        for k in range(int(np.searchsorted(self.plain_ends, a, side="right")), len(self.frames)):
            low = int(self.plain_ends[k] - self.frames[k, 1])
            if low >= b:
                break
            yield self._frame(k)[max(a - low, 0) : b - low]


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` and returns one row per file: part, file, uri, n_ids, n_docs.

    Files in the order of (part, file) hold the documents in the order of doc_id.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()  # an encoder learns from task to task
        encoder = cache[path] = cache.get(path) or ChunkEncoder(path)
        writer, number, end = None, 0, np.array([end_id], "<u4").tobytes()

        def closed(part: int) -> pa.RecordBatch:
            uri, ids, n = writer.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([number], pa.int32()), "uri": [uri], "n_ids": [ids], "n_docs": [n]})

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else None
            for doc_id, parts in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text"))):
                writer = writer or Writer(folder)
                writer.add(doc_id, _ended(parts, end))
                if writer.ids >= FILE_IDS:
                    yield closed(part)
                    writer, number = None, number + 1
        if writer:
            yield closed(part)

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    numbered = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))
    return stored(numbered.mapInArrow(task, "part int, file int, uri string, n_ids bigint, n_docs bigint"))


def _ended(parts: Iterator[bytes], end: bytes) -> Iterator[bytes]:
    yield from parts
    yield end


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids in all files before. One row per file goes through the window."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, read from the files of a ``placed`` manifest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("uri").to_pylist(), batch.column("ids_before").to_pylist()):
                reader = Reader(uri)
                for k in range(0, len(reader.documents), 10_000):
                    ids, starts, sizes = reader.documents[k : k + 10_000].T
                    sums = []
                    for start, n in zip(starts.tolist(), sizes.tolist()):
                        crc = 0
                        for part in reader.ids(start, n):
                            crc = zlib.crc32(part, crc)
                        sums.append(crc)
                    given = pa.array(ids.tolist(), pa.int64(), mask=ids == NO_ID)
                    yield pa.RecordBatch.from_arrays([given, pa.array(starts + before), pa.array(sizes), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = one_file_a_task(manifest.select("part", "file", "uri", "ids_before"), "part", "file")
    return files.mapInArrow(task, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def fetch(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and packed ids of single documents; only the frames that hold them are decompressed."""
    wanted = np.array(sorted(doc_ids), np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                reader = Reader(uri)
                for i, start, n in reader.documents[np.isin(reader.documents[:, 0], wanted)].tolist():
                    yield pa.RecordBatch.from_pydict({"doc_id": [i], "ids": [b"".join(reader.ids(start, n))]})

    return one_file_a_task(manifest.select("uri"), "uri").mapInArrow(task, "doc_id bigint, ids binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Writes the ids of ``docs`` and returns what the files say of each document."""
    return read(placed(write(docs, new_folder(docs.sparkSession, "token-ids"), path)))
