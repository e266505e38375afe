"""BPE, token files and WARC archives: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from attesta.llm import bpe, files, tokenfile, warc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "'s", " ", "\n", "\t", "\xa0", "é", "1", "!", "　", "<|endoftext|>", "th", "é", "\x1c", "Ü", "語", "😀"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts(n, seed=3):
    r = random.Random(seed)
    return ["", None, "a" * 5_000, " " * 300] + ["".join(r.choice(ODD) for _ in range(r.randint(0, 20))) for _ in range(n)]


def test_bpe_is_the_librarys(spark):
    texts, lib = odd_texts(400), library(BYTE_BPE)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, ids_sha256 string")
    got = {r.doc_id: r for r in bpe.round_trip(docs, BYTE_BPE).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        back = lib.decode(ids, skip_special_tokens=False)
        want = (k, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert tuple(got[k]) == want, t


def test_bpe_of_a_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "CHARS_PER_BLOCK", 50)
    monkeypatch.setattr(bpe, "WORDS_PER_BLOCK", 7)
    monkeypatch.setattr(bpe, "CACHED_BYTES", 500)
    lib, own = library(BYTE_BPE), bpe.TextEncoder(bpe.Vocabulary.from_file(BYTE_BPE))
    texts = ["of the ananthe ingest  those,\n\n 12 words " * k for k in range(1, 9)]
    for text, made in zip(texts, own.encode_all(texts)):
        assert np.frombuffer(made, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_bpe_empty_table_and_kept_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    coded = bpe.encode(docs, BYTE_BPE)
    assert coded.columns == ["doc_id", "lang", "ids"] and coded.count() == 0


def token_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    return tokenfile.round_trip(docs, WORD_BPE).collect()


def test_token_files_hold_every_document(spark, monkeypatch):
    texts, lib = odd_texts(300), library(WORD_BPE)
    got = {r.doc_id: r for r in token_rows(spark, [(k * 3, t, None) for k, t in enumerate(texts)])}
    start = 0
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(got[3 * k]) == (3 * k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_decomposed_capitals_have_the_librarys_ids():
    lib, own = library(WORD_BPE), tokenfile.ChunkEncoder(WORD_BPE)
    for pair in ("H\u0331", "J\u030c", "T\u0308", "T\u0344", "W\u030a", "Y\u030a"):
        for text in (pair, f"The {pair}x, {pair}. Y{pair} <| {pair}", f"THE End {pair}"):
            assert np.frombuffer(b"".join(own.encode(text)), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, ascii(text)


def test_chunks_have_the_librarys_ids(monkeypatch):
    """Words with marks, digits, apostrophes, foreign and exotic letters, control tokens, and caches that overflow."""
    lib, own = library(WORD_BPE), tokenfile.ChunkEncoder(WORD_BPE)
    monkeypatch.setattr(tokenfile, "CACHED_CHUNKS", 60)
    monkeypatch.setattr(tokenfile, "BLOCK_BYTES", 200)
    monkeypatch.setattr(tokenfile, "CHUNKS_PER_BLOCK", 25)
    monkeypatch.setattr(tokenfile, "WORDS_PER_CALL", 3)
    pieces = ["word", "Été", "straße", "don't", "'s", "it's", "(see", "[a]", '"quoted"', "3.5", "a1b", "क़", "İstanbul", "Ωmega", "слово", "語彙", "ǅ", "ﬁn", "é",
              "***", "x--y", "_x_", "<|endoftext|>", "<|x", "ñ%%%", "𐐀", "ŉ", "ª", "", "q", "$$$.", "mañana,&&&", "ẞ", "ͅ", "aͅ", " ", "ab"]
    r = random.Random(4)
    texts = pieces + ["".join(r.choice(pieces) + r.choice([" ", "", "\n", "."]) for _ in range(r.randint(1, 60))) for _ in range(300)]
    for text, parts in zip(texts, own.encode_all(pa.array(texts))):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, ascii(text)


def test_a_task_reads_a_few_files(spark, monkeypatch):
    """40 small files: adaptive execution must not pack them into one task."""
    monkeypatch.setattr(tokenfile, "FILE_IDS", 10)
    docs = spark.createDataFrame([(k, "a b c " * 4) for k in range(40)], "doc_id bigint, text string")
    manifest = tokenfile.placed(tokenfile.write(docs, files.new_folder(spark, "t"), WORD_BPE)).cache()
    assert manifest.count() == 40
    found = tokenfile.read(manifest).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert max(r["count"] for r in found) <= 3 and sum(r["count"] for r in found) == 40


def test_token_files_null_and_repeated_ids(spark):
    got = token_rows(spark, [(None, "a b", None), (7, "a", None), (7, "a", None), (7, None, None)])
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in got if r.doc_id) == [(False, 7, 1), (False, 7, 2), (False, 7, 2)]
    assert sorted(r.start for r in got) == [0, *np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()]
    assert token_rows(spark, []) == []


def test_single_documents_and_damage(spark, tmp_path):
    writer = tokenfile.Writer(str(tmp_path))
    many = np.arange(3 * tokenfile.FRAME_IDS, dtype="<u4").tobytes()
    writer.add(1, iter([b"\1\0\0\0"]))
    writer.add(2, iter([many]))
    writer.add(3, iter([b"\3\0\0\0"]))
    uri, ids, n = writer.close()
    reader = tokenfile.Reader(uri)
    assert (ids, n) == (len(many) // 4 + 2, 3) and len(reader.frames) == 4
    assert b"".join(reader.ids(1, len(many) // 4)) == many
    manifest = spark.createDataFrame([(uri,)], "uri string")
    assert [(r.doc_id, bytes(r.ids)) for r in tokenfile.fetch(manifest, [3]).collect()] == [(3, b"\3\0\0\0")]
    reader.frames[0, 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(reader.ids(0, 1))


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")


def test_archives_round_trip(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcé\r\n<") for _ in range(3 * warc.SEGMENT_BYTES))
    htmls = ["x", long, "", None, "y", "x", long, "x", "0\r\n\r\n"]
    pages = pages_of(spark, [(k, None if k == 4 else f"http://a/{k}\n", h, "clash") for k, h in enumerate(htmls)])
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for k, h in enumerate(htmls):
        first = next(i for i, x in enumerate(htmls) if (x or "") == (h or ""))
        data = (h or "").encode()
        want = (k, len(data), warc.sha1_base32(data), "response" if first == k else "revisit", None if first == k else first, None)
        assert tuple(got[k]) == want
    only_long = {r.page_id: r.record_type for r in warc.round_trip(pages, least_bytes=100).collect()}
    assert [k for k, t in only_long.items() if t == "revisit"] == [6]


def test_archives_of_no_pages_equal_ids_and_null_ids(spark):
    assert warc.round_trip(pages_of(spark, [])).count() == 0
    got = warc.round_trip(pages_of(spark, [(1, "u", "a", ""), (1, "u", "a", ""), (2, "u", "a", ""), (None, "u", "a", "")])).collect()
    assert sorted((r.page_id or 9, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (1, "response", None), (2, "revisit", 1), (9, "revisit", 1)]


def test_archives_are_opened_once_by_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 1_000)
    long = "".join(random.Random(1).choice("abcdef") for _ in range(2 * warc.SEGMENT_BYTES))
    pages = pages_of(spark, [(k, "u", f"{k}{long}" if k % 5 == 0 else "x" * k, None) for k in range(60)])
    manifest = warc.write(pages, files.new_folder(spark, "w"))
    n = manifest.count()
    read = warc.read_records(manifest)
    tasks = read.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert n >= 10 and tasks >= n / 2
    opened = spark.sparkContext.accumulator(0)
    counted = read.rdd.mapPartitions(lambda rows: (opened.add(1), rows)[1]).toDF(read.schema)
    found = warc.reassemble(counted, payloads=False)
    assert sorted(int(r.page_id) for r in found.collect()) == list(range(60)) and {r.fault for r in found.collect()} == {None}
    assert opened.value == counted.rdd.getNumPartitions()  # read once, however often the result is asked for


def test_broken_segments_are_told(spark, tmp_path):
    page = {"page_id": 1, "url": "u", "html": "z" * 3 * warc.SEGMENT_BYTES, "payload_bytes": 3 * warc.SEGMENT_BYTES, "revisit": False, "payload_digest": warc.sha1_base32(b"z" * 3 * warc.SEGMENT_BYTES)}
    parts = list(warc.page_records(page))
    faults = []
    for kept in (parts, parts[::-1], parts[:1] + parts[2:], parts[:-1]):
        out = files.Output(str(tmp_path), ".warc.gz")
        for data in kept:
            out.write(data)
        read = warc.reassemble(warc.read_records(spark.createDataFrame([(out.close(),)], "uri string")))
        faults += [r.fault for r in read.collect()]
    assert faults == [None, None, "segments are missing or repeated", "the total length differs"]


def test_chunk_framing():
    assert warc.dechunked(warc.chunked(b"abc" * 9_999)) == b"abc" * 9_999
    assert warc.dechunked(b"3;name=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"x\r\n", b"0\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)
