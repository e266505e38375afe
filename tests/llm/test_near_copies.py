"""Near copies of the pipeline against all pairs of shingle sets."""

import random

import pytest
from attesta.llm import nearcopies, simhash
from test_text_rules import DOCS, classes, near_texts, prose


def shingle_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def changed_texts():
    """Copies with one to four words changed in runs and apart, on both sides of similarity 0.8."""
    r = random.Random(11)
    out = near_texts()
    for _ in range(12):
        words = prose(r, 100).split(" ")
        for n in (1, 2, 3, 4):
            for step in (1, 20):
                copy = list(words)
                for k in range(n):
                    copy[8 + k * step] = f"new{r.randrange(9**9)}"
                out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("part_shingles", [300, 2_000_000])
def test_classes_are_those_of_all_pairs(spark, part_shingles):
    texts = changed_texts()
    sets = [shingle_set(t) for t in texts]
    want = classes(range(len(texts)), lambda a, b: alike(sets[a], sets[b]))
    docs = spark.createDataFrame([(k, t, "en", "clash") for k, t in enumerate(texts)], DOCS)
    found = {x.doc_id: x.root for x in nearcopies.classes(docs, part_shingles).collect()}
    least = {}
    for k in sorted(found):
        least.setdefault(found[k], k)
    assert {k: least[found[k]] for k in found} == want


def test_a_copy_beyond_three_bits_goes(spark):
    words = prose(random.Random(5), 100).split(" ")
    texts = [" ".join(words), " ".join([*words[:40], "one", "two", "three", "four", *words[44:]])]
    a, b = map(simhash.fingerprint, texts)
    assert ((a ^ b) % 2**64).bit_count() > 3 and alike(*map(shingle_set, texts))
    kept = simhash.keep_one(spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)], DOCS))
    assert [x.doc_id for x in kept.collect()] == [0]


def test_simhash_comes_first(spark, monkeypatch):
    """Copies within three bits are linked without any band; those beyond are left to the bands."""
    r = random.Random(3)
    words = prose(r, 400).split(" ")
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words[:100], "a1", "b2", "c3", *words[103:200], "d4", "e5", "f6", *words[203:]]), prose(r, 300)]
    docs = spark.createDataFrame([(k, t, None, None) for k, t in enumerate([*texts, texts[0], None, ""])], DOCS)
    fp = {x.doc_id: x.fp for x in nearcopies.sketches(docs).collect()}
    apart = [((fp[0] ^ fp[k]) % 2**64).bit_count() for k in range(7)]
    assert apart[1] <= 3 < min(apart[2], apart[3]) and apart[4] == 0 and fp[5] == fp[6] == 0
    both = {x.doc_id: x.root for x in nearcopies.classes(docs).collect()}
    assert both[0] == both[1] == both[2] == both[4] != both[3] and both[5] == both[6]
    monkeypatch.setattr(nearcopies, "band_keys", lambda found, odd: [])
    alone = {x.doc_id: x.root for x in nearcopies.classes(docs).collect()}
    assert alone[0] == alone[1] == alone[4] and len({alone[k] for k in (0, 2, 3, 5)}) == 4
