"""SimHash, decontamination, quality rules, language and chat formatting against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from attesta.llm import chat, decontam, graph, langid, quality, simhash
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, fp string"
WORDS = "of the and in that with for this then over under river stone green bright seven walking slowly house garden window".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {n: find(n) for n in nodes}


def near_texts():
    r = random.Random(8)
    out = [None, "", "one", "ONE", "two words"]
    for _ in range(25):
        text = prose(r, 120)
        out += [text, text, text.upper()]
        for _ in range(3):
            w = text.split(" ")
            w[r.randrange(120)] = "changed"
            out.append(" ".join(w))
    return out


def test_simhash_classes(spark):
    texts = near_texts()
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame([(k, t, "en", "clash") for k, t in enumerate(texts)], DOCS)).collect()}
    fps = {k: slow_fingerprint(t) for k, t in enumerate(texts)}
    want = classes(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {k: r.fp % 2**64 for k, r in got.items()} == fps
    assert {k: r.component_id for k, r in got.items()} == want


@pytest.mark.parametrize("tree_nodes", [5, 10_000])
def test_links_lose_no_class(spark, tree_nodes):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**64, 40, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for _ in range(4)]
    fps = np.unique(np.concatenate([base, *flips])).astype(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), tree_nodes=tree_nodes)
    found = {x.node: x.root for x in graph.components(edges, "a", "b").collect()}
    want = classes(sorted(fps), lambda a, b: ((a ^ b) % 2**64).bit_count() <= 3)
    assert {f: found.get(f, f) for f in fps} == want


def test_components_of_a_chain_and_of_nothing(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(5, 5), (100, 99)], "a bigint, b bigint")
    assert {r.root for r in graph.components(edges, "a", "b").where("node <= 60").collect()} == {0}
    assert graph.components(edges.where("a < 0"), "a", "b").count() == 0


def test_one_of_each_class_stays(spark):
    rows = [(4, "a b c d", "en", None), (2, "A b c d", "de", None), (2, "A b c d", "de", None), (None, "a B c d", "en", None), (9, "q r s t u v", None, None), (None, None, None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "fp"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(2, "A b c d"), (9, "q r s t u v")]
    assert kept.count() == 3
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def slow_overlap(doc, item):
    a, b = (["".join(w) for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()] for x in (doc, item))
    best = None
    for k in range(-len(b), len(a) + 1):
        same = [a[k + j] == w for j, w in enumerate(b) if 0 <= k + j < len(a)]
        wide = any(sum(same[s : s + 13]) >= 11 for s in range(len(same) - 12))
        if wide or (8 <= len(b) < 13 and len(same) == len(b) and same.count(False) <= (len(b) >= 10)):
            best = max(best or 0, sum(same))
    return len(b) if a == b and 0 < len(b) < 8 else best


@pytest.mark.parametrize("block_tokens", [30, 10_000])
def test_decontamination(spark, block_tokens):
    r = random.Random(4)
    items = [prose(r, n) for n in (7, 8, 12, 13, 14, 30, 60)] + [None, ""]
    docs = [None, "", "short"]
    for item in items[:7]:
        w = item.split()
        for changes in (0, 1, 2, 4):
            v = list(w)
            for k in r.sample(range(len(v)), min(changes, len(v))):
                v[k] = "Other"
            docs.append(prose(r, r.randint(0, 30)) + " " + " ".join(v).upper() + " " + prose(r, r.randint(0, 30)))
        docs.append(" ".join(w[: len(w) // 2]))
    table = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(docs)], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.n_equal for x in decontam.overlaps(table, bench, block_tokens).collect()}
    want = {(i, j): n for i, d in enumerate(docs) for j, t in enumerate(items) if (n := slow_overlap(d, t))}
    assert got == want and len(want) > 15
    clean = decontam.clean(table, bench)
    assert {x.doc_id for x in clean.collect()} == set(range(len(docs))) - {i for i, _ in want} and clean.columns == table.columns


def test_short_items(spark):
    """Every single substitution in items of 8 to 12 tokens, and texts that are, or only hold, an item under 8 tokens."""
    r = random.Random(9)
    items = [[f"w{n}x{k}" for k in range(n)] for n in range(1, 13)]
    docs, want = [], set()
    for j, item in enumerate(items):
        n = len(item)
        docs.append(" ".join(item).upper() + "!")  # the text is the item
        want.add((len(docs) - 1, j))
        docs.append("before " + " ".join(item) + " after")
        want |= {(len(docs) - 1, j)} if n >= 8 else set()
        for k in range(n):
            changed = " ".join(item[:k] + ["other"] + item[k + 1 :])
            docs += [f"some lead {changed} and more", changed]
            want |= {(len(docs) - 2, j), (len(docs) - 1, j)} if n >= 10 else set()
        docs.append(" ".join(item[1:]))  # all but the first
    docs += docs[:3]  # repeated rows
    want |= {(len(docs) - 3 + i, j) for i, j in list(want) if i < 3}
    table = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(j, " ".join(item)) for j, item in enumerate(items)] + [(90, ""), (91, None), (0, "w1x0")], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.overlaps(table, bench).collect()} == want
    long = prose(r, 30_000) + " " + " ".join(items[9]) + " " + prose(r, 10)
    assert decontam.clean(spark.createDataFrame([(1, long, None, None)] * 2 + [(2, prose(r, 30_000), None, None)], DOCS), bench).select("doc_id").collect() == [(2,)]


def test_decontamination_without_benchmark_and_with_null_ids(spark):
    bench = spark.createDataFrame([(1, " ".join(WORDS))], "item_id bigint, text string")
    docs = spark.createDataFrame([(None, " ".join(WORDS), None, None), (None, "clean", None, None)], DOCS)
    assert [r.text for r in decontam.clean(docs, bench).collect()] == ["clean"]
    assert decontam.clean(docs, bench.where("item_id < 0")).count() == 2


def test_large_benchmark_goes_to_no_task_whole(spark):
    """Above its limit a benchmark is dealt out, the texts are read as often for any number of items, and copies of an item count once."""
    r = random.Random(12)
    items = [prose(r, 20) for _ in range(40)]
    texts = [None, "", *(f"{prose(r, 30)} {item} {prose(r, 30)}" for item in items[::4]), prose(r, 400)]
    docs = spark.createDataFrame([(k % 9 or None, t, None, None) for k, t in enumerate(texts + texts[:5])], DOCS)
    bench = spark.createDataFrame([(k, item) for k, item in enumerate(items * 3)], "item_id bigint, text string")
    rows = lambda found: sorted(map(tuple, found.collect()), key=str)
    plan = lambda found: found._jdf.queryExecution().optimizedPlan().toString()
    few, dealt, near = decontam.overlaps(docs, bench.limit(10), 40), decontam.overlaps(docs, bench, 40), decontam.overlaps(docs, bench, 801)
    assert rows(dealt) == rows(near) and len(rows(near)) >= 30
    assert "strategy=broadcast" not in plan(dealt) and "strategy=broadcast" in plan(near)  # 2 400 places, but 800 of different items
    assert plan(few).count("Join") == plan(dealt).count("Join")


def test_filter_holds_every_hash(spark):
    hashes = spark.range(-2_000, 2_000).select(F.xxhash64("id").alias("h"))
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("v"))
    assert hashes.toDF("v").where(decontam._held(hashes, 4_000, "v")).count() == 4_000
    assert others.where(decontam._held(hashes, 4_000, "v")).count() < 200


def slow_repeats(words):
    seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    return len({k + j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(5)})


def test_quality_counts_and_order_free_verdict(spark):
    r = random.Random(6)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 40, "### " * 20, "SHOUT NOW!! " * 3 + prose(r, 5)]
    texts += [prose(r, r.randint(1, 60)) + "\n" + prose(r, 4) * r.randint(0, 3) for _ in range(40)] + [(prose(r, 30) + "\n") * 3]
    rows = [(k, t, None, None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    rules = quality.default_rules()
    got = {x.doc_id: x for x in quality.judged(docs).collect()}
    for k, t in enumerate(texts):
        words = (t or "").split()
        assert (got[k].n_words, got[k].n_repeat_words) == (len(words), slow_repeats(words))
        assert got[k].word_chars == sum(map(len, words)) and got[k].n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        own = [x for x in (t or "").split("\n") if x.strip()]
        assert got[k].n_dup_lines == len(own) - len(set(own))
        assert got[k].base_failed == (len(words) < 10 or 100 * slow_repeats(words) > 20 * len(words))
    for order in (rules, rules[::-1]):
        again = {x.doc_id: x.ok for x in docs.select("doc_id", quality.verdict(order).alias("ok")).collect()}
        assert all(got[k].kept == (again[k] and not got[k].base_failed) for k in got)
    assert sorted(x.doc_id for x in quality.kept(docs).collect()) == sorted(k for k in got if got[k].kept)
    assert quality.kept(docs).columns == docs.columns
    assert quality.kept(docs.limit(0)).count() == 0


def test_cheap_rejections_come_first(spark):
    docs = spark.range(2_000).selectExpr("id AS doc_id", "repeat('word ', 50) AS text")
    from pyspark.sql import functions as F

    never = quality.Rule("never", F.size(F.array_distinct(F.split("text", ""))) > 1_000)
    always = quality.Rule("always", F.length("text") > 0)
    assert [x.name for x in quality.ordered(docs, [never, always])] == ["always", "never"]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F

    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = langid.identify(docs, langid.train(docs, ~held_out)).where(held_out).collect()
    assert sum(x.lang == x.lang_pred for x in found) / len(found) > 0.98
    assert all(zlib.crc32(str(x.doc_id).encode()) % 4 == 2 and 0 <= x.score <= 1 for x in found)


def test_language_edges(spark):
    rows = [(k, t, lang, None) for k, (t, lang) in enumerate([("the house", "en"), ("das haus", "de"), (None, "en"), ("12 ! 3", None), ("", "de"), ("the the house " * 9, None)])]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    model = langid.train(docs, F.lit(True))
    got = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert [got[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and got[5].lang_pred == "en" and got[3].score == 0
    none = langid.train(docs.where("lang = 'xx'"), F.lit(True))
    assert {x.lang_pred for x in langid.identify(docs, none).collect()} == {"und"}
    one = langid.train(docs.where("lang = 'en'"), F.lit(True))
    assert {x.lang_pred for x in langid.identify(docs.where("doc_id < 2"), one).collect()} == {"en"}


def test_repeats_of_few_words_and_in_long_texts(spark):
    """Few different words, and a long text with one repeat at its end."""
    r = random.Random(2)
    texts = [" ".join(r.choice("ab") for _ in range(n)) for n in (30, 80, 300)] + [" ".join(str(r.randrange(10**6)) for _ in range(5_000)) + " a b c d e f a b c d e"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    found = quality.with_repeats(docs.withColumn("w", quality.words()), "w", "n")
    assert {r.doc_id: r.n for r in found.collect()} == {k: slow_repeats(t.split()) for k, t in enumerate(texts)}


def test_chat_and_quality_with_clashing_columns(spark):
    rows = [(1, 0, "user", "a <|im_end|> b", "p", 3), (1, 1, "assistant", "x" * 60_000, "q", 4), (1, 1, "assistant", "x" * 60_000, "q", 4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, plain string, place int")
    assert chat.format_conversations(turns).select("verified").collect() == [(True,)]
    got = chat.read_back(chat.format_conversations(turns)).first()
    assert (got.n_turns, got.loss_chars) == (3, 120_000)
    docs = spark.createDataFrame([(1, "a " * 50_000 + "end", 7, "old")] * 2, "doc_id long, text string, n_words int, kept string")
    assert [(r.n_words, r.n_repeat_words, r.kept) for r in quality.judged(docs).collect()] == [(50_001, 50_000, False)] * 2


def test_chat_query_takes_more_columns(spark, tmp_path):
    from attesta.llm import queries

    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    table.selectExpr("*", "'x' AS plain", "1 AS place").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op10_chat(spark, str(tmp_path)).count() == table.select("conv_id").distinct().count() + 1


def test_repeated_rows_are_learnt_once(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    once, twice = (langid.train(d, F.lit(True), 40) for d in (docs, docs.union(docs)))
    assert once.languages == twice.languages == sorted(x.lang for x in docs.select("lang").distinct().collect() if x.lang)
    assert (once.weights == twice.weights).all()
    rows = [(1, "the house", "en"), (1, "a garden", "en"), (None, "das haus", "de"), (None, "das haus", "de")]
    assert langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True)).languages == ["de", "en"]


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    text, letters = "Das ist, ein Haus! " * 50, langid.letter_table()
    whole = langid.ngram_counts(text, letters)
    monkeypatch.setattr(langid, "CHARS_PER_BLOCK", 7)
    assert (langid.ngram_counts(text, letters) == whole).all()


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20])
def test_codewords_are_apart(n):
    words = langid.codewords(n)
    apart = min((words[i] != words[j]).sum() for i in range(n) for j in range(i))
    assert apart >= max(1, words.shape[1] // 4)


TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_chat_round_trip(spark):
    marks = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<|", "<\\\\|", "\n", "x", "é", "assistant\n", "|>", "<"]
    r = random.Random(9)
    rows = []
    for conv in range(150):
        for turn in range(r.randint(1, 6)):
            role = r.choice(["user", "assistant", "system", None, "a\nb", "%0A<|im_end|>"])
            rows.append((conv, turn, role, r.choice([None, "".join(r.choice(marks) for _ in range(r.randint(0, 6)))])))
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (900, None, "assistant", "b"), (900, None, "assistant", "a")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    assert formatted.where("NOT verified").count() == 0
    got = {x.conv_id: x for x in chat.read_back(formatted).collect()}
    for conv in {x[0] for x in rows}:
        own = sorted(((t is not None, t, ro or "", te or "") for c, t, ro, te in rows if c == conv), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        whole = "".join(f"{ro}\n{te}\n" for *_, ro, te in own)
        loss = "".join(te for *_, ro, te in own if ro == "assistant")
        x = got[conv]
        assert (x.n_turns, x.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_escapes_only_conflicts(spark):
    rows = [(1, 0, "user", "a < b | c"), (1, 1, "assistant", "fine"), (2, 0, "user", chat.PROBE)]
    got = {x.conv_id: x for x in chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert (got[1].escaped, got[2].escaped) == (False, True)
    assert got[1].formatted == "<|im_start|>user\na < b | c<|im_end|>\n<|im_start|>assistant\nfine<|im_end|>\n"
    span = got[1].loss_spans[0]
    assert got[1].formatted[span.start : span.start + span.length] == "fine"
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def _slow_languages(rows, per_language, limit):
    """Sample, counts, classifiers and decoding of ``langid``, written out row by row in double precision."""
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    pool = {}
    for doc, text, lang in rows:
        if lang is not None and text is not None:
            start = 42 if doc is None else xxhash.xxh64(str(doc).encode(), seed=42).intdigest()
            pool.setdefault(lang, {})[signed(xxhash.xxh64(text.encode(), seed=start).intdigest())] = text
    dealt = sorted((place, lang, text) for lang, texts in pool.items() for place, (_, text) in enumerate(sorted(texts.items())) if place < per_language)
    dealt = dealt[:limit]
    languages = sorted({lang for _, lang, _ in dealt})

    def shares(text):
        counts, cut = {}, 2**32
        codes = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()]
        for i, c in enumerate(codes):
            if c:
                b = codes[i - 1] if i else 0
                a = codes[i - 2] if b and i > 1 else 0
                one = c * 0x9E3779B1 % cut
                two = (one ^ (b + 1)) * 0x85EBCA6B % cut
                three = (two ^ (a + 3)) * 0xC2B2AE35 % cut
                for h in (one, two, three):
                    counts[h >> 20] = counts.get(h >> 20, 0) + 1
        out = np.zeros(4096)
        for place, n in counts.items():
            out[place] = (n / sum(counts.values())) ** 0.5
        return out

    n = len(languages)
    bits = [[1] + [-1 if k >> i & 1 else 1 for i in range(n - 1)] for k in range(1, 2 ** (n - 1))]
    x = np.array([shares(text) for _, _, text in dealt])
    weight = np.array([1 / n / sum(other == lang for _, other, _ in dealt) for _, lang, _ in dealt])
    fitted = []
    for bit in bits:
        y = np.array([bit[languages.index(lang)] for _, lang, _ in dealt])
        w, b, v, u = np.zeros(4096), 0.0, np.zeros(4096), 0.0
        for _ in range(300):
            pull = -y * weight / (1 + np.exp(y * (x @ w + b)))
            v, u = 0.9 * v + x.T @ pull + 1e-4 * w, 0.9 * u + pull.sum()
            w, b = w - 4 * v, b - 4 * u
        fitted.append((bit, w, b, max(2 * weight[y * (x @ w + b) > 0].sum() - 1, 0.01)))
    trust = sum(t for *_, t in fitted)

    def predict(text):
        if not any(c.isalpha() for c in (text or "").lower()):
            return "und", 0.0
        f = shares(text)
        loss = [sum(t / trust * np.log1p(np.exp(-bit[i] * (f @ w + b))) for bit, w, b, t in fitted) for i in range(n)]
        near = [np.exp(-len(bits) * (v - min(loss))) for v in loss]
        return languages[near.index(max(near))], max(near) / sum(near)

    return predict


def test_languages_against_a_slow_version(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()] + [(None, "Zwei kurze W\u00f6rter", "de"), (-1, None, "fr"), (-2, "1 2 3", None), (-3, "\u0130stanbul " * 9, None)]
    rows += rows[:40] + [(-4, "ha " * 40_000, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("of the table"))
    for per_language, limit in ((25, 1_000), (25, 22)):
        predict = _slow_languages(rows, per_language, limit)
        got = langid.identify(table, langid.train(table, F.lit(True), per_language, limit)).collect()
        assert len(got) == len(rows)
        for r in got:
            lang, score = predict(r.text)
            assert abs(r.score - score) < 0.01 and (r.lang_pred == lang or r.ambiguous)


def test_equally_near_languages(spark):
    model = langid.CodeModel.fit(["b", "a", "c"], np.zeros((3, langid.BUCKETS), np.uint32))
    model.weights[:], model.bias[:] = 0, 0  # no bit leans to any language
    assert model.predict("any text")[0] == "a" and model.predict("any text")[2]
