"""Embedding whitening, mixing of sources and the conversation trie against slow versions."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from attesta.llm import mixing, prefixtrie, queries, whitening
from compare import connect, differences

SF = "/root/testdata/sf0.001"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, source string"


@pytest.fixture(params=["one part", "many parts"])
def parts(spark, request):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, str(request.param == "one part").lower())
    yield
    spark.conf.unset(key)


# whitening ---------------------------------------------------------------------------------------


def brute_whitened(vectors: dict) -> dict:
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000 for i, v in vectors.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - fit.mean(axis=0)
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(16, len(total))
    scaled = vecs[:, :k] / np.sqrt(values[:k])
    return {i: (n, int(((n * v - total) ** 2).sum()), (n * v - total) / n @ scaled, values[:k] / values.sum()) for i, v in x.items()}


def check_whitened(spark, vectors: dict, rows: list) -> None:
    want = brute_whitened(vectors)
    found = whitening.whitened(spark.createDataFrame(rows, EMBEDDINGS)).collect()
    assert {r["vec_id"] for r in found} == set(want)
    k = len(next(iter(want.values()))[2])
    assert len({(r["vec_id"], r["component"]) for r in found}) == k * len(want)
    signs = {}
    for r in found:
        n, deviation, w, shares = want[r["vec_id"]]
        c = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] / shares[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
        if abs(w[c]) > 1e-6:
            signs.setdefault(c, set()).add(np.sign(w[c]) * np.sign(r["whitened"]))
            assert abs(abs(r["whitened"]) - abs(w[c])) < 1e-7
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("dim", [2, 5, 40])
def test_whitening_matches_numpy(spark, dim):
    made = np.random.default_rng(dim).normal(size=(120, dim)) * np.linspace(3, 0.3, dim)
    vectors = {i: v.tolist() for i, v in enumerate(made)}
    check_whitened(spark, vectors, [(i, v, 0) for i, v in vectors.items()])


def test_whitening_of_odd_rows(spark):
    made = np.random.default_rng(1).normal(size=(60, 4)) * 2
    vectors = {i: v.tolist() for i, v in enumerate(made)}
    vectors |= {100 + i: vectors[7] for i in range(300)}  # one hot vector counts once
    odd = [(900, None, 1), (901, [1.0, None, 1.0, 1.0], 1), (902, [math.nan] * 4, 1), (903, [math.inf, 0.0, 0.0, 0.0], 1), (904, [], 1), (905, [1.0], 1)]
    check_whitened(spark, vectors, [(i, v, None) for i, v in vectors.items()] + odd)


def test_whitening_of_huge_entries_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1e30, 0.0], 1), (2, [-1e30, 1.0], 1), (3, [0.0, -1.0], None), (3, [0.0, -1.0], None)], EMBEDDINGS)
    found = whitening.whitened(df).collect()
    # The second dimension is 20 orders of magnitude below the first: no component that doubles can tell from none.
    assert len(found) == 4 and {r["n"] for r in found} == {3} and all(math.isfinite(r["whitened"]) for r in found)
    assert {r["deviation"] for r in found if r["vec_id"] is None} == {None}  # beyond 64 bits


def test_whitening_without_variance(spark):
    assert whitening.whitened(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, EMBEDDINGS)).count() == 0
    line = [(i, [float(i), 2.0, 0.5], 0) for i in range(9)]  # one direction alone
    assert {r["component"] for r in whitening.whitened(spark.createDataFrame(line, EMBEDDINGS)).collect()} == {1}


def test_whitening_ignores_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], "a", 1.0, 2) for i in range(9)], "vec_id long, embedding array<double>, x string, w double, n int")
    assert whitening.whitened(df).count() == 18


def test_eigenvectors_of_clustered_and_split_matrices():
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    for values in (np.r_[[5.0] * 6, np.linspace(3, 1, 24)], np.r_[4.0, 4.0 + 1e-12, 4.0 - 1e-12, np.ones(27)], np.r_[1e12, np.logspace(3, -3, 29)]):
        v = basis * values @ basis.T
        v = (v + v.T) / 2
        got, vecs = whitening.principal(v, 16)
        assert np.abs(got - np.sort(values)[::-1][:16]).max() < 1e-12 * values.max()
        assert np.abs(vecs.T @ vecs - np.eye(16)).max() < 1e-12
        assert np.abs(v @ vecs - vecs * got).max() < 1e-12 * values.max()
    got, vecs = whitening.principal(np.diag([2.0, 7.0, 2.0, 0.0]), 4)
    assert got.tolist() == pytest.approx([7, 2, 2, 0]) and np.abs(vecs.T @ vecs - np.eye(4)).max() < 1e-12


def test_products_are_exact_for_large_entries():
    y = np.array([[2**40 + 1, 3], [-(2**40), 2**30]], np.int64)
    assert whitening.products(y).tolist() == [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(2)] for i in range(2)]


# mixing ------------------------------------------------------------------------------------------


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while free := [s for s in order if s not in held]:
        share = (total - sum(held.values())) / sum(weight[s] for s in free)
        above = {s: 3 * sizes[s] for s in free if share * weight[s] >= 3 * sizes[s]}
        if not above:
            return held | {s: share * weight[s] for s in free}
        held |= above
    return held


def check_mix(spark, rows: list, group_rows: int, monkeypatch) -> list:
    monkeypatch.setattr(mixing, "GROUP_ROWS", group_rows)
    found = mixing.mix(spark.createDataFrame(rows, DOCS), ["doc_id", "source"]).collect()
    size = lambda t: len((t or "").replace("\x0b", " ").split()) if (t or "").isascii() else None
    assert sorted((r["doc_id"] or -1, r["size"]) for r in found) == sorted((i or -1, size(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    for s, own in sizes.items():
        mine = [r for r in found if r["source"] == s]
        assert all(r["source_size"] == own and abs(r["target"] - want[s]) < 1e-6 for r in mine)
        assert all(r["taken"] in (r["size"] * k for k in range(4)) for r in mine)
        taken, whole = sum(r["taken"] for r in mine), round(want[s]) // own if own else 0
        assert taken <= round(want[s])
        left = [r["size"] for r in mine if r["size"] and r["copies"] == whole]
        if group_rows >= len(mine) and left and round(want[s]) - whole * own:
            assert min(left) > round(want[s]) - taken  # nothing left out would have fitted
        assert round(want[s]) - taken <= max((r["size"] for r in mine), default=0)
    return sorted((r["doc_id"] or -1, r["taken"]) for r in found)


def mixed_rows() -> list:
    rows = [(i, "w " * (1 + i * i % 41), f"s{i % 5}" if i % 3 else "hot") for i in range(600)]
    rows += [(1000 + i, "long " * 5_000, "long") for i in range(3)] + [(2000, "a b", None), (2001, None, None), (2002, " \t ", "empty"), (None, "x y z", "é")]
    return rows + [(3000, "same row", "rows")] * 50


@pytest.mark.parametrize("group_rows", [4_096, 7])
def test_mixing_meets_targets(spark, group_rows, monkeypatch, parts):
    first = check_mix(spark, mixed_rows(), group_rows, monkeypatch)
    assert first == check_mix(spark, mixed_rows()[::-1], group_rows, monkeypatch)  # in any order


def test_repeated_rows_are_told_apart(spark, monkeypatch):
    rows = [(1, "a b c", "x")] * 400 + [(2, "d " * 900, "y")]
    found = check_mix(spark, rows, 10, monkeypatch)
    taken = sum(t for i, t in found if i == 1)
    assert 700 - 3 < taken <= 700  # a third of 2 100 words


def test_mixing_keeps_columns_and_empty_tables(spark):
    clashing = "doc_id long, text string, source string, budget int, more string, size string, n int, _of int, `a.b` int"
    found = mixing.mix(spark.createDataFrame([(1, "a b", "s", 5, "m", "old", 1, 2, 3)], clashing)).collect()
    assert [tuple(r) for r in found] == [(1, "a b", "s", 5, "m", 1, 2, 3, 2, 2, 2.0, 1, 2)]
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "s"), (None, "", None)], DOCS)).agg({"taken": "sum"}).first()[0] == 0


def test_mixing_of_the_table(spark):
    found = queries.op12_mixing(spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r["taken"] for r in found) <= sum(r["size"] for r in found)


# trie --------------------------------------------------------------------------------------------


def brute_trie(rows: list, borrow: bool = True) -> list:
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrow else 0
        made[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    nodes, total = {(): sorted(made)}, {}
    for c in sorted(made):
        for d in range(1, len(made[c]) + 1):
            nodes.setdefault(tuple(made[c][:d]), []).append(c)
    inner = {p[:-1] for p in nodes if p}
    for path, members in nodes.items():
        saved = (len(members) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            t = total.setdefault(path[:d], [0, 0, 0])
            t[0] += d == len(path) - 1
            t[1] += path not in inner
            t[2] += saved
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(made[c]) == len(path))
        parent = min(nodes[path[:-1]], default=None) if path else None
        out.append((min(members, default=None), len(path), parent, len(members), *total[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found_trie(df) -> list:
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def turn_rows() -> list:
    deep = [(c, t, "user" if t % 2 else "assistant", f"turn {t if t < split else (t, c)}") for c, split in ((5000, 99), (5001, 40), (5002, 3), (5003, 33)) for t in range(70)]
    short = [(c, t, "user", f"é{min(t, c % 3)}") for c in range(-120, 320, 7) for t in range(1 + c % 5)]
    heads = [(c, t, None, None) for c in (0, 100, 200, -100) for t in range(c % 300 // 100 + 1)]
    odd = [(None, 1, "user", "lost"), (77, None, "user", "first"), (77, None, "user", "first"), (77, 3, "a", "x"), (77, 3, "a", "w"), (601, 0, "user", "alone")]
    return deep + short + heads + odd


@pytest.mark.parametrize("band", [2, 16])
def test_trie_matches_brute_force(spark, band, parts):
    df = spark.createDataFrame(turn_rows(), TURNS)
    assert found_trie(prefixtrie.trie(df, band)) == brute_trie(turn_rows())


def test_trie_without_borrowing(spark):
    rows = [(c, t, "u", f"{t}" * (1 + (c % 2) * (t > 2))) for c in range(5) for t in range(9)]
    assert found_trie(prefixtrie.trie(spark.createDataFrame(rows, TURNS), 3, borrow=False)) == brute_trie(rows, borrow=False)


def test_trie_of_a_hot_conversation(spark):
    """Many equal conversations: their ids are hashed in several blocks."""
    rows = [(c, 0, "user", "same") for c in range(0, 30_000)]
    found = found_trie(prefixtrie.trie(spark.createDataFrame(rows, TURNS), borrow=False))
    ids = hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest()
    assert found == sorted([(0, 0, None, 30_000, 1, 1, 4 * 29_999, hashlib.sha256(b"").hexdigest()), (0, 1, 0, 30_000, 0, 1, 4 * 29_999, ids)], key=repr)


def test_trie_of_empty_and_wide_tables(spark):
    empty = found_trie(prefixtrie.trie(spark.createDataFrame([], TURNS)))
    assert empty == [(None, 0, None, 0, 0, 1, 0, hashlib.sha256(b"").hexdigest())] == brute_trie([])
    wide = spark.createDataFrame([(1, 0, "u", "x" * 100_000, 5, "d"), (2, 0, "u", "y", 6, "e")], TURNS + ", depth int, k1 string")
    assert found_trie(prefixtrie.trie(wide)) == brute_trie([tuple(r)[:4] for r in wide.collect()])


def test_trie_against_its_sql(spark):
    assert differences(queries.op13_prefixtrie(spark, SF), connect(SF), prefixtrie.SQL) == []
