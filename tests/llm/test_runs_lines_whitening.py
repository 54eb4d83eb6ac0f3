"""Periodic runs, line dedup and whitening beside plain versions of them."""

import hashlib
import random
import string
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import lines, registry, runs, whitening
from tests.llm.test_operators import documents, sha
from tests.oracle import agree

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=6, times=4):
    """All runs by sliding over every period, the smallest period of a stretch first."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    lost = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in lost)


def some_words(rnd, size):
    """Words with powers, copies of earlier stretches and noise, over few letters."""
    words = []
    while len(words) < size:
        kind = rnd.random()
        if kind < 0.3 and words:
            a = rnd.randrange(len(words))
            words += words[a : rnd.randint(a, len(words))]
        elif kind < 0.6:
            root = [rnd.choice("abc") for _ in range(rnd.randint(1, 4))]
            words += (root * 9)[: rnd.randint(1, len(root) * 7)]
        else:
            words.append(rnd.choice("abcd"))
    return words


@pytest.mark.parametrize("times", [3, 4, 5])
def test_runs_are_those_of_every_period(times):
    rnd = random.Random(times)
    for _ in range(400):
        texts = [some_words(rnd, rnd.randint(0, 90)) for _ in range(rnd.randint(0, 4))]
        coded = [[w.encode() for w in t] for t in texts]
        assert runs.runs_of(coded, 6, times) == [plain_runs(t, 6, times) for t in texts]


def test_factors_are_the_longest_before():
    rnd = random.Random(8)
    for _ in range(60):
        words = some_words(rnd, rnd.randint(1, 60))
        n = len(words)
        keys = np.array([ord(w[0]) for w in words])
        order, ranks = runs.factor_ranks(keys, np.full(n, n))
        assert [words[i:] for i in order.tolist()] == sorted(words[i:] for i in range(n))
        length, source = runs.previous_factors(order, ranks)
        same = lambda i, j: next((k for k in range(n - max(i, j)) if words[i + k] != words[j + k]), n - max(i, j))  # noqa: B023, E731
        assert length == [max((same(i, j) for j in range(i)), default=0) for i in range(n)]
        assert all(source[i] < i and same(i, source[i]) == length[i] for i in range(n) if length[i])


def test_long_periodic_texts_take_linear_work():
    root = [b"%d" % i for i in range(50)]
    words = (root * 20 + [b"x"]) * 60
    (found,) = runs.runs_of([words], 6, 4)
    # Each thousand words repeat 50; 1,001 of them stand 60 times.
    assert found == [(0, 1000, 50), (0, len(words), 1001)] + [(1001 * k, 1000, 50) for k in range(1, 60)]
    assert runs.runs_of([[b"a"] * 200_000], 6, 4) == [[(0, 200_000, 1)]]


def test_runs_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", 50)
    texts = [None, "", " \n\t", "a a a a a", "a a a a a a", "x " * 5000, "日 本 " * 4 + "é", "a a " * 6, (None, "b b b b b b b"), (3, "a a a a a a"), " ".join(f"w{i}" for i in range(3000))]
    found = runs.find(documents(spark, texts), row=True).collect()
    assert len(found) == len(texts)
    for r in found:
        words = (r["row"]["text"] or "").encode().split()
        words = [w.decode() for w in words]
        expected = plain_runs(words) if len(words) < 2000 else [(0, 5000, 1)] if words[0] == "x" else []
        assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(words), expected)
        assert r["collapsed"] == plain_collapse(words, expected) and r["row"]["row"] == "r"
    assert runs.find(documents(spark, texts).limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.find(documents(spark, texts), times=2)


def test_the_query_is_a_plain_version_of_it(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in registry.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(found) == len(docs)
    periodic = 0
    for d in docs:
        words = [w.decode() for w in (d["text"] or "").encode().split()]
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        expected = plain_runs(words)
        r = found[d["doc_id"]]
        best = min(expected, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(expected), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if expected else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in expected)) and r["collapsed_sha256"] == sha(plain_collapse(words, expected))
        periodic += bool(expected)
    assert periodic > 5


STRIPPED = " \t\n\x0b\x0c\r"


def plain_lines(rows, min_length=10, min_docs=2):
    """(key, lines, dropped, kept) of each row."""
    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    held = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            held[line.strip(STRIPPED).translate(fold)].add(k)
    first = lambda ks: min(ks, key=lambda k: (k is None, k))
    out = []
    for k, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (len(c := x.strip(STRIPPED).translate(fold)) >= min_length and len(held[c]) >= min_docs and first(held[c]) != k)]
        out.append((k, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("min_length", "min_docs"), [(10, 2), (3, 4)])
def test_lines_are_those_of_a_plain_version(spark, min_length, min_docs):
    rnd = random.Random(min_docs)
    pool = [f"line number {i % 40} of many" for i in range(40)] + ["short", "", "  ", "ÄÖÜ äöü lange Zeile", "äöü ÄÖÜ lange Zeile", " the same line here", "the same line here"]
    dress = [lambda s: s, lambda s: f" \t{s}\r", str.upper, lambda s: f"\x0b\x0c{s} "]
    texts = [(rnd.randrange(60), "\n".join(rnd.choice(dress)(rnd.choice(pool)) for _ in range(rnd.randint(0, 12)))) for _ in range(80)]
    texts += [None, "", "\n", "\n\n\n", (None, "the same line here\nline number 3 of many"), (None, "the same line here"), (7, "line number 3 of many\n" * 3000), (8, "own long line here\nown long line here")] + [(9, "a row twice over\nx")] * 2
    df = documents(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    found = lines.deduplicate(df, min_length, min_docs, row=True).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found), key=repr) == sorted(plain_lines(rows, min_length, min_docs), key=repr)
    assert all(r["row"]["row"] == "r" and r["row"]["doc_id"] == r["doc_id"] for r in found)
    assert lines.deduplicate(df.limit(0)).collect() == []


def test_a_line_of_all_documents_and_all_lines_lost(spark):
    texts = ["the banner of the site\n" * 2 + f"and then number {i} alone" for i in range(200)] + ["The Banner of the Site"]
    found = {r["doc_id"]: r for r in lines.deduplicate(documents(spark, texts)).collect()}
    assert (found[0]["n_dropped"], found[0]["kept"]) == (0, texts[0])
    assert all((found[i]["n_lines"], found[i]["n_dropped"], found[i]["kept"]) == (3, 2, f"and then number {i} alone") for i in range(1, 200))
    assert (found[200]["n_lines"], found[200]["n_dropped"], found[200]["kept"]) == (1, 1, "")


def test_line_dedup_agrees_with_sql(spark):
    agree(spark, registry.QUERIES["op12_line_dedup"], registry.ORACLES["op12_line_dedup"], SF)


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    off = [[n * int(c) - int(s) for c, s in zip(r, sums, strict=True)] for r in x]
    y = np.array(off, float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return [sum(c * c for c in r) for r in off], values[::-1], y @ axes[:, ::-1]


def test_whitening_query_is_a_plain_version_of_it(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, values, scores = plain_whitening([r["embedding"] for r in given])
    rows = registry.QUERIES["op13_whitening"](spark, SF).orderBy("vec_id", "component").collect()
    assert len(rows) == 32 * len(given) and {r["n"] for r in rows} == {len(given)} and len({r["identity_error"] for r in rows}) == 1
    assert [r["deviation"] for r in rows[::32]] == deviation and rows[0]["identity_error"] < 1e-9
    white = np.array([r["whitened"] for r in rows]).reshape(-1, 32)
    plain = scores[:, :32] / np.sqrt(values[:32])
    assert np.abs(np.abs(white) - np.abs(plain)).max() < 1e-8
    assert np.allclose((white * np.sign((white * plain).sum(axis=0))), plain, atol=1e-8)
    assert np.allclose([r["explained"] for r in rows[:32]], values[:32] / values.sum(), rtol=1e-10)
    assert [r["component"] for r in rows[:32]] == [*range(1, 33)]


EMBEDDINGS = "vec_id long, embedding array<double>, key string, v int, x int"


def test_whitening_of_odd_vectors(spark):
    rnd = np.random.default_rng(3)
    good = rnd.standard_normal((40, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0], [1e300, 0.0, 1.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(i, v, "k", 1, 2) for i, v in enumerate(good)] + [(None, good[0], "k", 1, 2), (0, good[0], "k", 1, 2)] + [(100 + i, v, "k", 1, 2) for i, v in enumerate(bad)]
    found = whitening.whiten(spark.createDataFrame(rows, EMBEDDINGS)).collect()
    fitted = [r[1] for r in rows[:42]]
    deviation, values, scores = plain_whitening(fitted)
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in found) == sorted((r[0] is None, r[0]) for r in rows[:42])
    assert sorted(r["deviation"] for r in found) == sorted(deviation) and {r["n"] for r in found} == {42} and all(len(r["whitened"]) == 3 for r in found)
    assert found[0]["identity_error"] < 1e-9 and np.allclose(found[0]["explained"], values / values.sum())
    assert np.allclose(sorted(np.abs([r["whitened"][0] for r in found])), sorted(np.abs(scores[:, 0] / np.sqrt(values[0]))))


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25], "k", 1, 2) for i in range(5)], EMBEDDINGS)
    assert [(r["n"], r["deviation"], list(r["whitened"]), list(r["explained"])) for r in whitening.whiten(same).collect()] == [(5, 0, [], [])] * 5
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], "k", 1, 2) for i in range(5)], EMBEDDINGS)
    assert [len(r["whitened"]) for r in whitening.whiten(line).collect()] == [1] * 5
    assert whitening.whiten(same.limit(0)).collect() == [] and whitening.whiten(spark.createDataFrame([(1, None, "k", 1, 2)], EMBEDDINGS)).collect() == []


def test_deviations_don_t_overflow():
    x = np.array([[1 << 40, 0], [0, 1 << 40]])
    off, squares = whitening.deviations(x, 2, [1 << 40, 1 << 40])
    assert [int(s) for s in squares] == [2 << 80] * 2 and off.tolist() == [[2.0**40, -(2.0**40)], [-(2.0**40), 2.0**40]]


def test_the_digest_is_of_utf8(spark):
    text = "é日本 line one\nline two"
    docs = documents(spark, [text])
    assert lines.deduplicate(docs).select(F.sha2("kept", 256)).first()[0] == hashlib.sha256(text.encode()).hexdigest()
