"""Phrase mining against SQL and counting by hand, whitening against numpy and Python integers."""

import random
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from isotherm.llm import phrases, whitening

DOCS = "doc_id long, text string, lang string, k1 string, n long, part int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 5, 1) for i, t, lang in rows], DOCS)


def by_hand(rows, least, top):
    """The contract, word for word."""
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\x0b\x0c\r":
            text = text.replace(mark, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in found.items():
        cuts = [(1000 * a * total[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(l == lang and len(w) > len(words) and b >= a and any(w[i : i + len(words)] == words for i in range(len(w))) for (l, w), b in found.items())
        if not inside:
            out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], total[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(own[:top], 1)]
    return sorted(ranked)


def random_rows(seed, size=60):
    random_ = random.Random(seed)
    words = ["the", "The", "é", "ß漢", "new", "york", "a\x1cb", "in", "of", "x" * 300]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?", " \xa0 "]
    rows = [(random_.choice([i, 7, None]), "".join(random_.choice(words) + random_.choice(marks) for _ in range(random_.randrange(80))), random_.choice(["en", "en", "de", None, "und", ""])) for i in range(size)]
    rows += [(99, "new york city hall in the rain " * 40, "en")] * 3 + [(1, None, "en"), (2, "", None), (3, " .,\n", "fr"), (4, "word", "de"), (5, "a b " * 30_000, "de")]
    return rows


@pytest.mark.parametrize("seed, least, top, sample", [(1, 5, 2000, 8), (2, 12, 3, 2), (3, 3, 7, 1_000_000_007)])
def test_phrases_equal_counting_by_hand(spark, seed, least, top, sample):
    rows = random_rows(seed)
    got = phrases.mine(documents(spark, rows).repartition(5), least, top, sample).collect()
    want = by_hand(rows, least, top)
    assert want and sorted(tuple(r) for r in got) == want


def test_phrases_equal_the_sql(spark):
    rows = [r for r in random_rows(4) if len(r[1] or "") < 5000]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.sql(phrases.sql(4, 50)).fetchall()
    got = phrases.mine(documents(spark, rows), 4, 50).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_no_documents_have_no_phrases(spark):
    assert phrases.mine(documents(spark, [])).collect() == []
    assert phrases.mine(documents(spark, [(1, None, None), (2, "", "en")])).collect() == []


def test_a_filter_forgets_nothing(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, size=(5000, 2))
    found = phrases.filter_of(spark.createDataFrame(keys.tolist(), "k1 long, k2 long"), 20)
    lanes = keys[:, 0].copy().view(np.uint64), keys[:, 1].copy().view(np.uint64)
    assert found.has(lanes).all()
    others = np.random.default_rng(2).integers(1 << 64, size=5000, dtype=np.uint64)
    assert found.has((others, others * np.uint64(3))).mean() < 0.01


def test_arithmetic_passes_64_bits(spark):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 2)], "lang string, phrase string, length int, n long")
    total = spark.createDataFrame([("en", 10 * big + 7)], "lang string, n long")
    row = phrases.score(counts, total).first()
    assert row["score"] == 1000 * big * (10 * big + 7) // ((big + 1) * (big + 2))


def test_equal_cuts_go_to_the_smaller_first_part(spark):
    counts = spark.createDataFrame([("en", "a b c", 3, 100), ("en", "a", 1, 200), ("en", "b c", 2, 100), ("en", "a b", 2, 100), ("en", "c", 1, 200)], "lang string, phrase string, length int, n long")
    total = spark.createDataFrame([("en", 1000)], "lang string, n long")
    rows = {r["phrase"]: r for r in phrases.score(counts.unionByName(spark.createDataFrame([("en", "b", 1, 150)], counts.schema)), total).collect()}
    # both cuts of the longer phrase score alike: the smaller k counts
    assert (rows["a b c"]["l"], rows["a b c"]["r"], rows["a b c"]["score"]) == (200, 100, 1000 * 100 * 1000 // 20000)


VECTORS = "vec_id long, embedding array<float>, label int, i int, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], VECTORS)


def test_whitening_against_numpy(spark):
    random_ = np.random.default_rng(3)
    data = (random_.normal(size=(700, 40)) @ random_.normal(size=(40, 40)) * 0.3).astype(np.float32)
    data[5:9] = data[4]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(900, None), (901, [float("nan")] + [0.0] * 39), (902, [None] + [0.0] * 39), (903, [float("-inf")] + [0.0] * 39)]
    got = whitening.whiten(vectors(spark, rows + odd).repartition(3)).toPandas()
    x = np.floor(64 * data.astype(float)).astype(int).astype(object) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    assert len(got) == n * 32 and set(got["n"]) == {n} and set(got["component"]) == set(range(1, 33))
    deviation = ((n * x - total) ** 2).sum(axis=1)
    assert dict(zip(got["vec_id"], got["deviation"])) == dict(enumerate(deviation.tolist()))
    assert {i: int(v) for i, v in zip(got["vec_id"], got["deviation_exact"])} == dict(enumerate(deviation.tolist()))
    centred = np.array([[(n * a - s) / n for a, s in zip(r, total)] for r in x], float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    want = centred @ basis[:, :32] / np.sqrt(values[:32])
    have = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-8)
    assert np.allclose(got.groupby("component")["explained"].first(), values[:32] / values.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    assert np.abs(np.cov(have.T, bias=True) - np.eye(32)).max() < 1e-9


def test_scatter_is_exact_at_any_size():
    random_ = np.random.default_rng(5)
    for low, high, rows, dims in [(-5, 5, 130, 7), (-(2**40), 2**40, 65, 3), (2**61 - 5, 2**61, 64, 2), (0, 1, 1, 4), (-(2**59), 2**59, 20, 2)]:
        numbers = random_.integers(low, high, size=(rows, dims))
        sums, products = whitening.scatter(numbers)
        whole = numbers.astype(object)
        assert sums.tolist() == whole.sum(axis=0).tolist()
        assert products.tolist() == whole.T.dot(whole).tolist()
        assert all(sum(p << (whitening.LIMB * k) for k, p in enumerate(whitening._limbs(int(v)))) == v for v in products.ravel())


def test_whitening_of_few_or_equal_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 4)).collect() == []
    rows = whitening.whiten(vectors(spark, [(1, [1.0, 5.0]), (1, [1.0, 5.0]), (None, [3.0, 5.0])])).collect()
    # one direction varies; repeated ids and a null id stay rows of their own
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], r["explained"]) for r in rows) == [(0, 1, 3, 1.0), (1, 1, 3, 1.0), (1, 1, 3, 1.0)]
    # x of 64 and 192 above the offset: 3 x - S is -128, -128 and 256
    assert sorted(r["deviation"] for r in rows) == [128**2, 128**2, 256**2]
    assert all(r["deviation_exact"] == Decimal(r["deviation"]) for r in rows)


def test_deviation_beyond_a_long(spark):
    rows = {r["vec_id"]: r for r in whitening.whiten(vectors(spark, [(k, [float(2**40 * k), 0.5]) for k in range(3)])).collect()}
    assert rows[1]["deviation"] == 0
    assert rows[2]["deviation"] is None and int(rows[2]["deviation_exact"]) == (3 * 2**46) ** 2


def test_vectors_of_two_widths_are_refused(spark):
    with pytest.raises(Exception, match="different widths"):
        whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
