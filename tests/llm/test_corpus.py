"""Operators over whole tables, against brute force on small ones."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isotherm import session
from isotherm.llm import graph, language, lines, neighbours, quality, queries, simhash, toxicity
from tests.llm.test_text import frame, plain_fingerprint

SF = "/root/testdata/sf0.001"


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components(spark):
    random_ = random.Random(1)
    edges = [(random_.randrange(60), random_.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, k) for k in range(501, 560)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert found == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_links(spark):
    random_ = random.Random(2)
    prints = {0, -1}
    for _ in range(40):
        base = random_.getrandbits(64)
        for _ in range(4):
            x = base
            for bit in random_.sample(range(64), random_.randrange(6)):
                x ^= 1 << bit
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    found = [(r["a"], r["b"]) for r in simhash.linked(spark.createDataFrame([(p,) for p in prints], "print long")).collect()]
    assert set(found) == want and len(found) == len(want)


def joins_of(frame):
    """The joins that ran for a frame."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return re.findall(r"\b(\w+Join)\b", plan)


def test_simhash_keys_are_never_broadcast(spark):
    # 66 keys for each fingerprint, which Spark sizes as one
    prints = spark.range(3000).select(F.xxhash64("id").alias("print")).distinct()
    assert joins_of(simhash.linked(prints)) == ["SortMergeJoin"]


def test_near_duplicates(spark):
    base = " ".join(f"w{k}" for k in range(300))
    texts = [base, base, base.replace("w150", "x"), "other words entirely here", "", None, base]
    rows = {(r["doc_id"], r["component_id"], r["fingerprint"]) for r in simhash.near_duplicates(frame(spark, texts, [4, 2, 9, 5, 7, 6, None])).collect()}
    by_id = {i: c for i, c, _ in rows}
    linked = bin(plain_fingerprint(base) ^ plain_fingerprint(texts[2])).count("1") <= 3
    assert by_id[4] == by_id[2] == by_id[None] == 2 and by_id[9] == (2 if linked else 9)
    assert by_id[7] == by_id[6] == 6 and by_id[5] == 5
    assert {f for i, _, f in rows if i == 4} == {f"{plain_fingerprint(base):016x}"}
    kept = simhash.keep_one(frame(spark, texts, [4, 2, 9, 5, 7, 6, 5])).select("doc_id").collect()
    assert len(kept) == len({r["doc_id"] for r in kept})
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def plain_removed(docs):
    gone, sets = {}, []
    for i, text in sorted(docs):
        gone[i] = []
        for k, line in enumerate(text.split("\n")):
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w]
            if not words:
                continue
            own = frozenset(words)
            if any(9 * len(own & s) >= 4 * (len(own) + len(s)) for s in sets):
                gone[i].append(k)
            sets.append(own)
    return gone


def test_lines(spark):
    random_ = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    stock = [[random_.choice(words) for _ in range(random_.randrange(1, 60))] for _ in range(12)]
    docs = []
    for i in range(60):
        made = []
        for _ in range(random_.randrange(1, 6)):
            line = list(random_.choice(stock))
            for _ in range(random_.randrange(3)):
                line[random_.randrange(len(line)) if random_.random() < 0.5 else -1] = random_.choice(words)
            made.append(random_.choice(["", "  ", "\t"]) + " ".join(line))
        docs.append((i, "\n".join(made + [""])))
    want = plain_removed(docs)
    found = {r["doc_id"]: list(r["removed"]) for r in lines.report(frame(spark, [t for _, t in docs])).collect()}
    assert found == want and sum(map(len, want.values())) > 20
    cleaned = {r["doc_id"]: r["text"] for r in lines.dedup(frame(spark, [t for _, t in docs])).collect()}
    assert cleaned == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in docs}


def test_a_stored_table_is_not_copied(spark, tmp_path):
    """Rows of several files, some of one id or none: told apart by their places, without a copy of their texts."""
    near = "a b c d e f g h i "
    texts = ["same line", "same line", None, "", f"same line\n{near}j", "one more line", f"{near}new"]
    ids = [3, 3, 1, 2, None, None, 9]
    frame(spark, texts, ids).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    with session.recorded() as paths:
        got = queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()
    assert paths and not [p for p in paths if "numbered" in p]
    want = lines.report(frame(spark, texts, ids)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n_lines"]) for r in got))) == sorted(map(repr, ((r["doc_id"], r["n_lines"]) for r in want)))
    assert sum(r["n_removed"] for r in got) == sum(r["n_removed"] for r in want) == 3
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cleaned = [r["text"] for r in lines.dedup(table, stored=True).collect()]
    assert sorted(t or "" for t in cleaned) == sorted(["", "", "", "one more line", f"same line\n{near}j", "", ""])


def test_both_sides_of_the_second_round_are_one_shuffle(spark, monkeypatch):
    """The words of the sets are dealt out once, not once for each side."""
    joins = []
    real = lines._pairs
    monkeypatch.setattr(lines, "SLICES", 1)
    monkeypatch.setattr(lines, "_pairs", lambda session_, joined: joins.append(joined(0)) or real(session_, joined))
    lines.kept_lines(lines.numbered(frame(spark, [f"a{k // 2} b{k // 3} c{k} d{k // 2} e f g h i" for k in range(40)])))
    rows = joins[1].collect()
    assert all(r["a_set"] < r["b_set"] and r["b_n"] > 0 for r in rows)
    assert "ReusedExchange" in joins[1]._jdf.queryExecution().executedPlan().toString()


def test_long_lines_that_differ_are_not_compared(spark, monkeypatch):
    """Long lines that share their rarest words by chance are told apart before their words are compared."""
    random_ = random.Random(8)
    words = [f"w{k}" for k in range(1500)]
    texts = [" ".join(random_.sample(words, 170)) for _ in range(120)]
    texts.append(texts[7].replace(" w1", " x1", 1) + " more")
    compared, real = [], lines._later_of
    monkeypatch.setattr(lines, "_later_of", lambda *a: compared.append(a[-1].count()) or real(*a))
    found = {r["doc_id"]: list(r["removed"]) for r in lines.report(frame(spark, texts)).collect()}
    assert found == plain_removed(list(enumerate(texts))) and found[120] == [0]
    assert sum(compared) < 10


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    cuts, real = [], lines.words_of
    monkeypatch.setattr(lines, "words_of", lambda line: cuts.append(line) or real(line))
    lines.kept_lines(lines.numbered(frame(spark, ["a b c d e f g h i j", "a b c d e f g h i k", "z"])))
    assert len(cuts) == 1


def test_lines_odd_rows(spark):
    docs = frame(spark, ["same line", "same line", None, "", "same line\nother", "same line"], [3, 3, 1, 2, 4, None])
    rows = sorted((r["doc_id"] or -1, r["text"]) for r in lines.dedup(docs).collect() if r["text"])
    assert rows == [(-1, "same line"), (4, "other")]
    assert lines.report(frame(spark, [])).count() == 0


def test_lines_with_clashing_columns(spark):
    names = ["row", "doc", "lines", "kept", "hashes", "clean", "set", "_row_number", "_kept", "_lines", "removed"]
    docs = frame(spark, ["a b c d e f", "a b c d e f\nx", None]).selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    rows = sorted(lines.dedup(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in rows] == ["a b c d e f", "x", None]
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names) and rows[0].__fields__ == docs.columns


def test_a_changed_word_is_no_new_line(spark):
    """One word in nine may differ, wherever it stands, and the order of words is nothing."""
    words = [f"w{k}" for k in range(10)]
    texts = [" ".join(words)] + [" ".join(words[:k] + ["new"] + words[k + 1 :]) for k in range(10)] + [" ".join(reversed(words)), " ".join(words[:7] + ["x", "y", "z"])]
    gone = {r["doc_id"] for r in lines.report(frame(spark, texts)).where("n_removed > 0").collect()}
    assert gone == set(range(1, 12))


def test_a_boilerplate_line_with_a_date(spark):
    """Thousands of variants of one line and a few far ones: all match the first, and no pairs among them are made."""
    texts = [f"all rights of this page are reserved by the owner since the day number {k}" for k in range(3000)] + ["all rights gone", "by the owner since the day"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(r["text"] for r in lines.dedup(docs).where("text <> ''").collect())
    assert left == sorted([texts[0], *texts[-2:]])


def test_rows_without_or_with_repeated_ids_are_documents(spark):
    docs = frame(spark, ["same line", "same line", "same line\nother", "one text", "two words more"], [None, None, None, 3, 3])
    rows = [(r["doc_id"], r["text"]) for r in lines.dedup(docs).collect()]
    assert sum("same line" in t for _, t in rows) == 1 and sum("other" in t for _, t in rows) == 1 and len(rows) == 5
    assert sum(r["n_removed"] for r in lines.report(docs).collect()) == 2
    base = " ".join(f"w{k}" for k in range(300))
    kept = simhash.keep_one(frame(spark, [base, base, "quite other words", "a text of its own", base], [None, None, 3, 3, None])).collect()
    assert sorted(r["text"] for r in kept) == sorted([base, "quite other words", "a text of its own"])


def test_neighbours(spark):
    random_ = np.random.default_rng(3)
    vectors = [(i, v.tolist()) for i, v in enumerate(random_.normal(size=(300, 8)))]
    vectors += [(400 + i, vectors[7][1]) for i in range(40)] + [(500, None), (520, [0.0] * 8), (540, [float("nan")] * 8), (560, [1.0, None] + [0.0] * 6), (0, vectors[0][1])]
    rows = neighbours.search(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), every=20, k=20).collect()
    good = {i: np.array(v, np.float32).astype(float) for i, v in vectors if v and None not in v and np.isfinite(v).all() and any(v)}
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert np.isclose(r["score"], good[r["query_id"]] @ good[r["vec_id"]])
    assert set(found) == {i for i in good if i % 20 == 0}
    for q, ids in found.items():
        want = sorted((i for i in good if i != q), key=lambda i: (-round(good[q] @ good[i], 9), i))[:20]
        assert ids == want
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.score(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total, distinct = sum(train.values()), len(train)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in train for w in own), total)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in own), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.98 * sum(r["base_score"] for r in held)


def test_class_probabilities_sum_to_one():
    prior = np.ones(language.CLASSES)
    model = language.beginning(prior)
    streams = [np.array([language.FILLER] * language.CONTEXT + [k], np.int32) for k in range(language.CLASSES)]
    assert np.isclose((10 ** language._log_probabilities(model, streams)).sum(), 1, atol=1e-4)


@pytest.mark.parametrize(("module", "column", "modulus", "held"), [(quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)])
def test_classifiers_on_held_out_rows(spark, module, column, modulus, held):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = {r["doc_id"]: r for r in module.score(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()}
    known = [(scored[r["doc_id"]], r[column]) for r in labels.collect() if scored[r["doc_id"]]["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored.values())
    right = lambda label: np.mean([r["predicted"] == label for r, y in known if y == label])
    assert min(right(0), right(1)) > (0.9 if module is quality else 0.6)


def test_every_leaning_feature_has_a_weight(spark, monkeypatch):
    # 4,000 toxic words, each in three toxic documents; a cut at 3,000 features would leave some without weight
    toxic = [f"{k:04d}" for k in range(4000)]
    rows = [(" ".join(toxic[k % 40 :: 40]) + ".", 1) for k in range(120)] + [(f"calm words {k}x here.", 0) for k in range(600)]
    known = spark.createDataFrame(rows, "text string, y int")
    hashes, weights = toxicity.fit(known)
    features = toxicity.Features(hashes, len(weights) - 1)
    assert len(weights) == len(hashes) + 1 and all(features[w] and weights[list(features[w])].min() > 0 for w in toxic)
    monkeypatch.setattr(toxicity, "MAX_WEIGHTS", 64)
    hashes, weights = toxicity.fit(known)
    features = toxicity.Features(hashes, len(weights) - 1)
    assert len(weights) == 65 and all(features[w] and weights[list(features[w])].min() > 0 for w in toxic)


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert set(out.columns) == set(docs.columns), name
        docs = spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count() == corpus_pipeline.run(spark, SF).count()


def test_the_pipeline_clears_up(spark):
    """Of all that a run stages, only what its result reads is left, and the next run takes that away too."""
    with session.recorded() as paths:
        packed = corpus_pipeline.run(spark, SF)
        rows = packed.count()
    hadoop = spark._jvm.org.apache.hadoop.fs
    there = lambda p: hadoop.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(p))
    left = [p for p in paths if there(p)]
    assert rows and len(paths) > 12 and len(left) <= 2 and packed.count() == rows
    with session.recorded():
        corpus_pipeline.run(spark, SF)
    assert [p for p in left if there(p)] == [p for p in left if "/secret-" in p]


def test_line_tables_of_many_rows_are_never_broadcast(spark, monkeypatch):
    """Spark sizes written tables by their files and exploded words as one row; the joins go by the number of rows."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 20, raising=False)
    plans, real = {}, lines.materialize

    def written(table, name, *codec):
        plans.setdefault(name, []).append(table._jdf.queryExecution().executedPlan().toString())
        return real(table, name, *codec)

    monkeypatch.setattr(lines, "materialize", written)
    texts = ["\n".join(f"line {k % 40} of {j} some words that come in all {k}" for j in range(4)) for k in range(60)]
    kept = lines.kept_lines(lines.numbered(frame(spark, texts)))
    found = {name: re.findall(r"\b(\w+Join)\b", " ".join(p)) for name, p in plans.items()}
    assert found["line-sets"] == ["SortMergeJoin"]
    assert "SortMergeJoin" in found["line-pairs"] and "BroadcastHashJoin" not in found["line-pairs"]
    assert joins_of(kept) == ["SortMergeJoin"]


def test_queries_have_stable_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))


def test_toxicity_steps_read_packed_rows(spark, monkeypatch):
    """The steps read a few rows of plain numbers, not one nested list for each text; what they learn is that of all texts."""
    texts = [("bad worse words here. Calm rest", 1)] * 7 + [("bad worse again", 1)] * 9 + [(f"calm words {k}. And more", 0) for k in range(80)]
    tables, real = [], toxicity._gradient
    monkeypatch.setattr(toxicity, "_gradient", lambda rows, weights: tables.append((rows, weights)) or real(rows, weights))
    hashes, weights = toxicity.fit(spark.createDataFrame(texts, "text string, y int"))
    rows, start = tables[0]
    assert set(rows.columns) == set(toxicity.PACKED) and rows.count() <= toxicity.TASKS
    features = toxicity.Features(hashes, len(weights) - 1)
    want = np.zeros_like(start)
    for text, y in texts:
        found, plain = toxicity.features_of(text, features)
        z = [start[-1] + start[own].sum() for _, _, own in found]
        slope = -1 / math.expm1(sum(map(toxicity.softplus, z)) + plain * toxicity.softplus(start[-1])) if y else 1
        for (_, _, own), v in zip(found, z):
            want[own] += slope / (1 + math.exp(-v)) / len(texts)
            want[-1] += slope / (1 + math.exp(-v)) / len(texts)
        want[-1] += plain * slope / (1 + math.exp(-start[-1])) / len(texts)
    assert np.allclose(real(rows, start), want, rtol=1e-9, atol=1e-12)


def test_features_of_words_of_any_letters():
    words = ["naïveté", "plain", "plainest", "ß", "日本語の文章", "a" * 70]
    hashes = np.unique(np.array([toxicity.hashed(p) for w in words for p in toxicity.parts(w)], np.int64))
    features, place = toxicity.Features(hashes, len(hashes)), {h: k for k, h in enumerate(hashes.tolist())}
    assert all(features[w] == tuple(place[toxicity.hashed(p)] for p in toxicity.parts(w)) for w in words)


def test_stored_lines_of_any_frame(spark, tmp_path):
    """Rows of a table as it was read are told apart by their places in its files; those of any other frame are written first."""
    path = str(tmp_path / "docs")
    frame(spark, ["same line here now", "another line of text", "same line here now"], [3, 1, 3]).repartition(2).write.parquet(path)
    read = spark.read.parquet(path)
    again = spark.createDataFrame(read.collect(), read.schema)
    want = [(1, 1, []), (3, 1, []), (3, 1, [0])]
    for docs, copied in ((read, False), (read.where("doc_id > 0"), True), (again, True), (read.unionByName(read.limit(0)), True)):
        with session.recorded() as paths:
            rows = lines.report(docs, stored=True).select("doc_id", "n_lines", "removed").collect()
        assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
        assert any("/numbered-" in p for p in paths) == copied
