"""Operators that work on one text at a time, against plain Python and public libraries."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from isotherm.llm import bpe, language, media, packing, quality, secret_scan, simhash, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "  ", "a", "\n\n", "it's  we'll 12three\t\tx   é漢字🙂", "<|endoftext|> a<|endoftext|>", "\x1c \x85 x y", "a" * 5000, " " * 300 + "b", "Ġ Ċ", "naïve\r\nline"]


def random_text(random_, size):
    return "".join(random_.choice(["the", " ", "  ", "\n", "é", "ß", "12", "'s", ".", "!!", "漢", "qx", "\t", "ing", "A"]) for _ in range(size))


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], SCHEMA)


def test_bpe_equals_the_library():
    own, library, random_ = bpe.load(PATH), Tokenizer.from_file(PATH), random.Random(1)
    for text in ODD + [random_text(random_, random_.randrange(400)) for _ in range(300)]:
        ids = own.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_fragments_are_certain_cuts():
    own = bpe.load(PATH)
    for word in (b" thththqzx", "éß漢字".encode(), b"aaaa"):
        parts = own.fragments(word)
        assert b"".join(parts) == word
        assert [i for p in parts for i in own.merge(p)] == own.merge(word)


def test_bpe_rows(spark):
    rows = {r["doc_id"]: r for r in bpe.digests(frame(spark, [*ODD, None]), PATH).collect()}
    library = Tokenizer.from_file(PATH)
    for i, text in enumerate([*ODD, ""]):
        ids = library.encode(text, add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def plain_secrets(text):
    found = []
    for kind, pattern, least, group in (
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
        ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0),
    ):
        found += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_spans():
    random_ = random.Random(2)
    parts = ["token = ", '"', "abc123", "PassWord:", "api_key=", "apikey", " ", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "ſecret:", "\n", "=", "zz"]
    for _ in range(500):
        text = "".join(random_.choice(parts) for _ in range(20))
        assert [s for s in secret_scan.spans_of(text) if s[0] != "costly"] == plain_secrets(text), text


def exhaustive_cost(value, ranks):
    """Least cost over all segmentations, each segment at its cheapest reading."""
    low, math = value.lower(), secret_scan.math

    def segment(a, b):
        part, lows, size = value[a:b], low[a:b], b - a
        costs = [sum(math.log10(secret_scan._alphabet(c)) for c in part)]
        for text, leet in ((lows, 0.0), (lows.translate(secret_scan.LEET), 0.5)):
            if size >= 3 and text in ranks:
                costs.append(math.log10(ranks[text] + 1) + leet + (0.0 if part.islower() else 0.4))
        # a date is read as the pattern reads it from its first character on
        costs += [secret_scan.YEAR_COST if size == 4 else secret_scan.DATE_COST for d in secret_scan.DATES if (m := d.match(low, a)) and m.end() == b]
        keys = lows.translate(secret_scan.UNSHIFT)
        if size >= 3 and all((x, y) in secret_scan.BESIDE for x, y in zip(keys, keys[1:])):
            costs.append(math.log10(47 * 4 * size))
        for w in (1, 2, 3, 4):
            if size >= max(3, 2 * w) and all(lows[k] == lows[k + w] for k in range(size - w)):
                costs.append(sum(math.log10(secret_scan._alphabet(c)) for c in part[:w]) + math.log10(size / w))
        return min(costs)

    best = [0.0]
    for end in range(1, len(value) + 1):
        best.append(min(best[a] + (math.log10(2) if a else 0.0) + segment(a, end) for a in range(end)))
    return best[-1]


def test_guess_cost_is_the_least_of_all_segmentations():
    random_ = random.Random(9)
    ranks = secret_scan.RANKS | {"aaa": 300, "qwe": 200, "sdf": 350, "abab": 400}
    bits = ["a", "aa", "aaa", "ab", "Q", "qwe", "rty", "1qaz", "2wsx", "!QAZ", "password", "p4ssw0rd", "1999", "2024-01-31", "31122020", "x", "#", "é", "sdf", "0", "12", "abc", "Summer"]
    for _ in range(1500):
        value = "".join(random_.choice(bits) for _ in range(random_.randrange(1, 9)))
        # a span of brute force costs no more for being cut, so the sums differ in rounding alone
        assert abs(secret_scan.guess_cost(value, ranks) - exhaustive_cost(value, ranks)) < 1e-9, value
    for value in ("1qaz2wsx3edc", "zaq12wsx", "!QAZ@WSX", "qwertyuiopassword", "a" * 100_000, "qw" * 50_000):
        assert secret_scan.guess_cost(value) < secret_scan.COSTLY, value
    assert secret_scan.guess_cost("#k!^z&%") >= secret_scan.COSTLY


def test_short_costly_values_are_found():
    text = "password: '#k!^z&%' and pwd=abc and token = x"
    assert [(k, text[a:b]) for k, a, b in secret_scan.spans_of(text) if k == "costly"] == [("costly", "#k!^z&%")]


def test_guess_cost():
    cost = secret_scan.guess_cost
    assert cost("") == 0
    assert cost("password") < 1 and cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 4 and cost("2019-05-12") < 6
    assert cost("abcabcabcabc") < cost("abcxyqmwtkpr") and cost("kT9vQz2mXw81") > secret_scan.COSTLY
    assert cost("password1999") < cost("pqsswxrd8205")


def test_costly_values_and_masks(spark):
    text = "bearer = kT9vQz2mXw81LpR and passphrase: password1999 token=abcdef12"
    spans = secret_scan.spans_of(text)
    assert [s[0] for s in spans] == ["costly", "assign"]
    assert secret_scan.redact(text, spans) == "[secret] and passphrase: password1999 [secret]".replace("[secret] and", "bearer = [secret] and")
    out = secret_scan.mask_secrets(frame(spark, [text, None, "", "clean"])).orderBy("doc_id").collect()
    assert "kT9v" not in out[0]["text"] and out[0]["n_chars"] == len(out[0]["text"])
    assert [r["text"] for r in out[1:]] == [None, "", "clean"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('password = "p@ss!W0rd9xQz"', "p@ss!W0rd9xQz"),
        ("secret=Summer!Xk29$q next", "Summer!Xk29$q"),
        ("bearer abc.0123456789abcdef01234567.xyz,", "abc.0123456789abcdef01234567.xyz"),
        ("api_key: 'kT9v Qz2m\\'Xw81'; x", "kT9v Qz2m\\'Xw81"),
        ("{mytoken: 'kT9vQz2mXw81LpR}", "kT9vQz2mXw81LpR"),
        ("passwd=schlüßel%kQ9xé$7 x", "schlüßel%kQ9xé$7"),
    ],
)
def test_whole_values_in_base_contexts(text, value):
    start = text.index(value)
    spans = secret_scan.spans_of(text)
    assert ("costly", start, start + len(value)) in spans
    assert [s for s in spans if s[0] != "costly"] == plain_secrets(text)
    assert value not in secret_scan.redact(text, spans) and value[-3:] not in secret_scan.redact(text, spans)


def test_values_that_are_base_spans_or_cheap_are_not_costly():
    for text in ('token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" of', "password: changeme1", "token=aaaaaaaaaaaaaaaaaaaaa", 'secret: "abc", "x": "kT9vQz2mXw81LpR"'):
        assert [s for s in secret_scan.spans_of(text) if s[0] == "costly"] == []


def test_words_of_the_corpus_are_no_secrets(spark):
    prose = "the documentation of Washington names an elephant"
    clean = ["credentials: documentation", "Signature: Washington", "passcode = elephant"]
    secret = "passcode = zqvkxjwyhbnm"
    docs = frame(spark, [prose, prose + " again", *clean, secret, secret + " twice"])
    ranks = secret_scan.dictionary(docs)
    assert {"documentation", "washington", "elephant"} < set(ranks) and "zqvkxjwyhbnm" not in ranks
    assert list(ranks)[: len(secret_scan.WORDS)] == list(secret_scan.WORDS) and sorted(ranks.values()) == list(range(1, len(ranks) + 1))
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask_secrets(docs).collect()}
    assert [masked[k] for k in range(2, 7)] == [*clean, "passcode = [secret]", "passcode = [secret] twice"]
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs).collect()}
    assert [spans[k] for k in range(2, 7)] == ["", "", "", "costly:11:23", "costly:11:23"]


def test_media_round_trip(spark, tmp_path):
    texts = ["", None, "a", "a ", "x" * 192, "é" * 1000, "x" * 192, "long " * 50_000]
    rows = {r["doc_id"]: r for r in media.describe(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        payload, size = media.payload_of(text or "")
        assert rows[i]["n_bytes"] == size and rows[i]["payload_bytes"] == len(payload) and len(payload) % 192 == 0 and payload
        assert rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and rows[i]["tail_crc32"] == zlib.crc32(payload[-16:])
        assert rows[i]["media_sha256"] == hashlib.sha256(media.to_png(payload)).hexdigest()
    assert rows[4]["feature"] == rows[6]["feature"]
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b" " * 192)[:-20] + b"\0" * 20)


def test_media_shards_are_tar_files(spark):
    import tarfile

    found = media.store(frame(spark, ["a", "b", "a"])).collect()
    for r in found:
        with tarfile.open(r["shard"].replace("file:", "")) as tar:
            member = tar.getmember(f"{r['digest']}.png")
            assert (member.offset_data, member.size) == (r["offset"], r["length"])


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashed = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_fingerprints():
    random_ = random.Random(3)
    for text in [*ODD, *(random_text(random_, 60) for _ in range(100))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_boundaries_are_optimal():
    import itertools

    random_ = random.Random(4)
    for _ in range(60):
        histogram = sorted({random_.randrange(1, 40): random_.randrange(1, 9) for _ in range(random_.randrange(1, 8))}.items())
        for buckets in (1, 2, 3):
            lengths = [n for n, _ in histogram]
            best = min(packing.padding(histogram, [*c, lengths[-1]]) for r in range(buckets) for c in itertools.combinations(lengths[:-1], min(r, len(lengths) - 1)))
            bounds = packing.boundaries(histogram, buckets)
            assert len(bounds) <= buckets and bounds[-1] == lengths[-1] and packing.padding(histogram, bounds) == best


def test_pack(spark):
    texts = ["w " * n for n in (0, 1, 1, 5, 5, 5, 2000, 3)] + [None]
    rows = packing.pack(frame(spark, texts, [*range(8), None]), buckets=2, budget=12).collect()
    assert len(rows) == len(texts)
    seen = {}
    for r in rows:
        assert r["n_tokens"] <= r["pad_to"]
        seen.setdefault((r["bucket"], r["batch"]), []).append((r["slot"], r["pad_to"]))
    for slots in seen.values():
        assert sorted(s for s, _ in slots) == list(range(len(slots))) and len(slots) <= max(1, 12 // slots[0][1])
    assert packing.pack(frame(spark, [])).count() == 0


def test_long_documents_get_exact_boundaries(spark):
    sizes = [1500, 1501, 3001, 9999, 20_021]
    rows = packing.pack(frame(spark, ["w " * (n - 1) for n in sizes])).collect()
    assert sorted((r["n_tokens"], r["pad_to"]) for r in rows) == [(n, n) for n in sizes]


def test_isotonic_curve():
    knots, levels = quality.pooled([(0.1, 1, 1), (0.2, 1, 0), (0.3, 2, 1), (0.4, 1, 1)])
    assert list(levels) == sorted(levels) and np.isclose(levels[0], 0.5) and levels[-1] == 1


def test_small_and_empty_inputs(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, ["", None, "some words here.", "some words here."], [1, None, 3, 3])
    assert {r["score"] for r in quality.score(docs, labels).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score(docs, labels).collect()} == {0.0}
    assert secret_scan.scan(docs).count() == 4
    for r in language.score(docs).collect():
        assert r["n_tokens"] in (1, 4) and np.isfinite(r["score"]) and r["score"] < 0
    empty = frame(spark, [])
    assert language.score(empty).count() == quality.score(empty, labels).count() == toxicity.score(empty, labels).count() == 0
    assert media.describe(empty).count() == bpe.digests(empty, PATH).count() == 0
