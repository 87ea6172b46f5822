"""Secret scans: fixed patterns plus the guess cost of values in credential contexts.

A value that stands where a credential stands is judged by the cheapest way to guess it: a dynamic programme over its
characters picks the segmentation into dictionary words, dates, repeats, keyboard walks and brute-force spans whose
product of guesses is least. Values that stay costly are reported, whatever their spelling; ``password: changeme1`` is
cheap and is reported by the fixed patterns only.

The dictionary is ranked: a fixed list of frequent parts of passwords, then the words of the corpus by the number of texts
they stand in, counted by Spark without the values of credential contexts, so that a secret cannot vouch for itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import map_batches, texts
from isotherm.session import discard, materialize

KINDS = ("assign", "access", "hex", "costly")
# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: contexts in which a value is judged by its guess cost: the base names and further ones. The value is whole: a quoted
#: string (a quote inside a word does not end it), or a run of anything but white space
CONTEXT = re.compile(
    r"""(?:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*"""
    r"""|(?<![A-Za-z])(?:pass_?phrase|pwd|passcode|credentials?|access_?key|private_?key|client_?key|auth(?:orization)?|bearer|signature|signing_?key|session_?id|pin_?code)["']?\x20*(?:[:=]\x20*|\x20(?=\S{16})))"""
    r"""(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.|'(?=\w))*)'(?!\w)|["']?(\S+))""",
    re.I | re.A,
)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "signature", "session", "pin")
#: a value is reported if guessing it takes at least ten to this power tries: of words of eight or more letters in sf0.1,
#: weighted by occurrence, 0.9 % reach it under the dictionary, and of random values of ten letters and digits all do
COSTLY = 10.0

# fixed values: frequent parts of passwords, most frequent first; the rank is the number of guesses
WORDS = (
    "password pass word admin root user login welcome secret token key test example sample demo default change changeme "
    "qwerty letmein monkey dragon master shadow sunshine princess football baseball love iloveyou hello freedom whatever "
    "michael jordan super hunter ninja summer winter spring autumn monday friday january june july december access system "
    "server client public private database backup guest temp null none true false value string text your my the and for "
    "api app dev prod stage local host mail web site data file name here insert enter placeholder xxx abc company"
).split()
LEET = str.maketrans("0134578@$!", "oieastbasi")
# fixed values: rows of a keyboard
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATES = [
    re.compile(r)
    for r in (
        r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])",
        r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d",
        r"(?:19|20)\d\d",
    )
]
DATE_COST = math.log10(365 * 120)
YEAR_COST = math.log10(120)
#: a walk starts at one of 47 keys and goes one of four ways
WALK_COST = math.log10(47 * 4)
RANKS = {w: r for r, w in enumerate(WORDS, 1)}
LETTERS = re.compile(r"[^\W\d_]+")
#: the dictionary holds at most so many words of the corpus, the most frequent ones; each has at most LONGEST letters and
#: stands in at least LEAST_TEXTS texts
MAX_WORDS, LONGEST, LEAST_TEXTS = 50_000, 32, 2
# a key touches its neighbours in the row, and two keys of the row below, which is shifted by half a key
_BESIDE = {(a, b) for row in ROWS for a, b in zip(row, row[1:])}
_BESIDE |= {(a, below) for row, under in zip(ROWS, ROWS[1:]) for k, a in enumerate(row) for below in under[max(k - 1, 0) : k + 1]}
BESIDE = _BESIDE | {(b, a) for a, b in _BESIDE}
# fixed values: what the shift key makes of the symbol keys
UNSHIFT = str.maketrans('!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./")


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def _runs(size: int, width: int, goes_on) -> list[tuple[int, int]]:
    """For each place the first and the end of the longest run through it: ``goes_on(k)`` ties the character at k to the one ``width`` behind it."""
    out = [(k, k) for k in range(size)]
    first = 0
    for k in range(size):
        if k + width >= size or not goes_on(k):
            # the run of places first .. k - 1 that go on ends with the last character they are tied to
            for place in range(first, k):
                out[place] = (first, k - 1 + width + 1)
            first = k + 1
    return out


def guess_cost(value: str, ranks: Mapping[str, int] = RANKS) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes; 0 for the empty string.

    ``best[e]`` is the least cost of the first ``e`` characters; each further segment also costs a factor of two for
    the order of segments. A repeat or walk has three characters or more, a block of two to four characters that comes again
    may stop in the middle; all three may start and end anywhere in their run. Two segments of one run where the first is no
    word or date are never cheaper than one, so behind the longest word only starts right after a word or date are tried, and
    the whole is about linear in the length.
    """
    size, low = len(value), value.lower()
    if not size:
        return 0.0
    plain, keys, step = low.translate(LEET), low.translate(UNSHIFT), math.log10(2)
    single = [math.log10(_alphabet(c)) for c in value]
    best = [0.0] + [math.inf] * size
    brute = [math.inf] * (size + 1)  # least cost of a prefix that ends in a brute-force span
    after_word = [False] * (size + 1)  # whether a word or date ends here
    walks = _runs(size, 1, lambda k: (keys[k], keys[k + 1]) in BESIDE)
    blocks = [_runs(size, w, lambda k, w=w: low[k] == low[k + w]) for w in (1, 2, 3, 4)]
    for start in range(size):
        here, more = best[start], step if start else 0.0
        # one more brute-force character: go on with the span or begin one
        grown = min(brute[start], here + more) + single[start]
        brute[start + 1] = min(brute[start + 1], grown)
        best[start + 1] = min(best[start + 1], grown)
        for length in range(3, min(LONGEST, size - start) + 1):
            end = start + length
            for text, leet in ((low, 0.0), (plain, 0.5)):
                rank = ranks.get(text[start:end])
                if rank:
                    case = 0.0 if value[start:end].islower() else 0.4
                    best[end] = min(best[end], here + more + math.log10(rank + 1) + case + leet)
                    after_word[end] = True
        if low[start].isdigit():
            for m in filter(None, (d.match(low, start) for d in DATES)):
                end = m.end()
                best[end] = min(best[end], here + more + (YEAR_COST if end - start == 4 else DATE_COST))
                after_word[end] = True
        for width, least, (first, last) in ((0, 3, walks[start]), *((w, max(3, 2 * w), b[start]) for w, b in enumerate(blocks, 1))):
            if last - start >= least and (start - first <= LONGEST or after_word[start]):
                base = here + more + (sum(single[start : start + width]) - math.log10(width) if width else WALK_COST)
                for end in range(start + least, last + 1):
                    best[end] = min(best[end], base + math.log10(end - start))
    return best[size]


class Judge(dict):
    """Whether a value is costly under a dictionary, remembered: ``value -> bool``."""

    def __init__(self, ranks: Mapping[str, int] = RANKS):
        self.ranks = ranks

    def __missing__(self, value: str) -> bool:
        if len(self) >= 65_536:
            self.clear()
        found = guess_cost(value, self.ranks) >= COSTLY
        if len(value) <= 256:
            self[value] = found
        return found


FIXED = Judge()


def dictionary(docs: DataFrame) -> dict[str, int]:
    """``word -> rank``: the fixed words, then those of ``docs`` by the number of texts they stand in.

    Words are runs of letters. Values in credential contexts are not counted. Of the words of one count, all are in the dictionary or none.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update({w for w in LETTERS.findall(without_values(text).lower()) if 3 <= len(w) <= LONGEST})
            if len(seen) >= 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = texts(docs).select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(counted.where((F.col("n") >= LEAST_TEXTS) & ~F.col("word").isin(*WORDS)), "words")
    # the least count that no more than MAX_WORDS words reach: only those come here, and no task sends more
    words_of_count = sorted(((r["n"], r["m"]) for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    held, least = 0, None
    for n, m in words_of_count:
        held += m
        if held > MAX_WORDS:
            break
        least = n
    known = [] if least is None else [(-r["n"], r["word"]) for r in counted.where(F.col("n") >= least).collect()]
    discard(counted)
    return RANKS | {word: k for k, (_, word) in enumerate(sorted(known), len(WORDS) + 1)}


def without_values(text: str) -> str:
    """The text with the values of credential contexts left out."""
    low = text.lower()
    if not any(h in low for h in CONTEXT_HINTS):
        return text
    return CONTEXT.sub(lambda m: m[0][: m.start(m.lastindex) - m.start()] + " ", text)


def values_of(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of the whole values in credential contexts."""
    found = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 3:  # not quoted: what closes a sentence or bracket is no part of it
            end = start + len(m[3].rstrip("\"'.,;:)]}>"))
        if end > start:
            found.append((start, end))
    return found


def spans_of(text: str, costly: Mapping[str, bool] = FIXED) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, ordered by start, then kind as in ``KINDS``; ``costly`` judges values."""
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        taken = {(s, e) for _, s, e in found}
        for start, end in values_of(text):
            if (start, end) not in taken and costly[text[start:end]]:
                found.append(("costly", start, end))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for _, start, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    Null and empty texts have no spans; repeated rows and null ids are rows of their own; an empty table gives no rows; texts and values of any length are read whole.
    """

    ranks = docs.sparkSession.sparkContext.broadcast(dictionary(docs))

    def make():
        costly = Judge(ranks.value)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": batch.column("doc_id").to_pylist()} | {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in batch.column("text").to_pylist():
                spans = spans_of(text, costly)
                base = [s for s in spans if s[0] != "costly"]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            return out

        return step

    return map_batches(texts(docs), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span masked in ``text``, and ``n_chars`` counted anew where it is there; all other columns stay.

    A null text stays null.
    """
    from pyspark.sql.functions import pandas_udf

    ranks = docs.sparkSession.sparkContext.broadcast(dictionary(docs))

    @pandas_udf("string")
    def masked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        costly = Judge(ranks.value)
        for text in parts:
            yield text.map(lambda t: t if t is None else redact(t, spans_of(t, costly)))

    out = docs.withColumn("text", masked(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
