"""Secret scans: fixed patterns, and a battery of randomness tests with controlled discoveries."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, prepare, slices, texts

#: Kinds in the order of the listing; "random" are the spans that the battery adds.
KINDS = ("assign", "access", "hex", "random")
_ANY = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
_NAMES = ("password", "passwd", "secret", "token")
ASSIGN = re.compile("(" + "|".join(map(_ANY, _NAMES)) + "|" + _ANY("api") + "_?" + _ANY("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # equal to runs of any length, the short ones dropped
#: Strings long enough for the battery to tell random from written text.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Alphabets of encodings, the narrowest first (fixed values).
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("ALNUM36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Classes of length: below 32, 64, 128 characters, and above. Bins of -log10(p).
LENGTHS, BINS, DEEPEST = (32, 64, 128), 64, 16.0
#: Below this p-value the battery calls a string not uniform over its alphabet.
LEVEL = 0.01
#: States of a character: lower vowel, frequent and other consonant, the same upper, digit, symbol; OTHER.
STATES = ("aeiou", "nrstldch", "bfgjkmpqvwxyz", "AEIOU", "NRSTLDCH", "BFGJKMPQVWXYZ", "0123456789", "+/_-")
DIGIT, SYMBOL, OTHER = 6, 7, 8
#: The kind of a state: lower, upper, digit, symbol.
KIND = np.array([0, 0, 0, 1, 1, 1, 2, 3])
_CODE = bytes(next((i for i, cs in enumerate(STATES) if chr(b) in cs), OTHER) for b in range(256))
_BLANK = 32


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns: leftmost and non-overlapping per kind, matches
    that fail the length rule dropped; by start, then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_upper(x: float, df: int) -> float:
    """Wilson-Hilferty upper tail."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(s: str) -> str | None:
    """The alphabet of the narrowest encoding that holds every character; None for strings of one
    kind of character, which words, rules and numbers are made of."""
    if sum((any(c.islower() for c in s), any(c.isupper() for c in s), any(c.isdigit() for c in s))) < 2:
        return None
    chars = set(s)
    return next((a for _, a in ALPHABETS if chars <= set(a)), None)


def states(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("latin-1", "replace").translate(_CODE), np.uint8).astype(np.int64)


@lru_cache(64)
def uniform(alphabet: str) -> np.ndarray:
    """The share of each state in an alphabet."""
    return np.bincount(states(alphabet), minlength=OTHER)[:OTHER] / len(alphabet)


def randomness(s: str, alphabet: str) -> float:
    """p-value of "s is uniform over the alphabet": the smallest of three tests times three
    (Bonferroni): chi-squared over the states of its characters, runs of one kind of character,
    serial correlation of places in the alphabet at lag one."""
    n, at = len(s), states(s)
    share = uniform(alphabet)
    want, got = n * share, np.bincount(at, minlength=OTHER)[:OTHER]
    few = (want < 2) & (share > 0)  # states too rare for a cell of their own are one
    cells = [(got[i], want[i]) for i in np.flatnonzero(want >= 2)] + ([(got[few].sum(), want[few].sum())] if few.any() else [])
    p1 = _chi2_upper(sum((c - w) ** 2 / w for c, w in cells), len(cells) - 1) if len(cells) > 1 else 1.0
    kinds = np.bincount(KIND, share)
    same, three = (kinds**2).sum(), (kinds**3).sum()
    var = (n - 1) * same * (1 - same) + 2 * (n - 2) * (three - same * same)
    off = abs((KIND[at[1:]] != KIND[at[:-1]]).sum() - (n - 1) * (1 - same))
    p2 = _normal_two_sided(max(0.0, off - 0.5) / math.sqrt(var)) if var > 0 else 1.0
    place = {c: i for i, c in enumerate(alphabet)}
    v = np.array([place[c] for c in s], float)
    v -= v.mean()
    ss = (v * v).sum()
    p3 = _normal_two_sided(((v[1:] * v[:-1]).sum() / ss + 1 / n) * math.sqrt(n)) if ss else 0.0
    return min(1.0, 3 * min(p1, p2, p3))


def transitions(text: str, random: list[str]) -> np.ndarray:
    """Two tables of state pairs of a text, flat: neighbours, without those inside the `random`
    strings, and the letters around one blank."""
    raw = text.encode("latin-1", "replace")
    code = np.frombuffer(raw.translate(_CODE), np.uint8).astype(np.int64)
    out = np.zeros((2, 81), np.int64)
    if len(code) > 1:
        out[0] = np.bincount(code[:-1] * 9 + code[1:], minlength=81)
    if len(code) > 2:
        joint = (np.frombuffer(raw, np.uint8)[1:-1] == _BLANK) & (code[:-2] < DIGIT) & (code[2:] < DIGIT)
        out[1] = np.bincount((code[:-2] * 9 + code[2:])[joint], minlength=81)
    for s in random:
        at = states(s)
        out[0] -= np.bincount(at[:-1] * 9 + at[1:], minlength=81)
    return out.ravel()


def written(counts: np.ndarray) -> np.ndarray:
    """log P(next state | state) of written strings, 8 x 8, from the summed tables of a corpus.

    Written strings are its neighbouring characters, and its words joined as names join them: a
    capital, a symbol, a number, or nothing between, each in a quarter of the places."""
    near, joint = (x.reshape(9, 9)[:OTHER, :OTHER].astype(float) for x in counts.reshape(2, 81))
    c = np.maximum(near, 0) + 0.5
    part = joint[:, :DIGIT] / 4
    c[:, :DIGIT] += part
    c[:, 3:6] += part[:, :3] + part[:, 3:]
    for mark in (SYMBOL, DIGIT):
        c[:, mark] += part.sum(axis=1)
        c[mark, :DIGIT] += part.sum(axis=0)
    c[DIGIT, DIGIT] += part.sum() * 2
    return np.log(c / c.sum(axis=1, keepdims=True))


def written_p(s: str, alphabet: str, chain: np.ndarray) -> float:
    """A p-value of "s is written": the likelihood of its states as written text, in its own or in
    swapped case, over that under uniform characters. The odds of a ratio this small among written
    strings are at most the ratio itself (Markov's inequality), whatever the length."""
    at = states(s)
    u = np.log(uniform(alphabet)[at[1:]]).sum()
    swapped = np.where(at < 6, (at + 3) % 6, at)
    w = np.logaddexp(chain[at[:-1], at[1:]].sum(), chain[swapped[:-1], swapped[1:]].sum()) - math.log(2)
    return min(1.0, math.exp(min(0.0, w - u)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base array<struct<start,kind,end>>, candidates
    array<struct<start,end,cls,u,based,s>> with the battery's p-value u; based ones overlap base
    spans. One more row per task has `pairs`, the task's sums of `transitions`."""
    prepare(docs.sparkSession)
    fields = "base array<struct<start:bigint,kind:string,end:bigint>>, candidates array<struct<start:bigint,end:bigint,cls:int,u:double,based:boolean,s:string>>, pairs array<bigint>"
    schema = docs.select(id_col).schema
    for field in docs.sparkSession.createDataFrame([], fields).schema:
        schema = schema.add(field)
    kinds = [
        pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])),
        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cls", pa.int32()), ("u", pa.float64()), ("based", pa.bool_()), ("s", pa.string())])),
        pa.list_(pa.int64()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, kind = np.zeros(162, np.int64), None
        for part in slices(batches, "__text"):
            base, more, kind = [], [], part.column(0).type
            for text in texts(part, "__text"):
                found = base_spans(text)
                tried = []
                for m in CANDIDATE.finditer(text):
                    body = m[0].rstrip("=")
                    if alphabet := encoding(body):
                        based = any(s < m.end() and m.start() < e for s, _, e in found)
                        tried.append({"start": m.start(), "end": m.end(), "cls": sum(len(body) >= x for x in LENGTHS), "u": randomness(body, alphabet), "based": based, "s": body})
                pairs += transitions(text, [x["s"] for x in tried if x["u"] >= LEVEL])
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                more.append(tried)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, kinds[0]), pa.array(more, kinds[1]), pa.nulls(len(base), kinds[2])], names=schema.names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.array([pairs.tolist()], kinds[2])], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(lean(run), schema)


def judge(rows: DataFrame, chain: np.ndarray) -> DataFrame:
    """The rows of a scan with candidates array<struct<start,end,cls,based,p>>: p is the p-value
    of "written", one where the battery says that the string is not random either."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cls", pa.int32()), ("based", pa.bool_()), ("p", pa.float64())]))
    others = [c for c in rows.columns if c != "candidates"]
    schema = rows.select(others).schema
    for field in rows.sparkSession.createDataFrame([], "candidates array<struct<start:bigint,end:bigint,cls:int,based:boolean,p:double>>").schema:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [[{**{k: c[k] for k in ("start", "end", "cls", "based")}, "p": written_p(c["s"], encoding(c["s"]), chain) if c["u"] >= LEVEL else 1.0} for c in own] for own in batch.column("candidates").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(done, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def thresholds(tested: list[tuple[int, int, int]], q: float) -> list[float]:
    """Per length class the p-value up to which a string counts as random, not written.

    Weighted Benjamini-Hochberg over (cls, bin, count) of all candidates: longer strings have more
    power and get more weight (1, 2, 4, 8, scaled to a mean of one). Bins are taken at their upper
    edge, and no cut is above q, so the share of written strings among those called random stays
    below q."""
    total = sum(n for _, _, n in tested)
    weight = [2.0**c for c in range(len(LENGTHS) + 1)]
    if not total:
        return [0.0] * len(weight)
    mean = sum(weight[c] * n for c, _, n in tested) / total
    weight = [w / mean for w in weight]
    ps = sorted((min(1.0, 10 ** (-b * DEEPEST / BINS)) / weight[c], n) for c, b, n in tested)
    best, seen = 0.0, 0
    for i, (p, n) in enumerate(ps):
        seen += n
        if i + 1 < len(ps) and ps[i + 1][0] == p:
            continue
        if p <= q * seen / total:
            best = p
    return [min(q, best * w) for w in weight]


def find_secrets(docs: DataFrame, q: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans array<struct<start,kind,end>> by start, then kind, and
    n_base_random, the strings that overlap base spans and that the battery calls random, too.

    Null text counts as empty and has no spans. Candidates of the battery are runs of 20 or more
    characters of an encoding, of two kinds of letters and digits at least. A candidate is added
    as kind "random" if the battery does not reject that it is uniform over its alphabet, and if
    that it is written text is rejected under a false discovery rate of q over all candidates of
    the table outside base spans. What written strings look like is counted over the whole table,
    in all text but the strings that may be random. Offsets are code points, ends exclusive. Rows
    that repeat an id are scanned one by one; other columns are not read; empty tables give no rows."""
    scanned = cut(scan(docs, id_col, text_col))
    sums = scanned.filter("pairs is not null").select(F.posexplode("pairs").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    counts = np.zeros(162, np.int64)
    for r in sums.collect():  # 162 rows
        counts[r["i"]] = r["n"]
    rows = cut(judge(scanned.filter("pairs is null").drop("pairs"), written(counts)))
    depth = F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(F.col("c.p"), F.lit(1e-300))) * BINS / DEEPEST)).cast("int")
    hist = rows.select(F.explode("candidates").alias("c")).filter("not c.based").groupBy(F.col("c.cls").alias("cls"), depth.alias("b")).count()
    # at most (classes x bins) rows
    cuts = thresholds([(r["cls"], r["b"], r["count"]) for r in hist.collect()], q)
    limit = F.array(*map(F.lit, cuts))
    random = F.filter("candidates", lambda c: ~c["based"] & (c["p"] <= F.element_at(limit, c["cls"] + 1)))
    spans = F.concat("base", F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit("random").alias("kind"), c["end"].alias("end"))))
    order = F.array(*map(F.lit, KINDS))
    by = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("n"), x["kind"].alias("kind"), x["end"].alias("end")))
    done = F.transform(F.array_sort(by), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    of_base = F.size(F.filter("candidates", lambda c: c["based"] & (c["p"] <= q))).cast("long")
    return rows.select(id_col, done.alias("spans"), of_base.alias("n_base_random"))
