"""Alignment of alleles with the reference: left normalisation, local affine alignment, CIGAR.

These are sequential per allele, so they run in Arrow-batched Python; flanks are joined beforehand
(sources.fasta.slices), never read per row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..workers import ship

#: Scores of the local alignment, the flank on either side, and how many allele lengths an indel
#: may move (fixed values).
MATCH, MISMATCH, OPEN, EXTEND = 10.0, -9.0, 15.0, 6.66
FLANK, REACH = 50, 30
#: Bases that each ambiguity code stands for; N and X match nothing (fixed values).
CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}
_SETS = {k: frozenset(v) for k, v in CODES.items()}
_NONE: frozenset[str] = frozenset()


def matches(a: str, b: str) -> bool:
    return bool(_SETS.get(a.upper(), _NONE) & _SETS.get(b.upper(), _NONE))


def left_align(pos: int, ref: str, alt: str, left: str) -> tuple[int, str, str]:
    """The leftmost equal form of an indel; `left` is the reference before pos. Other alleles, and
    indels without room to move, come back trimmed."""
    if not ref or not alt or not (ref + alt).isalpha():
        return pos, ref, alt
    at = len(left)
    least = max(0, at - REACH * max(len(ref), len(alt)))
    while True:
        if ref and alt and ref[-1] == alt[-1] and (len(ref) > 1 and len(alt) > 1 or at > least):
            ref, alt = ref[:-1], alt[:-1]
        elif ref and alt:
            break
        if not ref or not alt:
            at -= 1
            pos -= 1
            ref, alt = left[at] + ref, left[at] + alt
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        ref, alt, pos = ref[1:], alt[1:], pos + 1
    return pos, ref, alt


@dataclass
class Alignment:
    score: float
    start: int
    reference: str
    query: str

    @property
    def cigar(self) -> str:
        """Runs of = (same), X (other), D (only in the reference) and I (only in the query)."""

        def op(r: str, q: str) -> str:
            return "I" if r == "-" else "D" if q == "-" else "=" if matches(r, q) else "X"

        return "".join(f"{len(list(g))}{k}" for k, g in groupby(op(r, q) for r, q in zip(self.reference, self.query, strict=True)))


def smith_waterman(reference: str, query: str, homopolymer: float = 0.0) -> Alignment:
    """The best local alignment under affine gaps: a gap of n costs OPEN + (n - 1) * EXTEND, less
    `homopolymer` where it opens inside a run of one base. Of equal scores the first end wins, and
    going back a substitution goes before a gap."""
    n, m = len(reference), len(query)
    low = float("-inf")
    h = [[0.0] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]
    f = [[low] * (m + 1) for _ in range(n + 1)]
    best, end = 0.0, (0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            open_d = OPEN - (homopolymer if i > 1 and reference[i - 1] == reference[i - 2] else 0.0)
            open_i = OPEN - (homopolymer if j > 1 and query[j - 1] == query[j - 2] else 0.0)
            e[i][j] = max(h[i - 1][j] - open_d, e[i - 1][j] - EXTEND)
            f[i][j] = max(h[i][j - 1] - open_i, f[i][j - 1] - EXTEND)
            same = h[i - 1][j - 1] + (MATCH if matches(reference[i - 1], query[j - 1]) else MISMATCH)
            h[i][j] = max(0.0, same, e[i][j], f[i][j])
            if h[i][j] > best + 1e-9:
                best, end = h[i][j], (i, j)
    i, j = end
    r, q, state = [], [], "h"
    while i and j and (state != "h" or h[i][j] > 0):
        if state == "h":
            same = h[i - 1][j - 1] + (MATCH if matches(reference[i - 1], query[j - 1]) else MISMATCH)
            if abs(h[i][j] - same) < 1e-9:
                r.append(reference[i - 1])
                q.append(query[j - 1])
                i, j = i - 1, j - 1
            else:
                state = "e" if abs(h[i][j] - e[i][j]) < 1e-9 else "f"
        elif state == "e":
            stay = abs(e[i][j] - (e[i - 1][j] - EXTEND)) < 1e-9
            r.append(reference[i - 1])
            q.append("-")
            i, state = i - 1, "e" if stay else "h"
        else:
            stay = abs(f[i][j] - (f[i][j - 1] - EXTEND)) < 1e-9
            r.append("-")
            q.append(query[j - 1])
            j, state = j - 1, "f" if stay else "h"
    return Alignment(best, i, "".join(reversed(r)), "".join(reversed(q)))


#: A bit for each base, so that codes match if they share one.
_BITS = np.zeros(256, np.uint8)
for _code, _bases in CODES.items():
    for _c in (_code, _code.lower()):
        _BITS[ord(_c)] = sum(1 << "ACGT".index(b) for b in _bases)
#: Pairs whose tables are filled at once.
TOGETHER = 2048


def smith_watermans(pairs: list[tuple[str, str]], homopolymer: float = 0.0) -> list[Alignment]:
    """`smith_waterman` of many (reference, query): each distinct pair once, pairs of equal lengths
    together, a cell of all their tables at a time."""
    by: dict[tuple[int, int], list[tuple[str, str]]] = {}
    for x in dict.fromkeys(pairs):
        by.setdefault((len(x[0]), len(x[1])), []).append(x)
    done: dict[tuple[str, str], Alignment] = {}
    for (n, m), own in by.items():
        for at in range(0, len(own), TOGETHER):
            part = own[at : at + TOGETHER]
            done.update(zip(part, _together(part, n, m, homopolymer), strict=True))
    return [done[x] for x in pairs]


def _together(pairs: list[tuple[str, str]], n: int, m: int, homopolymer: float) -> list[Alignment]:
    k = len(pairs)
    if not n or not m:
        return [Alignment(0.0, 0, "", "") for _ in pairs]
    raw = [np.frombuffer("".join(x[i] for x in pairs).encode("latin-1", "replace"), np.uint8).reshape(k, -1).T for i in (0, 1)]
    ref, query = (_BITS[x] for x in raw)
    cost = [np.full(x.shape, OPEN) for x in raw]
    for c, x in zip(cost, raw, strict=True):
        c[1:] -= homopolymer * (x[1:] == x[:-1])
    h, e, f = np.zeros((n + 1, m + 1, k)), np.full((n + 1, m + 1, k), -np.inf), np.full((n + 1, m + 1, k), -np.inf)
    same = np.where(ref[:, None, :] & query[None, :, :], MATCH, MISMATCH)
    for i in range(1, n + 1):
        e[i, 1:] = np.maximum(h[i - 1, 1:] - cost[0][i - 1], e[i - 1, 1:] - EXTEND)
        start = np.maximum(np.maximum(h[i - 1, :-1] + same[i - 1], e[i, 1:]), 0.0)
        for j in range(1, m + 1):
            f[i, j] = np.maximum(h[i, j - 1] - cost[1][j - 1], f[i, j - 1] - EXTEND)
            h[i, j] = np.maximum(start[j - 1], f[i, j])
    flat = h.reshape(-1, k)
    best = flat.max(axis=0)
    ends = (flat >= best - 1e-9).argmax(axis=0)  # the first
    out = []
    for x, (reference, other) in enumerate(pairs):
        if best[x] <= 0:
            out.append(Alignment(0.0, 0, "", ""))
            continue
        i, j = divmod(int(ends[x]), m + 1)
        r, q, state = [], [], "h"
        while i and j and (state != "h" or h[i, j, x] > 0):
            if state == "h":
                if abs(h[i, j, x] - h[i - 1, j - 1, x] - same[i - 1, j - 1, x]) < 1e-9:
                    i, j = i - 1, j - 1
                    r.append(reference[i])
                    q.append(other[j])
                else:
                    state = "e" if abs(h[i, j, x] - e[i, j, x]) < 1e-9 else "f"
            elif state == "e":
                stay = abs(e[i, j, x] - (e[i - 1, j, x] - EXTEND)) < 1e-9
                i, state = i - 1, "e" if stay else "h"
                r.append(reference[i])
                q.append("-")
            else:
                stay = abs(f[i, j, x] - (f[i, j - 1, x] - EXTEND)) < 1e-9
                j, state = j - 1, "f" if stay else "h"
                r.append("-")
                q.append(other[j])
        out.append(Alignment(float(best[x]), i, "".join(reversed(r)), "".join(reversed(q))))
    return out


def in_flanks(ref: str, alt: str, before: str, after: str) -> tuple[str, str]:
    """The reference around an allele, and the same with the allele."""
    return before[-FLANK:] + ref + after[:FLANK], before[-FLANK:] + alt + after[:FLANK]


def align_allele(ref: str, alt: str, before: str, after: str) -> Alignment:
    """An allele in its flanks against the reference there."""
    return smith_waterman(*in_flanks(ref, alt, before, after))


#: Operations that the alignment of each class may show.
ALLOWED = {"snp": {"=", "X"}, "mnp": {"=", "X"}, "ins": {"=", "I"}, "del": {"=", "D"}, "complex": {"=", "X", "I", "D"}}


def consistent(cls: str, cigar: str) -> bool:
    return set(c for c in cigar if not c.isdigit()) <= ALLOWED.get(cls, set())


def left_aligned(alleles: DataFrame, left: str = "left") -> DataFrame:
    """Alleles (npos, nref, nalt, ...) with a column of reference bases before them, left-aligned."""
    ship(alleles.sparkSession)
    columns = [c for c in alleles.columns if c != left]
    schema = alleles.select(columns).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [left_align(p, r, a, x or "") for p, r, a, x in zip(b["npos"], b["nref"], b["nalt"], b[left], strict=True)]
            yield b[columns].assign(npos=[d[0] for d in done], nref=[d[1] for d in done], nalt=[d[2] for d in done])

    return alleles.mapInPandas(run, schema)


def aligned(alleles: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Alleles with score, cigar and whether the cigar fits their class."""
    ship(alleles.sparkSession)
    schema = StructType(list(alleles.schema.fields)).add("score", "double").add("cigar", "string").add("consistent", "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = smith_watermans([in_flanks(r, a, x or "", y or "") for r, a, x, y in zip(b["nref"], b["nalt"], b[before], b[after], strict=True)])
            yield b.assign(score=[d.score for d in done], cigar=[d.cigar for d in done], consistent=[consistent(c, d.cigar) for c, d in zip(b["cls"], done, strict=True)])

    return alleles.mapInPandas(run, schema)


def with_left(alleles: DataFrame, chunks: DataFrame, reach: int = REACH) -> DataFrame:
    """Alleles with `left`, the reference bases before them, as many as an indel may move. Only
    insertions and deletions are looked up."""
    from ..sources.fasta import slices

    indel = alleles.filter(F.col("cls").isin("ins", "del"))
    size = (reach * F.greatest(F.length("nref"), F.length("nalt"))).cast("int")
    size = F.least(size, F.col("npos") - 1)
    own = indel.withColumn("start", F.col("npos") - 1 - size).withColumn("len", size)
    found = slices(own.select("record_id", "aid", "chrom", "start", "len"), chunks).select("record_id", "aid", F.col("bases").alias("left"))
    return alleles.join(found, ["record_id", "aid"], "left")
