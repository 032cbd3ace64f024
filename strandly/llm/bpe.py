"""BPE encoding and decoding with a word-level vocabulary file (word ends marked)."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import lean, prepare, slices, texts
from .token_counts import byte_symbols

#: Unicode's White_Space, which the vocabulary's rules call \s (fixed value).
BLANK = "\t\n\x0b\x0c\r \x85\xa0                　"
#: What str.split() takes for white space beyond BLANK.
ODD = re.compile("[\x1c-\x1f]")
#: Pieces of text whose ids a worker remembers.
KEPT = 200_000

_coders: dict[str, "Coder"] = {}


class Coder:
    """Encodes and decodes as the tokenizers library does for the file: special strings are found
    first, then NFC, white space, lower case, the split pattern, bytes, merges by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Of each rank the two ids and the merged one; of each pair (packed) its rank.
        self.table = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        self.ranks = {a << 24 | b: rank for rank, (a, b, _) in enumerate(self.table)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", "".join(f"\\u{ord(c):04x}" for c in BLANK)))
        self.blank = re.compile(f"[{re.escape(BLANK)}]+")
        symbols = {b: c for c, b in byte_symbols().items()}
        self.inner = [self.ids.get(symbols[b], -1) for b in range(256)]
        self.last = [self.ids.get(symbols[b] + self.suffix, -1) for b in range(256)]
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token. Symbols form a doubly linked list; the heap holds rank and place
        in one number, and an entry whose pair changed since is stale and skipped."""
        raw = word.encode("utf-8")
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        if -1 in sym:
            sym = [x for x in sym if x >= 0]
        n, ranks, table = len(sym), self.ranks, self.table
        heap = [r << 32 | i for i in range(n - 1) if (r := ranks.get(sym[i] << 24 | sym[i + 1])) is not None]
        if not heap:
            return sym
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        sym.append(-1)
        while heap:
            entry = heapq.heappop(heap)
            a, b, new = table[entry >> 32]
            i = entry & 0xFFFFFFFF
            if sym[i] != a or sym[j := after[i]] != b:
                continue
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(new << 24 | sym[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := ranks.get(sym[h] << 24 | new)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return [x for x in sym if x >= 0]

    def keep(self, piece: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Remembers short pieces, the last KEPT to twice as many."""
        if len(piece) <= 48:
            if len(self.known) >= KEPT:
                self.older, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def forget(self) -> None:
        """At a task's end only the pieces last used stay, KEPT at most."""
        self.older = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a normalised piece without white space that is not among the last known."""
        if (ids := self.older.get(piece)) is not None:
            return self.keep(piece, ids)
        found = [piece] if piece.isascii() and piece.isalpha() else self.words.findall(piece)
        if len(found) == 1:
            return self.keep(piece, tuple(self.merge(found[0])))
        out: list[int] = []
        for word in found:
            ids = self.known.get(word)
            out.extend(self.piece(word) if ids is None else ids)
        return self.keep(piece, tuple(out))

    def plain(self, text: str) -> list[int]:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # one character at a time: a capital sigma has one lower form here
        text = text.replace("Σ", "σ").lower()
        pieces = self.blank.split(text) if ODD.search(text) else text.split()
        known = self.known
        if new := set(pieces).difference(known):
            found = {p: self.piece(p) for p in new}
            if self.known is not known or not new <= known.keys():  # long ones are not remembered
                known = {p: found[p] if p in found else known[p] for p in set(pieces)}
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        if not self.cut or "<|" not in text and not self.cut.search(text):
            return self.plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += self.plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings one after another; the file names no decoder, so a blank stands between."""
        try:
            return " ".join(map(self.strings.__getitem__, ids))
        except KeyError:
            return " ".join([s for i in ids if (s := self.strings.get(i)) is not None])


def coder(path: str) -> Coder:
    """One per worker process and file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def bpe_encode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The columns `keep` of each row and the ids of its whole text (null: empty) as array<int>.

    Other columns are dropped, so none can clash. Empty tables give no rows."""
    prepare(docs.sparkSession)
    schema = docs.select(keep).schema.add(ids_col, ArrayType(IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(path)
        for part in slices(batches, "__text"):
            lists = [tool.encode(x) for x in texts(part, "__text")]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(lists), np.int32, ends[-1])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(lean(encode, lambda: coder(path).forget()), schema)


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids (null: empty; unknown ids give nothing)."""
    prepare(rows.sparkSession)
    others = [c for c in rows.columns if c != out_col]
    schema = rows.select(others).schema.add(out_col, "string")
    at = others.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(at)
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                given = zip(lists.is_valid().to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
                out = pa.array([tool.decode(flat[a:b].tolist()) if ok else "" for ok, a, b in given], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=schema.names)

    return rows.select(others).mapInArrow(lean(decode), schema)
