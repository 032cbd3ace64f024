"""Token counts by a public byte-level BPE vocabulary, lengths only."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, slices, texts

#: The split pattern of byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A letter, one space, a letter: no token spans the place before the space.
SAFE = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
#: Characters after which a long text is split at the next safe place; bytes of an encoded batch.
LONG, BATCH = 32_768, 262_144

_counters: dict[str, "Counter"] = {}


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else 256 and on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain(spec: dict) -> bool:
    """Whether ranks are the ids of the vocabulary and the settings are those that Counter's own
    splitting stands for: bytes split by PATTERN, merges in the order of their ids, and special
    strings found as they are."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"].get(m, -1) for m in merged]
    settings = [spec.get("normalizer"), model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")]
    settings += [model.get("fuse_unk"), model.get("byte_fallback"), model.get("ignore_merges"), before.get("add_prefix_space", True), not before.get("use_regex", True)]
    added = [x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")]
    return model["type"] == "BPE" and before.get("type") == "ByteLevel" and not any(settings) and not any(added) and ids == sorted(ids) and min(ids, default=0) >= 0


class Counter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file: its special
    strings inside texts are one token each, no tokens are added around a text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = None
        if not _plain(spec):
            import tokenizers

            self.whole = tokenizers.Tokenizer.from_file(path)
            self.whole.no_truncation()
            self.whole.no_padding()
            return
        symbols = byte_symbols()
        special = [x["content"] for x in spec["added_tokens"]]
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in set(special)}
        self.codec = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Parts whose counts add up, and the number of special strings between them."""
        parts = self.special.split(text) if self.special else [text]
        out = []
        for part in parts:
            start = 0
            while len(part) - start > LONG and (m := SAFE.search(part, start + LONG)):
                out.append(part[start : m.start()])
                start = m.start()
            out.append(part[start:])
        return out, len(parts) - 1

    def counts(self, given: list[str]) -> list[int]:
        if self.whole is not None:  # a file of other settings: the library itself
            return [len(self.whole.encode(text, add_special_tokens=False).ids) for text in given]
        total, batch, owners, held = [0] * len(given), [], [], 0

        def flush() -> None:
            for i, ids in zip(owners, self.codec.encode_ordinary_batch(batch, num_threads=1), strict=True):
                total[i] += len(ids)

        for i, text in enumerate(given):
            parts, specials = self.pieces(text)
            total[i] += specials
            for part in parts:
                batch.append(part)
                owners.append(i)
                held += len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass"))
                if held >= BATCH:
                    flush()
                    batch, owners, held = [], [], 0
        flush()
        return total


def counter(path: str) -> Counter:
    """One per worker process and file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty; rows that repeat come back as often; other columns are not read, so
    none can clash; empty tables give no rows. The file at `path` is read on each executor. Texts
    are encoded in batches of equal bytes, long ones in parts cut at safe places (a text without
    one is a single part), and only lengths leave Python. A file whose settings are not those of
    plain byte-level BPE is counted by the tokenizers library itself.
    """
    prepare(docs.sparkSession)
    schema = docs.select(id_col).schema.add("n_bytes", "long").add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for part in slices(batches, "text"):
            given = texts(part, "text")
            sizes = pa.array([len(x.encode("utf-8", "surrogatepass")) for x in given], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(tool.counts(given), pa.int64())], names=schema.names)

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(count), schema).withColumn("over_limit", F.col("n_tokens") > limit)
