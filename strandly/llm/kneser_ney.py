"""Quality classifier: interpolated modified Kneser-Ney over characters, trained on trusted text.

Grams are ORDER units of BITS bits packed into 64 bits, so a gram's history and its shorter
suffixes are bit operations and every count join is a join of whole numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, lean, prepare, slices, texts, with_ids

#: A unit is a UTF-16 code below DIRECT as it is; higher ones share the rest of the 2**BITS units.
ORDER, BITS, DIRECT = 5, 12, 3072
BOS, EOS = 2, 3
#: Grams that are held at once of one text or several.
PIECE = 1_000_000
#: Most grams whose scores are sent to every executor (16 bytes each); the others are joined.
HEAD = 262_144
#: Width of the bins of log-perplexity whose counts give the quantiles, and the most bins.
WIDTH, MOST_BINS = 0.001, 40_000
#: Words of a stretch in which repeated ones are counted.
STRETCH = 50


def repeated(text: str) -> float:
    """The share of words that their stretch of STRETCH words already holds; 0 without words."""
    found = text.split()
    if not found:
        return 0.0
    return 1 - sum(len(set(found[i : i + STRETCH])) for i in range(0, len(found), STRETCH)) / len(found)


def _units(text: str) -> np.ndarray:
    """Units of a text between begin and end marks; none of an empty text."""
    code = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.int64)
    if not len(code):
        return code
    rest = DIRECT + (code * 40503 >> 4) % ((1 << BITS) - DIRECT)
    return np.concatenate([[BOS] * (ORDER - 1), np.where(code < DIRECT, code, rest), [EOS]])


def _packed(units: np.ndarray) -> np.ndarray:
    n = len(units) - ORDER + 1
    out = np.zeros(n, np.int64)
    for i in range(ORDER):
        out = out << BITS | units[i : i + n]
    return out


def grams(given: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed grams of texts and of each the text's number, at most about PIECE at a time: a text
    has as many as units and the end mark, an empty one has none."""
    rows, owners, held = [], [], 0
    for i, text in enumerate(given):
        units = _units(text)
        for at in range(0, len(units) - ORDER + 1, PIECE):
            rows.append(_packed(units[at : at + PIECE + ORDER - 1]))
            owners.append(np.full(len(rows[-1]), i))
            held += len(rows[-1])
            if held >= PIECE:
                yield np.concatenate(rows), np.concatenate(owners)
                rows, owners, held = [], [], 0
    if rows:
        yield np.concatenate(rows), np.concatenate(owners)


class Lookup:
    """Whole numbers to values by open addressing, all at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int64)
        self.values = values
        todo, place = np.arange(len(keys)), self.start(keys)
        while len(todo):
            free = self.at[place] < 0
            self.at[place[free]] = todo[free]  # of several, the last stays
            self.keys[place[free]] = keys[todo[free]]
            rest = self.at[place] != todo
            todo, place = todo[rest], (place[rest] + 1) & self.mask

    def start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent), and where present."""
        place = self.start(keys)
        at = self.at[place]
        hit = (self.keys[place] == keys) & (at >= 0)
        todo = np.flatnonzero(~hit & (at >= 0))
        while len(todo):
            place[todo] = (place[todo] + 1) & self.mask
            now = self.at[place[todo]]
            same = (self.keys[place[todo]] == keys[todo]) & (now >= 0)
            at[todo] = now
            hit[todo] = same
            todo = todo[~same & (now >= 0)]
        return np.where(hit, self.values[np.where(hit, at, 0)] if len(self.values) else 0.0, 0.0), hit


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n, c): grams of a task's documents and of those to train on."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    size = 0

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, *(np.bincount(back, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2))

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n, c = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n), pa.array(c)], names=["lang", "gram", "n", "c"])

    for part in slices(batches, "text", PIECE):
        given, langs, use = texts(part, "text"), part.column("lang").to_pylist(), part.column("use").to_pylist()
        for lang, train in sorted({(x, u == 1) for x, u in zip(langs, use, strict=True)}):
            for found, _ in grams([t for t, x, u in zip(given, langs, use, strict=True) if x == lang and (u == 1) == train]):
                keys, n = np.unique(found, return_counts=True)
                held.setdefault(lang, []).append((keys, n, n * train))
                size += len(keys)
        if size > 2_000_000:
            held = {lang: [summed(parts)] for lang, parts in held.items()}
            size = sum(len(p[0][0]) for p in held.values())
            if size > 1_000_000:
                yield from out()
                held, size = {}, 0
    yield from out()


def _suffix(gram: Column, k: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << BITS * k) - 1)) if k < ORDER else gram


def _history(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, BITS)


def _discounts(counts: DataFrame) -> DataFrame:
    """Per language the three discounts of modified Kneser-Ney from the counts of counts."""
    n = [F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    d = counts.groupBy("lang").agg(*n)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    one = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(0.5 * i)) for i in (1, 2, 3)]
    return d.select("lang", *[F.least(F.greatest(F.coalesce(x, F.lit(0.5 * i)), F.lit(0.05)), F.lit(0.95 * i)).alias(f"d{i}") for i, x in enumerate(one, 1)])


def model_scores(table: DataFrame) -> DataFrame:
    """(lang, gram, n, logp) for every gram of the table (lang, gram, n, c), c its trusted count.

    Each order's counts are joined by gram and by history, which shards them by key. A history has
    at most 2**BITS grams, so no key is large. An empty model gives log(1 / 2**BITS) everywhere."""
    counts = {ORDER: table.filter("c > 0").select("lang", "gram", "c")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = cut(counts[k + 1].groupBy("lang", _suffix(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    asked = {ORDER: table.select("lang", "gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select("lang", _suffix(F.col("gram"), k).alias("gram")).distinct()
    lower = None
    for k in range(1, ORDER + 1):
        d = _discounts(counts[k])
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        known = with_ids(counts[k], cut(d), "inner").withColumn("taken", taken)
        sums = known.groupBy("lang", (_history(F.col("gram")) if k > 1 else F.lit(0).cast("long")).alias("history")).agg(F.sum("c").alias("total"), F.sum("taken").alias("left"))
        rows = asked[k].withColumn("history", _history(F.col("gram")) if k > 1 else F.lit(0).cast("long"))
        rows = rows.join(known.select("lang", "gram", "c", "taken"), ["lang", "gram"], "left")
        rows = rows.join(sums, ["lang", "history"], "left") if k > 1 else with_ids(rows, cut(sums.drop("history")), "left")
        if lower is None:
            rows = rows.withColumn("low", F.lit(1 / (1 << BITS)))
        else:
            rows = rows.withColumn("suffix", _suffix(F.col("gram"), k - 1)).join(lower, ["lang", "suffix"])
        own = F.coalesce(F.col("c") - F.col("taken"), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("low")).otherwise((own + F.col("left") * F.col("low")) / F.col("total"))
        done = cut(rows.select("lang", F.col("gram").alias("suffix"), p.alias("low")) if k < ORDER else rows.select("lang", "gram", "n", F.log(p).alias("logp")))
        free(*([counts[k]] if k < ORDER else []), *([lower] if lower is not None else []))
        lower = done
    return lower


def _score(head: Broadcast, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document: units scored, the sum of head scores, its share of repeated words, and the other grams with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {lang: Lookup(k, v) for lang, (k, v) in head.value.items()}
        none = Lookup(np.zeros(0, np.int64), np.zeros(0))
        for part in slices(batches, "text", PIECE):
            given, langs = texts(part, "text"), part.column("lang").to_pylist()
            sums, sizes, missed = np.zeros(len(given)), np.zeros(len(given), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for lang in sorted(set(langs)):
                own = np.array([i for i, x in enumerate(langs) if x == lang])
                for keys, owner in grams([given[i] for i in own]):
                    value, hit = tables.get(lang, none)(keys)
                    owner = own[owner]
                    sums += np.bincount(owner, value, len(given))
                    sizes += np.bincount(owner, minlength=len(given))
                    missed.append((keys[~hit], owner[~hit]))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(sizes), pa.array(sums), pa.array([repeated(t) for t in given], pa.float64()), *_counted(missed, len(given))], names=[*keep, "units", "head", "same", "rest", "times"])

    return run


def _counted(missed: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[pa.Array, pa.Array]:
    """Of each of n texts its distinct grams, and their counts: lists of numbers take 12 bytes a
    gram in a checkpoint, of pairs 32."""
    keys, owner = (np.concatenate([m[i] for m in missed]) for i in (0, 1))
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(keys)]]))
    ends = pa.array(np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (keys[first], counts.astype(np.int32)))


def thresholds(rows: DataFrame, q: float, least: int) -> DataFrame:
    """(lang, hi, most, bound_of): the highest log-perplexity and the highest share of repeated
    words that stay, for each language of rows (lang, use, x, same).

    The first is the quantile q of trusted documents that the model was not trained on, the second
    that of all trusted documents (nothing is trained on it), from exact counts of bins. A bound
    of a language with fewer than `least` such documents is that of all languages, and bound_of
    says so ("all", else "own"); without any such document nothing is rejected ("none")."""
    bins = lambda c: F.least(F.floor(F.col(c) / WIDTH), F.lit(MOST_BINS)).cast("int")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), bins(c).alias("b")) for c in ("x", "same")])).alias("v")
    counted = rows.filter("use > 0").select("lang", "use", both).filter("use = 2 OR v.what = 'same'").groupBy("lang", "v.what", "v.b").count()
    both = counted.withColumn("every", F.lit(False)).unionAll(counted.groupBy(F.lit("").alias("lang"), "what", "b").agg(F.sum("count").alias("count")).withColumn("every", F.lit(True)))
    by = Window.partitionBy("every", "lang", "what")
    upto = both.select("every", "lang", "what", "b", F.sum("count").over(by.orderBy("b")).alias("upto"), F.sum("count").over(by).alias("all"))
    at = F.min(F.when(F.col("upto") >= F.lit(q) * F.col("all"), F.col("b"))) * WIDTH + WIDTH
    found = cut(upto.groupBy("every", "lang", "what").agg(F.max("all").alias("n"), at.alias("z")))
    of = {r["what"]: r["z"] for r in found.filter("every").collect()}  # two rows
    own = found.filter(~F.col("every") & (F.col("n") >= least)).groupBy("lang").agg(*[F.max(F.when(F.col("what") == c, F.col("z"))).alias(n) for c, n in (("x", "hi"), ("same", "most"))])
    out = rows.select("lang").distinct().join(own, "lang", "left")
    other = [F.coalesce(n, F.lit(of.get(c, float("inf")))).alias(n) for c, n in (("x", "hi"), ("same", "most"))]
    name = F.when(F.col("hi").isNotNull() & F.col("most").isNotNull(), "own").otherwise("all" if of else "none").alias("bound_of")
    return out.select("lang", *other, name)


def classify(
    docs: DataFrame, trusted: DataFrame, q: float = 0.99, least: int = 30, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per input row: id, lang, n_units, perplexity, kept, bound_of.

    A model per language is trained on half of the trusted documents (by a hash of the id); the
    other half sets the bounds, see `thresholds`, so that a share of q of clean text stays: each of
    the two is at the quantile 1 - (1 - q) / 2. kept means a perplexity and a share of
    repeated words up to the bounds: a few characters do not see that words come again.
    Perplexity is per UTF-16 unit and the end mark. Null or empty text has none and is not kept;
    null language is "?". Rows that repeat an id are scored one by one; other columns are not
    read. Empty tables give no rows.

    Counts cover the whole corpus and all trusted text. They are combined within a task; the
    joins of counts are sharded by gram. The `head` most frequent grams' scores, a fixed number,
    are broadcast; a document's other grams are joined by key and summed."""
    spark = docs.sparkSession
    prepare(spark)
    flags = cut(trusted.select(F.col(id_col).alias("id")).distinct().withColumn("use", F.when(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(2)) == 0, 1).otherwise(2)))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("?")).alias("lang"), F.col(text_col).alias("text"))
    rows = with_ids(rows, flags, "left").select("id", "lang", F.coalesce("use", F.lit(0)).alias("use"), "text")
    counted = rows.select("lang", "use", "text").mapInArrow(lean(_count), "lang string, gram long, n long, c long")
    table = cut(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("c").alias("c")))
    scores = model_scores(table)
    free(table)
    top = scores.orderBy(F.desc("n"), "lang", "gram").limit(head).select("lang", "gram", "logp").toArrow()
    by_lang = {}
    for lang in pc.unique(top["lang"]).to_pylist():
        own = top.filter(pc.equal(top["lang"], lang))
        by_lang[lang] = (own["gram"].to_numpy(), own["logp"].to_numpy())
    sent = spark.sparkContext.broadcast(by_lang)
    schema = rows.select("id", "lang", "use").schema
    for field in spark.createDataFrame([], "units long, head double, same double, rest array<bigint>, times array<int>").schema:
        schema = schema.add(field)
    done = cut(rows.mapInArrow(lean(_score(sent, ["id", "lang", "use"])), schema).withColumn("rid", F.monotonically_increasing_id()))
    rest = done.select("rid", "lang", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("rid", "lang", F.col("r.rest").alias("gram"), F.col("r.times").alias("c"))
    rest = rest.join(scores.select("lang", "gram", "logp"), ["lang", "gram"]).groupBy("rid").agg(F.sum(F.col("c") * F.col("logp")).alias("tail"))
    scored = done.join(rest, "rid", "left").withColumn("x", -(F.col("head") + F.coalesce("tail", F.lit(0.0))) / F.nullif(F.col("units"), F.lit(0)))
    scored = cut(scored.select("id", "lang", "use", "units", "x", "same"))
    free(scores, done)
    bounds = cut(thresholds(scored, 1 - (1 - q) / 2, least))  # two bounds share what may be lost
    kept = F.coalesce((F.col("x") <= F.col("hi")) & (F.col("same") <= F.col("most")), F.lit(False))
    return with_ids(scored, bounds, "inner").select(F.col("id").alias(id_col), "lang", F.col("units").alias("n_units"), F.exp("x").alias("perplexity"), kept.alias("kept"), "bound_of")
