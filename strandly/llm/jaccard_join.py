"""N-gram Jaccard join: an exact metric-space join of documents' shingle sets.

Jaccard distance d = 1 - J is a metric, and J >= t is d <= r with r = 1 - t. Texts without common
shingles are at distance one from each other and from any pivot, where no triangle inequality
tells them apart; so cells of documents that can link at all are found first (two exact filters),
and the recursion over pivots, Voronoi regions and windows runs in each cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lean, prepare, slices, texts, with_ids
from .components import components
from .jaccard_cells import cell_links

#: Frequent shingles kept apart: most of a task, and of all tasks (8 bytes each).
TASK_HOT, HOT = 4096, 65_536
#: Shingles that a bucket or a cell in one task holds on average; pivots of a group in the first
#: round of a larger cell, and the most rounds.
BUCKET, CELL, PIVOTS, ROUNDS = 1_000_000, 2_000_000, 16, 32
#: Most sets whose names and ids are sent to every worker as sorted arrays (16 bytes each).
SENT = 2_000_000

U64 = np.uint64
#: Stands for a null id inside.
NO_ID = -(1 << 63)
_words: dict[bytes, int] = {}


def _hash(word: bytes) -> int:
    value = _words[word] = xxhash.xxh64_intdigest(word)
    return value


def _forget() -> None:
    _words.clear()


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return a ^ (a >> U64(32))


def shingle_sets(given: list[str], size: int) -> list[np.ndarray]:
    """Of each text its distinct shingles as sorted 64-bit hashes: `size` words each, A-Z lowered,
    words between ASCII white space; all words as one shingle of a shorter text; none without words."""
    if len(_words) > 150_000:
        _words.clear()
    out = []
    known = _words
    for text in given:
        # bytes know ASCII only: lower() and split() are those of A-Z and [\x20\x09-\x0D]
        words = text.encode("utf-8", "surrogatepass").lower().split()
        w = np.array([known[x] if x in known else _hash(x) for x in words], U64)
        if not len(w):
            out.append(w)
            continue
        k = min(size, len(w))
        acc = np.full(len(w) - k + 1, k, U64)
        for i in range(k):
            acc = _mixed(acc + w[i : len(w) - k + 1 + i] * U64(0x9E3779B97F4A7C15) + U64(i + 1))
        out.append(np.unique(acc))
    return out


def _name(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A set's name, the first `bits` of a 128-bit hash of its sorted members, and the other 64."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    key, check = h >> 128 - bits << 64 - bits, h & (1 << 64) - 1
    return key - (key >> 63 << 64), check - (check >> 63 << 64)


def _namer(renamed: Broadcast | None, bits: int) -> Callable[[np.ndarray], int]:
    """Names of sets, those of several sets replaced."""
    other = renamed.value if renamed is not None else {}

    def name(s: np.ndarray) -> int:
        key, check = _name(s, bits)
        return other.get((key, check), key) if other else key

    return name


def _slackness(t: tuple[int, int]) -> Callable[[np.ndarray], np.ndarray]:
    """How many members of a set of n a linked set may lack."""
    return lambda n: n - -(-n * t[0] // t[1])


def _scan(size: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, n, key, check, hot) of documents, and with hot set (-, count, shingle) of a task's frequent
    shingles by Misra-Gries counters: what is dropped lowers all that stay, so counts are never too high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        top, count = np.zeros(0, U64), np.zeros(0, np.int64)
        pending: list[np.ndarray] = []

        def merge() -> None:
            nonlocal top, count
            keys, n = np.unique(np.concatenate(pending), return_counts=True)
            pending.clear()
            keys, n = np.concatenate([top, keys[n > 1]]), np.concatenate([count, n[n > 1]])
            top, back = np.unique(keys, return_inverse=True)
            count = np.bincount(back, n, len(top)).astype(np.int64)
            if len(top) > 4 * TASK_HOT:
                order = np.lexsort((top, -count))
                count = count - count[order[4 * TASK_HOT]]
                order = order[: 4 * TASK_HOT]
                order = order[count[order] > 0]
                top, count = top[order], count[order]

        for part in slices(batches, "text", 3_000_000):
            sets = shingle_sets(texts(part, "text"), size)
            keys = [_name(s, bits) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [k for k, _ in keys], [c for _, c in keys])], pa.array([False] * len(keys))], names=["id", "n", "key", "check", "hot"])
            for s, (_, check) in zip(sets, keys, strict=True):
                if check not in seen:
                    seen.add(check)
                    pending.append(s)
            if sum(map(len, pending)) > 1_000_000:
                merge()
        if pending:
            merge()
        if len(top):
            order = np.lexsort((top, -count))[:TASK_HOT]
            order = order[count[order] > 1]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(order), pa.int64()), pa.array(count[order]), pa.array(top[order].view(np.int64)), pa.nulls(len(order), pa.int64()), pa.array([True] * len(order))], names=["id", "n", "key", "check", "hot"])

    return run


def _sets(size: int, name: Callable[[], Callable[[np.ndarray], int]], wanted: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, members) of documents that have a shingle, of those whose id and key are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = name()
        if wanted is not None:
            ids, names = wanted.value
            batches = (b.filter(pa.array(_is_in(b.column("id").to_numpy(), ids))) for b in batches)
        for part in slices(batches, "text", 2_000_000):
            found = [(named(s), s) for s in shingle_sets(texts(part, "text"), size) if len(s)]
            if wanted is not None and found:
                some = _is_in(np.array([k for k, _ in found], np.int64), names)
                found = [x for x, own in zip(found, some, strict=True) if own]
            if found:
                ends = np.concatenate([[0], np.cumsum([len(s) for _, s in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s for _, s in found]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), lists], names=["key", "members"])

    return run


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


#: Shingles of many sets dealt by range of their hash: sets' names, how many shingles each has in
#: the bucket, the shingles; and, in the bucket of the name, names with a number each.
BLOBS = "bucket int, names binary, sizes binary, members binary, owners binary, numbers binary"


def _deal(sets: list[np.ndarray], names: np.ndarray, numbers: np.ndarray, bits: int, drop: int) -> Iterator[pa.RecordBatch]:
    """The sets as BLOBS in 2**bits buckets. `drop` high bits of a member are known to be zero;
    32 bits after the bucket's are kept if any are dropped, else all 64."""
    lens = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    owner = np.repeat(np.arange(len(sets)), lens)
    at = (flat >> U64(64 - drop - bits)).astype(np.int64) if bits else np.zeros(len(flat), np.int64)
    order = np.argsort(at.astype(np.uint16 if bits <= 16 else np.int64), kind="stable")
    flat, owner, at = flat[order], owner[order], at[order]
    member = ((flat >> U64(32 - drop - bits)) & U64(0xFFFFFFFF)).astype(np.uint32) if drop and bits + drop <= 32 else flat
    home = (names.view(U64) >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
    place = np.argsort(home, kind="stable")
    cuts, homes = np.searchsorted(at, np.arange((1 << bits) + 1)), np.searchsorted(home[place], np.arange((1 << bits) + 1))
    rows: list[tuple] = []
    for b in range(1 << bits):
        own, here = owner[cuts[b] : cuts[b + 1]], place[homes[b] : homes[b + 1]]
        if not len(own) and not len(here):
            continue
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(own)]])).astype(np.int32)
        rows.append((b, names[own[starts]].tobytes(), sizes.tobytes(), member[cuts[b] : cuts[b + 1]].tobytes(), names[here].tobytes(), numbers[here].astype(np.int64).tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6)]], names=["bucket", "names", "sizes", "members", "owners", "numbers"])


def _blobs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, member, named, number) of a bucket's rows."""

    def joined(column: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)

    sizes = joined("sizes", np.int32)
    raw = sum(len(x) for x in table.column("members").to_pylist())
    wide = raw == 8 * int(sizes.sum())
    return np.repeat(joined("names", np.int64), sizes), joined("members", U64 if wide else np.uint32), joined("owners", np.int64), joined("numbers", np.int64)


def _pairs(owner: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (member, owner) by member: index of the owner, owners, member, and in how many
    owners each member is."""
    names, index = np.unique(owner, return_inverse=True)
    order = np.lexsort((index, member))
    member, index = member[order], index[order]
    if len(member):
        first = np.concatenate([[True], (member[1:] != member[:-1]) | (index[1:] != index[:-1])])
        member, index = member[first], index[first]
        starts = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(member)]]))
        held = np.repeat(counts, counts)
    else:
        held = np.zeros(0, np.int64)
    return index, names, member, held


def _bits(total: float, each: int) -> int:
    return min(24, max(0, int(np.ceil(np.log2(max(1.0, total / each))))))


def survivors(rows: DataFrame, hot: Broadcast, size: int, name: Callable[[], Callable[[np.ndarray], int]], t: tuple[int, int], total: int) -> DataFrame:
    """Names of sets that may link with another: of a set's shingles in the lower half of the hash
    range, all but those that a linked set may lack must be in another set, too. Exact: it drops
    no set with a link. Frequent shingles count as shared without being dealt."""
    bits, lack = _bits(total / 2, BUCKET), _slackness(t)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, names, numbers, held, seen = [], [], [], 0, set()
        table, named = hot.value, name()
        for part in slices(batches, "text", 3_000_000):
            for s in shingle_sets(texts(part, "text"), size):
                key = named(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                low = s[: np.searchsorted(s, U64(1 << 63))]
                rest = low[~_is_in(low, table)]
                sets.append(rest)
                names.append(key)
                numbers.append(len(rest) - int(lack(len(s))))
                held += len(rest)
                if held > BUCKET:
                    yield from _deal(sets, np.array(names, np.int64), np.array(numbers, np.int64), bits, 1)
                    sets, names, numbers, held = [], [], [], 0
        yield from _deal(sets, np.array(names, np.int64), np.array(numbers, np.int64), bits, 1)

    def shared(table: pa.Table) -> pa.Table:
        owner, member, named, number = _blobs(table)
        index, names, _, held = _pairs(owner, member)
        n = np.bincount(index[held > 1], minlength=len(names))
        some = n > 0
        return pa.table({"key": np.concatenate([names[some], named]), "shared": np.concatenate([n[some], np.zeros(len(named), np.int64)]), "need": np.concatenate([np.full(int(some.sum()), -(1 << 40)), number])})

    dealt = rows.select("text").mapInArrow(lean(emit, _forget), BLOBS)
    found = dealt.groupBy("bucket").applyInArrow(shared, "key long, shared long, need long")
    return found.groupBy("key").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).filter("shared >= need").select("key")


def postings(sets: DataFrame, hot: Broadcast, t: tuple[int, int], total: int) -> DataFrame:
    """(member, key): the shingles in prefixes of sets, but those of one set alone. Shingles are
    ordered by how many of the sets hold them, frequent ones last; a prefix is one longer than
    what a linked set may lack, so linked sets share a member of both prefixes."""
    bits, lack = _bits(total, BUCKET), _slackness(t)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hot.value
        for batch in batches:
            names = batch.column("key").to_numpy()
            given = [np.asarray(x.values).view(U64) for x in batch.column("members")]
            rest = [s[~_is_in(s, table)] for s in given]
            wanted = np.array([int(lack(len(s))) + 1 for s in given], np.int64)
            yield from _deal(rest, names, wanted, bits, 0)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequent members of prefixes that reach them."""
        table = hot.value
        for batch in batches:
            a, h = [], []
            for key, x in zip(batch.column("key").to_pylist(), batch.column("members"), strict=True):
                s = np.asarray(x.values).view(U64)
                often = _is_in(s, table)
                more = int(lack(len(s))) + 1 - int((~often).sum())
                if more > 0:
                    h.append(s[often][:more].view(np.int64))
                    a.append(np.full(len(h[-1]), key, np.int64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), pa.array(np.concatenate(a))], names=["member", "key"])

    def counted(table: pa.Table) -> pa.Table:
        """To the bucket of each set's name: its shared members with their counts, how many of its
        members no other set has, and its prefix length."""
        owner, member, named, number = _blobs(table)
        index, names, member, held = _pairs(owner, member)
        alone = np.bincount(index[held == 1], minlength=len(names))
        several = held > 1
        order = np.argsort(index[several], kind="stable")
        index, member, held = index[several][order], member[several][order], held[several][order]
        out = []
        for what, keys, parts in (("m", names[index], (member.view(np.int64), held)), ("u", names[alone > 0], (alone[alone > 0],)), ("w", named, (number,))):
            home = (keys.view(U64) >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            place = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[place], np.arange((1 << bits) + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                own = place[cuts[b] : cuts[b + 1]]
                out.append((int(b), what, keys[own].tobytes(), parts[0][own].astype(np.int64).tobytes(), parts[1][own].astype(np.uint32).tobytes() if len(parts) > 1 else b""))
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate((("bucket", pa.int32()), ("what", pa.string()), ("keys", pa.binary()), ("values", pa.binary()), ("counts", pa.binary())))})

    def prefixes(table: pa.Table) -> pa.Table:
        part = {w: table.filter(pc.equal(table.column("what"), w)) for w in ("m", "u", "w")}
        get = lambda w, c, k=np.int64: np.frombuffer(b"".join(part[w].column(c).to_pylist()), k)
        names, first = np.unique(get("w", "keys"), return_index=True)
        left = get("w", "values")[first].copy()
        np.subtract.at(left, np.searchsorted(names, get("u", "keys")), get("u", "values"))
        owner, member, held = np.searchsorted(names, get("m", "keys")), get("m", "values"), get("m", "counts", np.uint32)
        order = np.lexsort((member.view(U64), held, owner))
        owner, member = owner[order], member[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = rank < left[owner] if len(owner) else np.zeros(0, bool)
        return pa.table({"member": member[keep], "key": names[owner[keep]]})

    dealt = sets.select("key", "members").mapInArrow(lean(emit), BLOBS).groupBy("bucket").applyInArrow(counted, "bucket int, what string, keys binary, values binary, counts binary")
    found = dealt.groupBy("bucket").applyInArrow(prefixes, "member long, key long")
    return cut(found.unionAll(sets.select("key", "members").mapInArrow(lean(last), "member long, key long")))


def _stars(posts: DataFrame) -> DataFrame:
    """Edges (a, b) from each row of a group to the smallest; they connect what shares a group."""
    least = posts.groupBy("member").agg(F.min("key").alias("b"))
    return posts.join(least, "member").select(F.col("key").alias("a"), "b").filter("a <> b").distinct()


def first_links(posts: DataFrame, sets: DataFrame, t: tuple[int, int], rounds: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """Links of the first rounds of pivots, and of the rows (member, key) those in groups that they
    do not connect, with the root of each key.

    A group's pivot is its smallest row. In a round each row is compared with one pivot that it
    is not connected with, so a round makes one comparison a row at most, and copies of one text
    are connected before any cell is gathered."""
    edges, links, roots = cut(_stars(posts)), [], None
    for turn in range(rounds):
        open_ = edges
        if roots is not None:
            open_ = open_.join(roots.withColumnsRenamed({"key": "a", "root": "x"}), "a", "left").join(roots.withColumnsRenamed({"key": "b", "root": "y"}), "b", "left")
            open_ = open_.filter(F.coalesce("x", "a") != F.coalesce("y", "b"))
        one = F.min("b") if turn == 0 else F.min_by("b", F.xxhash64("b", F.lit(turn)))
        links.append(cut(compare(cut(open_.groupBy("a").agg(one.alias("b"))), sets, t).filter("link").select("a", "b")))
        roots = cut(components(_union(links)).withColumnsRenamed({"a": "key", "b": "root"}))
    rooted = cut(posts.join(roots, "key", "left").select("member", "key", F.coalesce("root", "key").alias("root")))
    several = rooted.groupBy("member").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("member")
    return links, cut(rooted.join(several, "member", "left_semi"))


def _salted(edges: DataFrame, bound: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Edges with a salt, and (b, salts): rows of a pivot with more than `bound` edges are dealt
    over several keys, so that no task gets all of them."""
    often = cut(edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound).select("b", F.ceil(F.col("n") / bound).cast("int").alias("salts")))
    own = with_ids(edges, often, "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int"))
    return own.drop("salts"), often


def compare(edges: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Edges (a, b) of distinct names with d, the Jaccard distance of the sets (key, members) of
    these names, and link, whether it is small enough. Sizes of intersections are native; a pivot
    b with very many rows is joined in salted parts."""
    edges, often = _salted(edges)
    tops = with_ids(sets.join(edges.select(F.col("b").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("b"), F.col("members").alias("y")), often, "left")
    tops = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    both = edges.join(sets.select(F.col("key").alias("a"), F.col("members").alias("x")), "a").join(tops, ["b", "salt"])
    both = both.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).cast("long").alias("c"))
    union = F.col("m") + F.col("n") - F.col("c")
    return both.select("a", "b", (1 - F.col("c") / union).alias("d"), (F.col("c") * t[1] >= union * t[0]).alias("link"))


def prefixes(members: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(cell, member, key) of rows (cell, key, members): the members of prefixes, the rarest in the
    cell first, that more than one row of the cell holds."""
    each = members.select("cell", "key", F.explode("members").alias("member"))
    held = each.groupBy("cell", "member").agg(F.count(F.lit(1)).alias("n"))
    own = each.join(held, ["cell", "member"]).groupBy("cell", "key").agg(F.array_sort(F.collect_list(F.struct("n", "member"))).alias("own"))
    size = F.size("own")
    most = size - F.ceil(size * t[0] / t[1]).cast("int") + 1
    return own.select("cell", "key", F.explode(F.slice("own", F.lit(1), most)).alias("p")).filter("p.n > 1").select("cell", "p.member", "key")


def split_cells(members: DataFrame, sizes: DataFrame, t: tuple[int, int], most: int, rounds: int = ROUNDS) -> tuple[DataFrame, list[DataFrame]]:
    """Cells of more than `most` shingles, split by rounds of pivots into smaller ones; what a cell
    in one task does, as joins.

    In each group of rows whose prefixes share a member (ordered anew in the cell) a round picks
    some rows as pivots, twice as many as the round before, and compares all rows of the group
    with them. Rows that are pivots in all their groups have no links to be found and leave; so do
    rows whose groups links connect already. Others go to the Voronoi region of the nearest pivot,
    and into the regions that their groups and the windows of the triangle inequality reach; a
    cell that regions would not separate stays one. The number of rounds grows with the logarithm
    of the largest group; cells that are large after `rounds` of them are left as they are.
    Returns (cell, key, members) of the cells left, and the links found."""
    left, links, r = [], [], 1 - t[0] / t[1]
    sets = cut(members.select("key", "members").dropDuplicates(["key"]))
    now, turn, label = cut(members.select("cell", "key").distinct()), 0, None
    while turn < rounds and not sizes.isEmpty():
        order = F.xxhash64("key", F.lit(turn))
        posts = cut(prefixes(now.join(sets, "key"), t).withColumn("o", order))
        if links:  # the label of earlier links connects what they do, in far fewer pieces
            label = cut(components(links[-1] if label is None else label.unionAll(links[-1])))
        if label is not None:
            posts = posts.join(label.withColumnsRenamed({"a": "key", "b": "root"}), "key", "left").withColumn("root", F.coalesce("root", "key"))
        else:
            posts = posts.withColumn("root", F.col("key"))
        held = posts.groupBy("cell", "member").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "key")).alias("best"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        share = F.pmod(F.col("o"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * PIVOTS * 2**turn / F.col("n")
        posts = posts.join(held.filter("n > 1 and lo < hi").select("cell", "member", "n", "best"), ["cell", "member"])
        posts = cut(posts.select("cell", "member", "key", "o", (share | (F.col("key") == F.col("best.key"))).alias("top")))
        tops = posts.filter("top").select("cell", "member", F.col("key").alias("b"), F.col("o").alias("bo"))
        edges = posts.join(tops, ["cell", "member"]).filter("key <> b and (not top or o > bo or o = bo and key > b)")
        done = cut(compare(cut(edges.select(F.col("key").alias("a"), "b").distinct()), sets, t))
        links.append(done.filter("link").select("a", "b"))

        stay = cut(posts.groupBy("cell", "key").agg(F.min("top").alias("out")).filter("not out").select("cell", "key"))
        near = done.select(F.col("a").alias("key"), F.col("b").alias("pivot"), "d").unionAll(done.select("b", "a", "d"))
        met = edges.select("cell", "key", F.col("b").alias("pivot")).distinct().join(near, ["key", "pivot"])
        home = stay.join(met.groupBy("cell", "key").agg(F.min(F.struct("d", "pivot")).alias("h")), ["cell", "key"]).select("cell", "key", "h.d", F.col("h.pivot").alias("home"))
        home = cut(home)
        radius = home.groupBy("cell", "home").agg(F.max("d").alias("radius"))
        placed = posts.join(home.select("cell", "key", "home"), ["cell", "key"])
        several = placed.groupBy("cell", "member").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("home").alias("homes"))
        apart = several.groupBy("cell").agg(F.sum(F.col("rows") * F.col("homes")).alias("x"), F.sum("rows").alias("y")).filter("x <= 16 * y").select("cell")
        placed = cut(placed.join(apart, "cell", "left_semi"))
        pairs = placed.select("cell", "member", "key").join(placed.select("cell", "member", "home").distinct(), ["cell", "member"]).select("cell", "key", "home").distinct()
        pairs = pairs.join(met.select("cell", "key", F.col("pivot").alias("home"), "d"), ["cell", "key", "home"], "left").join(radius, ["cell", "home"])
        pairs = cut(pairs.filter(F.col("d").isNull() | (F.col("d") <= F.col("radius") + r + 1e-12)).select("cell", "home", "key"))
        counts = pairs.groupBy("cell", "home").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
        counts = counts.join(stay.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")), "cell")
        apart = cut(counts.filter("2 * most <= rows and 2 * all <= 3 * rows").select("cell"))
        regions = pairs.join(apart, "cell", "left_semi").select(F.xxhash64("cell", "home", F.lit(turn)).alias("cell"), "key")
        now = cut(regions.unionAll(stay.join(apart, "cell", "left_anti")))
        all_sizes = cut(now.join(sets, "key").groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("members")).alias("total")))
        sizes = all_sizes.filter(F.col("total") > most)
        left.append(now.join(sizes, "cell", "left_anti"))
        now = now.join(sizes.select("cell"), "cell", "left_semi")
        turn += 1
    return _union([*left, now]).join(sets, "key").select("cell", "key", "members"), links


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def jaccard_join(docs: DataFrame, threshold: tuple[int, int] = (75, 100), size: int = 5, cell: int = CELL, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    A document's set is its distinct `size`-word shingles (see shingle_sets). Two documents link
    when threshold[1] * |intersection| >= threshold[0] * |union|; component_id is the smallest id
    reachable by links. Null or empty texts and texts without words have an empty set, link with
    nothing and are their own component. Equal sets are one vertex, so copies cost one row each;
    rows that repeat an id come back as often; a null id is never the smallest of others. Other
    columns are not read; empty tables give no rows. Shingles are compared by 64-bit hashes, sets
    by 128 bits: of `bits` (64) each has its name, and sets that share a name get others."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    scanned = cut(rows.mapInArrow(lean(_scan(size, bits), _forget), "id long, n long, key long, check long, hot boolean"))
    all_docs = scanned.filter("not hot").select("id", "n", "key", "check")
    frequent = scanned.filter("hot").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(HOT).toArrow()
    hot = spark.sparkContext.broadcast(np.sort(frequent["key"].to_numpy().astype(np.int64).view(U64)))
    named = F.when(F.col("id") != NO_ID, F.col("id"))
    of = lambda given: cut(given.filter("n > 0").groupBy("key").agg(F.min(named).alias("rep"), F.max("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")))
    classes, renamed = of(all_docs), None
    if not (twice := classes.filter("lo < hi").select("key")).isEmpty():  # two sets of one name, about one in 10^19 pairs
        again = all_docs.filter("n > 0").join(twice, "key", "left_semi").select("key", "check").distinct().withColumn("other", F.xxhash64("key", "check"))
        again = cut(again)
        renamed = spark.sparkContext.broadcast({(r["key"], r["check"]): r["other"] for r in again.collect()})
        all_docs = cut(all_docs.join(again, ["key", "check"], "left").select("id", "n", F.coalesce("other", "key").alias("key"), "check"))
        classes = of(all_docs)
    classes, all_docs = classes.select("key", "rep", "n"), all_docs.select("id", "n", "key")
    total = classes.agg(F.sum("n")).first()[0] or 0
    name = lambda: _namer(renamed, bits)

    alive = cut(survivors(rows, hot, size, name, threshold, total).join(classes, "key").select("key", "n", F.coalesce("rep", F.lit(NO_ID)).alias("id")))
    found = "key long, members array<bigint>"
    if alive.limit(SENT + 1).count() <= SENT:  # as arrays: the driver would build tables of many times their size
        given = alive.select("id", "key").toArrow()
        wanted = spark.sparkContext.broadcast(tuple(np.sort(given[c].to_numpy().astype(np.int64)) for c in ("id", "key")))
        del given
        sets = rows.mapInArrow(lean(_sets(size, name, wanted), _forget), found)
    else:
        picked = with_ids(rows, cut(alive.select("id").distinct()), "left_semi")
        sets = with_ids(picked.mapInArrow(lean(_sets(size, name, None), _forget), found), alive.select("key"), "left_semi")
    sets = cut(sets.dropDuplicates(["key"]))
    total = alive.agg(F.sum("n")).first()[0] or 0

    links, live = first_links(postings(sets, hot, threshold, total), sets, threshold)
    if not live.isEmpty():
        cells = components(_stars(live)).withColumnsRenamed({"a": "key", "b": "cell"})
        cells = cells.unionAll(cells.select("cell", "cell").distinct()).join(live.select("key", "root").distinct(), "key")
        cells = cut(cells.join(alive.select("key", "n"), "key").select("key", "cell", "n", "root"))
        sizes = cut(cells.groupBy("cell").agg(F.sum("n").alias("total")))
        large = sizes.filter(F.col("total") > cell)
        members = sets.join(cells.select("key", "cell"), "key").select("cell", "key", "members")
        if not large.isEmpty():
            parts, more = split_cells(members.join(large.select("cell"), "cell", "left_semi"), cut(large), threshold, cell)
            links += more
            members = members.join(large.select("cell"), "cell", "left_anti").unionAll(parts)
        packs = 8 * int(sizes.agg(F.sum("total")).first()[0] // cell) + 64
        dealt = members.join(cells.select("key", "root"), "key").withColumn("pack", F.pmod(F.xxhash64("cell"), F.lit(packs)))
        links.append(dealt.groupBy("pack").applyInArrow(cell_links(threshold), "a long, b long"))

    found = components(_union(links)).withColumnsRenamed({"a": "key", "b": "root"})
    found = found.unionAll(found.select("root", "root").distinct())
    smallest = found.join(classes, "key").groupBy("root").agg(F.min("rep").alias("least"))
    labelled = found.join(smallest, "root").select("key", "least")
    labelled = classes.join(labelled, "key", "left").select("key", F.coalesce("least", "rep").alias("component_id"))
    labelled = fresh(cut(labelled), "key")
    out = all_docs.join(labelled, "key", "left")
    real = F.when(F.col("id") != NO_ID, F.col("id"))
    return out.select(real.alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(real).alias("component_id"))
