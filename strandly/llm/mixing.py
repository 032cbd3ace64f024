"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words

LEVELS = ["domain", "lang", "source"]
#: The order of a leaf's epoch is summed in 2**STEP parts, the part where its budget ends in as many
#: again, and so on DEEP times before any row is ranked.
STEP, DEEP = 8, 3
#: Most leaves whose plan is broadcast; above it the same joins shuffle.
LEAVES = 100_000
UNKNOWN = "?"


@dataclass(frozen=True)
class Targets:
    """Weights of the children of each node of the tree, by path: () for domains, (domain,) for
    languages, (domain, lang) for sources. Children not named weigh `other`; weights need not sum
    to one. `ratio`: tokens wanted for each token there is. `epochs`: most passes over a leaf."""

    weights: dict[tuple[str, ...], dict[str, float]] = field(default_factory=dict)
    other: float = 1.0
    ratio: float = 1.0
    epochs: int = 4
    seed: int = 20240601

    def weight(self, path: tuple[str, ...], child: str) -> float:
        return self.weights.get(path, self.weights.get(("*",) * len(path), {})).get(child, self.other)


def share(budget: float, wanted: dict[str, float], most: dict[str, float]) -> dict[str, float]:
    """The budget by weight, none above its most; what one cannot take goes to its siblings."""
    got = dict.fromkeys(wanted, 0.0)
    open_ = {k for k, w in wanted.items() if w > 0 and most[k] > 0}
    left = min(budget, sum(most[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(wanted[k] for k in open_)
        full = {k for k in open_ if got[k] + left * wanted[k] / total >= most[k]}
        if not full:
            for k in open_:
                got[k] += left * wanted[k] / total
            return got
        for k in sorted(full):
            left -= most[k] - got[k]
            got[k] = most[k]
        open_ -= full
    return got


def budgets(tokens: dict[tuple[str, ...], int], targets: Targets) -> dict[tuple[str, ...], float]:
    """Tokens to take of each leaf, for trees at hand (`leaf_budgets` does the same in Spark). A
    node's most is the sum of its leaves' tokens times the epochs, so a shortage stays among
    siblings until their common parent is full."""
    most: dict[tuple[str, ...], float] = {}
    for leaf, n in tokens.items():
        for i in range(len(leaf) + 1):
            most[leaf[:i]] = most.get(leaf[:i], 0.0) + n * targets.epochs
    out: dict[tuple[str, ...], float] = {}

    def down(path: tuple[str, ...], budget: float) -> None:
        if path in tokens:
            out[path] = budget
            return
        children = {p[-1] for p in most if len(p) == len(path) + 1 and p[:-1] == path}
        got = share(budget, {c: targets.weight(path, c) for c in sorted(children)}, {c: most[(*path, c)] for c in children})
        for c in sorted(children):
            down((*path, c), got[c])

    if tokens:
        down((), targets.ratio * sum(tokens.values()))
    return out


def _weight(targets: Targets, path: list[str], child: str) -> Column:
    """Targets.weight as an expression on the columns of a path and a child."""

    def of(weights: dict[str, float]) -> Column:
        if not weights:
            return F.lit(float(targets.other))
        table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
        return F.coalesce(F.try_element_at(table, F.col(child)), F.lit(float(targets.other)))

    out = of(targets.weights.get(("*",) * len(path), {}))
    for names, weights in targets.weights.items():
        if path and len(names) == len(path) and set(names) != {"*"}:
            here = F.lit(True)
            for c, name in zip(path, names, strict=True):
                here = here & (F.col(c) == name)
            out = F.when(here, of(weights)).otherwise(out)
    return out


def leaf_budgets(totals: DataFrame, targets: Targets) -> DataFrame:
    """`budgets` of leaves (domain, lang, source, n) as column budget, planned in Spark.

    Level by level the children of a node are ordered by how soon their weight fills them; a child
    is full if the budget covers all that fill before it and as much for the weight of the rest,
    and what full ones leave is shared by weight among the others."""
    tree = totals.select(*LEVELS, "n", (F.col("n") * float(targets.epochs)).alias("most"))
    now = None
    for i, child in enumerate(LEVELS):
        path = LEVELS[:i]
        rows = tree.groupBy(*path, child).agg(F.sum("most").alias("most"), F.sum("n").alias("n"))
        by = Window.partitionBy(path or F.lit(0))
        if now is None:
            rows = rows.withColumn("budget", F.sum("n").over(by) * float(targets.ratio))
        else:
            rows = rows.join(now, path)
        rows = rows.withColumn("w", _weight(targets, path, child)).withColumn("open", (F.col("w") > 0) & (F.col("most") > 0))
        used = lambda c: F.when(F.col("open"), F.col(c)).otherwise(0.0)
        order = by.orderBy(F.col("open").desc(), F.col("most") / F.when(F.col("open"), F.col("w")), child)
        before = F.coalesce(F.sum(used("most")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        behind = F.sum(used("w")).over(order.rowsBetween(0, Window.unboundedFollowing))
        rows = rows.withColumn("full", F.col("open") & (before + F.col("most") / F.col("w") * behind <= F.col("budget")))
        left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(by)
        rest = F.sum(F.when(F.col("open") & ~F.col("full"), F.col("w"))).over(by)
        got = F.when(F.col("full"), F.col("most")).when(F.col("open"), left * F.col("w") / rest).otherwise(0.0)
        now = rows.select(*path, child, got.alias("budget"))
    return totals.join(now, LEVELS)


def plan(rows: DataFrame, targets: Targets) -> DataFrame:
    """Of rows (domain, lang, source, id, n): per leaf the full epochs, and the last place (hash,
    id) of the token-prefix of one more epoch in its seeded order; null if that is empty.

    A leaf's order is summed in parts of the hash range with map-side combining, then the part
    where its budget ends again; so no more than 2**STEP parts of a leaf come together, and only
    rows of the last part, one of 2**(STEP * DEEP), are ranked."""
    totals = cut(rows.groupBy(LEVELS).agg(F.sum("n").alias("n")))
    leaves = leaf_budgets(totals, targets).withColumn("full", F.when(F.col("n") > 0, F.least(F.lit(targets.epochs), F.floor(F.col("budget") / F.col("n")))).otherwise(0).cast("int"))
    rest = F.when((F.col("full") < targets.epochs) & (F.col("n") > 0), F.bround(F.col("budget") - F.col("full") * F.col("n"))).otherwise(0).cast("long")
    leaves = cut(leaves.select(*LEVELS, "full", rest.alias("rest")))
    sent = F.broadcast if leaves.limit(LEAVES + 1).count() <= LEAVES else lambda df: df
    place = F.struct(F.shiftrightunsigned("h", 1).alias("o"), "h", "id")
    now = rows.join(sent(leaves), LEVELS).filter("rest > 0").withColumn("h", F.xxhash64(F.lit(targets.seed), F.col("full"), F.col("id")))
    now, ends = now.select(*LEVELS, "rest", "h", "id", "n", F.lit(0).cast("long").alias("before")), []
    for level in range(1, DEEP + 1):
        part = F.shiftrightunsigned("h", 64 - STEP * level).bitwiseAND(F.lit((1 << STEP) - 1)).cast("int")
        now = now.withColumn("part", part)
        sums = now.groupBy(*LEVELS, "rest", "before", "part").agg(F.sum("n").alias("n"), F.max(place).alias("end"))
        sums = cut(sums.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(LEVELS).orderBy("part"))))
        ends.append(sums.filter("upto <= rest").select(*LEVELS, "end"))
        edge = sums.filter("upto > rest and upto - n < rest").select(*LEVELS, "part", (F.col("upto") - F.col("n")).alias("before"))
        now = now.drop("before").join(sent(edge), [*LEVELS, "part"]).drop("part")
    ranked = now.withColumn("end", place)
    ranked = ranked.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(LEVELS).orderBy("end")))
    ends.append(ranked.filter("upto <= rest").select(*LEVELS, "end"))
    found = ends[0]
    for e in ends[1:]:
        found = found.unionAll(e)
    last = found.groupBy(LEVELS).agg(F.max("end").alias("end"))
    return cut(leaves.join(last, LEVELS, "left").select(*LEVELS, "full", "end"))


def mix(docs: DataFrame, targets: Targets, domain: Column, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` as often as the mixture takes them, with columns domain, epoch (from 0)
    and n_tokens.

    `tokens` measures a row (default: words of the text; null text has none). Null domain, lang or
    source is the child "?". Rows that repeat an id stand or fall together; null ids are ordered
    by a fixed hash, so rows of equal place come together or not at all. A leaf with no tokens is taken in no epoch. Columns of `docs` named domain,
    epoch or n_tokens are replaced; empty tables give no rows."""
    measure = (F.size(words(F.coalesce(F.col(text_col), F.lit("")))) if tokens is None else tokens).cast("long")
    leaf = [F.coalesce(x, F.lit(UNKNOWN)).alias(c) for x, c in zip((domain, F.col("lang"), F.col("source")), LEVELS, strict=True)]
    rows = cut(docs.select(*leaf, F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), measure.alias("n")))
    ends = plan(rows, targets).withColumnsRenamed({"domain": "__k0", "lang": "__k1", "source": "__k2", "full": "__full", "end": "__end"})
    keyed = docs.select(*[F.col(c) for c in docs.columns if c not in ("domain", "epoch", "n_tokens")], *[x.alias(f"__k{i}") for i, x in enumerate(leaf)], leaf[0], measure.alias("n_tokens"))
    on = ["__k0", "__k1", "__k2"]
    keyed = keyed.join(F.broadcast(ends) if ends.limit(LEAVES + 1).count() <= LEAVES else ends, on)
    hashed = F.xxhash64(F.lit(targets.seed), F.col("__full"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)))
    place = F.struct(F.shiftrightunsigned(hashed, 1).alias("o"), hashed.alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"))
    times = F.col("__full") + F.coalesce((place <= F.col("__end")).cast("int"), F.lit(0))
    copies = keyed.withColumn("__times", times).filter("__times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    return copies.drop(*on, "__full", "__end", "__times")
