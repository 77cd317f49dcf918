"""Mixing sources to target weights by temperature.

A source's share of all tokens, raised to an exponent and normalised, is its
weight: exponent 1 keeps the shares, 0 makes all sources equal. The exponent is
bisected, many points a round, until the entropy of the weights meets a target,
or until no source is repeated more often than a limit. A target that no exponent
meets is refused: an entropy below that of the largest sources alone, a budget of
more tokens than the limit of repeats allows. The budget is the given
number of tokens or, without one, the least at which every source is read in
full, so that no document is left out.

A source's target, weight times budget, is realised as whole permutations of its
documents and one partial permutation. Documents are dealt by hash into blocks of
some ``block_tokens``; a pass permutes the blocks and the documents in each. The
partial pass ends where the budget does: blocks before the last one are in it
whole, and of the last one the documents up to a hash. So the choice is a
function of a document's hash and one row for each source; texts are never
shuffled or ordered.

Tokens are words between ASCII white space, plus one for the document's end.
Defined results: null counts as empty; a null source is a source of its own;
documents alike in doc_id and text are taken or left together. An empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, looked_up, pick, positional, written

POINTS, ROUNDS = 33, 6
#: The largest exponent that is tried for an entropy.
LARGEST = 256


@dataclass(frozen=True)
class Target:
    """Production parameters. Just one of max_repeats and entropy (in nats) is used: entropy if it is given."""

    max_repeats: float = 4.0
    entropy: float | None = None
    budget_tokens: int | None = None
    block_tokens: int = 100_000
    max_blocks: int = 1_000_000  # beyond, blocks grow, so that tables of blocks stay small at any size
    seed: int = 42


def token_count(text: Column) -> Column:
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def _name(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def _hash(seed: int, doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text)


def _order(seed: int, what: str, turn: Column) -> Column:
    """The order of a pass: another hash for each pass."""
    return F.xxhash64(F.lit(seed), turn.cast("long"), F.col(what).cast("long"))


class Unreachable(ValueError):
    """A target that no exponent meets."""


def _measures(totals: DataFrame, exponents: list[float], all_tokens: int) -> dict[float, tuple[float, float, float]]:
    """For each exponent, the entropy of the weights, the largest weight-to-share ratio over the smallest, and the largest."""
    p = F.col("tokens") / F.lit(float(all_tokens))
    high = totals.agg(F.max("tokens")).first()[0] / all_tokens
    x, log = F.col("x"), F.log(F.col("p") / F.lit(high))  # against the largest share, so that nothing underflows to zero in all
    rows = totals.select(p.alias("p"), F.explode(F.array(*[F.lit(float(e)) for e in exponents])).alias("x"))
    raised = F.exp(x * log)
    ratio = raised / F.col("p")
    found = rows.groupBy("x").agg(F.sum(raised).alias("z"), F.sum(raised * x * log).alias("s"), F.max(ratio).alias("high"), F.min(ratio).alias("low"))
    found = found.select("x", (F.log("z") - F.col("s") / F.col("z")).alias("entropy"), F.try_divide("high", "low").alias("spread"), (F.col("high") / F.col("z")).alias("most"))
    return {r.x: (r.entropy, r.spread if r.spread is not None else float("inf"), r.most) for r in found.collect()}  # as many rows as exponents


def exponent(totals: DataFrame, target: Target) -> float:
    """The smallest exponent that keeps the target: the entropy at most, or the repeats at most, the target's.

    Both fall as the exponent grows: the repeats until 1, where every source is read alike, the entropy beyond it
    too, towards the sources that share the largest size. A target below what the largest exponent reaches is
    refused. Each round measures POINTS exponents over the table of sources at once and goes on between two
    neighbours; nothing but the measures comes to the driver.
    """
    all_tokens = totals.agg(F.sum("tokens")).first()[0]
    if not all_tokens:
        return 1.0

    def meets(measure: tuple[float, float, float]) -> bool:
        entropy, spread, most = measure
        if target.entropy is not None:
            return entropy <= target.entropy + 1e-9
        repeats = spread if target.budget_tokens is None else most * target.budget_tokens / all_tokens
        return repeats <= target.max_repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    if target.entropy is not None:
        steps = [2.0**i for i in range(LARGEST.bit_length())]
        measure = _measures(totals, steps, all_tokens)
        found = next((i for i, x in enumerate(steps) if meets(measure[x])), None)
        if found is None:
            raise Unreachable(f"no weights of an entropy of {target.entropy}: at exponent {steps[-1]:g} it is {measure[steps[-1]][0]:.4g}")
        low, high = (steps[found - 1] if found else 0.0), steps[found]
    elif not meets(_measures(totals, [1.0], all_tokens)[1.0]):
        needed = 1.0 if target.budget_tokens is None else target.budget_tokens / all_tokens
        raise Unreachable(f"every source is read {needed:.4g} times at least, and the limit is {target.max_repeats:g}")
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
        measure = _measures(totals, points, all_tokens)
        good = next((i for i, x in enumerate(points) if meets(measure[x])), POINTS - 1)
        if good == 0:
            return points[0]
        low, high = points[good - 1], points[good]
    return high


@dataclass
class Plan:
    """One row for each source: passes, blocks, and where its partial pass ends."""

    sources: DataFrame
    exponent: float
    target: Target
    docs: DataFrame  # doc_id, source, name, tokens, h


def planned(docs: DataFrame, target: Target = Target(), bound: int = BROADCAST_ROWS) -> Plan:
    """The weights, and how each source's documents realise them."""
    seed = target.seed
    rows = pick(docs, "doc_id", "source", "text").select("doc_id", "source", _name(F.col("source")).alias("name"), token_count(F.col("text")).alias("tokens"), _hash(seed, F.col("doc_id"), F.col("text")).alias("h"))
    rows = written(rows)
    totals = written(rows.groupBy("name").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    power = exponent(totals, target)
    all_tokens = float(totals.agg(F.sum("tokens")).first()[0] or 1)
    largest = float(totals.agg(F.max("tokens")).first()[0] or 1)
    raised = F.exp(power * F.log(F.col("tokens") / largest))
    z, least = totals.agg(F.sum(raised), F.max(F.col("tokens") / raised)).first()
    budget = target.budget_tokens if target.budget_tokens is not None else (least or 0.0) * (z or 1.0)
    weight = raised / (z or 1.0)
    goal = F.round(weight * F.lit(float(budget))).cast("long")
    block = max(target.block_tokens, -(-int(all_tokens) // target.max_blocks))
    parts = totals.select("name", "docs", F.col("tokens").alias("source_tokens"), weight.alias("weight"), goal.alias("goal"), F.expr(f"cast(ceil(tokens / {block}) as long)").alias("n_blocks"))
    parts = written(parts.withColumn("passes", F.expr("goal div source_tokens")).withColumn("rest", F.expr("goal % source_tokens")))
    # The partial pass: blocks in its order, then the documents of the block in which the budget ends.
    dealt = looked_up(rows.select("name", "tokens", "h"), parts.filter("rest > 0").select("name", "docs", "passes", "rest", "n_blocks"), "name", "docs", bound).filter("rest is not null")
    dealt = dealt.groupBy("name", "h", "passes", "rest", "n_blocks").agg(F.sum("tokens").alias("tokens")).withColumn("block", F.expr("pmod(h, n_blocks)"))
    dealt = dealt.withColumn("block_at", _order(seed, "block", F.col("passes"))).withColumn("at", _order(seed, "h", F.col("passes")))
    blocks = dealt.groupBy("name", "block_at", "rest").agg(F.sum("tokens").alias("tokens"))
    ahead = F.sum("tokens").over(Window.partitionBy("name").orderBy("block_at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = blocks.withColumn("until", ahead).filter("until > rest").groupBy("name").agg(F.min_by(F.struct("block_at", (F.col("rest") - F.col("until") + F.col("tokens")).alias("left")), "block_at").alias("end"))
    last = written(last.select("name", F.col("end.block_at").alias("end_block"), F.col("end.left").alias("left")))
    inside = dealt.join(F.broadcast(last) if last.count() <= bound else last, "name").filter("block_at = end_block")  # one block of each source
    until = F.sum("tokens").over(Window.partitionBy("name").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = inside.withColumn("until", until).filter("until <= left").groupBy("name").agg(F.max("at").alias("end_at"))
    sources = parts.join(last.select("name", "end_block"), "name", "left").join(cut, "name", "left")
    return Plan(written(sources), power, target, rows)


def _turns(seed: int) -> Column:
    """The passes in which a document stands, as numbers from 0."""
    block_at = F.xxhash64(F.lit(seed), F.col("passes"), F.expr("pmod(h, n_blocks)"))
    at = F.xxhash64(F.lit(seed), F.col("passes"), F.col("h"))
    partial = (F.col("rest") > 0) & (F.col("end_block").isNull() | (block_at < F.col("end_block")) | ((block_at == F.col("end_block")) & (at <= F.col("end_at"))))
    last = F.col("passes") - F.when(F.coalesce(partial, F.lit(False)), 0).otherwise(1)
    return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))


def mixed(docs: DataFrame, target: Target = Target(), bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document and pass: doc_id, source, tokens, weight, pass, block and at, its place in the mixed stream.

    at runs from 0 to about 1: sources are spread evenly over it, blocks of a pass in
    that pass's order, documents in theirs. Sorting by (at, source, doc_id) gives
    the stream.
    """
    plan = planned(docs, target, bound)
    seed = target.seed
    rows = looked_up(plan.docs, plan.sources, "name", "docs", bound)
    rows = rows.withColumn("pass", F.explode(_turns(seed))).withColumn("block", F.expr("pmod(h, n_blocks)"))
    rows = rows.withColumn("key", F.xxhash64("name", "pass", "block"))
    order = plan.sources.select("name", "n_blocks", "passes", "rest").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).withColumn("block", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
    order = order.withColumn("block_at", _order(seed, "block", F.col("pass")))
    place = F.row_number().over(Window.partitionBy("name", "pass").orderBy("block_at", "block")) - 1
    order = written(order.select(F.xxhash64("name", "pass", "block").alias("key"), "name", "pass", "block", place.alias("place"), F.lit(1).alias("one")))
    rows = looked_up(rows, order.select("key", "place", "one"), "key", "one", bound)
    inner = (F.xxhash64(F.lit(seed), F.col("pass"), F.col("h")).cast("double") / F.lit(2.0**64)) + 0.5
    spread = F.col("goal") / F.col("source_tokens") * F.col("n_blocks")  # blocks of the whole stream of the source
    at = (F.col("pass") * F.col("n_blocks") + F.col("place") + inner) / F.greatest(spread, F.lit(1.0))
    return rows.select("doc_id", "source", "tokens", "weight", F.col("pass").cast("int").alias("pass"), "block", at.alias("at"))


def realised(docs: DataFrame, target: Target = Target(), bound: int = BROADCAST_ROWS) -> DataFrame:
    """The documents, with all their columns, each as often as the plan has it."""
    names = docs.columns
    plan = planned(docs, target, bound)
    at = {n: F.col(f"c{names.index(n)}") for n in ("doc_id", "source", "text")}
    rows = positional(docs).withColumn("name", _name(at["source"])).withColumn("h", _hash(target.seed, at["doc_id"], at["text"]))
    rows = looked_up(rows, plan.sources, "name", "docs", bound).withColumn("turn", F.explode(_turns(target.seed)))
    return rows.select([F.col(f"c{i}") for i in range(len(names))]).toDF(*names)
