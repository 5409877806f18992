"""Temperature mixing: source weights proportional to a power of the sources' token shares.

The exponent is bisected to a target entropy and a repetition limit; the weights are then
realised under a token budget by block permutations: each source is dealt by hash into BLOCKS
blocks, blocks and the rows in them stand in hash order, whole passes over a source give
whole copies and the rest of its budget takes a prefix of the permutation. Prefix sums run
over blocks first and inside a block afterwards, so no task holds a source. No Python runs on
the data; the driver sees only the sums for a grid of exponents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm._common import text_or_empty, written

BLOCKS_HEX = 3  # hexadecimal digits of a block's name: 4096 blocks
BRACKET = 30  # the exponent's bracket is narrowed to 2 ** -BRACKET
FEW, FINE, COARSE = 4096, 10, 5  # up to FEW sources a round tries 2 ** FINE - 1 exponents at once, else 2 ** COARSE - 1


def token_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_name() -> Column:
    """A null source counts as the empty name."""
    return F.coalesce(F.col("source"), F.lit(""))


def solve_exponent(sources: DataFrame, budget: float, entropy_share: float | None, max_repeat: float | None) -> float:
    """The exponent in [0, 1] for (src, tokens), rounded to six places.

    The largest one whose weights have at least entropy_share of the greatest possible entropy;
    then, if max_repeat is given and some source would be read more often, the smallest one that
    keeps to it. Entropy and the largest repetition both fall as the exponent rises.
    """
    live = sources.where("tokens > 0")
    whole = live.agg(F.count("*").alias("n"), F.sum("tokens").cast("double").alias("all")).first()
    if not whole["n"]:
        return 1.0
    share = F.col("tokens") / F.lit(whole["all"])

    def tried(low: float, high: float, first: int, last: int, parts: int) -> dict[float, tuple[float, float]]:
        """exponent -> entropy, largest repetition; the exponents are the first to the last of the bracket's parts."""
        exponent = F.lit(low) + F.lit(high - low) * F.col("i") / F.lit(float(parts))
        rows = (
            live.select(share.alias("p"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("i"))
            .withColumn("a", exponent)
            .groupBy("i")
            .agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.ln("p")).alias("zl"), F.max(F.pow(F.col("p"), F.col("a") - 1)).alias("top"))
            .collect()
        )  # a row for each exponent
        import math

        at = {r["i"]: low + (high - low) * r["i"] / parts for r in rows}
        return {at[r["i"]]: (math.log(r["z"]) - at[r["i"]] * r["zl"] / r["z"], r["top"] / r["z"] * budget / whole["all"]) for r in rows}

    bits = FINE if whole["n"] <= FEW else COARSE

    def bisect(holds) -> tuple[float, float]:
        """The bracket of the place in [0, 1] where holds, true from some exponent on, changes."""
        low, high = 0.0, 1.0
        for _ in range(BRACKET // bits):
            found = tried(low, high, 1, 2**bits - 1, 2**bits)
            bad = [a for a in found if not holds(*found[a])]
            low, high = max(bad, default=low), min([a for a in found if holds(*found[a])], default=high)
        return low, high

    import math

    ends = tried(0.0, 1.0, 0, 1, 1)
    out = 0.0 if entropy_share is None else 1.0
    goal = None if entropy_share is None else entropy_share * math.log(whole["n"])
    if goal is not None and ends[1.0][0] < goal:
        out = bisect(lambda h, _: h < goal)[0]
    if max_repeat is not None:
        least = 0.0 if ends[0.0][1] <= max_repeat else bisect(lambda _, r: r <= max_repeat)[1]
        out = max(out, least)
    return round(out, 6)


def mix(docs: DataFrame, budget_share: float = 1.0, entropy_share: float | None = 0.95, max_repeat: float | None = 4.0, seed: str = "mix") -> DataFrame:
    """docs with n_tokens, weight (of the source), copies (0 and up) and block.

    budget_share: the tokens to give out, as a share of all tokens. Sources without tokens
    have weight 0 and no copies. Null and empty texts have no tokens. Rows with a null doc_id
    take part, placed by their text; repeated rows are rows of their own and stand side by side in the permutation.
    Extra columns stay, except those named as a result or src, order_key, budget, whole, before.
    """
    if entropy_share is None and max_repeat is None:
        raise ValueError("a target is needed: entropy_share or max_repeat")
    names = {"n_tokens", "weight", "copies", "block", "src", "order_key", "budget", "whole", "before"}
    base = docs.drop(*[c for c in docs.columns if c in names])
    order_key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text_or_empty()))).cast("binary"))
    rows = base.select("*", source_name().alias("src"), token_count(text_or_empty()).alias("n_tokens"), order_key.alias("order_key")).withColumn(
        "block", F.substring("order_key", 1, BLOCKS_HEX)
    )
    blocks = written(rows.groupBy("src", "block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    sources = written(blocks.groupBy("src").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    budget = float(total) * budget_share
    exponent = solve_exponent(sources, budget, entropy_share, max_repeat)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent))).otherwise(F.lit(0.0))
    norm = sources.agg(F.coalesce(F.sum(power), F.lit(0.0)).alias("z")).first()["z"] or 1.0
    # The hair on top keeps a product that is a whole number in exact arithmetic from falling below it.
    given = sources.select("src", F.col("tokens").alias("whole"), (power / F.lit(norm)).alias("weight")).withColumn(
        "budget", F.floor(F.col("weight") * F.lit(budget) + F.lit(1e-6)).cast("long")
    )
    before = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).drop("tokens").join(given.hint("merge"), "src")
    inside = Window.partitionBy("src", "block").orderBy("order_key", F.xxhash64(text_or_empty())).rowsBetween(Window.unboundedPreceding, 0)
    passes = F.when(F.col("whole") > 0, F.expr("budget div whole")).otherwise(F.lit(0))
    return (
        rows.withColumn("upto", F.sum("n_tokens").over(inside))
        .join(starts.hint("merge"), ["src", "block"])
        .select(
            *base.columns,
            "n_tokens",
            F.round("weight", 9).alias("weight"),
            F.when(F.col("whole") > 0, passes + (F.col("before") + F.col("upto") <= F.col("budget") - passes * F.col("whole")).cast("int")).otherwise(F.lit(0)).cast("int").alias("copies"),
            F.conv("block", 16, 10).cast("int").alias("block"),
        )
    )


def realise(mixed: DataFrame) -> DataFrame:
    """A row for each copy, with epoch and its place's sort keys: epoch, block_key (blocks are permuted anew in each epoch), row_key."""
    epoch = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    shown = mixed.where("copies > 0").withColumn("epoch", epoch)
    return shown.withColumns(
        {
            "block_key": F.xxhash64("epoch", F.coalesce(F.col("source"), F.lit("")), "block"),
            "row_key": F.xxhash64("epoch", "doc_id"),
        }
    )
