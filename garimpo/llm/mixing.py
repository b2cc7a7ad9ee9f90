"""Mixing sources to target weights (problem 8).

Method: Pareto order sampling. A text is to be used an expected number of times, in
proportion to its weight and at most its source's cap; the whole part is allocated
for certain, the fraction is an inclusion probability. Texts are ranked by the odds of a fixed uniform number
over the odds of inclusion, and the smallest ranks are taken until the source's
remaining tokens are used up. The cut is found from a histogram of ranks, so no
source is ever sorted as a whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from garimpo.session import written

CELLS = 4096  # cells of the rank histogram of a source


def clean_source(source: Column) -> Column:
    """Trimmed, lower case, without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.trim(source)), r"^www\.", "")


def token_counts(texts: DataFrame, ranks: str, pattern: str | None = None) -> DataFrame:
    """(key, text) to (key, tokens) by the byte-pair vocabulary in the driver's file
    ``ranks`` (tiktoken format, below 1 MB), which is sent to the tasks. ``pattern``
    cuts texts into pieces; without it that of the public tokenizers' package
    holds. A null text has no tokens."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(ranks, "rb") as file:
        shared = texts.sparkSession.sparkContext.broadcast((file.read(), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        lines, pattern = shared.value
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        encoding = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["key", "tokens"])

    return texts.mapInArrow(run, "key long, tokens long")


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends only on the seed and the columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _rates(texts: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, rate, max_repeats): the rate at which min(max_repeats, rate * weight)
    uses of every text add up to the source's planned tokens. Texts at the cap are
    set aside and the rate is raised for the others until no more reach it. The
    driver keeps one number for each target."""
    goals = {r["source"]: r for r in plan.where("available > 0").select("source", "planned", "max_repeats").collect()}
    rates = dict.fromkeys(goals, 0.0)
    schema = "source string, rate double, max_repeats int"
    while True:
        table = texts.sparkSession.createDataFrame([(k, rates[k], goals[k]["max_repeats"]) for k in goals], schema)
        capped = F.col("rate") * F.col("weight") >= F.col("max_repeats")
        sums = texts.join(table, "source").groupBy("source").agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(~capped, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("free"))
        found = {r["source"]: (goals[r["source"]]["planned"] - r["full"] * goals[r["source"]]["max_repeats"]) / r["free"] if r["free"] else rates[r["source"]] for r in sums.collect()}
        # rates only grow while texts reach the cap; an equal or smaller one ends it
        grown = {k: v for k, v in found.items() if v > rates[k] * (1 + 1e-12)}
        if not grown:
            return table
        rates.update(grown)


def mix(
    docs: DataFrame, targets: DataFrame, ranks: str, *, total_tokens: int | None = None, seed: int = 20, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): the chosen texts with the number of uses, and the shares.

    uses is (doc_id, source, tokens, uses); shares is (source, target_share,
    max_repeats, texts, available_tokens, planned_tokens, used_tokens,
    actual_share). Equal texts of one source are one text, which stands under its
    smallest doc_id, so its copies do not add to its repeats. Without
    ``total_tokens`` the total is the largest at which every source that has texts
    can reach its share within its repeats. A source without texts cannot be used:
    its shortfall shows in the shares and is not given to others. Null, blank and
    wordless texts, unknown sources and null shares are left out; of repeated
    targets the largest share and repeats hold. ``weight`` names a column of wanted
    use relative to other texts of the source (the same for all without it); texts
    with a null weight or one not above 0 are left out."""
    spark = docs.sparkSession
    goal = targets.where("source IS NOT NULL AND target_share > 0").groupBy(clean_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), clean_source(F.col(source)).alias("source"), F.col(text).alias("text"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    rows = rows.where("doc_id IS NOT NULL AND trim(text) != '' AND weight > 0").join(goal.select("source"), "source", "left_semi")
    keyed = rows.select("doc_id", "source", F.xxhash64("text").alias("h"), F.md5("text").alias("m"), "weight")
    firsts = keyed.groupBy("source", "h", "m").agg(F.min("doc_id").alias("doc_id"), F.max("weight").alias("weight")).select("doc_id", "source", "weight")
    counted = token_counts(rows.select(F.col("doc_id").alias("key"), "text"), ranks).groupBy("key").agg(F.max("tokens").alias("tokens"))
    texts = written(firsts.join(counted, firsts["doc_id"] == counted["key"]).where("tokens > 0").select("doc_id", "source", "tokens", "weight"), "tokens")

    have = texts.groupBy("source").agg(F.count("*").alias("texts"), F.sum("tokens").alias("available"))
    plan = goal.join(have, "source", "left").withColumns({"texts": F.coalesce("texts", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    if total_tokens is None:
        most = plan.where("available > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("n")).first()["n"]
        total_tokens = int(most or 0)
    planned = F.least(F.col("target_share") * F.lit(float(total_tokens)), (F.col("available") * F.col("max_repeats")).cast("double"))
    plan = written(plan.withColumn("planned", F.coalesce(planned, F.lit(0.0))), "plan")

    expected = texts.join(_rates(texts, plan), "source").withColumn("each", F.least(F.col("rate") * F.col("weight"), F.col("max_repeats").cast("double")))
    expected = expected.withColumn("whole", F.floor("each")).withColumn("part", F.col("each") - F.floor("each"))
    left = expected.groupBy("source").agg(F.sum(F.col("part") * F.col("tokens")).alias("left"))
    u, p = uniform(seed, "source", "doc_id"), F.col("part")
    rank = (u / (1 - u)) / (p / (1 - p))
    ranked = expected.join(left, "source").withColumn("rank", F.when((p > 0) & (p < 1), rank))
    # ranks in (0, 1) form; the cut lies about the middle, where they are dense by p (1 - p)
    ranked = ranked.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS))
    cells = ranked.where("rank IS NOT NULL").groupBy("source", "cell", "left").agg(F.sum("tokens").alias("tokens"))
    through = F.sum("tokens").over(Window.partitionBy("source").orderBy("cell"))
    cells = cells.withColumn("before", through - F.col("tokens")).select("source", "cell", "before", (F.col("before") + F.col("tokens") <= F.col("left")).alias("full"))
    placed = ranked.join(cells, ["source", "cell"], "left")
    border = placed.where("NOT full AND before < left")
    order = Window.partitionBy("source", "cell").orderBy("rank", "doc_id")
    border = border.withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    # the text across the border is taken if more than half of it fits
    border = border.where(F.col("upto") - F.col("tokens") / 2 <= F.col("left"))
    sampled = placed.where("full").select("doc_id", "source").union(border.select("doc_id", "source")).withColumn("more", F.lit(1))
    chosen = ranked.join(sampled, ["doc_id", "source"], "left")
    uses = chosen.select("doc_id", "source", "tokens", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("int").alias("uses")).where("uses > 0")
    uses = written(uses, "uses")
    used = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    grand = used.agg(F.sum("used_tokens").alias("n")).first()["n"] or 0
    shares = plan.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", "texts", F.col("available").alias("available_tokens"), F.round("planned").cast("long").alias("planned_tokens"),
        F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), (F.coalesce("used_tokens", F.lit(0)) / F.lit(float(grand or 1))).alias("actual_share"),
    )
    return uses, shares
