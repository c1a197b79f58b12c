"""Problem 9: draw texts by source in target shares of the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.tokens import TOKENIZER, token_sizes
from legajo.session import materialize

SEED = 20241
#: Rows meant for one bucket of the two-level prefix sum.
ROWS_PER_BUCKET = 20_000


def draw_mix(
    df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    total_tokens: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """(drawn texts, shares reached).

    drawn: (doc_id, source, n_tokens, times), times >= 1 and at most the source's max_repeats.
    shares: one row per target: (source, target_weight, max_repeats, available_tokens, budget_tokens,
    drawn_tokens, actual_share, full_rounds).

    Without total_tokens the total is the largest for which each source that has tokens can give its
    share within its repeats. A source is gone through whole as often as its budget holds, the rest is
    the start of one more round in the order of a hash-random key, cut at the budget: the one text that
    lies across the cut is in, out or passed over, whichever comes nearest. Running sums are taken in two levels: the key's leading bits make buckets,
    sums of buckets are accumulated first, then rows inside each bucket; so a source with a third of all
    rows is spread over many tasks. Null, unknown or zero-weight sources, null ids and texts without
    tokens are never drawn; weights are taken relative to the sources that have tokens. Repeated target
    rows: the first by weight counts. Equal texts under several ids are separate texts.
    """
    sized = materialize(
        token_sizes(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")), "text", ["doc_id", "source"], tokenizer)
        .filter("doc_id is not null and source is not null and n_tokens > 0"), "mix")
    goals = targets.groupBy("source").agg(F.max(F.struct("target_weight", "max_repeats")).alias("t")).select(
        "source", F.col("t.target_weight").alias("target_weight"), F.greatest(F.lit(1), F.coalesce("t.max_repeats", F.lit(1))).alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count(F.lit(1)).alias("rows"))
    # A row per source: what follows is a few numbers, not data.
    plan = goals.join(have, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    able = (F.col("available_tokens") > 0) & (F.coalesce("target_weight", F.lit(0.0)) > 0)
    whole = plan.filter(able).agg(F.sum("target_weight").alias("w"))
    plan = plan.crossJoin(F.broadcast(whole)).withColumn("w", F.when(able, F.col("target_weight") / F.col("w")).otherwise(0.0))
    reach = plan.filter("w > 0").agg(F.min(F.col("max_repeats") * F.col("available_tokens") / F.col("w")).alias("reach"))
    total = F.col("reach") if total_tokens is None else F.lit(float(total_tokens))
    plan = plan.crossJoin(F.broadcast(reach)).withColumn(
        "budget_tokens", F.when(F.col("w") > 0, F.least(F.round(total * F.col("w")), F.col("max_repeats") * F.col("available_tokens"))).otherwise(0).cast("long"))
    plan = plan.withColumn("full_rounds", F.when(F.col("available_tokens") > 0, F.floor(F.col("budget_tokens") / F.col("available_tokens"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("budget_tokens") - F.col("full_rounds") * F.col("available_tokens")).drop("w", "reach")
    plan = materialize(plan, "plan")  # a row for each target; read by every later step

    rows_in, buckets = sized.count(), 1
    while buckets * ROWS_PER_BUCKET < rows_in:
        buckets *= 2
    key = F.xxhash64("doc_id", F.lit(seed))
    rows = sized.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")).drop("s")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, ["source", "bucket"])
    upto = F.col("before") + F.col("upto")
    run = materialize(run.select("doc_id", "source", "n_tokens", upto.alias("upto")), "order")
    # What is joined from here on has a row for each target source: broadcast, so that no source's rows are gathered.
    run = run.join(F.broadcast(plan.select("source", "full_rounds", "rest", "max_repeats")), "source")
    # One text of a source may lie across its cut. Either it is in or out, by where its larger part lies, or it is passed
    # over and the order goes on without it, so that one huge text does not spoil a share: whichever comes nearer.
    across = (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n_tokens") < F.col("rest"))
    held = run.filter(across).groupBy("source").agg(F.max("upto").alias("held_upto"), F.max("n_tokens").alias("held"))  # a row per source
    run = run.join(F.broadcast(held), "source", "left").na.fill(0, ["held"])
    whole = F.col("upto") <= F.col("rest")
    beyond = F.coalesce(F.col("upto") > F.col("held_upto"), F.lit(False)) & (F.col("upto") - F.col("held") - F.col("n_tokens") / 2 < F.col("rest"))
    start = F.col("held_upto") - F.col("held")
    missed = F.abs(F.first("rest") - F.sum(F.when(whole | beyond, F.col("n_tokens")).otherwise(0)))
    kept = F.least(F.first("held_upto") - F.first("rest"), F.first("rest") - F.first(start))
    better = run.groupBy("source").agg(F.coalesce(missed <= kept, F.lit(False)).alias("pass_over"))  # a row per source
    run = run.join(F.broadcast(better), "source")
    is_held = F.coalesce(F.col("upto") == F.col("held_upto"), F.lit(False))
    extra = F.when(whole, 1).when(F.col("pass_over"), beyond.cast("int")).otherwise((is_held & (F.col("rest") - start > F.col("held") / 2)).cast("int"))
    drawn = run.withColumn(
        "times", F.least(F.col("full_rounds") + extra, "max_repeats").cast("int")).filter("times > 0").select("doc_id", "source", "n_tokens", "times")
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("drawn_tokens"))
    shares = plan.drop("rows", "rest").join(F.broadcast(got), "source", "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
    sum_all = shares.agg(F.sum("drawn_tokens").alias("all_tokens"))
    shares = shares.crossJoin(F.broadcast(sum_all)).select(
        "source", "target_weight", "max_repeats", "available_tokens", "budget_tokens", "drawn_tokens",
        F.when(F.col("all_tokens") > 0, F.col("drawn_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"), "full_rounds")
    return drawn, shares
