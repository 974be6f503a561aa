"""Preference pairs: the common prompt once, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows of one key are summed in buckets of that many order values.
BUCKET = 256
# Rows without an order value are told apart by that many characters.
TIE_CHARS = 24
PLACE = ["pair_id", "b__"]


def _bucket(number: str) -> Column:
    return F.floor(F.col(number) / BUCKET)


def render(role: Column, text: Column) -> Column:
    """A turn as the template writes it."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of a key up to the row, itself included.

    ``order[0]`` is a number, which may be null (first); the others are texts and break
    ties. A window sums within buckets of ``order[0]``, and of the first characters of
    the others where it is null; bucket totals are summed in a second window and joined
    back. So no task gets all rows of a long key, only its buckets.
    """
    number, ties = F.col(order[0]), [F.when(F.col(order[0]).isNull(), F.substring(c, 1, TIE_CHARS)) for c in order[1:]]
    bucket = F.struct(
        F.coalesce(F.floor(number / BUCKET), F.lit(-(2**62))).alias("n"),
        *(F.coalesce(t, F.lit("")).alias(f"t{i}") for i, t in enumerate(ties)),
    )
    bucketed = df.withColumns({"v__": value, "b__": bucket})
    within = W.partitionBy(*keys, "b__").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = bucketed.withColumn("s__", F.sum("v__").over(within))
    totals = bucketed.groupBy(*keys, "b__").agg(F.sum("v__").alias("t__"))
    before = W.partitionBy(*keys).orderBy("b__").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "b__", F.coalesce(F.sum("t__").over(before), F.lit(0)).alias("o__"))
    joined = summed.join(offsets, [*keys, "b__"])
    return joined.withColumn(name, F.col("s__") + F.col("o__")).drop("v__", "b__", "s__", "o__")


def turns_in_order(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``pair_id, position, role, text``: the turns of each conversation, counted from 0.

    Turns stand in the order of their number, null first, then role and text. A
    repeated row counts once; null roles and texts are empty; rows without an id are
    dropped.
    """
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("pair_id"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    ).distinct()
    counted = running_sum(turns, ["pair_id"], ["turn", "role", "text"], F.lit(1).cast("long"), "n")
    return counted.select("pair_id", (F.col("n") - 1).alias("position"), "role", "text")


def format_preferences(
    chosen: DataFrame,
    rejected: DataFrame,
    id_col: str = "pair_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """``pair_id, part, position, role, rendered, trained, start, stop``: a row per rendered turn.

    The longest common prefix of a pair is the turns, from the first on, with equal
    role and text in both conversations. It is rendered once as part ``prompt``; the
    other turns of either conversation are its completion, part ``chosen`` or
    ``rejected``. ``start`` and ``stop`` are offsets in characters in the text of the
    part, so that the rows of a part, put together by position, are its text.
    ``trained`` is the mask: true for turns of ``trained_role`` in a completion.

    Equal conversations are all prompt; an id on one side only has an empty prompt
    and one completion. See :func:`turns_in_order` for nulls, ties and repeated rows.
    Empty tables give an empty table, other columns are not read.

    Turns of both sides meet in one exchange by id and bucket of positions; windows
    and sums stay within a bucket, and what goes from bucket to bucket (prefix,
    offsets) is joined as a row for each. So a conversation with very many turns is
    spread over tasks, and texts are not shuffled again.
    """
    sides = [
        turns_in_order(side, id_col, turn_col, role_col, text_col).withColumn("side", F.lit(name))
        for side, name in ((chosen, "chosen"), (rejected, "rejected"))
    ]
    both = sides[0].unionByName(sides[1]).withColumn("b__", _bucket("position"))
    # Of turns at the same position "chosen" comes first.
    near = W.partitionBy(*PLACE).orderBy("position", "side")
    turn = F.struct("position", "role", "text")
    other = F.when(F.col("side") == "chosen", F.lead(turn).over(near)).otherwise(F.lag(turn).over(near))
    paired = both.withColumn("same__", turn.eqNullSafe(other))
    ends = paired.groupBy(*PLACE).agg(
        F.min(F.when(~F.col("same__"), F.col("position"))).alias("differs"), F.max("position").alias("last")
    )
    pair = W.partitionBy("pair_id")
    prefixes = ends.select(
        *PLACE, F.coalesce(F.min("differs").over(pair), F.max("last").over(pair) + 1).alias("prefix")
    )
    common = F.col("position") < F.col("prefix")
    rendered = (
        paired.join(prefixes, PLACE)
        .where(~common | (F.col("side") == "chosen"))
        .select(
            *PLACE, F.when(common, F.lit("prompt")).otherwise(F.col("side")).alias("part"), "position", "role",
            render(F.col("role"), F.col("text")).alias("rendered"),
            (~common & (F.col("role") == trained_role)).alias("trained"),
        )
    )
    size = F.length("rendered").cast("long")
    sizes = rendered.groupBy(*PLACE, "part").agg(F.sum(size).alias("size"))
    earlier = W.partitionBy("pair_id", "part").orderBy("b__").rowsBetween(W.unboundedPreceding, -1)
    # At most three parts in a bucket.
    offsets = (
        sizes.select(*PLACE, "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("o"))
        .groupBy(*PLACE)
        .agg(F.map_from_entries(F.collect_list(F.struct("part", "o"))).alias("offsets"))
    )
    so_far = W.partitionBy(*PLACE, "part").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = (
        rendered.withColumn("within", F.sum(size).over(so_far))
        .join(offsets, PLACE)
        .withColumn("stop", F.col("within") + F.col("offsets")[F.col("part")])
    )
    return summed.select(
        "pair_id", "part", "position", "role", "rendered", "trained",
        (F.col("stop") - F.length("rendered")).alias("start"), "stop",
    )


def assemble(parts: DataFrame) -> DataFrame:
    """``pair_id, prompt, chosen, rejected`` as whole texts; missing parts are empty.

    Each pair becomes one row, so its conversations must fit in one.
    """
    def text(part: str) -> Column:
        of = F.collect_list(F.when(F.col("part") == part, F.struct("position", "rendered")))
        return F.array_join(F.transform(F.array_sort(of), lambda t: t["rendered"]), "").alias(part)

    return parts.groupBy("pair_id").agg(*(text(p) for p in ("prompt", "chosen", "rejected")))


def echoing(conversations: DataFrame) -> DataFrame:
    """A worse version of each conversation (``conv_id, turn, role, text``).

    From its middle reply on, each ``assistant`` turn repeats the turn before it.
    """
    turns = turns_in_order(conversations, "conv_id", "turn", "role", "text").withColumn("b__", _bucket("position"))
    reply = (F.col("role") == "assistant").cast("long")
    within = W.partitionBy(*PLACE).orderBy("position")
    counted = turns.select(
        "*", F.sum(reply).over(within.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("here"),
        F.lag("text").over(within).alias("said"),
    )
    replies = turns.groupBy(*PLACE).agg(F.sum(reply).alias("n"))
    pair = W.partitionBy("pair_id")
    earlier = pair.orderBy("b__").rowsBetween(W.unboundedPreceding, -1)
    totals = replies.select(
        *PLACE, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(pair).alias("total")
    )
    # The turn before the first one of a bucket is the last one of the bucket before.
    last = turns.where((F.col("position") + 1) % BUCKET == 0).select(
        "pair_id", (F.col("b__") + 1).alias("b__"), F.col("text").alias("said_in_last")
    )
    late = (F.col("role") == "assistant") & ((F.col("here") + F.col("before")) * 2 > F.col("total"))
    said = F.coalesce("said", "said_in_last", F.lit(""))
    return (
        counted.join(totals, PLACE)
        .join(last, PLACE, "left")
        .select(
            F.col("pair_id").alias("conv_id"), F.col("position").alias("turn"), "role",
            F.when(late, said).otherwise(F.col("text")).alias("text"),
        )
    )
