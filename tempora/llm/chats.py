"""Chat formatting: collapse of cumulative snapshots, then rendering, with DataFrame functions only.

A chat that is logged after every turn leaves a conversation for each prefix of
it. Each conversation gets rolling hashes of its turn prefixes; one whose whole
hash is a proper prefix of another is dropped by an anti-join, and of equal ones
the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rolling(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (role and text in order of turn), hashes (of each prefix).

    Rows without conv_id are no conversation and are left out. A null turn sorts
    first, null role and text count as empty; equal turn numbers are ordered by
    role and text, repeated rows count as turns of their own.
    """
    turns = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return (
        conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
        .where("conv_id IS NOT NULL")
        .groupBy("conv_id")
        .agg(turns.alias("turns"))
        .withColumn(
            "hashes",
            F.expr("""aggregate(turns, CAST(array('') AS array<string>), (h, t) -> concat(h, array(sha2(concat(
                      element_at(h, -1), ':', length(t.role), ':', t.role, ':', t.text), 256))), h -> slice(h, 2, size(h) - 1))"""),
        )
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """One of each set of equal conversations, and none that begins a longer one.

    Both sides are aggregated by hash before they are shuffled to the join, so a
    first turn that many conversations share is one row of it."""
    whole = rolled.withColumn("hash", F.element_at("hashes", -1))
    inner = whole.select(F.explode(F.expr("slice(hashes, 1, size(hashes) - 1)")).alias("hash")).distinct()
    first = whole.groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    return first.join(inner, "hash", "left_anti").join(whole.drop("hash"), "conv_id")


def membership(rolled: DataFrame) -> DataFrame:
    """conv_id, kept_id of every conversation: the kept one that begins with its turns, the smallest if several do.

    Prefixes of kept conversations are aggregated by hash before they are joined."""
    prefixes = maximal(rolled).select("conv_id", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("conv_id").alias("kept_id"))
    return rolled.select("conv_id", F.element_at("hashes", -1).alias("hash")).join(prefixes, "hash").select("conv_id", "kept_id")


TEMPLATE = "concat('<|', t.role, '|>\n', trim(BOTH '\n' FROM t.text), '<|end|>')"


def render(kept: DataFrame, template: str = TEMPLATE) -> DataFrame:
    return kept.withColumn("chat", F.expr(f"array_join(transform(turns, t -> {template}), '\n')"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal (conversations with these very turns), chat."""
    return render(maximal(rolling(conversations))).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_equal", "chat")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def oracle() -> str:
    return """
    WITH t AS (SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
               FROM conversations WHERE conv_id IS NOT NULL),
    p AS (SELECT conv_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                 string_agg(concat(length(role), ':', role, ':', text), chr(1)) OVER w AS prefix,
                 string_agg(concat('<|', role, '|>', chr(10), trim(text, chr(10)), '<|end|>'), chr(10)) OVER w AS chat
          FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_equal, any_value(n) AS n_turns, any_value(chat) AS chat FROM p WHERE i = n GROUP BY prefix)
    SELECT conv_id, n_turns, n_equal, chat FROM f
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = f.prefix AND p.i < p.n)"""
