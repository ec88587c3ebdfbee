"""Chat formatting after collapsing cumulative snapshots, in DataFrame operations only.

A logger that stores a conversation after every turn leaves many conversations that are prefixes of a longer one. Each
conversation's turns get a rolling prefix hash: a running exclusive-or of 64-bit hashes of (place, role, text),
twice with different seeds, so it is linear in the turns and sorts by spilling. A conversation is dropped if its whole hash
is a proper prefix hash of another (an anti-join of distinct hashes), and of equal conversations the smallest
conv_id stays. Only what is left is rendered.

Distinct prefixes are aggregated before the join, so a first turn that many share is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlework.llm.common import read, spool

TURN, END = "<|{role}|>\n{text}\n", "<|end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, n (place from 1), a and b (hash of the turns up to it), last.

    Turns are in the order of turn, role, text. Null role and null text are values of their own.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("n"))
    content = [F.col("n"), F.col("role").isNull(), F.length(F.coalesce("role", F.lit(""))), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashed = placed.select("conv_id", "turn", "role", "text", "n", F.xxhash64(F.lit(1), *content).alias("x"), F.xxhash64(F.lit(2), *reversed(content)).alias("y"))
    return hashed.select("conv_id", "n", F.expr("bit_xor(x)").over(upto).alias("a"), F.expr("bit_xor(y)").over(upto).alias("b"), F.lead("n").over(order).isNull().alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of conversations that are not a proper prefix of any other; of equal ones the smallest. Null ids are left out."""
    hashes = spool(prefix_hashes(turns.where("conv_id is not null")), "prefixes")
    whole = hashes.where("last").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    proper = hashes.where("not last").select("n", "a", "b").distinct()
    return whole.join(proper, ["n", "a", "b"], "left_anti").select("conv_id")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and one text per conversation: each turn under its role (null: user), null text empty."""
    turn = F.struct(F.col("turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"))
    one = lambda t: F.concat(F.lit("<|"), F.coalesce(t["r"], F.lit("user")), F.lit("|>\n"), F.coalesce(t["x"], F.lit("")), F.lit("\n"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.concat(F.array_join(F.transform("turns", one), ""), F.lit(END)).alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    return render(turns.join(maximal(turns), "conv_id", "left_semi"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


#: The same in DuckDB: whole texts of turns are compared instead of hashes.
OP10_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER w AS n, role, text,
         string_agg(coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n'), '') OVER (w ROWS UNBOUNDED PRECEDING) AS key,
         lead(conv_id) OVER w IS NULL AS is_last,
         '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS shown
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
whole AS (SELECT key, min(conv_id) AS conv_id FROM t WHERE is_last GROUP BY key),
kept AS (SELECT conv_id FROM whole WHERE NOT EXISTS (SELECT 1 FROM t WHERE NOT t.is_last AND t.key = whole.key))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(shown, '' ORDER BY n) || '<|end|>' || chr(10) AS text
FROM t JOIN kept USING (conv_id) GROUP BY conv_id
"""
