"""Chat formatting of logged conversations, after their cumulative snapshots are collapsed.

A chat log often holds a conversation once per reply, each time a little longer. Every turn has a hash of
its position, role and text; the running XOR of these hashes names each prefix of a conversation. A
conversation whose whole hash equals a proper prefix of a longer one is anti-joined away; of
equal conversations the one with the smallest id stays. What is left is rendered.

Only DataFrame functions are used. Positions and running hashes are found in two steps, within blocks of
``BLOCK`` turn numbers and then over the blocks, so a conversation of any length is not one task's work.

Turns are put in order by turn (null first), then role, then text; null roles and texts are empty
strings. Rows that are equal in all four columns are one turn. Turns with a null conv_id are one
conversation. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(turns: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).distinct()


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), and the two running hashes of the prefix that ends there."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).alias("block")
    own = _clean(turns).select("conv_id", "turn", block, F.sha2(F.concat(F.col("role"), F.lit("\x00"), F.col("text")), 256).alias("content"), "role", "text")
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = own.select("conv_id", "block", "content", F.row_number().over(inner).alias("within"))
    sizes = placed.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    p, b = placed.alias("p"), before.alias("b")
    at = F.col("b.before") + F.col("p.within")
    hashed = p.join(b, F.col("p.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("p.block") == F.col("b.block"))).select("p.conv_id", "p.block", at.alias("position"), F.xxhash64(at, "p.content").alias("h1"), F.xxhash64(F.col("p.content"), at, F.lit(7)).alias("h2"))
    upto = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.select("conv_id", "block", "position", *(F.bit_xor(c).over(upto).alias(c) for c in ("h1", "h2")))
    totals = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    carried = totals.select("conv_id", "block", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"c{c}") for c in ("t1", "t2")))
    r, c = running.alias("r"), carried.alias("c")
    return r.join(c, F.col("r.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("r.block") == F.col("c.block"))).select("r.conv_id", "r.position", F.col("r.h1").bitwiseXOR(F.col("c.ct1")).alias("h1"), F.col("r.h2").bitwiseXOR(F.col("c.ct2")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are no prefix of another (and the first of equal ones)."""
    rows = prefixes(turns)
    whole = rows.groupBy("conv_id").agg(F.max_by(F.struct("position", "h1", "h2"), "position").alias("w")).select("conv_id", "w.*")
    firsts = whole.groupBy("position", "h1", "h2").agg(F.min_by(F.struct("conv_id"), F.coalesce("conv_id", F.lit(-(2**63)))).alias("first")).select("position", "h1", "h2", "first.conv_id")
    lengths = whole.select(F.col("conv_id").alias("of"), F.col("position").alias("last"))
    proper = rows.join(lengths, F.col("conv_id").eqNullSafe(F.col("of"))).where("position < last").select("position", "h1", "h2").distinct()
    return firsts.join(proper, ["position", "h1", "h2"], "left_anti").select("conv_id", F.col("position").alias("n_turns"))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered: the text of every maximal conversation."""
    kept = maximal(turns).select(F.col("conv_id").alias("of"), "n_turns")
    rows = _clean(turns).join(kept, F.col("conv_id").eqNullSafe(F.col("of")))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text")))
    return rows.groupBy("conv_id").agg(F.first("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform(ordered, lambda t: _turn(t["role"], t["text"])), "").alias("rendered"))


def render_sql() -> str:
    """The same in DuckDB, by comparing the rendered texts of all prefixes."""
    return f"""
    WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position,
                      '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS one FROM turns),
    prefixes AS (SELECT conv_id, position, string_agg(one, '') OVER (PARTITION BY conv_id ORDER BY position) AS upto,
                        count(*) OVER (PARTITION BY conv_id) AS n_turns FROM placed),
    whole AS (SELECT conv_id, n_turns, upto AS rendered,
                     row_number() OVER (PARTITION BY n_turns, upto ORDER BY conv_id NULLS FIRST) AS copy
              FROM prefixes WHERE position = n_turns),
    proper AS (SELECT DISTINCT md5(upto) AS digest, position FROM prefixes WHERE position < n_turns)
    SELECT conv_id, n_turns, rendered FROM whole
    WHERE copy = 1 AND NOT EXISTS (SELECT 1 FROM proper p WHERE p.position = whole.n_turns AND p.digest = md5(whole.rendered))
    """
