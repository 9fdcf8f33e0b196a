"""Cumulative-snapshot collapse: of logged conversations that grow turn by turn, the longest stays.

Every prefix of a conversation has a hash, the running sum of its turns' hashes (place, role, text).
A conversation whose last prefix hash occurs as an earlier prefix of a longer one goes (anti-join);
of equal ones the smallest id stays. Texts are shuffled only for rendering what is left.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns in one running sum; longer conversations are summed in pieces, then over the pieces.
PIECE = 1024


def _turn_hash(place: Column, role: Column, text: Column, seed: int) -> Column:
    """A hash of 50 bits as a decimal, so a sum over any number of turns is exact."""
    parts = [F.lit(seed), place, F.coalesce(role, F.lit("\x00null")), F.coalesce(text, F.lit("\x00null"))]  # the seed first: what follows goes on from it
    return F.shiftrightunsigned(F.xxhash64(*parts), 14).cast("decimal(38,0)")


def prefixes(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, n, h1, h2): length and hashes of the prefix that ends with each turn.

    The place of a turn is its rank; turns with equal numbers are ordered by role and text. Rows with a
    null id belong to no conversation and are left out.
    """
    t = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.xxhash64(F.coalesce(text_col, F.lit("\x00null"))).alias("a"), F.xxhash64(F.lit(1), F.coalesce(text_col, F.lit("\x00null"))).alias("b"))
    piece = F.floor(F.coalesce("turn", F.lit(-1)) / PIECE)
    t = t.withColumn("piece", piece)
    inner = Window.partitionBy("id", "piece").orderBy("turn", "role", "a", "b")
    t = t.withColumn("i", F.row_number().over(inner))
    sizes = t.groupBy("id", "piece").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    t = t.join(sizes.select("id", "piece", "_before"), ["id", "piece"]).withColumn("n", F.col("i") + F.col("_before"))
    t = t.withColumn("h1", _turn_hash(F.col("n"), F.col("role"), F.col("a").cast("string"), 1)).withColumn("h2", _turn_hash(F.col("n"), F.col("role"), F.col("b").cast("string"), 2))
    sums = t.groupBy("id", "piece").agg(F.sum("h1").alias("_s1"), F.sum("h2").alias("_s2"))
    for c in ("1", "2"):
        sums = sums.withColumn(f"_o{c}", F.coalesce(F.sum(f"_s{c}").over(w), F.lit(0)))
    run = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = t.select("id", "piece", "turn", "n", F.sum("h1").over(run).alias("r1"), F.sum("h2").over(run).alias("r2"))
    out = out.join(sums.select("id", "piece", "_o1", "_o2"), ["id", "piece"])
    return out.select("id", "turn", "n", (F.col("r1") + F.col("_o1")).cast("decimal(38,0)").alias("h1"), (F.col("r2") + F.col("_o2")).cast("decimal(38,0)").alias("h2"))


def collapse(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, n_copies) of the conversations that stay: no proper prefix of another, one of equals.

    Copies are grouped before any join, so a conversation that was logged a million times is one row in it. A null role or text is
    told from an empty one; texts and conversations may be of any length; equal turn numbers are ordered by role and text, and a
    turn that is logged twice counts twice; an empty table gives an empty one; other columns are left out, whatever their names.
    """
    from tidemark.llm.common import written

    p = written(prefixes(turns, id_col, turn_col, role_col, text_col), "prefixes")
    total = p.groupBy(F.col("id").alias("of")).agg(F.max("n").alias("n_turns"))
    ends = p.join(total, (F.col("id") == F.col("of")) & (F.col("n") == F.col("n_turns"))).select("id", "n", "h1", "h2")
    inner = p.join(total, (F.col("id") == F.col("of")) & (F.col("n") < F.col("n_turns")), "left_semi").select("n", "h1", "h2").distinct()
    whole = ends.groupBy("n", "h1", "h2").agg(F.min("id").alias(id_col), F.count(F.lit(1)).alias("n_copies"))
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select(id_col, F.col("n").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, n_copies, chat) of kept conversations: every turn as <|role|>, a line break, its text and <|end|>."""
    line = F.concat(F.lit("<|"), F.coalesce(role_col, F.lit("")), F.lit("|>\n"), F.coalesce(text_col, F.lit("")), F.lit("<|end|>\n"))
    t = turns.select(id_col, F.struct(F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.xxhash64(F.coalesce(text_col, F.lit("\x00null"))).alias("a"), line.alias("line")).alias("x"))
    chat = t.join(kept.select(id_col), id_col, "left_semi").groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "").alias("chat"))
    return kept.join(chat, id_col)
