"""Line deduplication across the corpus within an edit bound, in DataFrame expressions only.

The first occurrence of a line, by (id, document, place), stays. A line goes if it is equal to an
earlier one or, with `min_words` words or more, one word edit (insertion, deletion, substitution) or
a change of case or spacing away from an earlier one, kept or not (so of a chain of small steps only the
first line stays). Blank lines stay. With `short`, lines of fewer words go as well: by a change of case or
spacing, or one character edit (words lowered and a space apart) if the longer of the two has `min_words`
characters or more. There a line of exactly `min_words` words counts with them, as one space more or less
makes a line of this size of a short one.

Both are edits of tokens, words in the one case and characters in the other, and found alike. Lines are
told apart by two independent 64-bit hashes of their text as it counts (lowered and evenly spaced, but for
short lines without `short`). Two lines one edit apart share their first or their last tokens, up to half
of them; only lines that share such a half with another one emit their deletion neighbourhood (the line
without each of its tokens, and whole) as hashed keys. A key is the exclusive or of hashes of tokens with
their places, so all keys of a line come from running sums over its tokens, in linear time. Equal keys are
joined, each line takes the earliest line it meets there (never all pairs of a group), and the tokens of
the two are compared before it goes.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hash_filter

BLANKS = " \t\n\x0b\x0c\r"


def _even(line: Column) -> Column:
    """Words lowered and one space apart."""
    spaced = F.translate(F.lower(line), BLANKS[1:], " " * len(BLANKS[1:]))
    return F.trim(F.when(spaced.contains("  "), F.regexp_replace(spaced, " +", " ")).otherwise(spaced))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(o, line) of all lines that aren't blank; o: id, key of the document, place."""
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), _key(id_col, text_col).alias("k"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return d.where(F.ltrim("line", F.lit(BLANKS)) != "")


def _counted(lines: DataFrame, min_words: int, short: bool) -> DataFrame:
    """lines with c, the text as it counts, and n, its words. Step by step: what is used more than once in a step is worked out more than once."""
    out = lines.withColumn("c", _even(F.col("line"))).withColumn("n", F.octet_length("c") - F.octet_length(F.replace("c", F.lit(" "), F.lit(""))) + 1)
    return out.drop("line") if short else out.withColumn("c", F.when(F.col("n") >= min_words, F.col("c")).otherwise(F.col("line"))).drop("line")


def _half(longer: Column) -> Column:
    """Tokens in a half of a line of so many, rounded down to three binary digits, so that neighbouring sizes mostly agree."""
    x = F.shiftright(longer.cast("int"), 1)
    drop = F.greatest(F.floor(F.log2(F.greatest(x, F.lit(1)))).cast("int") - 2, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def _halves(min_words: int, short: bool) -> list[Column]:
    """Keys of the halves by which a line may meet another one; null where it has none. Columns c, n, m (characters).

    Of two lines one edit apart, the longer (or either) of t tokens, the first or the last k agree if 2k <= t: the line
    is the longer one (t = its tokens) or the shorter one (one more).
    """
    out = []
    for kind in (0, 1) if short else (0,):
        size = F.col("m" if kind else "n")
        fits = (F.col("n") <= min_words if kind else F.col("n") >= min_words)
        own, more = _half(size), _half(size + 1)
        for k, ok in ((own, fits & (size >= min_words)), (more, fits & (size + 1 >= min_words) & ((own != more) | (size < min_words)))):
            first, last = (F.substring("c", F.lit(1), k), F.right("c", k)) if kind else (F.call_function("substring_index", "c", F.lit(" "), k), F.call_function("substring_index", "c", F.lit(" "), -k))
            out += [F.when(ok, F.xxhash64(F.lit(2 * kind), k, first)), F.when(ok, F.xxhash64(F.lit(2 * kind + 1), k, last))]
    return out


def _tokens(c: Column, kind: Column) -> Column:
    return F.when(kind == 0, F.split(c, " ")).otherwise(F.split(c, ""))


def _neighbours(scratch: Scratch, texts: DataFrame, min_words: int, short: bool) -> DataFrame:
    """(r) of the lines that are one edit from an earlier one. texts (r, c, n): r rises with the first occurrence; rows may repeat."""
    kinds = F.filter(F.array(F.when(F.col("n") >= min_words, 0), *[F.when(F.col("n") <= min_words, 1)] * short), lambda x: x.isNotNull())
    lines = texts.dropDuplicates(["r"]).withColumn("f", F.explode(kinds)).withColumn("w", _tokens(F.col("c"), F.col("f")))
    tokens = lines.select("r", "f", F.size("w").alias("n"), F.posexplode("w").alias("i", "x"))
    # a place's hash as it is, and as it becomes once an earlier token is gone
    tokens = tokens.select("r", "f", "n", "i", F.xxhash64("x", "i").alias("a"), F.xxhash64("x", F.col("i") - 1).alias("b"))
    w = Window.partitionBy("r", "f").orderBy("i")
    before, upto, all_ = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = tokens.select("r", "f", "n", "i", F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("a"), F.bit_xor("b").over(upto).alias("b"), F.bit_xor("a").over(all_).alias("all_a"), F.bit_xor("b").over(all_).alias("all_b"))
    less = F.struct(F.col("i"), F.xxhash64("f", F.col("n") - 1, F.col("a").bitwiseXOR(F.col("b")).bitwiseXOR(F.col("all_b"))).alias("v"))
    whole = F.struct(F.lit(-1).alias("i"), F.xxhash64("f", "n", "all_a").alias("v"))
    long = F.col("n") >= min_words
    keys = F.when(long & (F.col("i") == 0), F.array(whole, less)).when(long, F.array(less)).when(F.col("i") == 0, F.array(whole))
    variants = scratch.write(x.select("r", F.col("f").cast("byte").alias("f"), F.explode(keys).alias("x")).select("r", "f", "x.i", "x.v"), "variants")
    shared = scratch.write(variants.groupBy("v").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b").select("v"), "shared")
    met = scratch.write(variants.where(hash_filter(scratch, shared, "v")(F.col("v"))), "met")
    # the earliest line of each way to be one edit away: same place substituted, this one longer, this one shorter
    same = met.where("i >= 0").groupBy("v", "f", "i").agg(F.min("r").alias("m"))
    shorter = met.where("i = -1").groupBy("v", "f").agg(F.min("r").alias("m"))
    longer = met.where("i >= 0").groupBy("v", "f").agg(F.min(F.struct("r", "i")).alias("x")).select("v", "f", F.col("x.r").alias("m"), F.col("x.i").alias("mi"))
    a = met.where("i >= 0").join(same, ["v", "f", "i"]).select("r", "f", "i", F.col("i").alias("mi"), "m")
    b = met.where("i >= 0").join(shorter, ["v", "f"]).select("r", "f", "i", F.lit(-1).alias("mi"), "m")
    c = met.where("i = -1").join(longer, ["v", "f"]).select("r", "f", "i", "mi", "m")
    near = a.unionByName(b).unionByName(c).where("m < r").groupBy("r").agg(F.min(F.struct("m", "i", "mi", "f")).alias("x")).select("r", "x.*")
    both = near.join(texts.select("r", F.col("c").alias("one")), "r").join(texts.select(F.col("r").alias("m"), F.col("c").alias("other")), "m")
    both = both.withColumn("one", _tokens(F.col("one"), F.col("f"))).withColumn("other", _tokens(F.col("other"), F.col("f")))
    without = lambda t, i: F.when(F.col(i) < 0, F.col(t)).otherwise(F.concat(F.slice(t, F.lit(1), F.col(i)), F.slice(t, F.col(i) + 2, F.size(t))))
    return both.where(without("one", "i") == without("other", "mi")).select("r").distinct()


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, short: bool = False) -> DataFrame:
    """(id, k, pos): the lines that go, by document (its id and a hash of id and text) and place; a written table."""
    scratch = Scratch(docs.sparkSession)
    counted = _counted(_lines(docs, id_col, text_col), min_words, short).withColumn("m", F.length("c"))
    halves = [x.alias(f"s{i}") for i, x in enumerate(_halves(min_words, short))]
    sides = [f"s{i}" for i in range(len(halves))]
    seen = scratch.write(counted.select("id", "k", "pos", F.xxhash64("c").alias("h"), F.xxhash64(F.lit(1), "c").alias("g"), *halves), "lines")
    place = F.struct("id", "k", "pos")
    # equal lines: those of a hash that occurs more than once, but for the first
    often = scratch.write(seen.groupBy("h", "g").agg(F.min(place).alias("o"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h", "g", "o"), "often")
    again = seen.where(hash_filter(scratch, often, "h")(F.col("h"))).join(often, ["h", "g"]).where(~place.eqNullSafe(F.col("o"))).select("id", "k", "pos")
    # lines that share a half with another one, by their first occurrence and in its order
    halved = seen.select("h", F.explode(F.array(*sides)).alias("s")).where("s is not null")
    shared = scratch.write(halved.groupBy("s").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("s"), "halves")
    passes = hash_filter(scratch, shared, "s")
    some = seen.where(" or ".join(f"{s} is not null" for s in sides))
    test = passes(F.col(sides[0]))
    for s in sides[1:]:
        test = test | passes(F.col(s))
    first = some.where(test).groupBy("h", "g").agg(F.min(place).alias("o"), *[F.first(s).alias(s) for s in sides])
    alike = first.select("h", "g", "o", F.explode(F.array(*sides)).alias("s")).where("s is not null").join(shared, "s", "left_semi").select("o").distinct()
    alike = scratch.write(alike.orderBy("o").select(F.xxhash64("o.id", "o.k", "o.pos").alias("q"), "o", F.monotonically_increasing_id().alias("r")), "alike")
    q = F.xxhash64("id", "k", "pos")
    texts = _lines(docs, id_col, text_col).where(hash_filter(scratch, alike, "q")(q)).withColumn("q", q).withColumn("o", place)
    texts = _counted(texts.join(alike, "q").where(texts["o"].eqNullSafe(alike["o"])).select("r", "line"), min_words, short)
    texts = scratch.write(texts, "texts")
    near = _neighbours(scratch, texts, min_words, short).join(alike, "r").select("o.id", "o.k", "o.pos")
    out = scratch.write(again.unionByName(near).distinct(), "gone")
    scratch.clear(out)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, short: bool = False) -> DataFrame:
    """docs with their text less the lines that go, and n_dropped, the count of those (a column of that name is replaced). All rows stay.

    A null text stays null; a text whose lines all go is empty; an empty table gives an empty one. Other columns are untouched,
    whatever their names. Rows equal in id and text are one document: they get equal results, and lose no line to each
    other. Null ids come first in the order. Lines and texts may be of any length. Documents that lose nothing aren't shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    gone = duplicates(docs, id_col, text_col, min_words, short).groupBy("id", "k").agg(F.collect_set("pos").alias("gone"))
    gone = scratch.write(gone.select(F.col("id").alias("gone_id"), F.col("k").alias("gone_k"), "gone"), "gone")
    all_ = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), _key(id_col, text_col).alias("k"))
    loses = hash_filter(scratch, gone, "gone_k")(F.col("k"))
    # the size of compressed lists of places says little about their size in memory, so they are never broadcast
    hit = all_.where(loses).join(gone.hint("merge"), (F.col("k") == F.col("gone_k")) & F.col("id").eqNullSafe(F.col("gone_id")), "left").withColumn("lines", F.split(F.when(F.col("gone").isNotNull(), F.col("doc").getField(text_col)), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("doc").getField(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    hit = hit.select("doc", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n"))
    out = hit.unionByName(all_.where(~loses).select("doc", F.col("doc").getField(text_col).alias("text"), F.lit(0).cast("long").alias("n")))
    cols = [F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns if c != "n_dropped"]
    return out.select(*cols, F.col("n").alias("n_dropped"))
