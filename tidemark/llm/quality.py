"""Quality rules by weak supervision, all in DataFrame expressions.

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the counts of vote
patterns finds each rule's accuracy without labels, and a document's posterior probability of being
good replaces a test that every rule must pass. The patterns (3**rules at most) are counted by Spark
over all documents and only those counts reach the driver.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_prefix

WORDS = r"[^\x20\x09-\x0D]+"


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column `_q` (replaced if there) of the counts of each whole text; a null or empty text has no words.

    Other columns stay, whatever their names. Equal rows get equal results; an empty table gives an empty one.

    Repeated word windows are found inside the row: the hashes of the windows are sorted with their
    places, neighbours compared, and the places of repeats united. O(n log n), no shuffle.
    """
    own = free_prefix(docs)  # what the steps add goes at the end
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    w = docs.withColumn(f"{own}h", F.transform(F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1)), lambda x: F.xxhash64(x)))
    w = w.withColumn(f"{own}marks", F.regexp_replace(text, r"[^#*$%&|<>!?]+", ""))
    w = w.withColumn(f"{own}n", F.size(f"{own}h")).withColumn(f"{own}lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORDS)))
    rest = lambda k: F.slice(f"{own}h", F.lit(k + 1), F.greatest(F.col(f"{own}n") - k, F.lit(0)))
    triples = F.zip_with(F.zip_with(f"{own}h", rest(1), lambda a, b: F.xxhash64(a, b)), rest(2), lambda a, b: F.xxhash64(a, b))
    w = w.withColumn(f"{own}g", F.slice(triples, F.lit(1), F.greatest(F.col(f"{own}n") - 2, F.lit(0))))
    placed = F.sort_array(F.transform(f"{own}g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    w = w.withColumn(f"{own}p", F.when(F.size(F.array_distinct(f"{own}g")) < F.size(f"{own}g"), placed))
    return w.withColumn(
        "_q",
        F.struct(
            F.col(f"{own}n").cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(f"{own}marks", "[!?]+", "")).cast("long").alias("n_symbols"),
            (F.size(f"{own}lines") - F.size(F.array_distinct(f"{own}lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(_covered(F.col(f"{own}p")), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(f"{own}lines").cast("long").alias("n_lines"),
            without(r"\p{Lu}+").cast("long").alias("n_upper"),
            F.size(F.array_distinct(f"{own}h")).cast("long").alias("n_distinct_words"),
            F.length(F.regexp_replace(f"{own}marks", "[^!?|]+", "")).cast("long").alias("n_marks"),
            F.regexp_count(text, F.lit(r"(?<=\p{L})[.!?](?:[\x20\x09-\x0D]|\z)")).cast("long").alias("n_ends"),
        ),
    ).drop(f"{own}h", f"{own}marks", f"{own}n", f"{own}lines", f"{own}g", f"{own}p")


def _covered(placed: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; placed: (hash, place) of all windows, sorted."""
    size = F.size(placed)
    twins = F.zip_with(F.slice(placed, F.lit(1), size - 1), F.slice(placed, F.lit(2), size - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))
    step = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(at, step, lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")), lambda s: s["n"])


@dataclass(frozen=True)
class Rule:
    """A vote by bounds on a ratio: beyond `bad` -1, beyond `good` on the other side 1, else it abstains."""

    name: str
    ratio: str
    bad: float
    good: float | None = None
    high_is_bad: bool = True

    def vote(self, q: str = "_q") -> Column:
        x = F.expr(self.ratio.replace("@", f"{q}."))
        out = F.when(F.col(f"{q}.n_words") == 0, 0).when(x >= self.bad if self.high_is_bad else x <= self.bad, -1)
        if self.good is not None:
            out = out.when(x <= self.good if self.high_is_bad else x >= self.good, 1)
        return out.otherwise(0)


RULES = (
    Rule("symbols", "@n_symbols / greatest(@n_words, 1L)", 0.3),
    Rule("repeats", "@n_repeat_words / greatest(@n_words, 1L)", 0.4),
    Rule("lines", "@n_dup_lines / greatest(@n_lines, 1L)", 0.4),
    Rule("capitals", "@n_upper / greatest(@word_chars, 1L)", 0.35),
    Rule("word_length_low", "@word_chars / greatest(@n_words, 1L)", 2.0, high_is_bad=False),
    Rule("word_length_high", "@word_chars / greatest(@n_words, 1L)", 15.0),
    Rule("marks", "@n_marks / greatest(@n_words, 1L)", 0.35),
    Rule("variety", "@n_distinct_words / sqrt(greatest(@n_words, 1L))", 1.2, 3.0, high_is_bad=False),
    Rule("sentences", "@n_ends / greatest(@n_words, 1L)", 0.004, 0.02, high_is_bad=False),
)


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array(*[r.vote().cast("int") for r in rules])


@dataclass(frozen=True)
class Model:
    """Prior of good, and for each rule the log likelihood ratio of its good, absent and bad vote."""

    prior: float
    weights: tuple[tuple[float, float, float], ...]

    def log_odds(self, v: Column) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for i, (bad, absent, good) in enumerate(self.weights):
            total = total + F.when(v[i] == 1, good).when(v[i] == -1, bad).otherwise(absent)
        return total

    def posterior(self, v: Column) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(v)))


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, prior: float = 0.8, rounds: int = 50, smooth: float = 1.0) -> Model:
    """EM for two classes with votes independent given the class.

    `prior`, the share of good documents, is given: with few bad ones the two classes could swap it freely.
    Starts from rules that seldom vote against a good document and often against a bad one. Each
    rule keeps the sense it was written in: a good vote never counts against a document, a bad one
    never for it, and abstention, which here is a middle value, counts neither way.
    """
    patterns = sorted(patterns)
    like = [[[0.03, 0.17, 0.8], [0.4, 0.2, 0.4]] for _ in range(n_rules)]  # [rule][good, bad][-1, 0, 1]
    if not patterns:
        return Model(prior, tuple((0.0, 0.0, 0.0) for _ in range(n_rules)))
    for _ in range(rounds):
        seen = [[[smooth] * 3 for _ in range(2)] for _ in range(n_rules)]
        for votes_, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(like[r][0][v + 1] / like[r][1][v + 1]) for r, v in enumerate(votes_) if v)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            for r, v in enumerate(votes_):
                seen[r][0][v + 1] += p * n
                seen[r][1][v + 1] += (1 - p) * n
        like = [[[c / sum(side) for c in side] for side in rule] for rule in seen]
    weights = []
    for rule in like:
        ratio = [math.log(rule[0][k] / rule[1][k]) for k in range(3)]
        weights.append((min(0.0, ratio[0]), 0.0, max(0.0, ratio[2])))
    return Model(prior, tuple(weights))


def learn(featured: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """The model of all documents that pass the base rules."""
    counted = featured.where(~base_failed()).groupBy(votes(rules).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return fit([(tuple(r["v"]), r["n"]) for r in counted.collect()], len(rules))


def base_failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def judge(featured: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """featured with base_failed, quality (posterior of good) and kept; columns of these names are replaced, all rows stay."""
    quality = model.posterior(votes(rules))
    return featured.withColumn("base_failed", base_failed()).withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
