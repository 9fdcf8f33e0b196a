"""Secret scan with corpus-wide ownership, in DataFrame expressions only.

Three base kinds are found by pattern, and `mixed` strings (long, of letters and digits) by the
method. Each candidate's hash is counted by the distinct owners and repositories that hold it, over
the whole corpus: a value many owners share is a copied example, one that a single owner holds looks
live. Offsets are code points, ends exclusive.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, least length, the group whose length counts.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]+", 16, 0),
)
#: The method's own kind: a run of key characters, long enough to be a key; find() asks for letters and digits.
MIXED = ("mixed", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", 20, 0)
MARK = "\x01"


def matches(text: Column, kind: str, pattern: str, least: int, group: int) -> Column:
    """array<struct<kind,start,end,value>> of the leftmost matches that don't overlap, short ones dropped.

    Every match is put between marks and the text cut there, so odd pieces are matches and the lengths
    before them give their places. The mark can't occur: it is first replaced in the text, one for one,
    by another control character, which no pattern matches either.
    """
    safe = F.replace(text, F.lit(MARK), F.lit("\x02"))
    # short runs can't pass and can't hide a longer one, so maximal runs need not be marked; assignments must be, as they use up their text
    strict = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}.get(kind, pattern)
    pieces = F.split(F.regexp_replace(safe, f"({strict})", f"{MARK}$1{MARK}"), MARK)
    found = _bind(pieces, lambda p: _placed(kind, p, strict, least, group))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(safe.rlike(strict), found).otherwise(empty)


def _bind(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it inside its lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Lengths summed up in one go. A running sum appends to its array, so it is taken in groups and then over the groups.
GROUP = 256


def _before(sizes: Column) -> Column:
    """The sum of all sizes before each, for a bound array."""
    none = F.array().cast("array<int>")
    upto = lambda a: F.aggregate(a, F.struct(F.lit(0).alias("at"), none.alias("all")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["all"], s["at"]).alias("all")), lambda s: s["all"])
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / GROUP).cast("int")), lambda g: F.slice(sizes, g * GROUP + 1, F.lit(GROUP)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, n: s + n)
    return _bind(groups, lambda gs: F.flatten(F.zip_with(gs, upto(F.transform(gs, total)), lambda g, base: F.transform(upto(g), lambda x: x + base))))


def _placed(kind: str, pieces: Column, strict: str, least: int, group: int) -> Column:
    """The matches, every second piece, with their places."""

    def one(start: Column, piece: Column) -> Column:
        value = F.regexp_extract(piece, strict, group) if group else piece
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(piece)).alias("end"), value.alias("value"))

    hits = _bind(_before(F.transform(pieces, lambda p: F.length(p))), lambda at: F.zip_with(at, pieces, one))
    return F.filter(F.filter(hits, lambda _, i: i % 2 == 1), lambda x: F.length(x["value"]) >= least)


def _joined(spans: Column) -> Column:
    order = F.create_map(*[x for i, k in enumerate([*KINDS, MIXED]) for x in (F.lit(k[0]), F.lit(i))])
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.element_at(order, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, owner columns kept by the caller..., base, mixed): the candidates of each whole text. Null texts have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[matches(text, *k) for k in KINDS])
    return docs.withColumn("_base", base).withColumn("_mixed", matches(text, *MIXED)).drop(text_col)


def ownership(candidates: DataFrame, owner: str = "owner", repo: str = "repo", hash_col: str = "hash") -> DataFrame:
    """(hash, n_owners, n_repos). Distinct (hash, owner, repo) first, on the map side too: a value that fills a
    third of the corpus shuffles a row for each task and repository."""
    seen = candidates.select(hash_col, owner, repo).distinct()
    owners = seen.groupBy(hash_col, owner).agg(F.count(F.lit(1)).alias("_repos"))
    return owners.groupBy(hash_col).agg(F.count(F.lit(1)).alias("n_owners"), F.sum("_repos").alias("n_repos"))


def _once(candidates: DataFrame) -> DataFrame:
    """Copies of one document (equal `_doc`) hold a value once, under the first of their owners."""
    first = candidates.groupBy("hash", "_doc").agg(F.min(F.struct("owner", "repo")).alias("x"))
    return first.select("hash", "x.*")


def _apart(candidates: DataFrame) -> DataFrame:
    """Without the `mixed` ones that overlap a base span: one that begins before them reaches into them, or one begins in them."""
    base = F.col("c.kind") != MIXED[0]
    so_far = lambda order: Window.partitionBy("_row").orderBy(order, base.desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = candidates.withColumn("_until", F.max(F.when(base, F.col("c.end"))).over(so_far(F.asc("c.start")))).withColumn("_from", F.min(F.when(base, F.col("c.start"))).over(so_far(F.desc("c.start"))))
    free = (F.coalesce("_until", F.lit(0)) <= F.col("c.start")) & F.coalesce(F.col("_from") >= F.col("c.end"), F.lit(True))
    return out.where(base | free).drop("_until", "_from")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, shared: int = 2) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared.

    base_sha256 is of the base spans; spans also has the method's `mixed` ones outside base spans that
    look live (held by fewer than `shared` owners). n_live and n_shared count the document's distinct
    candidate values by ownership, where exact copies of a document count as one. Null owners count as one owner, and so do null repositories. Rows with equal or null ids stay
    apart; a null or empty text has no spans; an empty table gives an empty one; other columns are left out, whatever their names.
    A text of any length and number of matches takes time nearly linear in both.
    """
    owner = F.coalesce(owner if owner is not None else F.col("source"), F.lit("")).cast("string")
    repo = F.coalesce(repo if repo is not None else F.concat_ws("/", "source", "lang"), F.lit("")).cast("string")
    found = scan(docs.select(F.col(id_col), F.col(text_col), owner.alias("owner"), repo.alias("repo"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_doc")), id_col, text_col)
    found = found.withColumn("_mixed", F.filter("_mixed", lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")))
    all_ = F.concat("_base", "_mixed")
    found = found.withColumn("_row", F.when(F.size(all_) > 0, F.concat_ws("-", F.lit("r"), F.monotonically_increasing_id().cast("string"))))
    from tidemark.llm.common import written

    found = written(found, "secrets")
    held, both = found.where("_row is not null"), (F.size("_base") > 0) & (F.size("_mixed") > 0)
    listed = lambda df: df.select("_row", "owner", "repo", "_doc", F.explode(F.concat("_base", "_mixed")).alias("c"))
    some = listed(held.where(~both)).unionByName(_apart(listed(held.where(both))))
    some = some.select("_row", "owner", "repo", "_doc", F.xxhash64("c.value").alias("hash"), "c")
    owned = ownership(_once(some))
    kinds = some.join(owned, "hash").groupBy("_row").agg(
        F.count_distinct(F.when(F.col("n_owners") < shared, F.col("hash"))).alias("n_live"),
        F.count_distinct(F.when(F.col("n_owners") >= shared, F.col("hash"))).alias("n_shared"),
        F.collect_list(F.when((F.col("c.kind") == MIXED[0]) & (F.col("n_owners") < shared), F.col("c"))).alias("_live"),
    )
    # documents without candidates have no row to meet: they pass by the join, or all of them would meet on a null key
    none = found.where("_row is null").withColumns({"n_live": F.lit(0).cast("long"), "n_shared": F.lit(0).cast("long"), "_live": F.lit(None).cast(found.schema["_base"].dataType)})
    out = found.where("_row is not null").join(kinds, "_row", "left").unionByName(none)
    count = lambda kind: F.size(F.filter("_base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        id_col, *[count(k[0]) for k in KINDS], F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.concat("_base", F.coalesce("_live", F.array().cast(found.schema["_base"].dataType)))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
    )
