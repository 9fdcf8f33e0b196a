"""One query for each operator over its whole table, with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontaminate, html, lines, minhash, quality, rans, secrets, urls
from tidemark.llm.common import written

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), pattern())


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), RULES)


def op3_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.written_and_read(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_table(spark, sf_dir, "documents"), short=True).select("doc_id", "text", "n_dropped")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    featured = written(quality.features(docs).select("doc_id", "_q"), "quality")
    judged = quality.judge(featured, quality.learn(featured))
    counts = [F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept", "quality")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    kept = written(chat.collapse(turns), "kept")
    return chat.render(turns, kept)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone fix of op2_urls."""
    return op2_urls(spark, sf_dir).select("page_id", "host", "path", "rule")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the patterns alone fix of op5_secrets."""
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the counts alone fix of op8_quality."""
    return op8_quality(spark, sf_dir).drop("kept", "quality")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_urls, op3_rans, op4_html, op5_secrets, op6_decontaminate, op7_lines, op8_quality, op9_minhash, op10_chat, url_rules, secrets_base, quality_base)}

_RULE = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'" for h, _, p in (r.partition("/") for _, r in sorted(RULES, key=lambda x: -len(x[1]))))

#: Results that plain SQL states; the near-duplicates' takes all pairs that share a shingle. Brute-force tests cover the other operators.
ORACLES = {
    "url_rules": rf"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages)
    SELECT page_id, host, path, CASE {_RULE} END AS rule FROM p""",
    "secrets_base": r"""SELECT doc_id,
      len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS n_assign,
      len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
      len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex FROM documents""",
    "quality_base": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, i, w[i:i + 2] AS three FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM g) WHERE n > 1),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    q AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM t LEFT JOIN l ON l.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id)
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q""",
    "op9_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0))),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM b JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * b.n >= 85 * (p.n + q.n - b.n)),
    r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.u),
    c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op10_chat": """WITH c AS (
      SELECT conv_id, count(*) AS n_turns, list((role, text) ORDER BY turn, role) AS turns,
        string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn, role) AS chat
      FROM conversations GROUP BY conv_id),
    p AS (SELECT DISTINCT list_slice(turns, 1, k) AS part FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c))
    SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, any_value(chat) AS chat FROM c
    WHERE turns NOT IN (SELECT part FROM p) GROUP BY turns, n_turns""",
}
