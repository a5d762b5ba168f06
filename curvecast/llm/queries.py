"""The queries of this package's operators, one for each, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fim, html_extract, jaccard, periodic, pieces, pii, quality, run_index, secret_scan, sharding, url_filter
from .common import ensure, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensure(table(spark, sf_dir, "documents"), doc_id="long", text="string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(ensure(table(spark, sf_dir, "pages"), page_id="long", url="string", html="string"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_documents(spark, sf_dir), with_text=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunk_share")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.remove_repeats(_documents(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ensure(table(spark, sf_dir, "pages"), page_id="long", url="string")
    return url_filter.filter_urls(pages, url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_documents(spark, sf_dir), with_text=False)
    base = F.filter("findings", lambda f: f["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(k) for k in secret_scan.KINDS[: secret_scan.N_BASE]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), F.size("findings").cast("long").alias("n_spans"))


def repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id and text, its words joined by a space and, in about a tenth of the documents, made periodic from one word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")
    split = docs.where("chosen").select("doc_id", "g", words.alias("w")).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = split.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    made = F.when(F.col("n") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " "))
    return docs.where("NOT chosen").select("doc_id", "text").union(period.select("doc_id", made.alias("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect_runs(repeated_words(_documents(spark, sf_dir)))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    runs = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(""))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    length, period = -F.col("best.less"), F.col("best.period")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(runs, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_documents(spark, sf_dir))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_sharding": op3_sharding,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_filter": op10_url_filter,
    "op11_secret_scan": op11_secret_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_OP10 = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), numbered AS (SELECT row_number() OVER () AS n, * FROM parts),
hits AS (
  SELECT n, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (n)
"""

_OP2 = """
WITH t AS (
  SELECT conv_id, list(coalesce(role, '') || chr(1) || coalesce(text, '') ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS text
  FROM conversations GROUP BY conv_id
), whole AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(text) AS text FROM t GROUP BY turns),
prefixes AS (SELECT DISTINCT turns[1:k] AS turns FROM t, LATERAL (SELECT unnest(range(1, len(turns))) AS k) AS u)
SELECT conv_id, len(turns) AS n_turns, n_copies, text FROM whole WHERE turns NOT IN (SELECT turns FROM prefixes)
"""

_OP9 = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM d),
s AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) AS i) AS u WHERE len(ws) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS i ON i.r = x JOIN n AS j ON j.r = y WHERE 100 * c >= 75 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN reach ON reach.x = d.r JOIN d AS o ON o.r = reach.y GROUP BY d.r, d.doc_id
"""

_OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
         CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""

ORACLES: dict[str, str] = {"op13_fill_in_middle": _OP13, "op9_jaccard_join": _OP9, "op2_chat_formatting": _OP2, "op10_url_filter": _OP10}
