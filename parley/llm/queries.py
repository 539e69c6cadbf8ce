"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, decontamination, divergence, periodic, pii, quality, sharding, simhash, substrings, suffixes, token_files, toxicity, urls
from parley.llm.common import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op1_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document in windows of 35 that start anywhere else."""
    found = substrings.repeated(table(spark, folder, "documents"), 35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.groups(table(spark, folder, "documents"))


@query
def op3_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document in strings of 400 that start anywhere else."""
    found = suffixes.repeated(table(spark, folder, "documents"), 400)
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as ids in Simple-8b files, read back."""
    path = shared_path(spark, "tokens")
    token_files.write(table(spark, folder, "documents"), VOCABULARY, 2, path)
    found = token_files.read(spark, path).select(
        "part",
        "block",
        "before",
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
    found = found.join(token_files.block_starts(spark, path), ["part", "block"])
    return found.select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


@query
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every document in 40 shards of near equal bytes."""
    return sharding.shard(table(spark, folder, "documents"), 40)


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and compression bands for every document."""
    return quality.judge(table(spark, folder, "documents"))


@query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find(table(spark, folder, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    digest = F.sha2(listed(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *(count(k) for k in pii.BASE), digest, listed(F.col("spans")).alias("spans"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every document, learned from four fifths of the labels."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out)
    return found.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of the benchmark in every document."""
    found = decontamination.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


@query
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded with the pair occurrence index."""
    found = bpe.encode_and_decode(table(spark, folder, "documents"), VOCABULARY)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far the word shares of each source lie from those of the other sources and of its language."""
    return divergence.audit(table(spark, folder, "documents"))


#: The rules that operator 12 is asked for.
URL_RULES = """VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')"""


@query
def op12_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page by host suffix and path prefix."""
    rules = spark.sql(f"SELECT * FROM {URL_RULES} AS rules(verdict, rule)")
    return urls.judge(table(spark, folder, "pages"), rules)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in documents whose CRC-32 of the id ends in 0 all words after a place repeat the first ones from there on."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.greatest(F.size("words"), F.lit(1))
    some = docs.select("doc_id", "text", hashed.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    )
    some = some.withColumn("n", n).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    whole = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n"))
    return some.select("doc_id", F.when(F.size("words") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document, with the runs that the contract plants."""
    found = periodic.runs(with_planted_runs(table(spark, folder, "documents"))).withColumn("longest", periodic.longest())
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE["op1_substrings"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
  SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
),
often AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM often),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept k USING (r)"""

ORACLE["op9_decontamination"] = r"""
WITH split AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS key, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark
),
lists AS (
  SELECT side, r, key, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM split
),
items AS (
  SELECT DISTINCT coalesce(CAST(key AS VARCHAR), 'null') AS item, size, array_to_string(w[i : i + size - 1], ' ') AS s
  FROM (SELECT key, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM lists WHERE side = 'b' AND len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM items),
windows AS (
  SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS s
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM lists, sizes WHERE side = 'd' AND len(w) >= size)
),
hits AS (SELECT r, i, size, item FROM windows JOIN items USING (size, s)),
places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT key AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM lists LEFT JOIN places USING (r) LEFT JOIN named USING (r) WHERE side = 'd'"""

ORACLE["op11_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
terms AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
),
priced AS (
  SELECT *,
    1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER g + 5 * count(*) OVER g) AS q
  FROM grid WINDOW g AS (PARTITION BY lang, source)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM priced WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 50"""

ORACLE["op12_urls"] = rf"""
WITH rules AS (
  SELECT verdict, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path
  FROM ({URL_RULES}) AS r(verdict, rule)
),
rests AS (
  SELECT row_number() OVER () AS r, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
parts AS (
  SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS own, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
),
hosts AS (
  SELECT r, page_id, path, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts
),
best AS (
  SELECT r, rule, verdict FROM hosts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hosts LEFT JOIN best USING (r)"""

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
