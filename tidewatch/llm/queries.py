"""One query per operator over whole tables, with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, html_text, language_model, lexical_search, licenses, merkle, mixing, near_dedup, packing, pii, quality, sharding, substring_dedup
from tidewatch.llm.common import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- op1: substring dedup ---------------------------------------------------------------------------

@query
def op1_substring_dedup(spark, sf):
    out = substring_dedup.repeated_spans(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("start").alias("start_char"), F.col("end").alias("end_char"), "n_chars", F.col("first_id").alias("first_doc_id"), "removed")


# --- op2: mixing ------------------------------------------------------------------------------------

@query
def op2_mix_sources(spark, sf):
    out = mixing.mix(table(spark, sf, "documents"))
    return out.select(F.col("__id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL["op2_mix_sources"] = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source),
steps AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source ASC NULLS LAST) AS place, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER below, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
  FROM sources
  WINDOW below AS (ORDER BY 2 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         least((2 * source_size)::DOUBLE, weight * coalesce((SELECT arg_min(level, place) FROM steps WHERE level <= 2 * source_size / weight), 0)) AS target
  FROM steps),
runs AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs
  FROM docs JOIN goals ON docs.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM runs
"""


# --- op3: HTML extraction ---------------------------------------------------------------------------

@query
def op3_html_text(spark, sf):
    return html_text.extract(table(spark, sf, "pages"))


# --- op4: language-model scores ---------------------------------------------------------------------

@query
def op4_lm_scores(spark, sf):
    return language_model.score(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


# --- op5: near dedup --------------------------------------------------------------------------------

@query
def op5_near_dedup(spark, sf):
    out = near_dedup.near_groups(table(spark, sf, "documents"), k=2)
    return out.select(F.col("__id").alias("doc_id"), "n_shingles", "component_id", "kept")


# --- op6: packing -----------------------------------------------------------------------------------

@query
def op6_pack_sequences(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


# --- op7: quality rules -----------------------------------------------------------------------------

@query
def op7_tokeniser_fertility(spark, sf):
    return quality.measure(table(spark, sf, "documents"))


# --- op8: exact dedup -------------------------------------------------------------------------------

@query
def op8_exact_dedup(spark, sf):
    out = exact_dedup.exact_groups(table(spark, sf, "documents"))
    return out.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


SQL["op8_exact_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
named AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST) AS keep_id,
         max(points) OVER (PARTITION BY text_sha256) AS most, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM docs)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND points = most AS kept, text_sha256 FROM named
"""


# --- op9: sharding ----------------------------------------------------------------------------------

@query
def op9_extendible_shards(spark, sf):
    out = sharding.shards(table(spark, sf, "documents"))
    return out.select(F.col("__id").alias("doc_id"), F.col("bytes").alias("n_bytes"), F.col("depth").cast("int").alias("depth"), "shard", "shard_bytes")


SQL["op9_extendible_shards"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
prefixes AS (SELECT doc_id, n_bytes, h, depth::INT AS depth, h >> (60 - depth)::INT AS prefix FROM docs, range(0, 61) AS d(depth)),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM prefixes GROUP BY depth, prefix),
fits AS (
  SELECT doc_id, n_bytes, p.depth, p.prefix, shard_bytes, row_number() OVER (PARTITION BY h, doc_id ORDER BY p.depth) AS turn
  FROM prefixes p JOIN sums s ON p.depth = s.depth AND p.prefix = s.prefix
  WHERE shard_bytes <= 16777216 OR p.depth = 60)
SELECT doc_id, n_bytes, depth, right(lpad(bin(prefix), 60, '0'), depth) AS shard, shard_bytes FROM fits WHERE turn = 1
"""


# --- op10: license scan -----------------------------------------------------------------------------

@query
def op10_license_scan(spark, sf):
    out = licenses.scan(table(spark, sf, "documents"))
    return out.select(F.col("__id").alias("doc_id"), "license", "notices", F.col("sha").alias("canonical_sha256"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(licenses.COPYRIGHT_LINE)}, ' ', 'g')"
    for other, usual in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(other)}, {_quoted(usual)})"
    return f"sha256(trim(regexp_replace({out}, {_quoted(licenses.NOT_WORD)}, ' ', 'g')))"


def _known_sql(rows) -> str:
    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in rows)
    return f"SELECT DISTINCT license, {_canonical_sql('t')} AS digest FROM (VALUES {values}) AS k(license, t)"


SQL["op10_license_scan"] = f"""
WITH whole AS ({_known_sql(licenses.TEXTS + licenses.NOTICES)}),
notice AS ({_known_sql(licenses.NOTICES)}),
docs AS (SELECT doc_id, text, {_canonical_sql('text')} AS canonical_sha256 FROM documents),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (
  SELECT doc_id, text, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM lines JOIN notice ON digest = {_canonical_sql('line')} GROUP BY doc_id, text)
SELECT docs.doc_id, license, coalesce(notices, '') AS notices, canonical_sha256
FROM docs LEFT JOIN whole ON digest = canonical_sha256
LEFT JOIN found ON docs.doc_id IS NOT DISTINCT FROM found.doc_id AND docs.text = found.text
"""


# --- op11: Merkle manifest --------------------------------------------------------------------------

@query
def op11_merkle_manifest(spark, sf):
    out = merkle.proofs_of_documents(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")


def _leaf_sql(*columns: str) -> str:
    fields = (f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in columns)
    return f"sha256({' || '.join(fields)})"


# crc32 bit by bit: DuckDB has no such function.
_CRC = ("xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, b: "
        "xor(a >> 8, list_reduce([xor(a, b) & 255] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))), 4294967295)")

SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
         CASE WHEN {_CRC.format('doc_id')} % 7 = 0 THEN {_leaf_sql('doc_id', 'source', 'lang', 'n_chars + 1', 'text')} END AS changed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves),
own(tree, level, pos, h, size) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(size) + 1) // 2 FROM own WHERE size > 1 GROUP BY tree, level, pos // 2),
above(level, pos, h, size) AS (
  SELECT 0, tree, h, count(*) OVER () FROM own WHERE size = 1
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(size) + 1) // 2 FROM above WHERE size > 1 GROUP BY level, pos // 2),
walk(doc_id, leaf, tree, pos, level, h, proof) AS (
  SELECT doc_id, leaf, tree, pos, 0, coalesce(changed, leaf), '' FROM placed
  UNION ALL
  SELECT doc_id, leaf, walk.tree, walk.pos // 2, walk.level + 1,
         sha256(CASE WHEN s.h IS NULL THEN walk.h WHEN walk.pos % 2 = 1 THEN s.h || walk.h ELSE walk.h || s.h END), proof || coalesce(s.h, '')
  FROM walk JOIN own n ON n.tree = walk.tree AND n.level = walk.level AND n.pos = walk.pos AND n.size > 1
  LEFT JOIN own s ON s.tree = walk.tree AND s.level = walk.level AND s.pos = xor(walk.pos, 1)),
high(doc_id, leaf, tree, pos, level, h, proof) AS (
  SELECT doc_id, leaf, walk.tree, walk.tree, 0, walk.h, proof
  FROM walk JOIN own n ON n.tree = walk.tree AND n.level = walk.level AND n.pos = walk.pos AND n.size = 1
  UNION ALL
  SELECT doc_id, leaf, tree, high.pos // 2, high.level + 1,
         sha256(CASE WHEN s.h IS NULL THEN high.h WHEN high.pos % 2 = 1 THEN s.h || high.h ELSE high.h || s.h END), proof || coalesce(s.h, '')
  FROM high JOIN above n ON n.level = high.level AND n.pos = high.pos AND n.size > 1
  LEFT JOIN above s ON s.level = high.level AND s.pos = xor(high.pos, 1))
SELECT doc_id, leaf, top.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, high.h AS folded_root, high.h = root.h AS verified
FROM high JOIN above root ON root.size = 1 AND high.level = root.level
JOIN own top ON top.size = 1 AND top.tree = high.tree
"""


# --- op12: personal data ----------------------------------------------------------------------------

@query
def op12_private_spans(spark, sf):
    out = pii.scan(table(spark, sf, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    plain = F.filter("found", lambda x: x.plain)
    kinds = F.transform(plain, lambda x: x.kind)
    counts = ((F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS)
    return out.select(F.col("__id").alias("doc_id"), *counts, F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
                      F.size(F.filter("found", lambda x: ~x.plain)).cast("long").alias("n_added"))


# --- op13: ranked lexical search --------------------------------------------------------------------

@query
def op13_lexical_search(spark, sf):
    return lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

SQL["op13_lexical_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
totals AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS total FROM docs),
items AS (SELECT DISTINCT item_id, text FROM benchmark),
wanted AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS term FROM items) GROUP BY q, item_id, term),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY r, doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term),
scores AS (
  SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
