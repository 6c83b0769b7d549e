"""One query per numbered operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velospan.llm import (
    host_rules,
    license_scan,
    lsh_forest,
    page_cut,
    pattern_packing,
    period_runs,
    preference,
    sketch,
    source_mix,
    suffix_dedup,
    token_alignment,
    token_scan,
    toxicity,
)
from velospan.llm.columns import whole_text, words

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


_RULES_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT row_number() OVER () AS r, doc_id, source, t, w, len(w) AS n FROM d),
p AS (SELECT r, n, w, unnest(generate_series(1, n - 2)) AS i FROM k WHERE n > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM p),
m AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM g WHERE c > 1),
q AS (SELECT r, sum(least(coalesce(nx - i, 3), 3)) AS reps FROM m GROUP BY r),
b AS (SELECT k.doc_id, k.source, k.n AS n_words,
   length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
   len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
   coalesce(q.reps, 0) AS n_repeat_words
   FROM k LEFT JOIN q USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM f GROUP BY source),
s AS (SELECT sum(bad) / sum(n) AS mean, var_pop(bad / n) - (sum(bad) / sum(n)) * (1 - sum(bad) / sum(n)) * avg(1 / n) AS between_hosts FROM h),
z AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(1000.0, greatest(1.0, mean * (1 - mean) / between_hosts - 1)) ELSE 1000.0 END AS strength FROM s),
v AS (SELECT h.source, (bad + mean * strength) / (n + strength) < 0.8 AS host_kept FROM h, z)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""


@query(_RULES_SQL)
def op10_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = host_rules.host_rules(_read(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
   ('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
      sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind FROM w),
o AS (SELECT *, 3 * source_size * behind < remain * weight AS capped FROM l),
u AS (SELECT arg_min(remain, 3 * source_size / weight) AS remain, arg_min(behind, 3 * source_size / weight) AS behind FROM o WHERE NOT capped),
t AS (SELECT o.source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (weight * u.remain)::DOUBLE / u.behind END AS target FROM o, u),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
b AS (SELECT *, floor(target - passes * source_size + 0.5)::BIGINT AS budget FROM p),
g AS (SELECT source, h, sum(size) AS hs FROM d GROUP BY source, h),
c AS (SELECT *, sum(hs) OVER (PARTITION BY source ORDER BY h) - hs AS before FROM g)
SELECT d.doc_id, d.size::BIGINT AS size, b.source_size, b.target,
  (b.passes * d.size + CASE WHEN c.before + c.hs <= b.budget THEN d.size WHEN c.before < b.budget THEN d.size * (b.budget - c.before) // c.hs ELSE 0 END)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h"""


@query(_MIX_SQL)
def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = source_mix.mix(_read(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op6_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pattern_packing.pack_documents(_read(spark, folder, "documents"))


@query()
def op7_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    judged = lsh_forest.near_duplicates(_read(spark, folder, "documents"), percent=85)
    return judged.select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    judged = toxicity.toxicity(_read(spark, folder, "documents"), _read(spark, folder, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


@query()
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.license_scan(_read(spark, folder, "documents"), name="found").select("doc_id", "found")
    columns = license_scan.digest("found")
    return found.select("doc_id", *[column.alias(name) for name, column in columns.items()])


@query()
def op5_page_cut(spark: SparkSession, folder: str) -> DataFrame:
    texts = page_cut.extract(_read(spark, folder, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op9_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.document_sketches(_read(spark, folder, "documents"))


@query()
def op3_token_scan(spark: SparkSession, folder: str) -> DataFrame:
    return token_scan.document_tokens(_read(spark, folder, "documents"))


_PREFERENCE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, max(i) AS n, max(CASE WHEN role = 'assistant' THEN i END) AS last FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, c.last, t.text AS reply FROM c JOIN t ON t.conv_id = c.conv_id AND t.i = c.last),
j AS (SELECT c.conv_id, c.last, r.reply AS own, o.reply AS other,
   CASE WHEN c.last IS NULL THEN c.n WHEN r.reply = o.reply THEN c.last ELSE c.last - 1 END AS k
   FROM c LEFT JOIN r ON c.conv_id = r.conv_id LEFT JOIN r AS o ON o.conv_id = xor(c.conv_id, 1)),
p AS (SELECT j.conv_id, string_agg('<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10), '' ORDER BY t.i) AS prompt
   FROM j JOIN t ON t.conv_id = j.conv_id AND t.i <= j.k GROUP BY j.conv_id)
SELECT j.conv_id, j.k::BIGINT AS n_prompt_turns, coalesce(p.prompt, '') AS prompt,
  CASE WHEN k < last THEN '<|assistant|>' || chr(10) || own || '<|end|>' || chr(10) ELSE '' END AS chosen,
  CASE WHEN k < last AND other IS NOT NULL THEN '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) ELSE '' END AS rejected,
  CASE WHEN k < last THEN '14-' || (22 + length(own)) ELSE '' END AS chosen_mask,
  CASE WHEN k < last AND other IS NOT NULL THEN '14-' || (22 + length(other)) ELSE '' END AS rejected_mask
FROM j LEFT JOIN p USING (conv_id)"""


@query(_PREFERENCE_SQL)
def op4_preference(spark: SparkSession, folder: str) -> DataFrame:
    whole = preference.whole_conversations(_read(spark, folder, "conversations"))
    made = preference.format_preferences(preference.swapped_replies(whole))
    masks = [preference.spans_text(c).alias(c) for c in ("chosen_mask", "rejected_mask")]
    return made.select("conv_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen", "rejected", *masks)


# A run of the contract has five places in a row or more where a word equals the one a period on,
# so every stretch of such places is a stretch of equal five-word windows.
_RUNS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(cast(doc_id AS VARCHAR), '') AS id,
   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o FROM documents),
c AS (SELECT r, doc_id, o, len(o)::BIGINT AS n,
   xor(list_reduce([4294967295::BIGINT] || list_transform(CASE WHEN id = '' THEN []::VARCHAR[] ELSE string_split(id, '') END, lambda x: ord(x)::BIGINT),
     lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0],
       lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS h FROM d),
m AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM c),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM m),
w AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN o
   ELSE list_transform(generate_series(0, n - 1), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM q),
k AS (SELECT r, n, w, unnest(generate_series(0, n - 6)) AS i FROM w WHERE n >= 6),
g AS (SELECT r, n, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5]) AS x, w[i + 1 : i + 5] AS five FROM k
   UNION ALL SELECT r, n, n - 5, hash(w[n - 4], w[n - 3], w[n - 2], w[n - 1], w[n]), w[n - 4 : n] FROM w WHERE n >= 6),
e AS (SELECT a.r, a.i, b.i - a.i AS p FROM g a JOIN g b ON a.r = b.r AND a.x = b.x AND a.five = b.five AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
t AS (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS part FROM e),
l AS (SELECT r, min(i) AS start, max(i) - min(i) + 5 + p AS length, p AS period FROM t GROUP BY r, p, part),
u AS (SELECT r, start, length, min(period) AS period FROM l WHERE length >= 6 AND length >= 4 * period GROUP BY r, start, length),
f AS (SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
b AS (SELECT r, start, length, period FROM u
   QUALIFY row_number() OVER (PARTITION BY r ORDER BY (length::HUGEINT * 1000000000000) // period DESC, start, period) = 1),
z AS (SELECT DISTINCT r, unnest(generate_series(start + period, start + length - 1)) AS i FROM u),
y AS (SELECT r, list_transform(list(i), lambda x: x + 1) AS gone FROM z GROUP BY r)
SELECT w.doc_id, coalesce(f.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
  (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(f.lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN y.gone IS NULL THEN w.w
    ELSE list_filter(w.w, lambda x, i: NOT list_contains(y.gone, i)) END, ' ')) AS collapsed_sha256
FROM w LEFT JOIN f USING (r) LEFT JOIN b USING (r) LEFT JOIN y USING (r)"""


@query(_RUNS_SQL)
def op11_period_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", words(whole_text()).alias("words"))
    put = period_runs.repeated_words(F.col("words"), F.col("doc_id"))
    found = period_runs.with_runs(docs.select("doc_id", put.alias("words")), F.col("words"), name="found")
    judged = found.select("doc_id", *[c.alias(n) for n, c in period_runs.run_columns("found").items()])
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return judged.select("doc_id", "n_runs", *best, milli, "runs_sha256", "collapsed_sha256")


@query()
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = token_alignment.align(_read(spark, folder, "documents"), digests=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


@query()
def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    kept = suffix_dedup.without_repeats(docs, name="found")
    removed = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, x: n + x["upto"] - x["start"])
    return kept.select(
        "doc_id",
        F.col("found.n_bytes").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("found.spans").cast("long").alias("n_spans"),
        F.sha2("found.kept", 256).alias("kept_sha256"),
    )
