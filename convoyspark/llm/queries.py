"""The registered queries of this subpackage, each over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convoyspark.functions import geo

from . import ann, audio, chat, jaccard, language, lines, mixing, packing, periodic, repair, token_files, toxicity, url_filter
from .shared import folder, ship, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where this machine has a public tokenizer file; an installed package, so the path is the same on all machines."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-ids")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.with_digests(token_files.read(spark, path))


@query("op10_ngram_jaccard_join")
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), words=5, percent=75)


TOXIC_INPUT = ("doc_id", "text")


@query("op2_toxicity_subword_bags")
def op2_toxicity_subword_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents").select(*TOXIC_INPUT), table(spark, sf_dir, "labels"))


_TEXT_TOKENS = "(ceil(strlen(text) / 4.0) + 8)::BIGINT"
_ESCAPE = r"regexp_replace({0}, '([<\[])(~*)(/?(?:s>|INST\]))', '\1~\2\3', 'g')"


@query("op3_budgeted_chat_windows", rf"""WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 t AS (SELECT *, {_TEXT_TOKENS} AS n, length({_ESCAPE.format('role')}) + length({_ESCAPE.format('text')}) + 20 AS chars, row_number() OVER w AS place FROM raw
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
 heads AS (SELECT conv_id, any_value(n) AS head_n, any_value(chars) AS head_chars FROM t WHERE place = 1 AND role = 'system' GROUP BY conv_id),
 s AS (SELECT t.*, coalesce(head_n, 0) AS head_n, coalesce(head_chars, 0) AS head_chars, sum(n) OVER (PARTITION BY t.conv_id ORDER BY place) AS upto,
  sum(n) OVER (PARTITION BY t.conv_id) AS total, max(n) OVER (PARTITION BY t.conv_id) AS longest, 1024 - 256 - coalesce(head_n, 0) AS left_n FROM t LEFT JOIN heads ON t.conv_id IS NOT DISTINCT FROM heads.conv_id),
 spans AS (SELECT *, CASE WHEN total <= 1024 THEN 0
  ELSE greatest(0, (upto - n - 256 - head_n) // greatest(1, left_n // 4, left_n - longest)) END AS span FROM s),
 ends AS (SELECT *, max(upto) OVER (PARTITION BY conv_id, span) AS span_end, max(span) OVER (PARTITION BY conv_id) AS last_span FROM spans),
 sized AS (SELECT conv_id, sum(chars) AS new_chars,
  sum(CASE WHEN span < last_span AND span_end - (upto - n) <= 256 AND NOT (place = 1 AND role = 'system') THEN chars ELSE 0 END) AS repeated_chars,
  (count(DISTINCT span) - 1) * any_value(head_chars) AS head_repeats FROM ends GROUP BY conv_id),
 told AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS loss FROM t GROUP BY conv_id)
 SELECT told.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  (new_chars + repeated_chars + head_repeats)::BIGINT AS formatted_chars
 FROM told JOIN sized ON told.conv_id IS NOT DISTINCT FROM sized.conv_id""")
def op3_budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("""SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')
     AS t(conv_id, turn, role, text)""")
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.read_back(chat.windows(told, budget=1024, history=256)))


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
NOISE, LEAST_NOISE = "[%$#*]{3}", 20  # a page with so many runs of signs is listed
_HOST = r"lower(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1))"
_PATH = r"regexp_extract(coalesce({0}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _canonical_sql(url: str) -> str:
    host, path = _HOST.format(url), _PATH.format(url)
    params = rf"""list_sort(list_filter(string_split(regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
     lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')))"""
    return rf"""(regexp_replace({host}, '^www\.', '') || regexp_replace({path}, '/+$', '') ||
     CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END)"""


def _rules_sql() -> str:
    fits = lambda r: (f"(host = '{r.split('/')[0]}' OR suffix(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}')")
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1]))
    return ", ".join("CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(v, r)}'" for v, r in ordered) + f" END AS {name}"
                     for name, what in (("rule", lambda v, r: r), ("ruled", lambda v, r: v)))


_LISTED_FORM = rf"""('http://www.' || regexp_replace({_HOST.format('url')}, '^www\.', '') || {_PATH.format('url')} || '?utm_source=list' ||
   coalesce('&' || nullif(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), ''))"""


@query("op4_url_bloom_filter", f"""WITH u AS (SELECT page_id, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_canonical_sql('url')} AS key FROM pages),
 noisy AS (SELECT {_LISTED_FORM} AS url FROM pages WHERE len(regexp_extract_all(html, '{NOISE}')) >= {LEAST_NOISE}),
 listed AS (SELECT DISTINCT {_canonical_sql('url')} AS key FROM noisy), r AS (SELECT *, {_rules_sql()} FROM u)
 SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN key IN (SELECT key FROM listed WHERE key <> '') THEN 'block' ELSE 'allow' END) AS verdict FROM r""")
def op4_url_bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the pages whose markup is full of signs, in the form in which a list may hold them: another scheme and host name, and a
    parameter that only tracks. Pages that canonicalise alike are blocked with them, all others of the same hosts are not."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_replace(url_filter.host_of(F.col("url")), r"^www\.", "")
    rest = F.nullif(F.regexp_extract("url", r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    form = F.concat(F.lit("http://www."), host, url_filter.path_of(F.col("url")), F.lit("?utm_source=list"), F.coalesce(F.concat(F.lit("&"), rest), F.lit("")))
    listed = pages.filter(F.regexp_count("html", F.lit(NOISE)) >= LEAST_NOISE).select(form.alias("url"))
    return url_filter.judge(pages.select("page_id", "url"), listed, URL_RULES).select("page_id", "_judged.host", "_judged.path", "_judged.rule", "_judged.verdict")


def _boilerplate_sql(rows: str, key: str, least: int) -> str:
    """Lines without boilerplate of ``rows``, a query of ``key``, ``site`` and ``text``."""
    return f"""WITH d AS ({rows}), l AS (SELECT row_number() OVER () AS k, {key}, site, text, string_split(text, chr(10)) AS lines FROM d),
 each AS (SELECT k, site, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM l),
 totals AS (SELECT site, count(*) AS pages FROM l GROUP BY site),
 bad AS (SELECT each.site, line FROM each JOIN totals ON each.site IS NOT DISTINCT FROM totals.site WHERE line <> ''
  GROUP BY each.site, line HAVING count(*) >= {least} AND count(*) > 0.05 * any_value(pages)),
 spots AS (SELECT k, generate_subscripts(lines, 1) AS i, unnest(lines) AS line, site FROM l),
 kept AS (SELECT k, string_agg(s.line, chr(10) ORDER BY i) AS text, count(*) AS n, bool_or(trim(s.line, ' ') <> '') AS any_left
  FROM spots s LEFT JOIN bad ON s.site IS NOT DISTINCT FROM bad.site AND trim(s.line, ' ') = bad.line WHERE bad.line IS NULL GROUP BY k)
 SELECT {key}, len(lines)::INT AS n_lines, (CASE WHEN any_left THEN len(lines) - n ELSE 0 END)::INT AS dropped_lines,
  CASE WHEN any_left THEN kept.text ELSE l.text END AS text FROM l LEFT JOIN kept USING (k)"""


_BLOCK_TEXT = rf"""array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '{lines._UNSEEN}', '', 'g'),
  '{lines._BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))"""


@query("op5_site_line_dedup", _boilerplate_sql(f"SELECT page_id, {_HOST.format('url')} AS site, {_BLOCK_TEXT} AS text FROM pages", "page_id", 3))
def op5_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host, a line for each block of their markup. On sf0.1 and check_l the lines above 5 % of a host are its
    advertisements and menu entries; text of the articles stays below. Markup is read once: texts are stored, as they are needed twice."""
    pages = table(spark, sf_dir, "pages").select("page_id", url_filter.host_of(F.col("url")).alias("host"), lines.block_text(F.col("html")).alias("text"))
    return lines.deduplicated(stored(pages, "page-texts"), site="host", ratio=0.05, least_pages=3).select(
        "page_id", F.col("_lines.all").alias("n_lines"), F.col("_lines.dropped").alias("dropped_lines"), "text")


@query("op5_source_line_dedup", _boilerplate_sql("SELECT doc_id, source AS site, text FROM documents", "doc_id", 5))
def op5_source_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.deduplicated(docs, site="source", ratio=0.05, least_pages=5).select(
        "doc_id", F.col("_lines.all").alias("n_lines"), F.col("_lines.dropped").alias("dropped_lines"), "text")


@query("op7_capped_water_filling", r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
 w AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
 v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
 aims AS (SELECT source, source_size, CASE WHEN cap / w > level THEN w * (SELECT arg_min(level, (cap / w, place)) FROM v WHERE cap / w > level) ELSE cap END AS target FROM v),
 parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM aims),
 x AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest FROM d JOIN parts ON d.source IS NOT DISTINCT FROM parts.source),
 y AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, size RANGE UNBOUNDED PRECEDING) <= rest AS drawn FROM x),
 z AS (SELECT *, rest - coalesce(sum(size) FILTER (WHERE drawn) OVER (PARTITION BY source), 0) AS missing FROM y),
 e AS (SELECT source, arg_min((h, size), (abs(size - missing), h, size)) AS pick FROM z WHERE NOT drawn AND size > 0 AND abs(size - missing) < missing GROUP BY source)
 SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN drawn OR coalesce((h, size) = pick, false) THEN 1 ELSE 0 END) AS taken
 FROM z LEFT JOIN e ON z.source IS NOT DISTINCT FROM e.source""")
def op7_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0, seed=7).select(
        "doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken")


@query("op8_learned_partitions")
def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, id_column="vec_id", vector_column="embedding")


@query("op1_chroma_fingerprints")
def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of recordings, so each conversation is sung: every word of its turns in order becomes a sound."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    told = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    recordings = told.select("conv_id", F.array_join("turns.text", " ").alias("audio"))
    prints = stored(audio.fingerprints(recordings, id_column="conv_id", audio_column="audio", decode=audio.sung), "fingerprints")
    return audio.same_recordings(prints).withColumnRenamed("doc_id", "conv_id")


def _periodic_damage(words: Column, h: Column) -> Column:
    """Of one text in ten, given by its hash, the words from one place on repeat themselves."""
    n, g = F.size(words).cast("bigint"), F.floor(h / 10)
    a = g % n
    p = F.floor((n - a) / (g % 8 + 3)) + 1
    at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    return F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, at(i)))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    damaged = geo.let(words, lambda w: F.when(F.size(w) > 0, F.array_join(_periodic_damage(w, h), " ")).otherwise(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(h % 10 == 0, damaged).otherwise(F.col("text")).alias("text"))
    found = periodic.with_runs(docs, text="text", least_length=24, least_exponent=3)
    best = F.aggregate("_runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda acc, r: F.when(
        acc.isNull() | (r["length"] * acc["period"] > acc["length"] * r["period"]), r).otherwise(acc))  # they come by start, then period
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("_runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("_runs", line), ""), 256).alias("runs_sha256"), F.sha2(F.coalesce("_collapsed", F.lit("")), 256).alias("collapsed_sha256"))


def damaged_conversations(told: DataFrame) -> DataFrame:
    """The rows of ``told`` as the contract damages them, by a hash of conversation and turn."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return told.filter(case != 0).select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(case == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mended = repair.Repair(damaged_conversations(told))
    found = mended.summary()
    found = found.join(mended.digests().withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    every = told.select(F.col("conv_id").alias("_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


LANGUAGE_INPUT = ("doc_id", "text")


@query("op13_compressed_language_id")
def op13_compressed_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.train(docs.select("doc_id", "text", "lang"), ~held_out)
    told = language.identified(docs.select(*LANGUAGE_INPUT), model)
    return told.select("doc_id", held_out.alias("held_out"), F.coalesce("_language.nearest", F.lit(language.UNDETERMINED)).alias("lang_pred"),
                       F.col("_language.margin").alias("score"), F.col("_language.accepted").alias("accepted"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)
