"""The numbered queries of the driver contract, each the application of one operator to its whole table."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from millrace.llm import blocks, decontam, infill, jaccard, langid, linefirst, packing, perspectives, repeats, resample, tokens, urlcascade, wrapper
from millrace.llm.batches import bound_batches
from millrace.plans.scratch import table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def bounded(spark, sf_dir):
            bound_batches(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = bounded
        ORACLES[f.__name__] = sql
        return bounded

    return add


def tokenizer_path() -> str:
    """The public vocabulary of the queries; it lies with the public_tokenizers package on each machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_pack(spark, sf_dir):
    return packing.pack_digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


#: What op2 edits: mail addresses (only tried where a run without blanks begins), long numbers, and what looks like a key.
MASKS = [(r"(?<![^\s@])[^\s@]++@[^\s@]++", "<mail>"), (r"\d[\d -]{6,}\d", "<number>"), (r"[A-Za-z0-9+/_]{32,}={0,2}", "<key>")]


@query()
def op2_edited_counts(spark, sf_dir):
    edits = tokens.mask_edits(table(spark, sf_dir, "documents"), MASKS)
    counted = tokens.apply_edits(tokens.build_trees(edits, tokenizer_path()), tokenizer_path())
    return counted.select(
        "doc_id", "n_tokens_before", "n_tokens", "n_edits", "n_ignored", "n_chars_encoded", F.size("leaf_tokens").cast("long").alias("n_leaves")
    )


@query()
def op3_page_text(spark, sf_dir):
    return wrapper.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(perspectives.ORACLE)
def op4_rotate_perspectives(spark, sf_dir):
    return perspectives.rotate_perspectives(table(spark, sf_dir, "conversations"))


@query()
def op5_ngram_join(spark, sf_dir):
    bound_batches(spark, 4)
    found = jaccard.link_groups(table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@query()
def op6_line_rules(spark, sf_dir):
    judged = linefirst.clean_lines(table(spark, sf_dir, "documents"))
    return judged.drop("clean_text", "removed_lines")


@query()
def op7_language(spark, sf_dir):
    docs = langid.fold(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).withColumn("learns", ~F.col("held_out"))
    return langid.learn_and_identify(docs, "learns", "doc_id", "held_out")


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Hosts of a block list: these sites under each of these suffixes.
LISTED_SITES, LISTED_UNDER = ["ads-track", "adult-x", "casino-win", "cheap-pills", "spam-farm"], ["example.com", "example.net", "example.org"]


@query(r"""
WITH parts AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's')) AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
rules(action, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'),
  ('block', 'net/es/'), ('block', 'net/fr/')),
cut AS (SELECT *, substr(rule, 1, strpos(rule, '/') - 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
best AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action FROM parts JOIN cut
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches(host,
  '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|spam-farm)\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
""")
def op8_url_filter(spark, sf_dir):
    listed = spark.createDataFrame([(f"{site}.{under}",) for site in LISTED_SITES for under in LISTED_UNDER], "host string")
    return urlcascade.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, listed).drop("listed_host")


@query()
def op9_repeated_strings(spark, sf_dir):
    return repeats.repeats_digest(table(spark, sf_dir, "documents"))


@query(decontam.ORACLE)
def op10_decontaminate(spark, sf_dir):
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.contamination_digest(found)


@query(infill.ORACLE)
def op11_fill_in_middle(spark, sf_dir):
    return infill.infill_digest(infill.fill_in_middle(table(spark, sf_dir, "documents"), unit="line", seed=7, percent=100, spm_percent=50))


@query()
def op12_importance_resampling(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20, seed=42)


@query()
def op13_repeated_windows(spark, sf_dir):
    return blocks.blocks_digest(table(spark, sf_dir, "documents"), width=35)
