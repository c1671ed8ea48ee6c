"""Queries of the text, gazetteer, search and HTML operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.config import CATEGORY_KEYWORDS, RESOURCE_KEYWORDS, TYPE_MAP
from terrane.functions import text as T
from terrane.functions import values
from terrane.operators import aggregates, gazetteer, search
from terrane.plans.registry import query
from terrane.session import table
from terrane.sources import html


def _labels_sql(column: str, keywords: dict) -> str:
    tests = [f"CASE WHEN {' OR '.join(f'contains(lower({column}), $${w}$$)' for w in words)} THEN '{label}' END" for label, words in keywords.items()]
    return f"concat_ws(',', {', '.join(tests)})"


@query(f"SELECT doc_id, {_labels_sql('text', CATEGORY_KEYWORDS)} AS labels FROM documents")
def keyword_multilabel(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.categorise(F.col("text"), CATEGORY_KEYWORDS), ",").alias("labels"))


@query(
    "SELECT label, count(*) AS n FROM (SELECT unnest(CASE WHEN l = '' THEN ['uncategorised'] ELSE string_split(l, ',') END) AS label FROM (SELECT "
    + _labels_sql("text", RESOURCE_KEYWORDS) + " AS l FROM conversations)) GROUP BY label"
)
def resource_tally(spark, d):
    rows = table(spark, d, "conversations").select(T.categorise(F.col("text"), RESOURCE_KEYWORDS).alias("labels"))
    return aggregates.label_tally(rows, "labels")


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '\([^)]*\)', ' ', 'g'), '[^a-z0-9_]+', ' ', 'g')) AS k FROM part""")
def compare_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", T.compare_key(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("k"))


@query(r"""SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents""")
def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_accents(F.col("text")).cast("binary")).alias("digest"))


@query(r"""SELECT source, lang, trim(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(*) AS n FROM documents GROUP BY 1, 2""")
def slugs(spark, d):
    rows = table(spark, d, "documents").select("source", "lang", T.slug(F.concat_ws(" / ", "source", "lang")).alias("slug"))
    return rows.groupBy("source", "lang", "slug").agg(F.count("*").alias("n"))


_PHRASES = ("the", "of the", "is the", "and the", "in that", "that is the", "to the")


@query(r"""WITH w AS (SELECT conv_id, turn, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS w FROM conversations),
  grams AS (SELECT conv_id, turn, array_to_string(list_slice(w, i.range + 1, i.range + n.range), ' ') AS g FROM w, range(0, 5000) i, range(1, 4) n WHERE i.range + n.range <= len(w)),
  hits AS (SELECT DISTINCT conv_id, turn, g AS norm FROM grams WHERE g IN ('the', 'of the', 'is the', 'and the', 'in that', 'that is the', 'to the')),
  best AS (SELECT *, rank() OVER (PARTITION BY conv_id, turn ORDER BY length(norm) DESC) AS r FROM hits)
SELECT conv_id, turn, norm FROM best WHERE r = 1""")
def gazetteer_longest(spark, d):
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    texts = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), plain.alias("t"))
    known = spark.createDataFrame([(p,) for p in _PHRASES], "norm string")
    found = gazetteer.longest_phrases(texts, known, "key", "t", already_normal=True, max_words=3)
    return found.select("key.conv_id", "key.turn", "norm")


@query(r"""WITH v AS (SELECT DISTINCT lower(p_brand) AS norm, CASE WHEN right(p_brand, 1) IN ('1', '3') THEN 7 ELSE p_size % 2 END AS id FROM part)
SELECT p_partkey, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN CAST(one AS VARCHAR) END AS locality_id
FROM part LEFT JOIN (SELECT norm, count(DISTINCT id) AS n, min(id) AS one FROM v GROUP BY norm) g ON regexp_replace(lower(p_brand), '[^a-z0-9_]+', ' ', 'g') = regexp_replace(g.norm, '[^a-z0-9_]+', ' ', 'g')""")
def gazetteer_exact(spark, d):
    parts = table(spark, d, "part")
    ident = F.when(F.right("p_brand", F.lit(1)).isin("1", "3"), 7).otherwise(F.col("p_size") % 2)
    known = parts.select(T.normalise(F.col("p_brand")).alias("norm"), ident.cast("string").alias("locality_id")).distinct()
    return gazetteer.exact(parts.select("p_partkey", "p_brand"), known, "p_partkey", "p_brand").select("p_partkey", "n_candidates", "locality_id")


@query("""SELECT p_partkey, p_name, starts_word FROM (
  SELECT *, row_number() OVER (ORDER BY starts_word DESC, p_partkey) AS r FROM (
    SELECT p_partkey, p_name, instr(k, 'ge') = 1 OR substr(k, instr(k, 'ge') - 1, 1) = ' ' AS starts_word
    FROM (SELECT p_partkey, p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g')) AS k FROM part) WHERE instr(k, 'ge') > 0)) WHERE r <= 25""")
def search_ranked(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    found = search.search(search.entries(rows, F.lit("part")), "ge")
    return found.select(F.col("ord").alias("p_partkey"), F.col("display").alias("p_name"), "starts_word")


@query()
def fuzzy_ratio_pairs(spark, d):
    """Suppliers' names against the next key's: the ratio has no SQL form."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    nxt = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("next_name"))
    return s.join(nxt, "s_suppkey").select("s_suppkey", F.round(T.sequence_ratio(F.col("s_name"), F.col("next_name")), 6).alias("ratio"))


@query()
def html_text(spark, d):
    pages = table(spark, d, "pages").select("page_id", html.article_text(F.col("html")).alias("body"))
    return pages.select("page_id", F.md5(F.col("body").cast("binary")).alias("digest"), F.length("body").alias("n_chars"))


@query()
def html_listing(spark, d):
    """Listing entries made of the pages' own addresses, read back by the parser."""
    link = F.concat(F.lit('<a class="list-item" href="/x/'), F.col("page_id").cast("string"), F.lit('.html"><span class="date">07، Aug 2026</span>'), T.escape_html(F.col("url")), F.lit("</a>"))
    pages = table(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 50).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(link)), "").alias("html"))
    return html.listing(pages).select("page", "url", "title", "date_raw")


@query("""SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  nullif(regexp_extract(url, '/(\\d+)\\.html$', 1), '') AS page_number FROM pages""".replace("\\\\", "\\"))
def url_fields(spark, d):
    return table(spark, d, "pages").select("page_id", T.escape_html(F.col("url")).alias("escaped"), T.id_from_url(F.col("url")).alias("page_number"))


@query("""SELECT c_mktsegment AS segment, CASE lower(c_mktsegment) WHEN 'building' THEN 'settlement' ELSE 'unknown' END AS kind, count(*) AS n FROM customer GROUP BY 1, 2""")
def vocab_map_unknowns(spark, d):
    kind = values.vocabulary(F.col("c_mktsegment"), TYPE_MAP | {"building": "settlement"}, "unknown")
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN NULL ELSE n_name END AS cleaned, CASE WHEN n_nationkey % 5 IN (0, 1) THEN NULL ELSE n_name END AS labelled FROM nation""")
def clean_names(spark, d):
    raw = F.when(F.col("n_nationkey") % 5 == 0, "  ").when(F.col("n_nationkey") % 5 == 1, "___").otherwise(F.concat(F.lit(" "), "n_name", F.lit(" ")))
    return table(spark, d, "nation").select("n_name", T.clean_strict(raw).alias("cleaned"), T.clean_label(raw).alias("labelled"))
