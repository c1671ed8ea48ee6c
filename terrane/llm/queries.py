"""The queries over the driver's tables that apply each operator, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontamination, licenses, packing, phrases, pii, quality, repeats, secrets, simhash, token_counts, urls, vectors

QUERIES: dict = {}
ORACLES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pii_key(spark: SparkSession) -> bytes:
    """The secret named in the session; where none is named, one drawn for this query alone: nobody can undo its pseudonyms."""
    named = spark.conf.get("spark.terrane.pii.key", None)
    return named.encode() if named else os.urandom(32)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@_query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@_query
def op8_subspace_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


ORACLES["op8_subspace_embedding_dedup"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
"""


@_query
def op2_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


@_query
def op3_ordinal_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.grades_of(_table(spark, sf_dir, "labels")))
    return quality.grade_documents(docs, model, keep=["doc_id"])


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


@_query
def op5_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    spans = F.array_join(F.transform("pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return done.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_pii"), spans.alias("spans"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Labelled page outcomes: the page of a labelled id is bad when it is of low quality or toxic."""
    bad = F.when((F.col("quality") < 1) | (F.col("toxic") > 0), 1).when(F.col("quality") >= 1, 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


@_query
def op9_bayes_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), page_outcomes(_table(spark, sf_dir, "labels")))


@_query
def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark")).drop("text")


def _op9_sql() -> str:
    upper = "".join(map(chr, range(65, 91)))
    known = ", ".join(f"'{s}'" for s in urls.SUFFIXES)
    low = 1 / (1 + urls.MIN_STRENGTH)

    def strength(table: str) -> str:
        return f"""(SELECT CASE WHEN more > 0 THEN 1 / least({low!r}, greatest(0.001, (seen - one) / more)) - 1 ELSE {urls.MIN_STRENGTH!r} END FROM (SELECT
          sum(n * pow(k / n - mu, 2)) AS seen, sum(mu * (1 - mu)) AS one, sum(mu * (1 - mu) * (n - 1)) AS more FROM {table}))"""

    tests = []
    for action, host, path in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])):
        tests.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path, action))
    rule = " ".join(f"WHEN {t} THEN '{r}'" for t, r, _ in tests)
    verdict = " ".join(f"WHEN {t} THEN '{a}'" for t, _, a in tests)
    return f"""
WITH split AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  named AS (SELECT doc_id AS page_id, CASE WHEN quality < 1 OR toxic > 0 THEN 1 WHEN quality >= 1 THEN 0 END AS bad FROM labels),
  bare AS (SELECT *, regexp_replace(CASE WHEN starts_with(u, '[') THEN regexp_extract(u, '^\\[[^\\]]*\\]?', 0) ELSE regexp_replace(u, ':[0-9]*$', '') END, '\\.+$', '') AS host
    FROM (SELECT page_id, regexp_replace(host, '^.*@', '') AS u, host AS full_host, path FROM split)),
  labelled AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS k FROM bare JOIN named USING (page_id) WHERE bad IS NOT NULL GROUP BY host),
  parts AS (SELECT host, string_split(host, '.') AS w, starts_with(host, '[') OR regexp_matches(host, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') AS address FROM (SELECT DISTINCT host FROM bare)),
  tails AS (SELECT *, array_to_string(w[-2:], '.') AS two, array_to_string(w[-3:], '.') AS three FROM parts),
  hosts AS (SELECT host, CASE WHEN address THEN host WHEN three IN ({known}) THEN array_to_string(w[-4:], '.') WHEN two IN ({known}) THEN three ELSE two END AS domain,
    CASE WHEN address THEN host WHEN three IN ({known}) THEN three WHEN two IN ({known}) THEN two ELSE w[-1] END AS suffix FROM tails),
  known AS (SELECT * FROM labelled JOIN hosts USING (host)),
  base AS (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + CAST(1 AS DOUBLE)) AS b FROM known),
  suf AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(b) AS mu FROM known, base GROUP BY suffix),
  ss AS (SELECT {strength("suf")} AS s),
  dom AS (SELECT d.suffix, domain, d.n, d.k, (ss.s * b + suf.k - d.k) / (ss.s + suf.n - d.n) AS mu
    FROM (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM known GROUP BY suffix, domain) d JOIN suf USING (suffix), base, ss),
  sd AS (SELECT {strength("dom")} AS s),
  every AS (SELECT h.host, coalesce(l.n, 0) AS n, coalesce(l.k, 0) AS k, coalesce(dom.n, 0) AS dn, coalesce(dom.k, 0) AS dk,
      coalesce(dom.mu, (ss.s * b + coalesce(suf.k, 0)) / (ss.s + coalesce(suf.n, 0))) AS dmu
    FROM hosts h LEFT JOIN labelled l USING (host) LEFT JOIN dom ON dom.domain = h.domain AND dom.suffix = h.suffix LEFT JOIN suf ON suf.suffix = h.suffix, base, ss),
  prior AS (SELECT host, n, k, (sd.s * dmu + dk - k) / (sd.s + dn - n) AS mu FROM every, sd),
  seen AS (SELECT * FROM prior WHERE n > 0),
  sh AS (SELECT {strength("seen")} AS s),
  posterior AS (SELECT host, (sh.s * mu + k) / (sh.s + n) AS share, sh.s + 1 + n AS weight FROM prior, sh),
  judged AS (SELECT host, share, greatest(share - {urls.Z!r} * sqrt(share * (1 - share) / weight), 0) AS bound_low FROM posterior)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE CASE WHEN bound_low > {urls.BLOCK_SHARE!r} THEN 'block' ELSE 'allow' END END AS verdict,
  round(share, 6) AS share, round(bound_low, 6) AS bound_low FROM (SELECT page_id, full_host AS host, path, host AS name FROM bare) JOIN (SELECT host AS name, share, bound_low FROM judged) USING (name)
"""


ORACLES["op9_bayes_url_filter"] = _op9_sql()


def _op10_sql() -> str:
    d = decontamination
    units, numbers = (", ".join(f"'{w}'" for w in words) for words in (d.UNITS, d.NUMBER_WORDS))
    slot = (
        f"CASE WHEN substr({{0}}, 1, 1) BETWEEN '0' AND '9' OR lower({{0}}) IN ({numbers}) THEN '#' WHEN substr({{0}}, 1, 1) <> lower(substr({{0}}, 1, 1)) THEN '@' WHEN {{0}} IN ({units}) THEN '%' END"
    )
    digits = "translate(coalesce(text, ''), '\ue000', ' ')"
    for _ in range(2):
        digits = rf"regexp_replace({digits}, '(\p{{N}})[.,](\p{{N}})', '\1\ue000\2', 'g')".replace("\\ue000", "\ue000")
    words = rf"list_filter(string_split(trim(regexp_replace({digits}, '[^\p{{L}}\p{{N}}\ue000]+', ' ', 'g')), ' '), lambda x: x <> '')".replace("\\ue000", "\ue000")

    def tokens(name: str, words_: str, key: str) -> str:
        """Runs of words of one type (a unit after its number too) as one token."""
        before = "lag(p) OVER (PARTITION BY id ORDER BY i)"
        return f"""{name} AS (SELECT id AS {key}, k AS i, any_value(p) FILTER (WHERE first) AS slot, string_agg(lower(x), ' ' ORDER BY i) AS v FROM
    (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS k FROM (SELECT *, NOT coalesce({before} = p OR ({before} = '#' AND p = '%'), FALSE) AS first FROM {words_})) GROUP BY id, k)"""

    consistent = f"coalesce(greatest(0, 1 - ({{1}} - {{0}}) / nullif(CAST({{0}} AS DOUBLE), 0)), 1) >= {d.CONSISTENT!r}"
    return f"""
WITH doc AS (SELECT doc_id, {words} AS w FROM documents),
  docw AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM doc),
  docs_ AS (SELECT doc_id AS id, i, x, {slot.format("x")} AS p FROM docw),
  every AS (SELECT item_id, {words} AS w FROM benchmark),
  itemw AS (SELECT item_id AS id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM every WHERE len(w) >= {d.MIN_WORDS}),
  items_ AS (SELECT *, {slot.format("x")} AS p FROM itemw),
  {tokens("doct", "docs_", "doc_id")},
  {tokens("itemt", "items_", "item_id")},
  itemn AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM itemt),
  wins AS (SELECT a.item_id, a.i AS pos, least({d.WINDOW}, a.n) AS size, string_agg(coalesce(b.slot, b.v), ' ' ORDER BY b.i) AS t, count(*) FILTER (WHERE b.slot IS NULL) AS literals
    FROM itemn a JOIN itemn b ON a.item_id = b.item_id AND b.i BETWEEN a.i AND a.i + least({d.WINDOW}, a.n) - 1 WHERE a.i + least({d.WINDOW}, a.n) - 1 <= a.n GROUP BY 1, 2, 3),
  telling AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_windows FROM wins WHERE literals >= least({d.LITERALS}, size - 1)),
  wordn AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM itemw),
  plain AS (SELECT a.id AS item_id, a.i AS pos, least({d.WINDOW}, a.n) AS size, a.n - least({d.WINDOW}, a.n) + 1 AS n_all, string_agg(lower(b.x), ' ' ORDER BY b.i) AS l
    FROM wordn a JOIN wordn b ON a.id = b.id AND b.i BETWEEN a.i AND a.i + least({d.WINDOW}, a.n) - 1 WHERE a.i + least({d.WINDOW}, a.n) - 1 <= a.n GROUP BY 1, 2, 3, 4),
  docs AS (SELECT id AS doc_id, list(lower(x) ORDER BY i) AS l FROM docs_ GROUP BY id),
  doctl AS (SELECT doc_id, list(coalesce(slot, v) ORDER BY i) AS t FROM doct GROUP BY doc_id),
  docwint AS (SELECT doc_id, size, p.range AS i, array_to_string(list_slice(t, p.range, p.range + size - 1), ' ') AS t FROM doctl, (SELECT DISTINCT size FROM telling), range(1, 40000) p WHERE p.range + size - 1 <= len(t)),
  docwin AS (SELECT doc_id, size, p.range AS i, array_to_string(list_slice(l, p.range, p.range + size - 1), ' ') AS l FROM docs, (SELECT DISTINCT size FROM plain), range(1, 40000) p WHERE p.range + size - 1 <= len(l)),
  hits AS (SELECT DISTINCT doc_id, item_id, n_windows, telling.pos, telling.size, docwint.i - telling.pos AS shift FROM docwint JOIN telling ON docwint.t = telling.t AND docwint.size = telling.size),
  covered AS (SELECT doc_id, item_id, count(DISTINCT pos) / CAST(any_value(n_windows) AS DOUBLE) AS covered FROM hits GROUP BY 1, 2 HAVING count(DISTINCT pos) / CAST(any_value(n_windows) AS DOUBLE) >= {d.COVERAGE!r}),
  under AS (SELECT DISTINCT h.doc_id, h.item_id, h.shift, i.i, i.v FROM hits h JOIN covered USING (doc_id, item_id) JOIN itemt i ON i.item_id = h.item_id AND i.i BETWEEN h.pos AND h.pos + h.size - 1 WHERE i.slot IS NOT NULL),
  filled AS (SELECT DISTINCT u.doc_id, u.item_id, u.shift, u.v, t.v AS f FROM under u JOIN doct t ON t.doc_id = u.doc_id AND t.i = u.i + u.shift),
  counted AS (SELECT doc_id, item_id, shift, count(DISTINCT v) AS values_, count(*) AS fills FROM filled GROUP BY 1, 2, 3),
  judged AS (SELECT h.doc_id, h.item_id, h.n_windows, h.pos, h.shift, c.covered, coalesce(k.values_, 0) AS values_, coalesce(k.fills, 0) AS fills
    FROM hits h JOIN covered c USING (doc_id, item_id) LEFT JOIN counted k USING (doc_id, item_id, shift)),
  whole AS (SELECT doc_id, item_id, any_value(covered) AS covered, sum(values_) AS values_, sum(fills) AS fills
    FROM (SELECT DISTINCT doc_id, item_id, shift, covered, values_, fills FROM judged) GROUP BY 1, 2),
  own AS (SELECT doc_id, item_id, count(DISTINCT pos) / CAST(any_value(n_windows) AS DOUBLE) AS own FROM judged WHERE {consistent.format("values_", "fills")} GROUP BY 1, 2),
  typed AS (SELECT doc_id, item_id, CASE WHEN {consistent.format("values_", "fills")} THEN covered ELSE own END AS covered
    FROM whole LEFT JOIN own USING (doc_id, item_id) WHERE {consistent.format("values_", "fills")} OR own >= {d.COVERAGE!r}),
  equal AS (SELECT doc_id, item_id, count(DISTINCT plain.pos) / CAST(any_value(n_all) AS DOUBLE) AS covered FROM docwin JOIN plain ON docwin.l = plain.l AND docwin.size = plain.size GROUP BY 1, 2
    UNION ALL SELECT d.doc_id, e.item_id, 1.0 FROM docs d JOIN every e ON len(e.w) BETWEEN 1 AND {d.MIN_WORDS - 1} AND d.l = list_transform(e.w, lambda x: lower(x))),
  found AS (SELECT * FROM typed UNION ALL SELECT * FROM equal WHERE covered >= {d.COVERAGE!r} AND NOT EXISTS (SELECT 1 FROM typed t WHERE t.doc_id = equal.doc_id AND t.item_id = equal.item_id)),
  by_doc AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items, max(covered) AS coverage FROM found GROUP BY 1)
SELECT doc_id, by_doc.n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items, coalesce(coverage, 0) AS coverage FROM documents LEFT JOIN by_doc USING (doc_id)
"""


ORACLES["op10_template_decontamination"] = _op10_sql()


@_query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def _op11_sql() -> str:
    """All phrases are counted, without buckets or pruning."""
    d, upper = phrases, "".join(map(chr, range(65, 91)))
    joined = lambda begin, end: f"array_to_string(w[{begin}:{end}], ' ')"
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
  total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
  grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, generate_subscripts(w, 1) AS i FROM words WHERE len(w) > 0), (SELECT unnest(range(1, {d.MAX_WORDS + 1})) AS k) WHERE i + k - 1 <= len(w)),
  found AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {d.LEAST}),
  cuts AS (SELECT lang, k, phrase, w, a, unnest(range(1, k)) AS cut FROM found WHERE k > 1),
  scored AS (SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, CAST(CAST({d.SCORE_SCALE} AS HUGEINT) * c.a // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
    FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = {joined(1, "cut").replace("w[", "c.w[")} JOIN found y ON y.lang = c.lang AND y.phrase = {joined("cut + 1", "k").replace("w[", "c.w[").replace(":k]", ":c.k]")}),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  inner_ AS (SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(a) AS held FROM (SELECT lang, w, k, a, m, unnest(range(1, k - m + 2)) AS b FROM (SELECT *, unnest(range(2, k)) AS m FROM found WHERE k > 2)) GROUP BY 1, 2),
  kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE held IS NULL OR CAST(held AS HUGEINT) * 100 < CAST(a AS HUGEINT) * {d.COVERED_PERCENT}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {d.TOP}
"""


ORACLES["op11_phrase_collocations"] = _op11_sql()


@_query
def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def _op12_sql() -> str:
    """Every window as a blob, every byte as a row."""
    w = repeats.WINDOW
    return f"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
  places AS (SELECT doc_id, b, n, unnest(range(0, n)) AS i FROM docs),
  windows AS (SELECT doc_id, i, b[i + 1:i + {w}] AS s FROM places WHERE i + {w} <= n),
  low AS (SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s HAVING count(*) > 1),
  marked AS (SELECT doc_id, i FROM windows JOIN low USING (s) WHERE doc_id > first_id),
  bytes AS (SELECT p.doc_id, p.i, hex(b[p.i + 1:p.i + 1]) AS b, count(m.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) > 0 AS gone
    FROM places p LEFT JOIN marked m ON p.doc_id = m.doc_id AND p.i = m.i),
  runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS begins FROM bytes),
  sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id)
"""


ORACLES["op12_repeated_passages"] = _op12_sql()


@_query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """The same rounds as a chain of common table expressions, one for each assignment and each mean."""
    d = codes

    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM
    (SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS far FROM x JOIN b{k} b ON x.part = b.part AND x.pos = b.pos GROUP BY 1, 2, 3) GROUP BY 1, 2)"""

    def moved(k: int) -> str:
        return f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN
    (SELECT a.part, a.entry, x.pos, (sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) AS v FROM a{k} a JOIN x ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY 1, 2, 3) m
    ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""

    rounds = ",\n  ".join(step(k) for k in range(d.ROUNDS) for step in (assigned, moved))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {d.SCALE}) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
  x AS MATERIALIZED (SELECT vec_id, (i - 1) // (n // {d.PARTS}) AS part, (i - 1) % (n // {d.PARTS}) AS pos, v FROM
    (SELECT vec_id, len(q) AS n, generate_subscripts(q, 1) AS i, unnest(q) AS v FROM kept)),
  b0 AS MATERIALIZED (SELECT part, s.entry, pos, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {d.ENTRIES}) s USING (vec_id)),
  {rounds},
  {assigned(d.ROUNDS)},
  done AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{d.ROUNDS} GROUP BY 1),
  sha AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{d.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM done JOIN kept USING (vec_id), sha
"""


ORACLES["op13_vector_codes"] = _op13_sql()
