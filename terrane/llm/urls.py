"""URL filters: longest matching rule, else an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host. Each level, from the suffix over the registered
domain to the host, has a beta prior whose mean is the posterior mean of the level above, without
the member's own pages, and whose strength comes from the spread between members (method of moments).
A host is blocked when even the lower bound of its posterior share of bad pages is over
``block_share``. Hosts without labelled pages stand by the posterior of their domain or suffix.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The rules of the driver's query, as (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Public suffixes of several labels that are known unless a caller gives others; all else has one label.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "org.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "co.nz", "org.nz", "ac.jp", "co.jp", "ne.jp", "or.jp",
    "com.br", "net.br", "org.br", "com.cn", "net.cn", "org.cn", "com.hk", "com.tw", "com.sg", "com.my", "co.id", "co.th", "co.in", "net.in", "org.in", "co.kr", "or.kr",
    "com.mx", "com.ar", "com.co", "com.pe", "com.tr", "com.ua", "com.pl", "com.vn", "com.ph", "com.eg", "com.sa", "co.il", "org.il", "co.za", "org.za", "co.ke", "com.ng",
    "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "herokuapp.com", "netlify.app", "vercel.app", "pages.dev", "web.app", "s3.amazonaws.com",
)
BLOCK_SHARE = 0.5
Z = 1.96
# A prior weighs at least this many pages, however far apart the members of its level are: one bad page is no verdict.
MIN_STRENGTH = 2.0
# So many rules are part of the plan; more are joined. Which rule fits is the same.
_PLAN_RULES = 500


def split_url(url):
    """(host, path) of a url: empty without ``://``; A-Z of the host lower-cased."""
    url = F.coalesce(url, F.lit(""))
    host = common.fold_ascii(F.regexp_extract(url, "://([^/?#]*)", 1))
    return host, F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def host_name(host):
    """The host without user, port and final dots: what reputation is kept by."""
    bare = F.regexp_replace(host, "^.*@", "")
    bare = F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[[^\]]*\]?", 0)).otherwise(F.regexp_replace(bare, ":[0-9]*$", ""))
    return F.regexp_replace(bare, r"\.+$", "")


def split_host(name, suffixes=SUFFIXES):
    """(registered domain, suffix) of a host's name; one label or an address in numbers is its own domain and suffix."""
    address = name.startswith("[") | name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    domain, suffix = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    for labels in sorted({s.count(".") + 1 for s in suffixes}):  # the longest is asked first
        here = F.substring_index(name, ".", -labels)
        known = here.isin(*[s for s in suffixes if s.count(".") + 1 == labels])
        domain, suffix = F.when(known, F.substring_index(name, ".", -labels - 1)).otherwise(domain), F.when(known, here).otherwise(suffix)
    return F.when(address, name).otherwise(domain), F.when(address, name).otherwise(suffix)


def judge(host, path, rules=RULES):
    """(rule, action) of the longest rule that fits, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def ruled(split: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (``host``, ``path``, more) with ``rule, action`` of the longest rule of a table (``action, host, path``) that fits, else nulls.

    A host meets the rules of all its ends at a dot by a join, so rules are as many as there are. Of rules with one
    text and two actions, ``block`` counts.
    """
    table = rules.select(F.col("host").alias("_end"), F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), F.col("action"), F.col("path").alias("begin")).alias("_rule"))
    hosts = split.groupBy("host").agg(F.count("*").alias("_n")).select("host")
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    met = hosts.select("host", F.explode(ends).alias("_end")).join(table, "_end").groupBy("host").agg(F.collect_set("_rule").alias("_rules"))  # a host's rules
    joined = split.join(met, "host", "left")
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["begin"])))
    return joined.withColumn("_best", best).select(*split.columns, F.col("_best.rule").alias("rule"), F.col("_best.action").alias("action"))


def _strength(level: DataFrame) -> float:
    """Prior strength from members (n, k) and the means of their parents (mu), by moments."""
    spread = F.col("mu") * (1 - F.col("mu"))
    row = level.agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("mu"), 2)).alias("seen"),
        F.sum(spread).alias("one"),
        F.sum(spread * (F.col("n") - 1)).alias("more"),
    ).first()
    if not row.more or row.more <= 0:
        return MIN_STRENGTH
    rho = min(1 / (1 + MIN_STRENGTH), max(0.001, (row.seen - row.one) / row.more))
    return 1 / rho - 1


def _shrunk(n, k, mu, strength: float):
    """Posterior mean of k in n under a beta prior."""
    return (F.lit(strength) * mu + k) / (F.lit(strength) + n)


def reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, n, k, share, bound_low`` for the distinct ``hosts`` (host, domain, suffix).

    ``outcomes``: host, domain, suffix, n labelled pages, k bad ones; one row for each host. A
    member's prior comes from the other members of its parent, so that no page counts twice.
    """
    outcomes = outcomes.where("n > 0")
    total = outcomes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = F.lit(((total.k or 0) + 0.5) / ((total.n or 0) + 1.0))
    suffixes = outcomes.groupBy("suffix").agg(F.sum("n").alias("n_s"), F.sum("k").alias("k_s"))
    s_suffix = _strength(suffixes.select(F.col("n_s").alias("n"), F.col("k_s").alias("k"), base.alias("mu")))
    domains = outcomes.groupBy("suffix", "domain").agg(F.sum("n").alias("n_d"), F.sum("k").alias("k_d")).join(suffixes, "suffix")
    mu_d = _shrunk(F.col("n_s") - F.col("n_d"), F.col("k_s") - F.col("k_d"), base, s_suffix)
    s_domain = _strength(domains.select(F.col("n_d").alias("n"), F.col("k_d").alias("k"), mu_d.alias("mu")))
    counted = outcomes.select("host", "n", "k")
    every = hosts.join(counted, "host", "left").join(domains.drop("n_s", "k_s"), ["suffix", "domain"], "left").join(suffixes, "suffix", "left")
    every = every.fillna(0, ["n", "k", "n_d", "k_d", "n_s", "k_s"])
    mu_h = _shrunk(F.col("n_d") - F.col("n"), F.col("k_d") - F.col("k"), mu_d, s_domain)
    every = every.select("host", "n", "k", mu_h.alias("mu"))
    s_host = _strength(every.where("n > 0"))
    share = _shrunk(F.col("n"), F.col("k"), F.col("mu"), s_host)
    every = every.withColumn("share", share)
    spread = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.lit(s_host + 1) + F.col("n")))
    return every.select("host", "n", "k", "share", F.greatest(F.col("share") - F.lit(Z) * spread, F.lit(0.0)).alias("bound_low"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, block_share: float = BLOCK_SHARE, suffixes=SUFFIXES) -> DataFrame:
    """``id, host, path, rule, verdict, share, bound_low`` for each page.

    ``rules`` are (action, host, path): a list, or a table of any size. ``outcomes``: labelled pages as (the id column, ``bad`` 0 or 1); null ids or labels are left
    out, a page labelled twice counts twice. Null urls have an empty host and path and are judged
    like any other. Reputation is kept by the host without user, port and final dots. Null ids and repeated pages keep their rows; an empty table gives none; other
    columns are not read.
    """
    host, path = split_url(F.col("_url"))
    split = pages.select(F.col(id_col).alias("_id"), F.col(url).cast("string").alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    split = split.withColumn("name", host_name(F.col("host")))
    named = outcomes.select(F.col(id_col).alias("_id"), F.col("bad").cast("long").alias("bad")).where("_id is not null and bad is not null")
    domain, suffix = split_host(F.col("host"), suffixes)
    names = split.select("_id", F.col("name").alias("host"))
    labelled = names.join(named, "_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    labelled = common.materialize(labelled.withColumn("domain", domain).withColumn("suffix", suffix))
    hosts = names.groupBy("host").agg(F.count("*").alias("_pages")).drop("_pages").withColumn("domain", domain).withColumn("suffix", suffix)
    known = common.materialize(reputations(hosts, labelled)).withColumnRenamed("host", "name")
    if isinstance(rules, DataFrame) or len(rules) > _PLAN_RULES:
        table = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
        split = ruled(split, table)
        rule, action = F.col("rule"), F.col("action")
    else:
        rule, action = judge(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound_low") > block_share, "block").otherwise("allow")
    return split.join(known, "name").select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"),
        F.round("share", 6).alias("share"), F.round("bound_low", 6).alias("bound_low"),
    )
