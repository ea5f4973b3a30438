"""URL filters: rules first, then trust and distrust propagated over the host graph.

Few rules are a chain of conditions; many are a table, joined by host suffixes. Hosts that hold pages under allow rules are trusted seeds, those with pages under block rules
are blocked seeds. Trust is a personalised PageRank along the links between hosts, distrust
one along the reversed links (who links to a blocked host gets a share of its distrust). A
host is blocked if its distrust exceeds both its trust and its share of all pages.
All of it is built-in Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._joins import join_checked
from tessera.llm._storage import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINKS = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"
# The rules (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING = 0.85
#: A round that moves less than this share of one page's weight ends the propagation.
CLOSE = 0.01
#: By how much distrust must exceed trust, and a host's share of the pages, to count as more.
MARGIN = 1e-9
#: Rules up to which they are a chain of conditions.
CHAIN = 200


def host_of(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_for(host: str, path: str, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's path; of
    equally long ones the first by name counts.
    """
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(slash + p)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def rules_found(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (key, host, path) with ``found``, the longest of ``rules`` (verdict, rule) that fits, for rules in any number."""
    cut = F.split("rule", "/", 2)
    table = rules.select("verdict", "rule", F.get(cut, F.lit(0)).alias("of"), F.concat(F.when(F.contains("rule", F.lit("/")), "/").otherwise(""), F.coalesce(F.get(cut, F.lit(1)), F.lit(""))).alias("start"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    distinct = saved(pages.select("host", "path").distinct())
    hits = join_checked(distinct.select("host", "path", F.explode(suffixes).alias("of")), table, "of", "inner", wide=("of", "start")).where(F.col("path").startswith(F.col("start")))
    best = F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), F.col("rule"))).alias("found")
    found = hits.groupBy("host", "path").agg(best).select(F.col("host").alias("host_"), F.col("path").alias("path_"), "found")
    return join_checked(pages, saved(found), (F.col("host") == F.col("host_")) & (F.col("path") == F.col("path_")), "left", wide=("host_", "path_")).drop("host_", "path_")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of one host to another; relative links stay on a host and don't count."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINKS), F.lit(1))
    edges = pages.select(host_of(url).alias("src"), F.explode(found).alias("to"))
    edges = edges.select("src", F.translate(F.regexp_replace("to", r"^[^@]*@", ""), UPPER, LOWER).alias("dst"))
    return edges.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, close: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) from ``hosts`` (host, good, bad: seed weights) and ``edges`` (src, dst, n).

    Both ranks sum to 1 if they have a seed, else they are 0. What a host without links on
    would pass on goes back to the seeds. It ends when a round moves less than ``close`` in all; as each
    round moves ``damping`` times what the last one did at most, that is after log(close) / log(damping) rounds.
    """
    names = hosts.select("host", "good", "bad").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0).alias("good"), F.lit(0).alias("bad")))
    seeds = names.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    all_good, all_bad = seeds.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()

    def part(name: str, total: float) -> Column:
        return F.col(name) / F.lit(float(total)) if total else F.lit(0.0)

    seeds = saved(seeds.select("host", part("good", all_good).alias("s_trust"), part("bad", all_bad).alias("s_distrust")))
    state = seeds.select("host", F.col("s_trust").alias("trust"), F.col("s_distrust").alias("distrust"))
    if edges.isEmpty():
        return state
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "n", F.lit(True).alias("onward")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "n", F.lit(False).alias("onward")))
    out = both.groupBy("a", "onward").agg(F.sum("n").alias("all"))
    share = saved(both.join(out, ["a", "onward"]).select("a", "b", "onward", (F.col("n") / F.col("all")).alias("w")))
    while True:
        moved = share.join(state, share["a"] == state["host"]).groupBy(F.col("b").alias("host"))
        moved = moved.agg(F.sum(F.when(F.col("onward"), F.col("w") * F.col("trust")).otherwise(0.0)).alias("t"), F.sum(F.when(~F.col("onward"), F.col("w") * F.col("distrust")).otherwise(0.0)).alias("d"))
        moved = saved(moved)
        kept_t, kept_d = moved.agg(F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum("d"), F.lit(0.0))).first()
        lost_t, lost_d = max(0.0, bool(all_good) - kept_t), max(0.0, bool(all_bad) - kept_d)

        def rank(seed: str, gain: str, lost: float) -> Column:
            return (1 - damping) * F.col(seed) + damping * (F.coalesce(gain, F.lit(0.0)) + lost * F.col(seed))

        new = seeds.join(moved, "host", "left").select("host", rank("s_trust", "t", lost_t).alias("trust"), rank("s_distrust", "d", lost_d).alias("distrust"))
        new = saved(new)
        old = state.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        change = new.join(old, "host").agg(F.sum(F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0")))).first()[0] or 0.0
        state = new
        if change < close:
            return state


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, close: float = CLOSE, **how) -> DataFrame:
    """(key, host, path, rule, verdict) for each row of ``pages``.

    ``rules``: pairs (verdict, rule), or a table with these columns.

    rule: the longest that fits, else null; verdict: the rule's, else ``block`` or ``allow`` by
    the host's trust and distrust.

    A null url, or one without ``://``, has an empty host and path, no rule, and is allowed, as are all
    hosts without distrust. Null html has no links. Repeated rows count each and get the
    same verdict; urls and html may be very long; an empty table gives an empty result. Other
    columns are not read.
    """
    own = pages.select(F.col(key).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"))
    if isinstance(rules, DataFrame) or len(rules) > CHAIN:
        own = rules_found(own, rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, rule string"))
    else:
        own = own.withColumn("found", rule_for("host", "path", rules))
    by_host = own.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("found.verdict") == "allow").alias("good"), F.count_if(F.col("found.verdict") == "block").alias("bad"))
    hosts = saved(by_host)
    total = float(hosts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]) or 1.0
    ranks = propagate(hosts, saved(host_edges(pages, url, html)), close=min(1e-6, close / total), **how)
    # a margin relative to each side: sums differ in their last digits from run to run, whatever the size of the shares
    over = lambda side: F.col("distrust") > side * (1 + MARGIN)
    bad = ranks.join(hosts, "host").where((F.col("distrust") > 0) & over(F.col("trust")) & over(F.col("pages") / total))
    blocked = saved(bad.select(F.col("host").alias("host_"), F.lit("block").alias("blocked")))
    out = join_checked(own, blocked, F.col("host") == F.col("host_"), "left")
    return out.select(F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "blocked", F.lit("allow")).alias("verdict"))
