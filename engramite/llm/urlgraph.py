"""URL filters: rules, and link-graph propagation for what no rule decides. DataFrame functions only.

A rule is (host, path, verdict). It fits its host and all subdomains if the path starts with its path; the longest
fitting rule decides. Hosts then form a graph: an edge for each host that another host's pages link to, weighted by its links.
Trust starts at hosts by the share of their pages that rules allow and follows links; distrust starts by the share that
rules block and follows links backwards. Both are personalised PageRank, to at most ``steps`` links away;
scores only grow from step to step, so the steps end early once their sum does not. A page without a
rule is blocked if its host's distrust exceeds its trust by that of a host of which over ``threshold`` of the pages are blocked.

Edges are summed per pair of hosts before they are joined, so their number is bounded by pairs of hosts, not by pages.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule and, as no host, no trust: it is allowed; null html has no
links; links within a host say nothing about it and are left out; pages that repeat are counted as often as they occur; without edges, the
seeds alone decide; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramite.llm.common import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
DEFAULT_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
STEPS, DAMPING, THRESHOLD = 60, 0.85, 0.5
#: Rules that are tested one by one within a page's row; longer lists are joined.
INLINE_RULES, SETTLED = 200, 1e-12


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_and_verdict(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Tests rules from the longest; of equally long ones the one with the longer host."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def fitting_rules(urls: DataFrame, rules) -> DataFrame:
    """(host, path, rule, by_rule) of the distinct urls(host, path) that a rule fits: each host's suffixes and each beginning of its path, of a
    length that rules have, meet the table of rules by equality. As many rows a url as it has suffixes and rules have lengths of path."""
    spark = urls.sparkSession
    table = spark.createDataFrame(sorted(rules), "h string, p string, v string")
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, p, _ in rules})])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keys = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("h"))
    keys = keys.select("host", "path", "h", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n")).select("host", "path", "h", F.substring("path", F.lit(1), F.col("n")).alias("p"))
    best = F.max(F.struct(F.length(F.concat("h", "p")).alias("n"), F.length("h").alias("m"), "h", "p", "v")).alias("best")
    return keys.join(table, ["h", "p"]).groupBy("host", "path").agg(best).select("host", "path", F.concat("best.h", "best.p").alias("rule"), F.col("best.v").alias("by_rule"))


def judged(pages: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """page_id, host, path, rule, by_rule. Both ways of testing rules give the same rows."""
    host, path = host_of(pages["url"]), path_of(pages["url"])
    found = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    if len(rules) > INLINE_RULES:
        return found.join(fitting_rules(found, rules), ["host", "path"], "left").select("page_id", "host", "path", "rule", "by_rule")
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another."""
    links = pages.select(host_of(pages["url"]).alias("src"), F.explode(F.regexp_extract_all(pages["html"], F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """seeds: (host, trust, distrust). Returns the same columns after propagation."""
    edges = materialize(edges, "edges")
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("w")), F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("w")))).alias("x"))
    start = materialize(start.select("x.kind", "host", (F.col("x.w") * (1 - damping)).alias("w")).where("w > 0"), "seeds")
    ranks = start
    if edges.limit(1).count():
        out = edges.groupBy("src").agg(F.sum("n").alias("total")).select("src", "total")
        into = edges.groupBy("dst").agg(F.sum("n").alias("total")).select("dst", "total")
        forward = edges.join(out, "src").select(F.lit(0).alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("n") / F.col("total") * damping).alias("share"))
        backward = edges.join(into, "dst").select(F.lit(1).alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), (F.col("n") / F.col("total") * damping).alias("share"))
        moves = materialize(forward.unionByName(backward), "moves")
        before = None
        for step in range(steps):
            flow = moves.join(ranks.withColumnRenamed("host", "from"), ["kind", "from"]).select("kind", F.col("to").alias("host"), (F.col("share") * F.col("w")).alias("w"))
            following = flow.unionByName(start).groupBy("kind", "host").agg(F.sum("w").alias("w"))
            if step % 4 == 3:
                following = materialize(following, "ranks")
                total = following.agg(F.sum("w")).first()[0] or 0.0
                if before is not None:
                    discard(ranks_before)
                    if total - before <= SETTLED * total:
                        ranks = following
                        break
                before, ranks_before = total, following
            ranks = following
        ranks = materialize(ranks, "ranks")
        discard(moves)
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("w")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("w")).otherwise(0.0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules=DEFAULT_RULES, steps: int = STEPS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict of each page."""
    rows = judged(pages, rules)
    seeds = rows.where("host <> ''").groupBy("host").agg(
        (F.count(F.when(F.col("by_rule") == "allow", 1)) / F.count("*")).alias("trust"), (F.count(F.when(F.col("by_rule") == "block", 1)) / F.count("*")).alias("distrust")
    )
    scores = propagate(host_edges(pages), seeds, steps, damping)
    bad = scores.where(F.round(F.col("distrust") - F.col("trust"), 9) > round(threshold * (1 - damping), 9)).select(F.col("host").alias("__host"))
    joined = rows.join(bad, rows["host"] == bad["__host"], "left")
    verdict = F.coalesce("by_rule", F.when(F.col("__host").isNotNull(), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _sql_values(rules) -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)


def oracle_sql(rules=DEFAULT_RULES, steps: int = STEPS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same by joins against a table of rules, the steps unrolled."""
    link = LINK.replace("'", "''")
    parts = [
        f"rules(h, p, v) AS (VALUES {_sql_values(rules)})",
        f"urls AS MATERIALIZED (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path, html FROM pages)",
        "fits AS (SELECT u.host, u.path, arg_max(h || p, (length(h || p), length(h))) AS rule, arg_max(v, (length(h || p), length(h))) AS by_rule FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY u.host, u.path)",
        "judged AS MATERIALIZED (SELECT page_id, host, path, rule, by_rule FROM urls LEFT JOIN fits USING (host, path))",
        f"links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM urls)",
        "edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)",
        f"""moves AS MATERIALIZED (SELECT 0 AS kind, src AS f, dst AS t, n / sum(n) OVER (PARTITION BY src) * {damping} AS share FROM edges
            UNION ALL SELECT 1, dst, src, n / sum(n) OVER (PARTITION BY dst) * {damping} FROM edges)""",
        f"""seeds AS MATERIALIZED (SELECT k AS kind, host, {1 - damping} * CASE k WHEN 0 THEN count(*) FILTER (by_rule = 'allow') ELSE count(*) FILTER (by_rule = 'block') END / count(*) AS w
            FROM judged, (VALUES (0), (1)) x(k) WHERE host <> '' GROUP BY k, host)""",
        "r0 AS (SELECT * FROM seeds)",
    ]
    for i in range(steps):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(w) AS w FROM (SELECT m.kind, m.t AS host, m.share * r.w AS w FROM moves m JOIN r{i} r ON m.kind = r.kind AND m.f = r.host UNION ALL SELECT kind, host, w FROM seeds) GROUP BY kind, host)")
    parts.append(f"bad AS (SELECT host FROM r{steps} GROUP BY host HAVING round(sum(CASE kind WHEN 1 THEN w ELSE -w END), 9) > {round(threshold * (1 - damping), 9)})")
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"
