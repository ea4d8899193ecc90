"""URL filters: host and path rules, and trust propagated over the link graph, in DataFrame functions only.

Method: hosts whose pages the rules mostly allow are trusted seeds, hosts whose pages they mostly block are blocked seeds. Trust
flows from trusted seeds along host edges (personalised PageRank), distrust from blocked seeds along reversed edges, so that
hosts that link to blocked ones are suspected. Trust and distrust each sum to 1 over all hosts, however many seeds there are. A
host is blocked where its distrust exceeds its trust and a threshold, which is a share of what one blocked seed restarts with, so
it means the same for any number of seeds. Pages that a rule fits keep the rule's verdict; the others get their host's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sharing import removed, written

#: The production rules: (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Absolute and protocol-relative links; relative ones stay on the host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>\\]+)"""
#: Hosts up to which the blocked ones may be broadcast.
BROADCAST_HOSTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a scheme or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits a url and its verdict, both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, prefix = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + prefix))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts, from columns host and html."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER)))
    found = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    return found.where("dst <> src and dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, cut: int = 5, tolerance: float = 1e-9) -> DataFrame:
    """(kind, host, rank) after ``rounds`` of personalised PageRank for each kind of edges (kind, src, dst) and seeds (kind, host).

    Each kind's ranks sum to 1: its seeds restart with equal shares of what no edge carries on, which is 1 - damping and the
    damped ranks of hosts without links onward. Every round is a written table; the loop ends early where no rank moved by more
    than ``tolerance`` over ``cut`` rounds, and at once without edges.
    """
    out = edges.groupBy("kind", "src").agg((F.lit(1.0) / F.count("*")).alias("share"))
    weighted = written(edges.join(out, ["kind", "src"]), "edges")
    n = seeds.groupBy("kind").agg((F.lit(1.0) / F.count("*")).alias("rank"))
    base = written(seeds.select("kind", "host").join(F.broadcast(n), "kind"), "seeds")  # n: a row a kind
    ranks = last = base
    for i in range(1, rounds + 1 if weighted.limit(1).count() else 0):
        moved = weighted.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank"))
        moved = written(moved, "moved")
        left = moved.groupBy("kind").agg((1 - F.sum("rank")).alias("left"))
        restart = base.join(F.broadcast(left), "kind", "left").select("kind", "host", (F.col("rank") * F.coalesce("left", F.lit(1.0))).alias("rank"))
        new = written(restart.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "ranks")
        removed(moved, *([ranks] if ranks is not last else []))
        ranks = new
        if i % cut == 0:
            change = last.select("kind", "host", (-F.col("rank")).alias("rank")).unionByName(ranks).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("d")).agg(F.max("d")).first()[0]
            if change is None or change <= tolerance:
                break
            removed(*([last] if last is not base else []))
            last = ranks
    return ranks


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, least: float = 0.001, damping: float = 0.85, rounds: int = 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    A page without a fitting rule is blocked where its host's distrust is over its trust and over ``least`` times the distrust that
    a blocked seed restarts with, else allowed.
    Null urls, and those without a scheme, have an empty host and path, fit no rule and are allowed. Null html has no links.
    Repeated rows and ids stay. Other columns are ignored. An empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), F.col(html_col).alias("html"))
    host, path = split_url(F.col("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "html")
    edges = written(host_edges(rows), "links")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    hosts = rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    kind = F.when(2 * F.col("a") > F.col("n"), "trust").when(2 * F.col("b") > F.col("n"), "distrust")
    seeds = hosts.select(kind.alias("kind"), "host").where("kind is not null")
    seeds = written(seeds, "kinds")
    ranks = propagate(both, seeds, damping, rounds)
    bar = least / max(1, seeds.where("kind = 'distrust'").count())
    score = ranks.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    blocked = written(score.where((F.col("distrust") > bar) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias("of")), "blocked")
    if blocked.count() <= BROADCAST_HOSTS:
        blocked = F.broadcast(blocked)
    judged = rows.drop("html").join(blocked, F.col("host") == F.col("of"), "left")
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(F.col("of").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def oracle(rounds: int = 20) -> str:
    """The same in SQL for DuckDB, its rounds written out."""
    fits = " ".join(
        f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{{{i}}}'" for i, (k, t) in sorted(enumerate(RULES), key=lambda r: (-len(r[1][1]), r[1][1]))
    )
    rule = "CASE " + fits.format(*(t for _, t in RULES)) + " END"
    verdict = "CASE " + fits.format(*(k for k, _ in RULES)) + " END"
    steps = ", ".join(
        f"m{i} AS MATERIALIZED (SELECT w.kind, w.dst AS host, sum(r.rank * w.share) * 0.85 AS rank FROM w JOIN r{i - 1} r ON w.kind = r.kind AND w.src = r.host GROUP BY w.kind, w.dst), "
        f"r{i} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT kind, host, rank * coalesce(1 - s, 1) AS rank FROM r0 LEFT JOIN (SELECT kind, sum(rank) AS s FROM m{i} GROUP BY kind) USING (kind) UNION ALL SELECT * FROM m{i}) GROUP BY kind, host)"
        for i in range(1, rounds + 1)
    )
    link = LINK.replace("'", "''")
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
p AS MATERIALIZED (SELECT page_id, html, host, path, {rule} AS rule, {verdict} AS verdict FROM s),
l AS (SELECT DISTINCT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM p WHERE host <> ''),
e AS (SELECT * FROM l WHERE src <> dst AND dst <> ''),
k AS (SELECT 'trust' AS kind, src, dst FROM e UNION ALL SELECT 'distrust', dst, src FROM e),
w AS MATERIALIZED (SELECT kind, src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind, src) AS share FROM k),
h AS (SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM p WHERE host <> '' GROUP BY host),
r0 AS MATERIALIZED (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS rank FROM (SELECT CASE WHEN 2 * a > n THEN 'trust' ELSE 'distrust' END AS kind, host FROM h WHERE 2 * a > n OR 2 * b > n)),
{steps},
b AS (SELECT host FROM r{rounds} GROUP BY host HAVING coalesce(sum(rank) FILTER (kind = 'distrust'), 0) > greatest(0.001 / greatest(1, (SELECT count(*) FROM r0 WHERE kind = 'distrust')), coalesce(sum(rank) FILTER (kind = 'trust'), 0)))
SELECT page_id, p.host, path, rule, coalesce(verdict, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM p LEFT JOIN b ON p.host = b.host"""
