"""URL filter: longest-rule verdicts, completed by trust and distrust that spread over the host link graph.

Rules. A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest fit
decides, and of two equally long ones the blocking one.

Method. Hosts that rules mostly allow are trusted seeds, hosts that rules mostly block are blocked seeds (more than half of
their pages). Trust is personalised PageRank from the trusted seeds along links; distrust runs from the blocked seeds
against the links, so a host that links to blocked ones gains it. A page without a rule gets its host's verdict: blocked
where distrust exceeds trust. Edges join different hosts and count once, however often they are linked.

Masses are whole numbers (shares are rounded down), so the result depends neither on order nor on engine, and a round that
changes nothing ends the loop exactly. DataFrame operations only.

Scale. Edges and degrees are built once; a round joins them to the masses and sums contributions map-side first, so a hub
host is combined before it is shuffled; each round's masses are written to the shared folder. Nothing but a
count and a checksum comes back to the driver. Seeds and verdicts are per host; joins back to pages are left to Spark
(measured before broadcast, skewed keys split).

Edge cases. A null url or one without '://' has empty host and path, fits no rule and is allowed. Null html has no links.
Repeated rows are judged alike; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link's host: the href attribute of any tag, absolute or protocol-relative.
LINK = r"""(?i)[ \t\r\n\f]href[ \t\r\n\f]*=[ \t\r\n\f]*["']?[ \t\r\n\f]*(?:https?:)?//([^/?#"' \t\r\n\f<>]+)"""
#: Whole units of mass shared by the seeds; percent that follows links; rounds at most.
UNITS, FOLLOW, ROUNDS = 10 ** 15, 85, 20


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ordered(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule as text, its verdict) or nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in reversed(ordered(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def ruled_pages(pages: DataFrame, rules) -> DataFrame:
    host, path = split_url(F.col("url"))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return df.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of different hosts."""
    host, _ = split_url(F.col("url"))
    links = pages.select(host.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    return (links.select("src", lower_ascii(F.col("dst")).alias("dst"))
            .filter((F.col("src") != "") & (F.col("src") != F.col("dst"))).distinct())


def seeds(ruled: DataFrame) -> DataFrame:
    """(host, t, d): what each seed is given per round, 15 % of its part of the units."""
    by_host = (ruled.groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("a"),
                                         F.count(F.when(F.col("ruled") == "block", 1)).alias("b")))
    marked = by_host.select("host", (2 * F.col("a") > F.col("n")).alias("good"), (2 * F.col("b") > F.col("n")).alias("bad")).filter("good or bad")
    marked = stored(marked, "url-seeds")
    good, bad = marked.agg(F.count(F.when(F.col("good"), 1)), F.count(F.when(F.col("bad"), 1))).first()
    part = lambda n: UNITS // n * (100 - FOLLOW) // 100 if n else 0
    return marked.select("host", F.when(F.col("good"), F.lit(part(good))).otherwise(0).cast("long").alias("t"),
                         F.when(F.col("bad"), F.lit(part(bad))).otherwise(0).cast("long").alias("d"))


def spread(seed: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, t, d) after the given rounds, or at the first round that changes nothing."""
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    into = edges.groupBy("dst").agg(F.count("*").alias("into"))
    edges = stored(edges.join(out, "src").join(into, "dst"), "url-edges")
    state, mark = seed, None
    for _ in range(rounds):
        trust = (edges.join(state.withColumnRenamed("host", "src"), "src")
                 .select(F.col("dst").alias("host"), F.expr(f"(t * {FOLLOW}) div (100 * out)").alias("t"), F.lit(0).cast("long").alias("d")))
        doubt = (edges.join(state.withColumnRenamed("host", "dst"), "dst")
                 .select(F.col("src").alias("host"), F.lit(0).cast("long").alias("t"), F.expr(f"(d * {FOLLOW}) div (100 * into)").alias("d")))
        state = stored(seed.unionByName(trust).unionByName(doubt).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "url-mass")
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("host", "t", "d"))).first()
        if now == mark:
            break
        mark = now
    return state


def judge_pages(pages: DataFrame, rules=None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rules = RULES if rules is None else rules
    ruled = ruled_pages(pages, rules)
    blocked = spread(seeds(ruled), host_edges(pages)).filter("d > t").select("host", F.lit("block").alias("spread"))
    return (ruled.join(blocked, "host", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict")))


def oracle_sql(rules=None, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``judge_pages`` over the table ``pages``."""
    rules = ordered(RULES if rules is None else rules)
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    name = " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    rest = "coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '')"
    link = LINK.replace("'", "''")
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    steps = ""
    for k in range(rounds):
        steps += f""",
m{k + 1} AS MATERIALIZED (SELECT host, sum(t)::BIGINT AS t, sum(d)::BIGINT AS d FROM (
  SELECT host, t, d FROM m0
  UNION ALL SELECT dst, (t * {FOLLOW}) // (100 * o), 0 FROM e JOIN m{k} ON src = host
  UNION ALL SELECT src, 0, (d * {FOLLOW}) // (100 * i) FROM e JOIN m{k} ON dst = host) GROUP BY host)"""
    return f"""
WITH u AS (SELECT page_id, html, {host} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT page_id, host, path, CASE {name} END AS rule, CASE {verdict} END AS ruled FROM u),
l AS (SELECT DISTINCT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM u WHERE host <> ''),
e AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS o, count(*) OVER (PARTITION BY dst) AS i FROM l WHERE src <> dst),
h AS (SELECT host, 2 * count(*) FILTER (ruled = 'allow') > count(*) AS good, 2 * count(*) FILTER (ruled = 'block') > count(*) AS bad FROM r GROUP BY host),
n AS (SELECT count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM h),
m0 AS MATERIALIZED (SELECT host, CASE WHEN good THEN ({UNITS} // g) * {100 - FOLLOW} // 100 ELSE 0 END::BIGINT AS t,
       CASE WHEN bad THEN ({UNITS} // b) * {100 - FOLLOW} // 100 ELSE 0 END::BIGINT AS d FROM h, n WHERE good OR bad){steps}
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN d > t THEN 'block' END, 'allow') AS verdict
FROM r LEFT JOIN m{rounds} m ON r.host = m.host
"""
