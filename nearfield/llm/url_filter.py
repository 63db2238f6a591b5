"""URL filter: host and path rules first, then trust and distrust that flow over the link graph of hosts.

Rules decide the pages they fit (longest rule wins).  For the other pages, a personalised PageRank runs over
host edges from trusted seeds (hosts with pages that a rule allows) and one over the reversed edges from
blocked seeds (hosts with pages that a rule blocks): trust follows links, distrust goes back to those who
link.  A host whose distrust exceeds ``ratio`` times its trust is blocked, any other allowed.  All steps are
DataFrame functions.

Scores are whole numbers (a total of ``FINE_MASS``; a link passes score * n / out, rounded down once), so that
sums do not depend on the order of rows and a retried task gives the same scores.  Both walks run as one join and one aggregation per step,
keyed by (walk, host); host edges are aggregated before they shuffle, so a host with a third of the pages
adds one partial row per task and pair.  Mass on a host without links is dropped.

A walk ends where a step changes no score, or where what its later steps could still move, ``keep_percent`` to
the power of the steps, is below ``tolerance`` of all mass; either way the number of steps follows from the
links and the tolerance, not from the size of the table.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed;
null html has no links; a page without a scheme in a link links to its own host; repeated rows are judged
alike; an empty table gives no rows; other columns are carried only where asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import ascii_lower, materialize

#: Total score, and parts of a share, of walks with rounded shares; total score of those with exact ones.
MASS, PARTS, FINE_MASS = 10**12, 10**6, 10**18
#: Part of all mass that a walk may leave unmoved.
TOLERANCE = 0.001
#: Steps of a walk between two written tables.
STRETCH = 6
#: More rules than this belong in a table that is joined, not in an expression.
MAX_RULES = 1000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts, counted; a relative link is one to the page's own host."""
    links = pages.filter("host <> ''").select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'>\s]+)"""), F.lit(1))).alias("link"))
    absolute = F.regexp_extract("link", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return links.select(F.col("host").alias("src"), F.when(absolute == "", F.col("host")).otherwise(ascii_lower(absolute)).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def steps_of(tolerance: float, keep_percent: int) -> int:
    """Steps after which less than ``tolerance`` of all mass can still move."""
    return math.ceil(math.log(tolerance) / math.log(keep_percent / 100))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int, keep_percent: int, parts: int | None = PARTS) -> DataFrame:
    """(walk, host, score) after ``steps`` steps; seeds: (walk, host, n), walk ``trust`` or ``distrust``.

    Steps that would change no score are left out.

    parts: shares of links are rounded down to so many parts of a total of ``MASS``, so that a link with less
    than one part passes nothing; None: shares are exact, of a total of ``FINE_MASS``.
    """
    both = edges.select(F.lit("trust").alias("walk"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    out = both.groupBy("walk", "host").agg(F.sum("n").alias("out"))
    totals = seeds.groupBy("walk").agg(F.sum("n").alias("total"))
    if parts:
        share, seed = [F.floor(parts * (F.col("n") / F.col("out"))).cast("long").alias("share")], F.floor(F.lit(float(MASS)) * (F.col("n") / F.col("total"))).cast("long")
        first, passed = f"seed * {100 - keep_percent} div 100", f"(score * share div {parts}) * {keep_percent} div 100"
    else:  # products of up to 38 digits
        share, seed = ["n", "out"], F.expr(f"cast(n AS decimal(19, 0)) * cast({FINE_MASS} AS decimal(19, 0)) div total")
        first, passed = f"cast(seed AS decimal(19, 0)) * {100 - keep_percent} div 100", f"cast(score AS decimal(19, 0)) * cast(n * {keep_percent} AS decimal(18, 0)) div (cast(out AS decimal(18, 0)) * 100)"
    shares = materialize(both.join(out, ["walk", "host"]).select("walk", "host", "to", *share), "url-shares")
    start = materialize(seeds.join(totals, "walk").select("walk", "host", seed.alias("seed")), "url-seeds")
    base = start.select("walk", "host", F.expr(first).alias("score"))
    scores = start.select("walk", "host", F.col("seed").alias("score"))
    for i in range(1, steps + 1):
        moved = scores.join(shares, ["walk", "host"]).select("walk", F.col("to").alias("host"), F.expr(passed).alias("score"))
        parted = moved.unionByName(base)
        if i % STRETCH:
            scores = parted.groupBy("walk", "host").agg(F.sum("score").alias("score"))
            continue
        both_steps = parted.withColumn("before", F.lit(0).cast("long")).unionByName(scores.select("walk", "host", F.lit(0).cast("long").alias("score"), F.col("score").alias("before")))
        step = materialize(both_steps.groupBy("walk", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")), f"url-scores-{i}")
        scores = step.select("walk", "host", "score")
        if step.filter("score <> before").isEmpty():
            break
    return scores


def judge(pages: DataFrame, rules: list[tuple[str, str]], tolerance: float = TOLERANCE, keep_percent: int = 85, ratio: int = 1, steps: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    rules: (``allow`` or ``block``, ``host/path``).  tolerance: part of all mass that the walks may leave
    unmoved.  steps: of the walks, instead.  keep_percent: of the mass that follows links in a step (the damping).  ratio: distrust above so many times the trust blocks a host.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    seeds = ruled.filter("ruled IS NOT NULL").groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("walk"), "host").agg(F.count(F.lit(1)).alias("n"))
    scores = propagate(materialize(host_edges(rows), "url-edges"), seeds, steps_of(tolerance, keep_percent) if steps is None else steps, keep_percent, parts=None)
    by_host = scores.groupBy("host").agg(F.sum(F.when(F.col("walk") == "trust", F.col("score")).otherwise(0)).alias("trust"), F.sum(F.when(F.col("walk") == "distrust", F.col("score")).otherwise(0)).alias("distrust"))
    blocked = by_host.filter(F.col("distrust") > F.col("trust").cast("decimal(19,0)") * ratio).select("host", F.lit(True).alias("bad"))
    return ruled.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
