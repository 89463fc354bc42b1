"""Queries over change history."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import churn as ch
from codefacts.plans import adapters as ad
from codefacts.plans.registry import query

#: last day of the change history of the adapter; windows end there
AS_OF = "1998-09-02"

_CHANGES = """
with ch as (select l_returnflag as repo, 'src/p' || l_partkey || '.py' as path, l_quantity::int as added,
  l_linenumber as deleted, l_shipdate::date as day from lineitem),
sz as (select 'src/p' || p_partkey || '.py' as path, p_size as loc, p_brand as brand from part),
churn as (select repo, path, count(*) as churn, sum(added)::bigint as added_lines from ch group by all),
spots as (select repo, path, churn, added_lines, loc::bigint as loc, brand as "group",
  round_even(churn * sqrt(greatest(loc, 1)) / 10, 1) as score, churn >= 5 and loc >= 25 as high_risk
  from churn join sz using (path))
"""


def _spots(spark, sf):
    churn = ch.churn_per_file(ch.relevant_changes(ad.line_changes(spark, sf)))
    return ch.hotspots(churn, ad.part_sizes(spark, sf), high_loc=25, group=F.col("brand"), on=("path",))


@query("churn_per_file", "D15 A4 B7", _CHANGES + "select * from churn")
def churn_per_file(spark, sf):
    return ch.churn_per_file(ch.relevant_changes(ad.line_changes(spark, sf)))


@query("hotspot_scores", "D16 E1", _CHANGES + "select * from spots")
def hotspot_scores(spark, sf):
    return _spots(spark, sf)


@query(
    "hotspot_files",
    "G1 D16 E1 F1",
    _CHANGES + "select * from (select *, row_number() over (partition by repo order by churn desc, loc desc, path) as rank from spots) where rank <= 20",
)
def hotspot_files(spark, sf):
    return ch.top_hotspots(_spots(spark, sf))


@query(
    "hotspot_groups",
    "D17 B10",
    _CHANGES + """select * from (select *, row_number() over (partition by repo order by churn desc, "group") as rank from (
    select repo, "group", sum(churn)::bigint as churn, sum(added_lines)::bigint as added_lines, sum(loc)::bigint as loc,
    count(*) as files, count(*) filter (high_risk) as high_risk_files from spots group by all)) where rank <= 12""",
)
def hotspot_groups(spark, sf):
    return ch.hotspot_groups(_spots(spark, sf))


@query(
    "churn_daily",
    "D15 K1",
    _CHANGES + """select repo, path, day, count(*) as n, sum(added)::bigint as added, sum(deleted)::bigint as deleted
    from ch group by all""",
)
def churn_daily(spark, sf):
    return ch.churn_daily(ad.line_changes(spark, sf))


@query(
    "rolling_churn_90_days",
    "F7",
    _CHANGES + """, d as (select repo, path, day, count(*) as n, sum(added) as added from ch group by all)
    select repo, path, day, sum(n) over w::bigint as churn, sum(added) over w::bigint as added_lines from d
    window w as (partition by repo, path order by day range between interval 89 days preceding and current row)""",
)
def rolling_churn_90_days(spark, sf):
    return ch.rolling_churn(ch.churn_daily(ad.line_changes(spark, sf)))


@query(
    "churn_window_advance",
    "F7 U6",
    _CHANGES + """select repo, path, count(*) as churn, sum(added)::bigint as added_lines from ch
    where day > date '1998-09-02' - 90 and day <= date '1998-09-02' group by all""",
)
def churn_window_advance(spark, sf):
    """The window of yesterday's report, minus the day that slid out, plus today."""
    changes = ad.line_changes(spark, sf)
    today = F.lit(AS_OF).cast("date")
    yesterday = F.date_sub(today, 7)
    day = F.to_date("ts")
    state = ch.churn_per_file(changes.where(ch.in_window("ts", yesterday)))
    entering = ch.churn_per_file(changes.where((day > yesterday) & (day <= today)))
    gone = (day > F.date_sub(yesterday, 90)) & (day <= F.date_sub(today, 90))
    return ch.advance_churn(state, entering, ch.churn_per_file(changes.where(gone)))


_COMMITS = """
with c as (select o_orderpriority as repo, o_orderkey::varchar as sha, 'c' || o_custkey as author, o_orderdate as ts from orders),
n as (select o_orderpriority as repo, l_orderkey::varchar as sha, 'src/p' || l_partkey || '.py' as path,
  l_quantity::int as added, l_linenumber as deleted from lineitem join orders on l_orderkey = o_orderkey),
p as (select repo, sha, count(*) as files_changed, sum(added)::bigint as additions, sum(deleted)::bigint as deletions from n group by all),
cc as (select c.*, coalesce(files_changed, 0) as files_changed, coalesce(additions, 0) as additions, coalesce(deletions, 0) as deletions
  from c left join p using (repo, sha))
"""


@query("commit_changes", "D18", _COMMITS + "select repo, sha, files_changed, additions, deletions from cc")
def commit_changes(spark, sf):
    changes = ch.commit_changes(ad.order_commits(spark, sf), ad.order_changes(spark, sf))
    return changes.select("repo", "sha", "files_changed", "additions", "deletions")


@query(
    "commit_summary",
    "D18 D37",
    _COMMITS + """select repo, count(*) as total_commits, max(ts) as latest, min(ts) as earliest,
    sum(additions)::bigint as total_additions, sum(deletions)::bigint as total_deletions from cc group by repo""",
)
def commit_summary(spark, sf):
    return ch.commit_summary(ch.commit_changes(ad.order_commits(spark, sf), ad.order_changes(spark, sf)))


@query(
    "commit_authors",
    "D18 D19 F10",
    _COMMITS + """select repo, author, commits, share_pct, rank from (select repo, author, count(*) as commits,
    round_even(count(*) * 100 / sum(count(*)) over (partition by repo), 1) as share_pct,
    row_number() over (partition by repo order by count(*) desc, author) as rank from c group by repo, author) where rank <= 10""",
)
def commit_authors(spark, sf):
    return ch.commit_authors(ad.order_commits(spark, sf))


@query(
    "commit_files_by_author",
    "D18",
    _COMMITS + """select * from (select repo, path, count(*) as commits, row_number() over (partition by repo order by count(*) desc, path) as rank
    from n where (repo, sha) in (select repo, sha from c where regexp_matches(author || ' <' || author || '@example.org>', 'c\\d*7@')
    and ts::date > date '1998-08-02' - 365 and ts::date <= date '1998-08-02') group by repo, path) where rank <= 20""",
)
def commit_files_by_author(spark, sf):
    picked = ch.select_commits(
        ad.order_commits(spark, sf), as_of=F.lit("1998-08-02").cast("date"), since_days=365, author=r"c\d*7@"
    )
    return ch.commit_files(picked, ad.order_changes(spark, sf))


@query(
    "newest_commits",
    "D18 F1",
    _COMMITS + """select repo, sha, author as author_name, ts from (select *, row_number() over (partition by repo order by ts desc, sha) as r from c) where r <= 50""",
)
def newest_commits(spark, sf):
    return ch.select_commits(ad.order_commits(spark, sf), newest=50).select("repo", "sha", "author_name", "ts")


@query(
    "growth_by_file",
    "D20 G9",
    _CHANGES + """select * from (select repo, path, sum(added)::bigint as added, sum(deleted)::bigint as deleted,
    (sum(added) - sum(deleted))::bigint as net, row_number() over (partition by repo order by sum(added) - sum(deleted) desc, path) as rank
    from ch group by repo, path having sum(added) > sum(deleted)) where rank <= 15""",
)
def growth_by_file(spark, sf):
    return ch.growth_files(ad.line_changes(spark, sf))


@query(
    "growth_by_component",
    "D20 B10 G9",
    """select *, row_number() over (partition by repo order by net desc, "group") as rank from (
    select o_orderpriority as repo, 'plugins/' || p_brand as "group", sum(l_quantity::int)::bigint as added,
    sum(l_linenumber)::bigint as deleted, (sum(l_quantity::int) - sum(l_linenumber))::bigint as net
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2)
    qualify rank <= 15""",
)
def growth_by_component(spark, sf):
    parts = ad.part_sizes(spark, sf).select("path", "brand")
    changes = ad.order_changes(spark, sf).join(parts, "path")
    below = changes.withColumn("path", F.concat(F.lit("plugins/"), "brand", F.lit("/"), "path"))
    return ch.growth(below, by="component")


@query(
    "bar_scaling",
    "F11",
    _CHANGES + """, g as (select repo, "group", sum(churn)::bigint as churn from spots group by all)
    select repo, "group", churn, round(churn / max(churn) over (partition by repo), 4) as bar from g""",
)
def bar_scaling(spark, sf):
    groups = ch.hotspot_groups(_spots(spark, sf), k=None).select("repo", "group", "churn")
    return ch.scaled_bars(groups, ["repo"], "churn")
