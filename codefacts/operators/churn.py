"""Change history: churn, hotspots, commit statistics, growth attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions import paths
from codefacts.functions.ranking import top_k
from codefacts.operators.overview import churn_relevant
from codefacts.profile import CHURN_DAYS, HIGH_CHURN, HIGH_LOC, Profile


def relevant_changes(numstat: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Keep text changes (binary ones have no counts) of files that count."""
    return numstat.where(F.col("added").isNotNull() & churn_relevant("path", profile))


def churn_daily(numstat: DataFrame) -> DataFrame:
    """Partial sums per file and day. Every churn question is answered from this table."""
    return numstat.groupBy("repo", "path", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted")
    )


def in_window(ts: Column | str, as_of: Column, days: int = CHURN_DAYS) -> Column:
    """Rows whose day lies in the ``days`` days that end with ``as_of``."""
    day = F.to_date(paths._c(ts))
    return (day > F.date_sub(as_of, days)) & (day <= as_of)


def churn_per_file(numstat: DataFrame) -> DataFrame:
    """Change count and added lines per file."""
    return numstat.groupBy("repo", "path").agg(F.count("*").alias("churn"), F.sum("added").alias("added_lines"))


def rolling_churn(daily: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    """for each file and active day, the sums over the ``days`` days that end there.

    The frame runs over daily partial sums, so a window partition holds one row per active day of one file.
    """
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy("repo", "path").orderBy(number).rangeBetween(-(days - 1), 0)
    return daily.select(
        "repo", "path", "day", F.sum("n").over(frame).alias("churn"), F.sum("added").over(frame).alias("added_lines")
    )


def advance_churn(state: DataFrame, entering: DataFrame, leaving: DataFrame) -> DataFrame:
    """``(state - leaving) + entering`` as one sum of signed rows; files that fall to zero disappear."""

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(
            "repo", "path", (F.col("churn") * sign).alias("churn"), (F.col("added_lines") * sign).alias("added_lines")
        )

    rows = signed(state, 1).unionByName(signed(entering, 1)).unionByName(signed(leaving, -1))
    merged = rows.groupBy("repo", "path").agg(F.sum("churn").alias("churn"), F.sum("added_lines").alias("added_lines"))
    return merged.where("churn > 0").withColumn("added_lines", F.greatest("added_lines", F.lit(0).cast("long")))


def hotspots(
    churn: DataFrame,
    locs: DataFrame,
    profile: Profile = Profile(),
    high_churn: int = HIGH_CHURN,
    high_loc: int = HIGH_LOC,
    group: Column | None = None,
    on: tuple[str, ...] = ("repo", "path"),
) -> DataFrame:
    """Churn joined with the current size of files that still exist, scored and flagged.

    ``score = round_half_even(churn * sqrt(max(loc, 1)) / 10, 1)``. ``group`` may use any column of ``locs``.
    """
    joined = churn.join(locs, list(on))
    score = F.bround(F.col("churn") * F.sqrt(F.greatest("loc", F.lit(1))) / 10, 1)
    risky = (F.col("churn") >= high_churn) & (F.col("loc") >= high_loc)
    key = paths.hotspot_group("path", profile.component_dir) if group is None else group
    return joined.select(
        "repo", "path", "churn", "added_lines", F.col("loc").cast("long").alias("loc"),
        score.alias("score"), risky.alias("high_risk"), key.alias("group"),
    )


def top_hotspots(spots: DataFrame, k: int = 20) -> DataFrame:
    """G1: most changed files per repository, larger files first on ties, path last."""
    return top_k(spots, ["repo"], [F.desc("churn"), F.desc("loc"), F.col("path")], k)


def hotspot_groups(spots: DataFrame, k: int | None = 12) -> DataFrame:
    """Churn, size and risk per component or module."""
    sums = spots.groupBy("repo", "group").agg(
        F.sum("churn").alias("churn"),
        F.sum("added_lines").alias("added_lines"),
        F.sum("loc").alias("loc"),
        F.count("*").alias("files"),
        F.count_if("high_risk").alias("high_risk_files"),
    )
    return sums if k is None else top_k(sums, ["repo"], [F.desc("churn"), F.col("group")], k)


def select_commits(
    commits: DataFrame,
    as_of: Column | None = None,
    since_days: int | None = None,
    author: str | None = None,
    newest: int | None = None,
) -> DataFrame:
    """Commits in a window, by author regex on ``Name <email>``, or the newest N of each repository."""
    if since_days is not None and as_of is not None:
        commits = commits.where(in_window("ts", as_of, since_days))
    if author:
        who = F.concat("author_name", F.lit(" <"), F.coalesce("author_email", F.lit("")), F.lit(">"))
        commits = commits.where(F.rlike(who, F.lit(author)))
    if newest is not None:
        commits = top_k(commits, ["repo"], [F.desc("ts"), F.col("sha")], newest, rank_col=None)
    return commits


def commit_changes(commits: DataFrame, numstat: DataFrame) -> DataFrame:
    """Per commit, changed files and line sums; binary changes count as files with no lines."""
    per_commit = numstat.groupBy("repo", "sha").agg(
        F.count("*").alias("files_changed"),
        F.sum(F.coalesce("added", F.lit(0))).alias("additions"),
        F.sum(F.coalesce("deleted", F.lit(0))).alias("deletions"),
    )
    zero = F.lit(0).cast("long")
    joined = commits.join(per_commit, ["repo", "sha"], "left")
    for name in ("files_changed", "additions", "deletions"):
        joined = joined.withColumn(name, F.coalesce(name, zero))
    return joined


def commit_summary(changes: DataFrame) -> DataFrame:
    """Totals and date range per repository."""
    return changes.groupBy("repo").agg(
        F.count("*").alias("total_commits"),
        F.max("ts").alias("latest"),
        F.min("ts").alias("earliest"),
        F.sum("additions").alias("total_additions"),
        F.sum("deletions").alias("total_deletions"),
    )


def commit_authors(commits: DataFrame, k: int | None = 10) -> DataFrame:
    """Commits per author and their share in percent.

    The total is a second aggregate of the per-author counts joined on ``repo``; no window gathers a repository.
    """
    counts = commits.groupBy("repo", F.col("author_name").alias("author")).agg(F.count("*").alias("commits"))
    total = counts.groupBy("repo").agg(F.sum("commits").alias("total"))
    head = counts if k is None else top_k(counts, ["repo"], [F.desc("commits"), F.col("author")], k)
    share = F.bround(F.col("commits") * 100 / F.col("total"), 1)
    return head.join(total, "repo").withColumn("share_pct", share).drop("total")


def commit_files(commits: DataFrame, numstat: DataFrame, k: int = 20) -> DataFrame:
    """Files touched by most of the selected commits."""
    touched = numstat.join(commits.select("repo", "sha"), ["repo", "sha"], "left_semi")
    counts = touched.groupBy("repo", "path").agg(F.count("*").alias("commits"))
    return top_k(counts, ["repo"], [F.desc("commits"), F.col("path")], k)


def growth(numstat: DataFrame, by: str = "dir", k: int = 15, component_dir: str = "plugins") -> DataFrame:
    """Added, deleted and net lines per group, most growth first.

    Summed from commit statistics; on a linear history the net equals a two-tree diff.
    """
    key = paths.churn_group("path", by, component_dir)
    sums = _net(numstat.groupBy("repo", key.alias("group")))
    return top_k(sums, ["repo"], [F.desc("net"), F.col("group")], k)


def growth_files(numstat: DataFrame, k: int = 15) -> DataFrame:
    """The files that grew most; only positive growth is listed."""
    sums = _net(numstat.groupBy("repo", "path")).where("net > 0")
    return top_k(sums, ["repo"], [F.desc("net"), F.col("path")], k)


def _net(grouped) -> DataFrame:
    sums = grouped.agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return sums.withColumn("net", F.col("added") - F.col("deleted"))


def scaled_bars(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """a value divided by the largest of its group (0 when that is not positive)."""
    top = df.groupBy(*by).agg(F.max(value).alias("__max"))
    ratio = F.when(F.col("__max") > 0, F.col(value) / F.col("__max")).otherwise(F.lit(0.0))
    return df.join(top, by).withColumn("bar", F.round(ratio, 4)).drop("__max")


def merge_risk(behind: Column | str) -> Column:
    """Grade from the number of commits a branch is behind."""
    n = paths._c(behind)
    return F.when(n > 20, "high").when(n > 5, "medium").otherwise("low")
