"""URL filters: rules indexed by their rarest literal token, run only on URLs that hold it."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorium.llm.base import Scratch, pick
from sensorium.session import small_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name`` and verdict; ``pattern`` is searched in ``host?path``; ``tokens`` are literals that every match holds.

    Neither a host nor a path holds a question mark, so it tells them apart whatever else they hold.
    A token is a run of letters and digits of the host or path that stands complete
    between other characters. Named rules beat nameless ones, then the longer wins.
    """

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    name: str | None = None
    strength: int = 0


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains if the path starts with ``path``."""
    if not re.findall(r"[0-9a-z]+", host):
        raise ValueError("a prefix rule needs a host")
    # the last run of the path may go on in the URL, so it is no complete token
    whole = re.findall(r"[0-9a-z]+(?=[^0-9a-z])", path)
    pattern = rf"^(?:[^?]*\.)?{re.escape(host)}\?{re.escape(path)}"
    return Rule(verdict, pattern, tuple(re.findall(r"[0-9a-z]+", host) + whole), host + path, 1_000_000 + len(host + path))


def word_rule(verdict: str, *words: str) -> Rule:
    """Fits hosts with all these complete words in this order, side by side."""
    pattern = r"^(?:[^?]*[^0-9a-z?])?" + "[^0-9a-z?]".join(map(re.escape, words)) + r"(?:[^0-9a-z?][^?]*)?\?"
    return Rule(verdict, pattern, words, None, len("".join(words)))


#: Hosts that are filtered where no named rule speaks.
DEFAULT_RULES = (
    word_rule("block", "casino"), word_rule("block", "poker"), word_rule("block", "pills"), word_rule("block", "viagra"), word_rule("block", "spam"),
    word_rule("block", "free", "bets"), word_rule("block", "porn"), word_rule("block", "xxx"), word_rule("block", "ads"), word_rule("block", "adserver"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url_column: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` columns and ``host, path, rule, verdict`` of every row.

    Each rule is filed under that of its tokens which fewest different URLs hold, so a
    common token such as ``com`` fetches no rule that has a rarer one. Different URLs are
    judged once, whatever their number of rows. No rule: ``default`` and a null rule; null
    URLs and those without ``://`` have empty host and path and take the default too.
    Equal strengths go to the smaller name, then the smaller pattern. Rows of ``pages`` are
    neither dropped nor repeated; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    host, path = host_and_path(F.col("url"))
    rows = pick(pages, url=url_column, **{f"k{i}": c for i, c in enumerate(keep)}).withColumns({"host": host, "path": path})
    places = scratch.keep(
        rows.select("host", "path").distinct().withColumn("line", F.concat_ws("?", "host", "path"))
        .withColumn("tokens", F.array_distinct(F.regexp_extract_all("line", F.lit("([0-9a-z]+)"))))
    )
    index = _filed(spark, scratch, places, rules)
    fetched = places.select("host", "path", "line", F.explode("tokens").alias("token"))
    fetched = fetched.join(F.broadcast(index) if len(rules) <= small_rows(spark) else index, "token")
    hits = fetched.filter(F.expr("regexp_like(line, pattern)"))
    best = F.min(F.struct(F.negative("strength").alias("weak"), F.coalesce("name", F.lit("")), "pattern", F.struct("name", "verdict").alias("rule"))).alias("best")
    found = scratch.keep(hits.groupBy("host", "path").agg(best).select("host", "path", "best.rule.name", "best.rule.verdict"))
    out = rows.join(found, ["host", "path"], "left")
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("name").alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def _filed(spark: SparkSession, scratch: Scratch, places: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rules as a table, each with the rarest of its tokens among the URLs."""
    kind = "no int, verdict string, pattern string, tokens array<string>, name string, strength int"
    table = spark.createDataFrame([(i, r.verdict, r.pattern, list(r.tokens), r.name, r.strength) for i, r in enumerate(rules)], kind)
    wanted = table.select("no", F.explode("tokens").alias("token"))
    named = wanted.select("token").distinct()
    named = F.broadcast(named) if sum(len(r.tokens) for r in rules) <= small_rows(spark) else named
    held = places.select(F.explode("tokens").alias("token")).join(named, "token").groupBy("token").agg(F.count("*").alias("urls"))
    rank = F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), F.length("token") * -1, "token")).alias("rarest")
    chosen = wanted.join(held, "token", "left").groupBy("no").agg(rank).select("no", "rarest.token")
    return scratch.keep(table.join(chosen, "no").select("token", "verdict", "pattern", "name", "strength"))
