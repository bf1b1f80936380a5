"""URL rules, fetched by their rarest literal token.

A rule is a host and a path prefix with a verdict. Its literal tokens are the labels of the host and
the segments of the path that stand between two slashes, each with its position counted from the
host's end or the path's start being left out: only the token itself. All urls are counted once
per token that some rule has; each rule is filed under its token that the fewest urls have. Then
every url fetches the rules filed under one of its tokens, and only these run their regular
expression. The longest rule that fits decides.

Work is done per distinct url; the verdicts, only of urls that some rule fits, are joined back, so
a url that a third of all rows share is judged once and its rows are split by adaptive execution.
The rules are a parameter; they are broadcast only while they are fewer than ``MAX_BROADCAST``, and
are joined by shuffled tokens beyond that.

Defined results: a url that is null or has no ``://`` has an empty host and path; without a rule
that fits, ``rule`` is null and the verdict is the default; rules of one length that both fit are
taken in alphabetical order; repeated rows are judged each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that a broadcast table may have; a rule is a few hundred bytes.
MAX_BROADCAST = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host/path…`` and what happens to urls that it fits."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]

    def pattern(self) -> str:
        """Over host, a line feed and path, which keeps the two apart."""
        return f"^(?:[^\\n]*\\.)?{_literal(self.host)}\\n{_literal(self.path)}"

    def tokens(self) -> list[str]:
        labels = [f"h:{x}" for x in self.host.split(".") if x]
        return sorted({*labels, *(f"p:{x}" for x in self.path.split("/")[1:-1] if x)})


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, "\\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def judge(
    df: DataFrame, rules: list[Rule], *, url: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``."""
    taken = {c.lower() for c in df.columns}
    if clash := [c for c in ("host", "path", "rule", "verdict") if c in taken]:
        raise ValueError(f"columns {clash} exist already; rename them first")
    spark = df.sparkSession
    listed = [(r.text, r.verdict, r.pattern(), r.tokens()) for r in rules]
    if any(not tokens for *_, tokens in listed):
        raise ValueError("every rule needs a literal host label or path segment")
    small = (lambda x: F.broadcast(x)) if len(listed) <= MAX_BROADCAST else (lambda x: x)
    book = spark.createDataFrame(
        listed, "rule string, verdict string, pattern string, tokens array<string>"
    )

    host, path = split_url(F.col("url"))
    urls = df.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()
    seen = urls.select("url", host.alias("host"), path.alias("path")).select(
        "url", F.concat("host", F.lit("\n"), "path").alias("key"),
        F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"),
    )

    # Each rule under its rarest token; tokens that no url has are the rarest of all.
    filed = book.select("rule", F.explode("tokens").alias("token"))
    counted = (
        seen.join(small(filed.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    )
    rarest = (
        filed.join(counted, "token", "left")
        .groupBy("rule")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    index = book.select("rule", "verdict", "pattern").join(rarest, "rule")

    fits = (
        seen.join(small(index), "token")
        .where(F.rlike("key", "pattern"))
        .groupBy("url")
        .agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), "rule")).alias("found"))
    )
    rows = df.select(F.struct("*").alias("row"), F.col(url).alias("url"))
    return rows.join(fits, "url", "left").select(
        "row.*",
        host.alias("host"),
        path.alias("path"),
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
    )
