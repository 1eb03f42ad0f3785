"""URL filters: pattern rules found by their rarest literal token, so that few rules run on a URL.

A pattern is literal text with ``*`` (any run), ``^`` (one character that is no letter or digit, or an end of
the URL), a leading ``||`` (the host or any of its parent domains starts here) and a leading or trailing
``|`` (start or end).  It applies to the lower-cased host followed by the rest of the URL as written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.llm import common

#: Rules of one index, which every task holds; more rules make more indexes.
INDEX_RULES = 100_000
TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    pattern: str
    action: str
    name: str | None = None
    rank: int = 0


def site_rule(action: str, site: str) -> Rule:
    """A rule on a host with its subdomains and on the start of the path, such as ``example.com/en/``."""
    return Rule(f"||{site}", action, site, rank=1)


def rule_regex(pattern: str) -> str:
    head, body, tail = "", pattern, ""
    if body.startswith("||"):
        head, body = r"^(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    wild = {"*": ".*", "^": "(?:^|$|[^A-Za-z0-9])"}
    return head + "".join(wild.get(c, re.escape(c)) for c in body) + tail


def rule_tokens(pattern: str) -> list[str]:
    """The words that every URL which fits must hold as whole tokens: runs with a separator or an anchor on both sides."""
    body, found = pattern.lower(), []
    start = 2 if body.startswith("||") else 1 if body.startswith("|") else 0
    end = len(body) - 1 if body.endswith("|") and len(body) > start else len(body)
    for m in TOKEN.finditer(body, start, end):
        left = body[m.start() - 1] not in "*" if m.start() > start else start > 0
        right = body[m.end()] not in "*" if m.end() < end else end < len(body)
        if left and right:
            found.append(m[0])
    return found


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and what follows the host; all empty for null or without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`url`"))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, r"(?s)^[^/?#]*(.*)$", 1)
    return common.ascii_lower(host), path, rest


def token_counts(urls: DataFrame, wanted: Sequence[str]) -> dict[str, int]:
    """How many rows of ``urls(subject)`` hold each wanted token; the answer is as small as the rule list."""
    wanted_rows = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    tokens = urls.select(F.explode(F.array_distinct(F.split(F.lower("subject"), "[^a-z0-9]+"))).alias("token"))
    counted = tokens.join(wanted_rows, "token", "left_semi").groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


def _judge(rules: Sequence[Rule], counts: dict[str, int]) -> Column:
    """A struct (rank, length, rule, action) of the best rule of this index that fits ``subject``."""
    index: dict[str, list[int]] = {}
    always: list[int] = []
    for k, r in enumerate(rules):
        tokens = rule_tokens(r.pattern)
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
        else:
            always.append(k)
    sources = [rule_regex(r.pattern) for r in rules]

    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            out = []
            for subject in batch:
                found = (-1, -1, -1)
                tokens = set(TOKEN.findall(subject.lower()))
                for k in [*always, *(k for t in tokens for k in index.get(t, ()))]:
                    if k not in compiled:
                        compiled[k] = re.compile(sources[k], re.DOTALL)
                    if (score := (rules[k].rank, len(rules[k].pattern), -k)) > found and compiled[k].search(subject):
                        found = score
                hit = rules[-found[2]] if found[1] >= 0 else None
                out.append((found[0], found[1], hit and (hit.name or hit.pattern), hit and hit.action))
            yield pd.DataFrame(out, columns=["rank", "length", "rule", "action"])

    return F.pandas_udf(best, "rank int, length int, rule string, action string")(F.col("subject"))


def judge(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per row of ``urls``: page_id, host, path, and rule, action and rank of the rule that fits, else nulls.

    The highest rank wins, then the longest pattern, then the first listed.  A null URL, or one without ``://``, has empty parts and
    fits no rule.  Rules beyond ``INDEX_RULES`` go to further indexes, each run on the same rows.
    """
    bare = common.narrow(urls, id=id_col, url=url_col)
    host, path, rest = url_parts(F.col("url"))
    parts = bare.select("id", host.alias("host"), path.alias("path"), rest.alias("rest")).withColumn(
        "subject", F.concat("host", "rest")
    )
    counts = token_counts(parts, sorted({t for r in rules for t in rule_tokens(r.pattern)}))
    judged = parts
    blocks = [rules[i : i + INDEX_RULES] for i in range(0, len(rules), INDEX_RULES)]
    for k, block in enumerate(blocks):
        judged = judged.withColumn(f"best{k}", _judge(block, counts))
    if not blocks:
        judged = judged.withColumn("best0", F.lit(None).cast("struct<rank:int,length:int,rule:string,action:string>"))
    won = F.col("best0")
    for k in range(1, len(blocks)):
        better = F.struct(F.col(f"best{k}.rank"), F.col(f"best{k}.length")) > F.struct(won["rank"].alias("rank"), won["length"].alias("length"))
        won = F.when(better, F.col(f"best{k}")).otherwise(won)
    real = F.col("host") != ""
    return judged.withColumn("won", won).select(
        F.col("id").alias("page_id"),
        "host",
        "path",
        *[F.when(real, F.col(f"won.{c}")).alias(c) for c in ("rule", "action", "rank")],
    )
