"""URL filter: pattern rules indexed by their rarest literal token.

Host rules such as `example.net/en/` fit a host, its subdomains and the paths
that begin with theirs; pattern rules use `||` (a host or subdomain), `|` (an
end of the URL), `^` (a separator or the end) and `*`, and `@@` makes one an
exception. Every rule becomes a regular expression and a list of literal
tokens, runs of letters and digits that any URL it fits must contain as tokens
of its own. The tokens' frequencies are counted over all URLs by a join, each
rule is filed under its rarest one, and a URL's tokens fetch the rules to try;
only these run, whatever the length of the list. Rules without a token are tried
on every URL.

Among host rules the longest wins and decides. Otherwise the patterns do: a
URL is blocked if a pattern fits and no exception does.

The rules are the caller's parameter, built in or read by `load` from a file or a
table. They are sent to every task and so are held to `MOST_RULES` (a longer list
raises); URLs are never shuffled.

Defined results for unusual input: a null URL, or one without `://`, has an
empty host and path, fits no host rule, and is judged by the patterns as it
stands (null: as an empty one); a very long URL is judged whole; of host rules of
equal length the first listed wins, of fitting patterns the first exception or
else the first; repeated rows give repeated rows; null ids are kept; an empty
table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 200_000
#: The host rules, as (verdict, host/path).
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The patterns used beside them.
PATTERNS = (
    "||doubleclick.net^", "||googlesyndication.com^", "||adservice.google.com^", "||pornhub.com^", "||bet365.com^",
    "/adserver/", "/ad-frame/", "/banner-ads/", "/popunder/", "/click-tracker/", "/cgi-bin/", "/wp-login.php", "/xmlrpc.php",
    "/signin^", "/checkout^", "/shopping-cart^", "^sessionid=", "^phpsessid=", "^jsessionid=", "/calendar/*/day/", ".torrent|", ".apk|", ".exe|",
    "@@||archive.org^", "@@/robots.txt|",
)

_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    by_host: bool
    regex: str
    tokens: tuple[str, ...] = field(default=())


def host_rule(verdict: str, name: str) -> Rule:
    """A rule over the host with the path after it."""
    host, slash, path = name.partition("/")
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    # The path's last token may go on in the URL.
    tokens = _TOKEN.findall(host) + [m.group() for m in _TOKEN.finditer((slash + path).translate(_LOWER)) if m.end() < len(slash + path)]
    return Rule(name, verdict, True, regex, tuple(tokens))


def pattern_rule(text: str) -> Rule:
    """A rule over the whole URL in lower case."""
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    body = body.translate(_LOWER)
    begin, end = "", ""
    if body.startswith("||"):
        begin, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        begin, body = "^", body[1:]
    if body.endswith("|"):
        end, body = "$", body[:-1]
    inner = "".join(".*" if c == "*" else "(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body)
    open_, close = bool(begin), bool(end)
    tokens = [m.group() for m in _TOKEN.finditer(body) if (body[m.start() - 1] != "*" if m.start() else open_) and (body[m.end()] != "*" if m.end() < len(body) else close)]
    return Rule(text, verdict, False, begin + inner + end, tuple(tokens))


def rules(host_rules=HOST_RULES, patterns=PATTERNS) -> list[Rule]:
    return [*(host_rule(*r) for r in host_rules), *map(pattern_rule, patterns)]


def load(lines: DataFrame) -> list[Rule]:
    """The rules of a table with one string column, as `spark.read.text` gives it from a list's files: `block host/path` and `allow host/path` are host rules, other lines are patterns; blank lines and those that begin with `!` or `#` are left out. Rules are in the order of the lines; repeated ones count once."""
    column = F.trim(F.col(lines.columns[0]))
    told = lines.select(column.alias("line")).filter("line <> '' AND NOT startswith(line, '!') AND NOT startswith(line, '#')")
    listed = [r.line for r in told.limit(MOST_RULES + 1).collect()]
    if len(listed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    split = [line.split() for line in dict.fromkeys(listed)]
    return [host_rule(*s) if len(s) == 2 and s[0] in ("block", "allow") else pattern_rule(" ".join(s)) for s in split]


def split_url(url: str | None) -> tuple[str, str]:
    """(host in lower case, path)."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(_LOWER), m[2]


def token_counts(urls: DataFrame, url: Column, tokens: set[str]) -> dict[str, int]:
    """How many times each of these tokens occurs in the URLs. The tokens, bounded by the rules, are sent to the URLs; no more rows than tokens come back."""
    wanted = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "t string"))
    found = urls.select(F.explode(F.split(F.lower(url), "[^a-z0-9]+", -1)).alias("t"))
    return {r.t: r["count"] for r in found.join(wanted, "t").groupBy("t").count().collect()}


class Index:
    def __init__(self, given: list[Rule], counts: dict[str, int]):
        if len(given) > MOST_RULES:
            raise ValueError(f"{len(given)} rules; at most {MOST_RULES} are sent to each task")
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.given = given
        for i, rule in enumerate(given):
            if rule.tokens:
                self.by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(i)
            else:
                self.always.append(i)
        self.compiled: dict[int, re.Pattern] = {}

    def __getstate__(self):
        return self.__dict__ | {"compiled": {}}

    def _fits(self, i: int, text: str) -> bool:
        regex = self.compiled.get(i)
        if regex is None:
            regex = self.compiled[i] = re.compile(self.given[i].regex, re.DOTALL)
        return regex.search(text) is not None

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None, int]:
        """(host, path, host rule, verdict, pattern, rules tried)."""
        host, path = split_url(url)
        low = (url or "").translate(_LOWER)
        tokens = {*_TOKEN.findall(low)}
        candidates = sorted({i for t in tokens & self.by_token.keys() for i in self.by_token[t]} | {*self.always})
        by_host = [r for i in candidates if (r := self.given[i]).by_host and host and self._fits(i, host + path)]
        if by_host:
            best = max(by_host, key=lambda r: len(r.name))
            return host, path, best.name, best.verdict, None, len(candidates)
        fitting = [r for i in candidates if not (r := self.given[i]).by_host and self._fits(i, low)]
        named = next((r for r in fitting if r.verdict == "allow"), fitting[0] if fitting else None)
        return host, path, None, named.verdict if named else "allow", named.name if named else None, len(candidates)


def judge(df: DataFrame, given: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern, n_tried for every row of df."""
    given = rules() if given is None else given
    counts = token_counts(df, F.col(url_col), {t for r in given for t in r.tokens})
    index = df.sparkSession.sparkContext.broadcast(Index(given, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*zip(*map(index.value.judge, batch.column(1).to_pylist()))] or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.int64())], names=["page_id", "host", "path", "rule", "verdict", "pattern", "n_tried"])

    return df.select(F.col(id_col).cast("long"), F.col(url_col)).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string, n_tried long")
