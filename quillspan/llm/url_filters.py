"""URL filters: pattern rules indexed by their rarest literal token.

Running every rule's regular expression on every URL costs rules times URLs. Here a
rule is filed under one literal token that each URL it fits must contain, the rarest
one by its count over all URLs of the table. A URL is cut into tokens, its tokens fetch
the rules filed under them, and only those rules' regular expressions run. Rules
without such a token are candidates for every URL.

Two kinds of rule:

* host rules such as ``example.net/en/``: a host, and a path that the URL's path must
  start with (without a slash: any path). They fit the host and its subdomains.
* patterns over the whole URL: literal text (letters of either case), ``*`` for any run
  of characters, ``^`` for one separator (no ASCII letter, digit, ``_ - . %``) or the end,
  ``||`` in front for the start of the host or of one of its labels, ``|`` at either end
  for the start or end of the URL.

A fitting host rule beats every pattern. Within a kind the longest rule wins; allow
beats block at equal length.

Scale: nothing is shuffled but the token counts, which are reduced in each task to the
tokens that rules have. Rules are sent to the executors in blocks of at most
``BLOCK_RULES``; each block is one more column, so a list of any length works.

Cases: a null url and one without ``://`` have empty host and path, which no host rule
fits; patterns see the url as it is, null as an empty one. An empty table gives an empty
result. Repeated rows are judged one by one. Other columns are kept; input columns named
like an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import LOWER, UPPER, broadcast_if_small, fresh, lower_ascii
from quillspan.sources.tables import read_table

#: Rules sent to the executors at a time: at a few hundred bytes each, some tens of MB.
BLOCK_RULES = 50_000
#: Longest rule, which bounds a block's bytes.
RULE_CHARS = 2_000

_LOWER = str.maketrans(UPPER, LOWER)
_TOKEN = re.compile(r"[a-z0-9]+")
_SEPARATOR = r"(?:[^A-Za-z0-9_.%\-]|\Z)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` is allow or block. ``host_rule``: the text is a host with a path, else a pattern."""

    text: str
    verdict: str
    host_rule: bool = False

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"verdict of {self.text!r} is neither allow nor block: {self.verdict!r}")
        if not 0 < len(self.text) <= RULE_CHARS or set(self.text) <= set("|*^"):
            raise ValueError(f"a rule needs 1 to {RULE_CHARS} characters and something to look for: {self.text!r}")

    @property
    def rank(self) -> tuple[bool, int, bool, str]:
        return self.host_rule, len(self.text), self.verdict == "allow", self.text

    def regex(self) -> str:
        """Looked for in host + path if it is a host rule, in the URL if it is a pattern (in lower case)."""
        if self.host_rule:
            host, slash, path = self.text.partition("/")
            return r"\A(?:[^/]*\.)?" + re.escape(host.translate(_LOWER)) + (re.escape(slash + path) or r"(?=/|\Z)")
        body, front = self.text.translate(_LOWER), ""
        if body.startswith("||"):
            body, front = body[2:], r"\A[^/?#]*?://(?:[^/?#]*\.)?"
        elif body.startswith("|"):
            body, front = body[1:], r"\A"
        end = r"\Z" if body.endswith("|") else ""
        body = body.removesuffix("|")
        parts = {"*": r"(?s:.)*?", "^": _SEPARATOR}
        return front + "".join(parts.get(c, re.escape(c)) for c in body) + end

    def tokens(self) -> list[str]:
        """Tokens that every URL it fits has whole: runs of letters and digits with a sure border on both sides."""
        text = self.text.translate(_LOWER)
        if self.host_rule:
            marked = f"^{text}*" if "/" in text else f"^{text}^"
        else:
            anchored = text.startswith("|"), text.endswith("|")
            text = text.strip("|")
            marked = ("^" if anchored[0] else "*") + text + ("^" if anchored[1] else "*")
        found = []
        for m in _TOKEN.finditer(marked):
            if marked[m.start() - 1] != "*" and marked[m.end()] != "*":
                found.append(m.group())
        return sorted(set(found))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return lower_ascii(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def token_counts(urls: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """In how many rows of ``urls`` each of ``tokens`` occurs. One row per token leaves each task."""
    words = urls.select(F.explode(F.array_distinct(F.split(lower_ascii(F.col(url)), "[^a-z0-9]+"))).alias("token"))
    wanted = urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    counted = words.join(broadcast_if_small(wanted), "token", "left_semi").groupBy("token").count()
    return {row["token"]: row["count"] for row in counted.collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token, the ones without a token under the empty string."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        token = min(rule.tokens(), key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        index.setdefault(token, []).append(rule)
    return index


def _judge_block(index: dict[str, list[Rule]]):
    """A pandas UDF with the index's best fitting rule, as its kind, length, allow flag and text."""
    compiled = {t: [(r.rank, r.host_rule, re.compile(r.regex())) for r in rs] for t, rs in index.items()}

    @F.pandas_udf("host_rule boolean, length int, allow boolean, text string")
    def judge(url: pd.Series, place: pd.Series) -> pd.DataFrame:
        out = []
        for whole, where in zip(url, place):
            low = "" if whole is None else whole.translate(_LOWER)
            best = None
            for token in {"", *_TOKEN.findall(low)}:
                for rank, host_rule, regex in compiled.get(token, ()):
                    if (best is None or rank > best) and regex.search(where if host_rule else low):
                        best = rank
            out.append(best or (None, None, None, None))
        return pd.DataFrame(out, columns=["host_rule", "length", "allow", "text"]).astype({"length": "Int32"})

    return judge


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (the host rule that fits, else null), pattern (the pattern, if
    that decides, else null) and verdict (that of the winning rule, ``default`` where none fits)."""
    rules = sorted(set(rules), key=lambda r: r.rank)
    counts = token_counts(pages, url, {t for r in rules for t in r.tokens()}) if rules else {}
    blocks = [rules[i : i + BLOCK_RULES] for i in range(0, len(rules), BLOCK_RULES)]
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "pattern", "verdict") or c == url]
    best = fresh(pages, "best")
    placed = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}) if url not in ("host", "path") else None
    if placed is None:
        raise ValueError(f"the url column can't be named {url}")
    found = [_judge_block(build_index(b, counts))(F.col(url), F.concat("host", "path")) for b in blocks]
    none = F.lit(None).cast("struct<host_rule:boolean,length:int,allow:boolean,text:string>")
    winner = reduce(lambda a, b: F.greatest(a, b), found) if len(found) > 1 else found[0] if found else none
    text, is_host = F.col(f"{best}.text"), F.coalesce(F.col(f"{best}.host_rule"), F.lit(False))
    named = F.when(F.col(f"{best}.allow"), "allow").when(text.isNotNull(), "block").otherwise(default)
    return placed.withColumn(best, winner).select(
        *rest, "host", "path", F.when(is_host, text).alias("rule"), F.when(~is_host, text).alias("pattern"), named.alias("verdict")
    )


# The host rules of the query.
HOST_RULES = (
    Rule("net/", "block", True),
    Rule("example.net/en/", "allow", True),
    Rule("example.com/de/", "block", True),
    Rule("org/fr/", "allow", True),
)
#: Patterns for urls that no host rule fits: link farms and pill shops, downloads and sign-in pages.
PATTERNS = (
    Rule("||spam-farm.", "block"),
    Rule("||cheap-pills.", "block"),
    Rule("/casino/", "block"),
    Rule(".exe|", "block"),
    Rule("/login^", "block"),
    Rule("||docs.*/login^", "allow"),
)


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by the host rules, then by the patterns."""
    judged = filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), HOST_RULES + PATTERNS)
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")


ORACLE_SQL = r"""
    WITH placed AS (
        SELECT page_id, coalesce(url, '') AS url,
               CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail
        FROM pages
    ), cut AS (
        SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
               translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
        FROM placed
    ), ruled AS (
        SELECT *, CASE
            WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
            CASE
            WHEN regexp_matches(low, '^[^/?#]*?://([^/?#]*\.)?docs\.(?s:.)*/login([^a-z0-9_.%\-]|\z)') THEN '||docs.*/login^'
            WHEN regexp_matches(low, '^[^/?#]*?://([^/?#]*\.)?cheap\-pills\.') THEN '||cheap-pills.'
            WHEN regexp_matches(low, '^[^/?#]*?://([^/?#]*\.)?spam\-farm\.') THEN '||spam-farm.'
            WHEN contains(low, '/casino/') THEN '/casino/'
            WHEN regexp_matches(low, '/login([^a-z0-9_.%\-]|\z)') THEN '/login^'
            WHEN ends_with(low, '.exe') THEN '.exe|' END AS pattern
        FROM cut
    )
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN pattern IS NULL OR pattern = '||docs.*/login^' THEN 'allow' ELSE 'block' END AS verdict,
           CASE WHEN rule IS NULL THEN pattern END AS pattern
    FROM ruled
"""
