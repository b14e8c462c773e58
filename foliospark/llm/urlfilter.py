"""URL filter: fixed rules first, gradient-boosted trees on lexical features for the rest.

All rows are parsed, matched and scored by Spark SQL expressions; the trees become CASE WHENs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import gbt
from foliospark.llm.common import hash_share

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    action: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


#: The rules that the registered query is given.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null or where there is no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(text, action) of the longest rule that fits, else nulls. Rules are a list of configuration, not a table."""
    text = action = F.lit(None).cast("string")
    for r in sorted(set(rules), key=lambda r: (len(str(r)), str(r), r.action)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, F.lit(str(r))).otherwise(text), F.when(fits, F.lit(r.action)).otherwise(action)
    return text, action


def entropy(c: Column) -> Column:
    """Bits per character of a string's own character distribution."""
    n = F.length(c).cast("double")
    chars = F.array_distinct(F.split(c, ""))

    def part(x: Column) -> Column:
        p = (n - F.length(F.replace(c, x, F.lit("")))) / n
        return F.when((x != "") & (p > 0), -p * F.log2(p)).otherwise(0.0)

    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda a, x: a + part(x))).otherwise(0.0)


#: Names of the lexical features, in the order of ``features``; the two suffix rates are put behind them.
FEATURES = ("length", "host_length", "path_length", "query_length", "host_labels", "depth", "digit_ratio", "host_digits", "hyphens", "longest_label", "parameters", "fragment", "secure", "entropy")


def features(url: Column, host: Column, path: Column) -> list[Column]:
    """Lexical features of a url, as doubles; a null url is an empty one."""
    u = F.coalesce(url, F.lit(""))
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    columns = [
        F.length(u), F.length(host), F.length(path), F.length(query), F.size(F.split(host, r"\.")), count(path, "/"),
        count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)), count(host, "[0-9]"), count(host, "-"),
        F.array_max(F.transform(F.split(host, r"\."), F.length)),
        F.when(query == "", 0).otherwise(1 + count(query, "&")), u.contains("#").cast("int"), ascii_lower(u).startswith("https").cast("int"), entropy(u)]
    return [c.cast("double") for c in columns]


def host_suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def path_suffix(path: Column) -> Column:
    """The extension of the last segment, ``/`` for a folder, else empty."""
    return F.when(path.endswith("/"), F.lit("/")).otherwise(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))


def rates(suffixes: list[str], y: np.ndarray, prior: float, most: int = 64) -> dict[str, float]:
    """Smoothed share of label 1 of the ``most`` commonest suffixes of the sample; others have the prior."""
    names, inverse, counts = np.unique(np.array(suffixes, dtype=str), return_inverse=True, return_counts=True)
    ones = np.bincount(inverse, y, len(names)) if len(names) else np.zeros(0)
    order = np.lexsort((names, -counts))[:most]
    return {str(names[i]): float((ones[i] + 10 * prior) / (counts[i] + 10)) for i in order}


def _rate(suffix: Column, table: dict[str, float], prior: float) -> Column:
    if not table:
        return F.lit(prior)
    known = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    return F.coalesce(known[suffix], F.lit(prior))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 6000, trees: int = 24, depth: int = 3) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``score`` (the trees' probability of block).

    Where a rule fits, its action is the verdict; elsewhere block from a score of 0.5 on. The trees learn from the urls
    that rules label: about ``sample`` of them, taken by a hash of page_id, reach the driver as features. Every row is answered once;
    null and malformed urls have empty host and path and are judged by the trees. Without labelled urls all else is allowed.
    """
    spark = pages.sparkSession
    url = F.col("url")
    parsed = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    text, action = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": text, "action": action})
    lexical = ruled.withColumns(dict(zip(FEATURES, features(url, F.col("host"), F.col("path")), strict=True))
                                | {"host_suffix": host_suffix(F.col("host")), "path_suffix": path_suffix(F.col("path"))})

    labelled = ruled.filter(F.col("action").isNotNull())
    total = labelled.count()
    rows = (lexical.filter(F.col("action").isNotNull() & hash_share("page_id", sample / max(1, total)))
            .select("page_id", "action", "host_suffix", "path_suffix", *FEATURES).limit(2 * sample).collect()) if total else []
    rows.sort(key=lambda r: (r["page_id"] is None, r["page_id"]))
    y = np.array([float(r["action"] == "block") for r in rows])
    prior = float(y.mean()) if len(y) else 0.0
    of_host, of_path = rates([r["host_suffix"] for r in rows], y, prior), rates([r["path_suffix"] for r in rows], y, prior)
    x = np.array([[*(r[f] for f in FEATURES), of_host.get(r["host_suffix"], prior), of_path.get(r["path_suffix"], prior)] for r in rows]).reshape(len(rows), len(FEATURES) + 2)
    model = gbt.fit(x, y, trees=trees, depth=depth)

    inputs = [F.col(f) for f in FEATURES] + [F.col("host_rate"), F.col("path_rate")]
    scored = lexical.withColumns({"host_rate": _rate(F.col("host_suffix"), of_host, prior), "path_rate": _rate(F.col("path_suffix"), of_path, prior)})
    score = 1 / (1 + F.exp(-model.column(inputs)))
    return scored.withColumn("score", score).select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
