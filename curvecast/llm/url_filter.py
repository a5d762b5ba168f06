"""URL filter: a trie over reversed host labels and path segments, longest match wins.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end. A null url or one without ``://`` has an empty host and
path and gets the default verdict. Of rules that fit equally long the first one given wins. Repeated
rows each get their verdict; urls of any length are read whole; an empty table stays empty; other
columns are kept, and an input column named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: A rule list up to this many bytes is broadcast as a trie; a longer one is joined.
MAX_TRIE_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def host_path(url):
    """(host, path) columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("1")).isNotNull()
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(rest, host), F.lit("")), F.coalesce(F.when(rest, path), F.lit(""))


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """A node: labels -> nodes, and under "" the path part: segments -> nodes; a rule ends in "=",
    a list of (prefix of the next segment or None, path length, rule, verdict)."""
    root: dict = {"kids": {}, "path": None}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node["kids"].setdefault(label, {"kids": {}, "path": None})
        at = node["path"] = node["path"] or {"kids": {}, "ends": []}
        parts = path.split("/")[1:] if path.startswith("/") else []
        for seg in parts[:-1]:
            at = at["kids"].setdefault(seg, {"kids": {}, "ends": []})
        at["ends"].append((parts[-1] if parts else None, len(path), host + path, verdict))
    return root


def _path_match(at: dict, path: str):
    best, segs, i = None, path.split("/")[1:] if path.startswith("/") else [], 0
    while at is not None:
        for prefix, size, rule, verdict in at["ends"]:
            if (prefix is None or (i < len(segs) and segs[i].startswith(prefix))) and (best is None or size > best[0]):
                best = (size, rule, verdict)
        if i >= len(segs) - 1:
            break
        at, i = at["kids"].get(segs[i]), i + 1
    return best


def match(trie: dict, host: str, path: str):
    """(rule, verdict) of the longest match: more of the host first, then more of the path."""
    node, found = trie, None
    labels = host.split(".")[::-1] if host else []
    for i in range(len(labels) + 1):
        if node["path"] is not None:
            found = _path_match(node["path"], path) or found
        node = node["kids"].get(labels[i]) if i < len(labels) else None
        if node is None:
            break
    return (found[1], found[2]) if found else (None, None)


def _joined(df: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """For rule lists too long to broadcast: each different url's host suffixes meet the rules of that host.

    The verdict depends on host and path alone, so they are the key; no row needs a number of its own.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(h, p, v, i) for i, (v, h, p) in enumerate(rules)], "r_host string, r_path string, r_verdict string, r_no long")
    hit = fresh("_hit", *df.columns)
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = F.struct(F.length("r_host"), F.length("r_path"), -F.col("r_no"))
    hits = (
        df.select("host", "path").distinct()
        .select("host", "path", F.explode(F.array_union(tails, F.array(F.lit("")))).alias("r_host"))
        .join(table, "r_host")
        .where(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), best).alias(hit))
    )
    return df.join(hits, ["host", "path"], "left").withColumns({"rule": F.col(f"{hit}.rule"), "verdict": F.coalesce(f"{hit}.verdict", F.lit(default))}).drop(hit)


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """df plus host, path, rule, verdict. rules: (verdict, host, path), the path empty (the whole host)
    or from its first slash on; ties keep the first rule given."""
    rules = list(dict.fromkeys(rules))
    if odd := [r for r in rules if r[2] and not r[2].startswith("/")]:
        raise ValueError(f"a rule's path is empty or begins with a slash: {odd[:3]}")
    host, path = host_path(F.col(f"`{url}`"))
    out = df.drop("rule", "verdict").withColumns({"host": host, "path": path})
    if sum(len(h) + len(p) + 64 for _, h, p in rules) > max_trie_bytes:
        return _joined(out, rules, default)
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf(_RULE)
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            known: dict[tuple[str, str], tuple] = {}  # of one batch: a host's pages often come together
            seen = [known.get((h, p)) or known.setdefault((h, p), match(trie.value, h, p)) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r for r, _ in seen], "verdict": [v or default for _, v in seen]}, dtype=object)

    found = fresh("_m", *out.columns)
    return out.withColumn(found, verdict("host", "path")).select("*", f"{found}.rule", f"{found}.verdict").drop(found)


#: The rules that the query is to apply (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
