"""URL filters: a trie over reversed host labels, then path segments.

The rules are compiled into one trie, broadcast, and walked once for each URL; the
longest entry on the way (host and path together) wins, so that a longer allow entry
opens part of what a block entry closes, and the other way round.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ascii_lower, own_names

#: A rule is a few dozen bytes; the list is the caller's own and must stay below this.
MOST_RULES = 1_000_000


@dataclass(slots=True)
class Node:
    labels: dict[str, Node] = field(default_factory=dict)  # host labels, from the last
    segments: dict[str, Node] = field(default_factory=dict)  # path segments that a slash ends
    entry: tuple[str, str] | None = None
    starts: dict[str, tuple[str, str]] = field(default_factory=dict)  # beginnings of a segment


def trie_of(rules: Iterable[tuple[str, str, str]]) -> Node:
    """From (verdict, host, path); a path is empty or starts with a slash.  Block wins a tie."""
    root = Node()
    for verdict, host, path in sorted(rules):  # allow before block
        if path and not path.startswith("/"):
            raise ValueError(f"the path {path!r} does not start with a slash")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.labels.setdefault(label, Node())
        entry = (verdict, host.lower() + path)
        if not path:
            node.entry = entry
            continue
        *closed, last = path.split("/")
        for segment in closed:  # the first is empty: what stands before the first slash
            node = node.segments.setdefault(segment, Node())
        if last:
            node.starts[last] = entry
        else:
            node.entry = entry
    return root


def walk(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The entry that fits with the longest host and path together; of equal ones that of the longer host."""
    best = None
    parts = path.split("/")

    def offer(entry: tuple[str, str] | None) -> None:
        nonlocal best
        # Hosts come from the shortest on: an equally long entry has the longer host.
        if entry and (best is None or len(entry[1]) >= len(best[1])):
            best = entry

    node = root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        offer(node.entry)
        at = node
        for i, part in enumerate(parts):
            for start, entry in at.starts.items():
                if part.startswith(start):
                    offer(entry)
            if i == len(parts) - 1:
                break
            at = at.segments.get(part)
            if at is None:
                break
            offer(at.entry)
    return best


@own_names
def url_filters(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow", no_host: str = "block"
) -> DataFrame:
    """All columns of ``pages`` and host, path, rule, verdict.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; the path goes on to ``?``, ``#`` or the end.  Of null or without
    ``://`` both are empty.  A rule fits its host and all subdomains if the path
    starts with the rule's.  The one with the longest host and path together wins; of equal
    ones that of the longer host, of the same host and path the block.  Where none fits, rule is null and the verdict is
    ``default``, or ``no_host`` where there is no host to judge.  Columns of the new
    names give way; rows are independent of each other; of an empty table the result is empty.
    """
    rules = list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; a broadcast trie is meant for {MOST_RULES} at most")
    shared = pages.sparkSession.sparkContext.broadcast(trie_of(rules))

    @F.pandas_udf("struct<verdict: string, rule: string>")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        root = shared.value
        found = [walk(root, h, p) or (default if h else no_host, None) for h, p in zip(host, path)]
        return pd.DataFrame(found, columns=["verdict", "rule"], dtype=object)

    address = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(address, "://") > 0, F.substring(address, F.instr(address, "://") + 3, F.char_length(address))).otherwise("")
    host = ascii_lower(F.regexp_extract(F.col("_rest"), r"(?s)\A([^/?#]*)([^?#]*)", 1))
    path = F.regexp_extract(F.col("_rest"), r"(?s)\A([^/?#]*)([^?#]*)", 2)
    kept = pages.drop("host", "path", "rule", "verdict")
    out = kept.withColumn("_rest", rest).withColumn("host", host).withColumn("path", path).drop("_rest")
    return out.withColumn("_found", judged("host", "path")).select(
        *[f"`{c}`" for c in out.columns], F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("verdict")
    )
