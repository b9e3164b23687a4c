"""Topic text: pattern routing, level extraction, rewriting."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The topic forms used on the wire and in the stored tables.
READING_TOPIC_ROOT = "yolink"
UNKNOWN_DEVICE = "unknown"

# Up to this many patterns there is an expression for each; more are looked up in a tree of levels.
INLINE_PATTERNS = 50

_NEVER = r"(?!)"


def pattern_regex(pattern: str) -> str:
    """Regular expression of a topic filter.

    '+' stands for one level. A last '#' stands for any number of further levels, none included,
    so 'a/#' also takes 'a'. A '#' that is not last makes the filter match nothing.
    """
    levels = pattern.split("/")
    open_end = levels[-1] == "#"
    if "#" in levels and not open_end:
        return _NEVER
    if open_end:
        levels = levels[:-1]
        if not levels:
            return r"(?s)\A.*\z"
    body = "/".join("[^/]*" if level == "+" else re.escape(level) for level in levels)
    tail = "(?:/.*)?" if open_end else ""
    return rf"(?s)\A{body}{tail}\z"


def pattern_tree(patterns: Sequence[tuple[str, str]]) -> Callable[[str], str | None]:
    """The same choice as :func:`route_topic` for one topic, by a walk through a tree of levels.

    The work follows the topic's levels and the wildcards met, not the number of patterns.
    """
    root: dict = {}
    for order, (pattern, table) in enumerate(patterns):
        levels = pattern.split("/")
        open_end = levels[-1] == "#"
        if "#" in levels and not open_end:
            continue
        node = root
        for level in levels[:-1] if open_end else levels:
            node = node.setdefault(level, {})
        # These two keys are no text, so no level is taken for them.
        node.setdefault(open_end, (order, table))

    def choose(topic: str) -> str | None:
        found, nodes = [], [root]
        for level in topic.split("/"):
            found += [node[True] for node in nodes if True in node]
            nodes = [node[name] for node in nodes for name in {"+", level} if name in node]
        found += [node[end] for node in nodes for end in (True, False) if end in node]
        return min(found)[1] if found else None

    return choose


def route_topic(topic: str | Column, patterns: Sequence[tuple[str, str]], inline: int = INLINE_PATTERNS) -> Column:
    """Table name of the first pattern, in list order, that takes the topic; NULL if none does.

    Lists of any length are taken. Long ones are matched in Arrow batches, each topic of a batch once.
    """
    column = F.col(topic) if isinstance(topic, str) else topic
    if len(patterns) > inline:
        choose = pattern_tree(patterns)

        def routed(batch: pd.Series) -> pd.Series:
            known = {name: choose(name) for name in batch.dropna().unique()}
            return batch.map(known).astype(object).where(batch.notna(), None)

        return F.pandas_udf(routed, "string")(column)
    choices = [F.when(column.rlike(pattern_regex(p)), F.lit(table)) for p, table in patterns]
    return F.coalesce(*choices, F.lit(None).cast("string"))


def topic_device(topic: str | Column) -> Column:
    """Third level of a topic with at least four levels, else 'unknown'."""
    levels = F.split(topic, "/")
    return F.when(F.size(levels) >= 4, F.element_at(levels, 3)).otherwise(F.lit(UNKNOWN_DEVICE))


def relay_topic(topic: str | Column, prefix: str = READING_TOPIC_ROOT) -> Column:
    """``root/home/device/rest`` becomes ``prefix/device/rest``; shorter topics get the prefix in front."""
    column = F.col(topic) if isinstance(topic, str) else topic
    levels = F.split(column, "/")
    rest = F.array_join(F.slice(levels, F.lit(3), F.greatest(F.size(levels) - 2, F.lit(0))), "/")
    return F.concat_ws("/", F.lit(prefix), F.when(F.size(levels) >= 4, rest).otherwise(column))


def reading_topic(device_type: str | Column, device_id: str | Column) -> Column:
    return F.concat_ws("/", F.lit(READING_TOPIC_ROOT), device_type, device_id)


def valid_table_name(name: str) -> bool:
    """Letters, digits and underscores only, and not underscores alone."""
    return bool(re.fullmatch(r"[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*", name))
