"""Predicates of the log browser, as column expressions and as one filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions import text as tx


def slice_window(df: DataFrame, start, end) -> DataFrame:
    """Messages with start <= ts < end; pushed to the scan."""
    ntz = lambda v: F.lit(str(v)).cast("timestamp_ntz")
    return df.filter((F.col("ts") >= ntz(start)) & (F.col("ts") < ntz(end)))


def filter_user(df: DataFrame, user: str, kind: str = "user") -> DataFrame:
    """One user, by id (exact) or by login (trimmed, case-insensitive)."""
    wanted = user.strip()
    if kind == "userid":
        return df.filter(F.col("user_id") == wanted)
    return df.filter(F.lower("username") == wanted.lower())


def filter_channel(df: DataFrame, channels) -> DataFrame:
    """Messages of some channels, by name or id; blanks around it and the case do not matter."""
    names = [channels] if isinstance(channels, str) else list(channels)
    return df.filter(F.lower(F.trim("channel")).isin(*(n.strip().lower() for n in names)))


def has_text(query: str) -> Column:
    return F.contains(F.lower("text"), F.lit(query.strip().lower()))


def has_username(query: str) -> Column:
    return F.contains(F.lower("username"), F.lit(query.strip().lower()))


def has_url() -> Column:
    return tx.has_url("text")


def has_mention() -> Column:
    return tx.has_mention("text")


def has_command() -> Column:
    return F.col("text").rlike(C.LOOSE_COMMAND_RE)


def has_emote() -> Column:
    return F.coalesce(F.length("emotes_tag") > 0, F.lit(False))


def has_number() -> Column:
    return F.col("text").rlike("[0-9]")


def _tag_set(key: str) -> Column:
    return F.coalesce(F.length(tx.tag("tags", key)) > 0, F.lit(False))


def _tag_is_one(key: str) -> Column:
    return F.coalesce(tx.tag("tags", key) == "1", F.lit(False))


def is_reply() -> Column:
    return _tag_set("reply-parent-msg-id")


def is_first_msg() -> Column:
    return _tag_is_one("first-msg")


def is_returning() -> Column:
    return _tag_is_one("returning-chatter")


def length_between(low: int | None = None, high: int | None = None) -> Column:
    """Inclusive bounds on the length in code points; either may be missing."""
    tests = []
    if low is not None:
        tests.append(F.length("text") >= low)
    if high is not None:
        tests.append(F.length("text") <= high)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


FLAGS = {
    "url": has_url,
    "mention": has_mention,
    "command": has_command,
    "emote": has_emote,
    "number": has_number,
    "reply": is_reply,
    "first_msg": is_first_msg,
    "returning": is_returning,
}


def active_predicates(text: str = "", username: str = "", min_length=None, max_length=None, **flags: bool) -> list[Column]:
    """The predicates that are switched on; blank texts and false flags are off."""
    unknown = set(flags) - set(FLAGS)
    if unknown:
        raise ValueError(f"unknown filter: {', '.join(sorted(unknown))}")
    tests = []
    if text.strip():
        tests.append(has_text(text))
    if username.strip():
        tests.append(has_username(username))
    tests += [FLAGS[name]() for name, on in flags.items() if on]
    if min_length is not None:
        tests.append(length_between(low=min_length))
    if max_length is not None:
        tests.append(length_between(high=max_length))
    return tests


def active_filter_count(**settings) -> int:
    return len(active_predicates(**settings))


def filter_messages(df: DataFrame, **settings) -> DataFrame:
    """Messages that pass every predicate switched on."""
    return df.filter(reduce(lambda a, b: a & b, active_predicates(**settings), F.lit(True)))


def message_tags() -> Column:
    """Labels of a message: URL, @, !cmd, emote, reply, first, returning."""
    labels = {
        "URL": has_url(),
        "@": has_mention(),
        "!cmd": has_command(),
        "emote": has_emote(),
        "reply": is_reply(),
        "first": is_first_msg(),
        "returning": is_returning(),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in labels.items()]))
