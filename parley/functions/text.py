"""Column functions over message text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley import constants as C


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_len(text: Column | str) -> Column:
    """Length in code points."""
    return F.length(_col(text)).cast("bigint")


def text_key(text: Column | str) -> Column:
    """256-bit hash that stands for a text where texts are grouped or compared; null for null."""
    return F.unhex(F.sha2(_col(text).cast("binary"), 256))


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def extract(text: Column, pattern: str, group: int) -> Column:
    """Like regexp_extract, but null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def clean_text(text: Column | str, lower: bool = True) -> Column:
    """URLs, then mentions, replaced by one blank each. Texts that cannot hold any skip the patterns."""
    t = _col(text)
    no_urls = F.when(F.contains(t, F.lit("http")), F.regexp_replace(t, C.URL_RE, " ")).otherwise(t)
    out = F.when(F.contains(t, F.lit("@")), F.regexp_replace(no_urls, C.MENTION_RE, " ")).otherwise(no_urls)
    return F.lower(out) if lower else out


def words(text: Column | str, lower: bool = True) -> Column:
    return extract_all(clean_text(text, lower), C.WORD_RE)


def word_count(text: Column | str) -> Column:
    return F.regexp_count(clean_text(text, lower=False), F.lit(C.WORD_RE)).cast("bigint")


def emote_tokens(text: Column | str) -> Column:
    return extract_all(_col(text), C.EMOTE_TOKEN_RE)


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of an array of words, joined by a blank.

    The array is read more than once: pass a column, not an expression that has to be computed.
    """
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)
    )


def urls(text: Column | str) -> Column:
    return extract_all(_col(text), C.URL_RE)


def has_url(text: Column | str) -> Column:
    return F.contains(_col(text), F.lit("http")) & _col(text).rlike(C.URL_RE)


def bare_url(url: Column) -> Column:
    """Trailing punctuation, then trailing slashes dropped."""
    return F.regexp_replace(F.regexp_replace(url, C.URL_TRAILING_PUNCT_RE, ""), "/+$", "")


def fold_host(bare: Column) -> Column:
    """Scheme and host lower-cased, the rest kept."""
    head = F.regexp_extract(bare, r"^(https?://[^/]+)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def normalize_url(url: Column) -> Column:
    return fold_host(bare_url(url))


def domain_of(url: Column) -> Column:
    return extract(url, C.DOMAIN_RE, 1)


def mentions(text: Column | str) -> Column:
    """Mentioned logins, lower-cased, without the @."""
    return F.transform(extract_all(_col(text), C.MENTION_RE), lambda m: F.lower(F.substr(m, F.lit(2))))


def has_mention(text: Column | str) -> Column:
    return F.contains(_col(text), F.lit("@")) & _col(text).rlike(C.MENTION_RE)


def command_name(text: Column | str) -> Column:
    """Lower-cased command of a message that starts with ``!name``, else null."""
    return F.lower(extract(_col(text), C.COMMAND_RE, 1))


def strip_end(text: Column | str) -> Column:
    """Unicode blanks removed at the end."""
    return F.rtrim(_col(text), F.lit(C.BLANKS))


def count_matches(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(_col(text), F.lit(pattern)).cast("bigint")


def non_ascii_chars(text: Column | str) -> Column:
    t = _col(text)
    plain = F.octet_length(t) == F.length(t)
    return F.when(plain, F.lit(0)).otherwise(F.length(F.regexp_replace(t, r"\p{ASCII}+", ""))).cast("bigint")


def letters(text: Column | str) -> Column:
    return F.length(F.regexp_replace(_col(text), r"\P{L}+", "")).cast("bigint")


def capitals(text: Column | str) -> Column:
    return count_matches(text, r"\p{Lu}")


def ellipsis(text: Column | str, limit: int = C.MAX_REPEAT_TEXT_LEN) -> Column:
    t = _col(text)
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("..."))).otherwise(t)


def role_of(badges: Column | str) -> Column:
    """Highest role among the badge names of ``name/version,name/version``."""
    names = F.transform(F.split(_col(badges), ","), lambda b: F.substring_index(b, "/", 1))
    role = F.lit(C.DEFAULT_ROLE)
    for name in reversed(C.ROLE_PRECEDENCE):
        role = F.when(F.array_contains(names, name), F.lit(name)).otherwise(role)
    return role


def tag(tags: Column | str, key: str) -> Column:
    """Value of a tag, null where the map or the key is missing."""
    return F.try_element_at(_col(tags), F.lit(key))


def parse_ts(value: Column | str) -> Column:
    """ISO-8601 text to UTC TIMESTAMP_NTZ; text without a zone is UTC; null if unreadable."""
    v = F.trim(_col(value))
    zoned = v.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$") & v.rlike(r"[T ]\d")
    instant = F.try_to_timestamp(F.when(zoned, v).otherwise(F.concat(v, F.when(v.rlike(r"[T ]\d"), F.lit("Z")).otherwise(F.lit("T00:00:00Z")))))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def iso_ts(ts: Column | str) -> Column:
    return F.date_format(_col(ts).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def channel_key(channel: Column | str, id_type: str = "channel") -> Column:
    safe = F.regexp_replace(F.lower(F.trim(_col(channel))), r"[^\p{L}\p{N}]", "_")
    return F.concat(F.lit(f"{id_type}_"), safe)


def parse_emotes(tag_value: Column | str, text: Column | str) -> Column:
    """Emote names of a positional tag ``id:s-e,s-e/id:s-e``; repeats are kept.

    The positions are inclusive code points. A range that cannot be read, or
    that selects nothing, yields ``[id]``.
    """
    txt = _col(text)

    def names_of(part: Column) -> Column:
        emote_id = F.substring_index(part, ":", 1)
        fallback = F.concat(F.lit("["), emote_id, F.lit("]"))

        def name_of(span: Column) -> Column:
            ends = F.split(span, "-")
            first = F.try_element_at(ends, F.lit(1)).try_cast("int")
            last = F.try_element_at(ends, F.lit(2)).try_cast("int")
            cut = F.substr(txt, first + 1, F.greatest(last - first + 1, F.lit(0)))
            found = F.when(F.size(ends) == 2, cut)
            return F.coalesce(F.nullif(found, F.lit("")), fallback)

        spans = F.split(F.substr(part, F.length(emote_id) + 2), ",")
        return F.transform(spans, name_of)

    parts = F.filter(F.split(_col(tag_value), "/"), lambda p: F.contains(p, F.lit(":")))
    return F.coalesce(F.flatten(F.transform(parts, names_of)), F.array().cast("array<string>"))


def name_pairs(names: Column, limit: int | None = None) -> Column:
    """Unordered pairs of a sorted array of distinct names; null below two names, or above ``limit`` where one is given.

    The array is read once per name: pass a column, not an expression that has to be computed.
    """
    n = F.size(names)

    def pairs_from(first: Column, i: Column) -> Column:
        rest = F.slice(names, i + 2, F.greatest(n - i - 1, F.lit(0)))
        return F.transform(rest, lambda second: F.struct(first.alias("emote1"), second.alias("emote2")))

    fits = (n >= 2) if limit is None else (n >= 2) & (n <= limit)
    return F.when(fits, F.flatten(F.transform(names, pairs_from)))
