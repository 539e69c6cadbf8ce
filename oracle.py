"""The registered queries as SQL over the raw tables, written independently of the Spark code."""

from __future__ import annotations

from parley import constants as C


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


URL = _lit(r"""https?://[^\s<>()\[\]{}"',;!]+""")
MENTION = _lit(r"\B@[A-Za-z0-9_]+")
WORD = _lit(r"[\p{L}\p{N}][\p{L}\p{N}']+")
TOKEN = _lit(r"[A-Za-z0-9_]+")
TAIL = _lit(r"""[.,;:!?)\]}"']+$""")
STOP = ", ".join(_lit(w) for w in C.STOPWORDS)
NOW, LOW, MID = "TIMESTAMP '2024-01-31'", "TIMESTAMP '2024-01-01'", "TIMESTAMP '2024-01-16'"

RAID = "n % 24 < 8"
EMOTED = "NOT (n % 24 < 8) AND u % 11 <> 0 AND n % 7 NOT IN (1, 2) AND n % 9 <> 3 AND n % 13 = 4"
COMMAND = "'!' || CASE n % 3 WHEN 0 THEN 'stats' WHEN 1 THEN 'so' ELSE 'Clip' END"

MESSAGES = f"""
source AS (
  SELECT e.event_id AS n, e.ts, e.user_id AS u, replace(d.text, chr(10), ' ') AS t, d.lang, p.url
  FROM events e
  JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
  JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
),
messages AS (
  SELECT 'm' || n AS id, ts, CAST(u AS VARCHAR) AS user_id, 'User' || u AS username,
    CASE WHEN {RAID} THEN 'Raid incoming Kappa'
         WHEN u % 22 = 0 THEN {COMMAND}
         WHEN u % 11 = 0 THEN {COMMAND} || ' ' || t
         WHEN n % 7 = 1 THEN '@User' || ((u * 7 + n) % 15) || ' ' || t
         WHEN n % 7 = 2 THEN t || ' ' || url || CASE WHEN n % 2 = 0 THEN '!' ELSE '' END
         WHEN n % 9 = 3 THEN 'WHAT IS THIS ' || (n % 3) || '?'
         WHEN n % 13 = 4 THEN CASE WHEN n % 2 = 0 THEN 'Kappa Keepo LUL ' ELSE 'Kappa Keepo ' END || t
         ELSE t END AS text,
    CASE WHEN {RAID} THEN '25:14-18'
         WHEN {EMOTED} THEN CASE WHEN n % 2 = 0 THEN '25:0-4/1902:6-10/425618:12-14' ELSE '25:0-4/1902:6-10' END
         END AS emotes_tag,
    CASE WHEN u = 1 THEN 'broadcaster' WHEN u % 10 = 0 THEN 'moderator' WHEN u % 10 = 1 THEN 'vip'
         WHEN u % 10 IN (2, 3) THEN 'subscriber' ELSE 'regular' END AS role,
    'ch' || (u % 3) AS channel, lang, n, u
  FROM source
)"""

TAGGED = (
    MESSAGES
    + """,
tagged AS (
  SELECT * REPLACE (CASE WHEN n % 50 = 0 THEN username ELSE user_id END AS user_id),
    n % 6 = 0 AS reply, n % 10 = 0 AS first_msg, n % 15 = 0 AS returning_chatter
  FROM messages WHERE n % 97 <> 0
)"""
)

EMOTES = """
emote_rows AS (
  SELECT id, user_id, username, ts, channel, ts >= TIMESTAMP '2024-01-16' AS cur,
         substring(text, CAST(split_part(r, '-', 1) AS INTEGER) + 1,
                   CAST(split_part(r, '-', 2) AS INTEGER) - CAST(split_part(r, '-', 1) AS INTEGER) + 1) AS name
  FROM (SELECT *, unnest(string_split(split_part(p, ':', 2), ',')) AS r
        FROM (SELECT *, unnest(string_split(emotes_tag, '/')) AS p FROM messages WHERE emotes_tag IS NOT NULL))
)"""

CATALOG = f"""
catalog AS (
  SELECT DISTINCT 'ch' || (item_id % 3) AS channel, unnest(regexp_extract_all(text, {TOKEN})) AS name FROM benchmark
  UNION
  SELECT DISTINCT 'ch' || (item_id % 3), unnest(['Kappa', 'WHAT', 'THIS', 'Raid', 'incoming']) FROM benchmark
)"""

TOKENS = f"""
token_rows AS (SELECT channel, unnest(regexp_extract_all(text, {TOKEN})) AS name FROM messages)"""

EMOTE_COUNTS = """
native AS (SELECT name, count(*) AS uses FROM emote_rows GROUP BY name),
emote_counts AS (
  SELECT name, uses FROM native
  UNION ALL
  SELECT name, count(*) AS uses FROM token_rows
  WHERE name IN (SELECT name FROM catalog) AND name NOT IN (SELECT name FROM native) GROUP BY name
)"""

CLEAN = f"regexp_replace(regexp_replace(text, {URL}, ' ', 'g'), {MENTION}, ' ', 'g')"
WORDS = f"""
word_rows AS (
  SELECT channel, period, word FROM (
    SELECT channel, CASE WHEN ts >= {MID} THEN 'current' ELSE 'previous' END AS period,
           unnest(regexp_extract_all(lower({CLEAN}), {WORD})) AS word FROM messages)
  WHERE word NOT IN ({STOP})
)"""
WORD_COUNTS = """
word_counts AS (
  SELECT word, count(*) AS uses FROM word_rows
  WHERE word NOT IN (SELECT lower(name) FROM emote_counts) GROUP BY word
)"""
ALL_WORDS = (EMOTES, CATALOG, TOKENS, EMOTE_COUNTS, WORDS, WORD_COUNTS)

SCHEME = r"'^(https?://[^/]+)'"
BARE = f"regexp_replace(regexp_replace(raw, {TAIL}, ''), '/+$', '')"


def _normal(source: str) -> str:
    return f"""
    SELECT *, lower(regexp_extract(bare, {SCHEME}, 1)) || substring(bare, length(regexp_extract(bare, {SCHEME}, 1)) + 1) AS url
    FROM (SELECT *, {BARE} AS bare FROM ({source}))"""


URLS = f"""
url_rows AS (
  SELECT url FROM ({_normal(f"SELECT unnest(regexp_extract_all(text, {URL})) AS raw FROM messages")}) WHERE length(url) > 0
),
url_counts AS (SELECT url, count(*) AS uses FROM url_rows GROUP BY url)"""
DOMAIN = r"nullif(regexp_extract(url, '^(?:https?://)?(?:www\.)?([^/]+)', 1), '')"

EDGES = f"""
edges AS (
  SELECT * FROM (
    SELECT id, ts, channel, lower(username) AS from_user, lower(substring(unnest(regexp_extract_all(text, {MENTION})), 2)) AS to_user
    FROM messages)
  WHERE from_user <> to_user
),
edge_counts AS (SELECT from_user, to_user, count(*) AS uses FROM edges GROUP BY ALL)"""


def _replies(seconds: int) -> str:
    return f"""
replies AS (
  SELECT e.from_user, e.to_user, e.ts AS ts_reply, m.ts AS ts_target
  FROM edges e ASOF JOIN (SELECT lower(username) AS target, ts FROM messages) m
    ON m.target = e.to_user AND e.ts >= m.ts
  WHERE floor(epoch_us(e.ts) / 1e6 - epoch_us(m.ts) / 1e6 + 1e-9) <= {seconds}
)"""


BIN = "time_bucket(INTERVAL '5 minutes', ts)"
BINS = f"""
bins AS (
  SELECT {BIN} AS window_start, count(*) AS message_count, count(DISTINCT user_id) AS unique_chatters
  FROM messages GROUP BY 1
)"""

DAILY = """
daily AS (
  SELECT d.day, coalesce(c.messages, 0) AS messages
  FROM (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS day FROM messages) d
  LEFT JOIN (SELECT ts::DATE AS day, count(*) AS messages FROM messages GROUP BY 1) c USING (day)
)"""
TREND = """
trend AS (
  SELECT day, messages, round(avg(messages) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 2) AS trend
  FROM daily QUALIFY count(*) OVER () >= 7
)"""

USERS = "users AS (SELECT user_id, count(*) AS x FROM messages GROUP BY user_id)"
SECONDS = "CAST(floor((epoch_us({b}) - epoch_us({a})) / 1000000) AS BIGINT)"


def _seconds(a: str, b: str) -> str:
    return f"CAST((epoch_us({b}) - epoch_us({a})) // 1000000 AS BIGINT)"


SESSIONS = f"""
marked AS (
  SELECT user_id, ts, id, CASE WHEN {_seconds("lag(ts) OVER w", "ts")} < 7200 THEN 0 ELSE 1 END AS starts
  FROM messages WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)
),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS sid FROM marked),
session_rows AS (
  SELECT user_id, count(*) AS messages, min(ts) AS session_start, max(ts) AS session_end,
         {_seconds("min(ts)", "max(ts)")} AS duration_s
  FROM numbered GROUP BY user_id, sid
)"""

GAPS = f"""
gaps AS (
  SELECT user_id, username, ts, text, {_seconds("lag(ts) OVER w", "ts")} AS gap
  FROM messages WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)
),
habits AS (
  SELECT user_id, last(username ORDER BY ts, username) AS username, count(*) AS messages, stddev_samp(gap) AS gap_std,
         count(DISTINCT text) / count(*) AS diversity, avg(CASE WHEN starts_with(text, '!') THEN 1.0 ELSE 0.0 END) AS command_ratio
  FROM gaps GROUP BY user_id
)"""


def _chains(seconds: int) -> str:
    return f"""
placed AS (
  SELECT text, user_id, ts, lag(user_id) OVER w AS prev_user, {_seconds("lag(ts) OVER w", "ts")} AS gap, count(*) OVER (PARTITION BY text) AS uses
  FROM messages WINDOW w AS (PARTITION BY text ORDER BY ts, id)
),
handoffs AS (SELECT * FROM placed WHERE uses >= 3 AND prev_user <> user_id AND gap <= {seconds}),
chains AS (
  SELECT h.text, h.occurrences, p.distinct_users
  FROM (SELECT text, count(*) AS occurrences FROM handoffs GROUP BY text) h
  JOIN (SELECT text, count(DISTINCT user_id) AS distinct_users
        FROM (SELECT text, user_id FROM handoffs UNION ALL SELECT text, prev_user FROM handoffs) GROUP BY text) p USING (text)
)"""


def _repeats(group: str) -> str:
    keep = f"{group}, " if group else ""
    return f"""
followed AS (
  SELECT {keep}coalesce(text = lag(text) OVER (PARTITION BY {keep}user_id ORDER BY ts, id), false) AS same FROM messages
)"""


LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"
CAPITALS = r"length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))"
ENDED = "rtrim(text, ' ' || chr(9) || chr(10) || chr(13))"
SHAPES = f"""count(*) FILTER (WHERE ends_with({ENDED}, '?')) AS questions,
  count(*) FILTER (WHERE ends_with({ENDED}, '!')) AS exclamations,
  count(*) FILTER (WHERE {LETTERS} >= 5 AND {CAPITALS} >= {LETTERS} * 0.8) AS all_caps,
  count(*) FILTER (WHERE length(text) <= 3) AS short_messages,
  count(*) FILTER (WHERE length(text) >= 200) AS long_messages"""


def _classes(group: str, known_native: str, known_listed: str, period: str = "") -> str:
    """Message classes per group: a message is emotes only when no token is outside the known names."""
    key = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    src = f"(SELECT *, {period} AS period FROM messages)" if period else "messages"
    join = f"LEFT JOIN only_emotes o USING ({group})" if group else ", only_emotes o"
    return f"""
class_tokens AS (
  SELECT {key}id, emotes_tag, regexp_extract_all(lower({CLEAN}), {TOKEN}) AS tokens FROM {src}
),
unknown AS (
  SELECT DISTINCT id FROM (SELECT {key}id, unnest(tokens) AS token FROM class_tokens) c
  WHERE NOT EXISTS (SELECT 1 FROM {known_native}) AND NOT EXISTS (SELECT 1 FROM {known_listed})
),
only_emotes AS (
  SELECT {key}count(*) AS emote_only FROM class_tokens
  WHERE id NOT IN (SELECT id FROM unknown) AND (emotes_tag IS NOT NULL OR len(tokens) > 0) {by}
),
class_counts AS (
  SELECT {'s.' + group + ', ' if group else ''}questions, exclamations, all_caps, short_messages, long_messages, coalesce(o.emote_only, 0) AS emote_only
  FROM (SELECT {key}{SHAPES} FROM {src} {by}) s {join}
)"""


POOLED_CLASSES = _classes(
    "",
    "emote_rows k WHERE lower(k.name) = c.token",
    "catalog k WHERE lower(k.name) = c.token",
)


def q(body: str, *ctes: str, base: str = MESSAGES) -> str:
    return f"WITH {', '.join([base, *ctes])}\n{body}"


COUNTED = "channel, count(*) AS n, min(id) AS first_id, max(id) AS last_id"
SHOWN = "id, ts, username, md5(text) AS text_md5"
POISSON = "exp(j * ln(lam) - lam - lgamma(j + 1))"

ORACLE: dict[str, str] = {}

# --- totals and users
TOTALS = f"""count(*) AS total_messages, count(DISTINCT user_id) AS unique_chatters,
  CAST(max(ts)::DATE - min(ts)::DATE + 1 AS BIGINT) AS days_spanned, round(avg(length(text)), 6) AS avg_message_length,
  median(length(text)) AS median_message_length, max(length(text)) AS max_message_length,
  round(avg(len(regexp_extract_all({CLEAN}, {WORD}))), 6) AS avg_words_per_message"""
ORACLE["overview_totals"] = q(f"SELECT {TOTALS} FROM messages")
ORACLE["overview_per_channel"] = q(f"SELECT channel, {TOTALS} FROM messages GROUP BY channel")
CHATTERS = """chatters AS (
  SELECT user_id, count(*) AS message_count, last(username ORDER BY ts, username) AS username, min(ts) AS first_seen, max(ts) AS last_seen,
         count(DISTINCT ts::DATE) AS active_days, avg(length(text)) AS avg_length,
         array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels
  FROM messages GROUP BY user_id)"""
ORACLE["top_chatters"] = q(
    """SELECT user_id, message_count, username, first_seen, last_seen, active_days, round(avg_length, 6) AS avg_length, channels,
  round(0.5::DOUBLE * message_count / (SELECT max(message_count) FROM chatters) + 0.3::DOUBLE * active_days / (SELECT max(active_days) FROM chatters)
        + 0.2::DOUBLE * avg_length / (SELECT max(avg_length) FROM chatters), 4) AS engagement_score
FROM chatters ORDER BY message_count DESC, user_id LIMIT 20""",
    CHATTERS,
)
ORACLE["top_chatters_per_channel"] = q(
    """SELECT channel, user_id, count(*) AS message_count, last(username ORDER BY ts, username) AS username, min(ts) AS first_seen, max(ts) AS last_seen,
         count(DISTINCT ts::DATE) AS active_days, round(avg(length(text)), 6) AS avg_length,
  round(0.5::DOUBLE * count(*) / max(count(*)) OVER (PARTITION BY channel) + 0.3::DOUBLE * count(DISTINCT ts::DATE) / max(count(DISTINCT ts::DATE)) OVER (PARTITION BY channel)
        + 0.2::DOUBLE * avg(length(text)) / max(avg(length(text))) OVER (PARTITION BY channel), 4) AS engagement_score
FROM messages GROUP BY channel, user_id
QUALIFY row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, user_id) <= 5"""
)
ORACLE["chatter_quantiles"] = q(
    "SELECT "
    + ", ".join(
        f"round(CAST(list_sort(list(x))[1 + CAST(round((count(*) - 1) * {p}::DOUBLE) AS BIGINT)] AS DOUBLE), 2) AS p{round(p * 100)}"
        for p in (0.5, 0.75, 0.9, 0.95, 0.99)
    )
    + " FROM users",
    USERS,
)
ORACLE["active_chatters"] = q(
    """SELECT round(avg(u), 6) AS avg_active_chatters, max(u) AS peak_active_chatters
FROM (SELECT ts::DATE AS day, count(DISTINCT user_id) AS u FROM messages GROUP BY 1)"""
)
ORACLE["roles_seen"] = q(
    "SELECT role, count(*) AS messages, count(DISTINCT user_id) AS unique_users FROM messages GROUP BY role"
)


def _roster(roles: str, tail: str = "") -> str:
    return q(
        f"""SELECT t.user_id, r.role, t.username, t.message_count, t.first_seen, t.last_seen
FROM (SELECT user_id, last(username ORDER BY ts, username) AS username, count(*) AS message_count, min(ts) AS first_seen, max(ts) AS last_seen
      FROM messages GROUP BY user_id) t
JOIN (SELECT user_id, last(role ORDER BY ts, role) AS role FROM messages WHERE role IN ({roles}) GROUP BY user_id) r USING (user_id) {tail}"""
    )


ORACLE["staff_list"] = _roster("'broadcaster', 'moderator', 'vip'")
ORACLE["subscriber_list"] = _roster("'subscriber'", "ORDER BY message_count DESC, user_id LIMIT 200")
ORACLE["subscriber_count"] = q("SELECT count(DISTINCT user_id) AS subscriber_count FROM messages WHERE role = 'subscriber'")

# --- time
ORACLE["hourly"] = q(
    """SELECT CAST(h.hour AS INTEGER) AS hour, coalesce(c.messages, 0) AS messages FROM (SELECT unnest(range(24)) AS hour) h
LEFT JOIN (SELECT hour(ts) AS hour, count(*) AS messages FROM messages GROUP BY 1) c USING (hour)"""
)
ORACLE["hourly_per_channel"] = q(
    """SELECT s.channel, CAST(s.hour AS INTEGER) AS hour, coalesce(c.messages, 0) AS messages
FROM (SELECT channel, unnest(range(24)) AS hour FROM (SELECT DISTINCT channel FROM messages)) s
LEFT JOIN (SELECT channel, hour(ts) AS hour, count(*) AS messages FROM messages GROUP BY 1, 2) c USING (channel, hour)"""
)
HEAT = """FROM (SELECT unnest(range(168)) AS slot) s
LEFT JOIN (SELECT (isodow(ts) - 1) * 24 + hour(ts) AS slot, count(*) AS messages FROM messages GROUP BY 1) c USING (slot)"""
ORACLE["weekday_hour"] = q(
    f"SELECT CAST(slot // 24 AS INTEGER) AS weekday, CAST(slot % 24 AS INTEGER) AS hour, coalesce(messages, 0) AS messages {HEAT}"
)
ORACLE["per_day"] = q("SELECT day, messages FROM daily", DAILY)
ORACLE["bins_5m"] = q("SELECT * FROM bins", BINS)
ORACLE["peaks_5m"] = q(
    "SELECT window_start, message_count FROM bins ORDER BY message_count DESC, window_start LIMIT 3", BINS
)
ORACLE["peak_concurrency"] = q(
    """SELECT unique_chatters AS peak_concurrent_chatters, window_start AS peak_concurrent_window
FROM bins ORDER BY unique_chatters DESC, window_start LIMIT 1""",
    BINS,
)
ORACLE["trend"] = q("SELECT * FROM trend", DAILY, TREND)
ORACLE["weekly_seasonality"] = q(
    """SELECT CAST(weekday AS INTEGER) AS weekday, round(ratio / avg(ratio) OVER (), 4) AS weekday_index FROM (
  SELECT w.weekday, coalesce(r.ratio, 1.0) AS ratio FROM (SELECT unnest(range(7)) AS weekday) w
  LEFT JOIN (SELECT isodow(day) - 1 AS weekday, avg(messages / trend) AS ratio FROM trend WHERE trend > 0 GROUP BY 1) r USING (weekday))""",
    DAILY,
    TREND,
)
ORACLE["first_message_hours"] = q(
    """SELECT CAST(h.hour AS INTEGER) AS hour, coalesce(c.users, 0) AS users FROM (SELECT unnest(range(24)) AS hour) h
LEFT JOIN (SELECT hour(first_ts) AS hour, count(*) AS users FROM (SELECT user_id, min(ts) AS first_ts FROM messages GROUP BY 1) GROUP BY 1) c USING (hour)"""
)
ORACLE["new_returning"] = q(
    """SELECT d.day, count(DISTINCT user_id) FILTER (WHERE m.day = first_day) AS new_chatters,
  count(DISTINCT user_id) FILTER (WHERE m.day > first_day) AS returning_chatters
FROM daily d LEFT JOIN (SELECT user_id, ts::DATE AS day, min(ts::DATE) OVER (PARTITION BY user_id) AS first_day FROM messages) m USING (day)
GROUP BY d.day""",
    DAILY,
)
ORACLE["session_table"] = q("SELECT * FROM session_rows", SESSIONS)
ORACLE["session_summary"] = q(
    """SELECT count(*) AS total_sessions, round(avg(messages), 6) AS avg_messages_per_session, round(avg(duration_s / 60.0), 6) AS avg_session_minutes,
  round(max(duration_s / 60.0), 6) AS longest_session_minutes, round(median(duration_s) / 60.0, 2) AS median_session_minutes,
  round(list_sort(list(duration_s))[1 + CAST(round((count(*) - 1) * 0.9::DOUBLE) AS BIGINT)] / 60.0, 2) AS p90_session_minutes
FROM session_rows""",
    SESSIONS,
)
RANKED = f"""{USERS},
ranked AS (SELECT x, row_number() OVER (ORDER BY x) AS i, row_number() OVER (ORDER BY x DESC) AS j, count(*) OVER () AS n, sum(x) OVER () AS total FROM users)"""
ORACLE["concentration_of_users"] = q(
    """SELECT round(abs(sum((2 * i - n - 1) * x)) / (max(n) * max(total)), 4) AS gini_coefficient,
  round(CAST(sum(x) FILTER (WHERE j <= greatest(1, ceil(n * 0.1::DOUBLE))) AS DOUBLE) / max(total) * 100, 2) AS top_10pct_share FROM ranked""",
    RANKED,
)
ORACLE["lorenz"] = q(
    " UNION ALL ".join(
        f"""SELECT {f * 100}::DOUBLE AS top_pct, round(CAST(sum(x) FILTER (WHERE j <= greatest(1, ceil(n * {f}::DOUBLE))) AS DOUBLE) / max(total) * 100, 2) AS message_share_pct FROM ranked"""
        for f in (0.01, 0.05, 0.1, 0.25, 0.5)
    ),
    RANKED,
)
ORACLE["anomalies_5m"] = q(
    f"""SELECT window_start, message_count, round(z, 2) AS z_score,
  round(CASE WHEN z > 0 THEN 1 - list_sum(list_transform(range(0, message_count), lambda j: {POISSON}))
             ELSE list_sum(list_transform(range(0, message_count + 1), lambda j: {POISSON})) END, 6) AS p_value
FROM (SELECT b.window_start, b.message_count, s.lam, (b.message_count - s.lam) / s.sd AS z FROM bins b,
      (SELECT avg(message_count) AS lam, stddev_samp(message_count) AS sd FROM bins) s)
WHERE abs(z) >= 3""",
    BINS,
)
ORACLE["length_trend"] = q(
    """SELECT round(regr_slope(l, i), 4) AS message_length_trend_slope
FROM (SELECT l, row_number() OVER (ORDER BY day) AS i FROM (SELECT ts::DATE AS day, avg(length(text)) AS l FROM messages GROUP BY 1))"""
)
ORACLE["cohort_retention"] = q(
    """SELECT cohort_week, cohort_size, week_offset, round(active / cohort_size * 100, 2) AS retention_pct FROM (
  SELECT cohort_week, CAST((week - cohort_week) // 7 AS INTEGER) AS week_offset, count(DISTINCT user_id) AS active FROM weeks GROUP BY ALL)
JOIN (SELECT cohort_week, count(DISTINCT user_id) AS cohort_size FROM weeks GROUP BY 1) USING (cohort_week)""",
    """weeks AS (SELECT user_id, week, min(week) OVER (PARTITION BY user_id) AS cohort_week
  FROM (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM messages))""",
)
ORACLE["gap_statistics"] = q("SELECT user_id, username, messages, round(gap_std, 4) AS gap_std FROM habits", GAPS)
ORACLE["bot_scores"] = q(
    """SELECT user_id, username, round(least(1.0, 0.4 * s1 + 0.4 * s2 + 0.2 * s3), 3)::DOUBLE AS score,
  concat_ws(',', CASE WHEN s1 = 1 THEN 'regular_interval' END, CASE WHEN s2 = 1 THEN 'low_diversity' END, CASE WHEN s3 = 1 THEN 'command_spam' END) AS signals
FROM (SELECT *, CASE WHEN gap_std < 5 THEN 1 ELSE 0 END AS s1, CASE WHEN diversity < 0.3 THEN 1 ELSE 0 END AS s2, CASE WHEN command_ratio > 0.5 THEN 1 ELSE 0 END AS s3
      FROM habits WHERE messages >= 50)
WHERE s1 + s2 + s3 > 0 ORDER BY score DESC, user_id LIMIT 50""",
    GAPS,
)

# --- emotes and words
ORACLE["top_emotes"] = q(
    "SELECT name, uses FROM emote_counts ORDER BY uses DESC, name LIMIT 50", EMOTES, CATALOG, TOKENS, EMOTE_COUNTS
)
ORACLE["top_emotes_per_channel"] = q(
    """SELECT channel, name, uses FROM (
  SELECT channel, name, count(*) AS uses FROM emote_rows GROUP BY ALL
  UNION ALL
  SELECT channel, name, count(*) AS uses FROM token_rows t
  WHERE EXISTS (SELECT 1 FROM catalog c WHERE c.channel = t.channel AND c.name = t.name)
    AND NOT EXISTS (SELECT 1 FROM emote_rows e WHERE e.channel = t.channel AND e.name = t.name) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY channel ORDER BY uses DESC, name) <= 5""",
    EMOTES,
    CATALOG,
    TOKENS,
)
PAIRS = """
kinds AS (SELECT DISTINCT id, name FROM emote_rows),
pairs AS (
  SELECT a.name AS emote1, b.name AS emote2, count(*) AS uses FROM kinds a JOIN kinds b ON a.id = b.id AND a.name < b.name
  WHERE a.id IN (SELECT id FROM kinds GROUP BY id HAVING count(*) >= 2) GROUP BY ALL
)"""
ORACLE["emote_pairs"] = q("SELECT * FROM pairs ORDER BY uses DESC, emote1, emote2 LIMIT 20", EMOTES, PAIRS)
ORACLE["emote_centrality"] = q(
    """SELECT emote, count(DISTINCT other) AS distinct_co_occurrences
FROM (SELECT emote1 AS emote, emote2 AS other FROM pairs UNION ALL SELECT emote2, emote1 FROM pairs)
GROUP BY emote ORDER BY 2 DESC, 1 LIMIT 20""",
    EMOTES,
    PAIRS,
)
ORACLE["emote_entropy"] = q(
    "SELECT round(-sum(p * log2(p)), 4) AS emote_entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM emote_rows GROUP BY name)",
    EMOTES,
)
ORACLE["emote_diversity"] = q(
    """SELECT user_id, last(username ORDER BY ts, username) AS username, count(*) AS total_emote_uses, count(DISTINCT name) AS unique_emotes,
  round(count(DISTINCT name) / count(*), 4) AS diversity_ratio
FROM emote_rows GROUP BY user_id HAVING count(*) >= 5 ORDER BY total_emote_uses DESC, user_id LIMIT 20""",
    EMOTES,
)
ORACLE["top_words"] = q("SELECT word, uses FROM word_counts ORDER BY uses DESC, word LIMIT 50", *ALL_WORDS)
ORACLE["top_words_per_channel"] = q(
    """SELECT channel, word, count(*) AS uses FROM word_rows w
WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.channel = w.channel AND lower(c.name) = w.word)
GROUP BY channel, word QUALIFY row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, word) <= 10""",
    CATALOG,
    WORDS,
)
ORACLE["vocabulary"] = q(
    """SELECT count(*) AS unique_word_count, round(count(*) / sum(uses), 4)::DOUBLE AS vocab_richness,
  round(count(*) FILTER (WHERE uses = 1) / count(*), 4)::DOUBLE AS hapax_ratio FROM word_counts""",
    *ALL_WORDS,
)
ORACLE["zipf_slope"] = q(
    """SELECT round(regr_slope(ln(uses), ln(r)), 4) AS zipf_slope
FROM (SELECT uses, row_number() OVER (ORDER BY uses DESC, word) AS r FROM word_counts QUALIFY r <= 1000)""",
    *ALL_WORDS,
)
COMMANDS = """commands AS (
  SELECT channel, user_id, lower(regexp_extract(text, '^!([A-Za-z0-9_\\-]+)', 1)) AS name FROM messages WHERE starts_with(text, '!'))"""
ORACLE["top_commands"] = q(
    """SELECT name, count(*) AS uses, count(DISTINCT user_id) AS unique_users FROM commands WHERE name <> ''
GROUP BY name ORDER BY uses DESC, name LIMIT 20""",
    COMMANDS,
)
ORACLE["messages_with_commands"] = q("SELECT count(*) AS messages_with_commands FROM commands WHERE name <> ''", COMMANDS)
ORACLE["top_phrases"] = q(
    """SELECT phrase, count(*) AS uses FROM (
  SELECT unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS phrase FROM tokens)
GROUP BY phrase HAVING count(*) >= 2 ORDER BY uses DESC, phrase LIMIT 50""",
    f"tokens AS (SELECT regexp_extract_all(lower({CLEAN}), {WORD}) AS t FROM messages)",
)

# --- links and mentions
ORACLE["top_urls"] = q("SELECT url, uses FROM url_counts ORDER BY uses DESC, url LIMIT 20", URLS)
ORACLE["all_urls"] = q("SELECT url, uses FROM url_counts ", URLS)
ORACLE["link_totals"] = q(
    f"""SELECT count(*) FILTER (WHERE regexp_matches(text, {URL})) AS messages_with_links,
  (SELECT count(*) FROM url_counts) AS unique_url_count FROM messages""",
    URLS,
)
ORACLE["top_domains"] = q(
    f"""SELECT {DOMAIN} AS domain, count(*) AS uses FROM url_rows WHERE {DOMAIN} IS NOT NULL
GROUP BY 1 ORDER BY uses DESC, domain LIMIT 20""",
    URLS,
)
HOSTS = "['www.youtube.com', 'clips.twitch.tv', 'discord.gg', 'x.com', 'netflix.com', 'kick.com', 'youtu.be', 'plain.org']"
MOVED = f"""
platform_urls AS (
  SELECT lower(url) AS url FROM url_rows
  UNION ALL
  SELECT lower(url) FROM ({_normal(f"SELECT unnest(regexp_extract_all(regexp_replace(url, '//[^/]+', '//' || {HOSTS}[page_id % 8 + 1]), {URL})) AS raw FROM pages")})
)"""


def _platforms(column: str, rules: dict[str, str]) -> str:
    tests = {name: f"regexp_matches({column}, {_lit(rule)})" for name, rule in rules.items()}
    tests["other"] = "NOT (" + " OR ".join(tests.values()) + ")"
    return ", ".join(f"count(*) FILTER (WHERE {test}) AS {name}" for name, test in tests.items())


ORACLE["platform_links"] = q(f"SELECT {_platforms('url', C.PLATFORM_RES)} FROM platform_urls", URLS, MOVED)
ORACLE["platform_links_strict"] = q(
    f"SELECT {_platforms('host', C.PLATFORM_HOSTS)} FROM (SELECT regexp_replace({DOMAIN}, '[:?#].*$', '') AS host FROM platform_urls)",
    URLS,
    MOVED,
)
ORACLE["messages_with_mentions"] = q(
    f"SELECT count(*) FILTER (WHERE regexp_matches(text, {MENTION})) AS messages_with_mentions FROM messages"
)
ORACLE["top_mentions"] = q(
    "SELECT to_user AS username, count(*) AS uses FROM edges GROUP BY 1 ORDER BY uses DESC, username LIMIT 20", EDGES
)
ORACLE["top_mention_pairs"] = q("SELECT * FROM edge_counts ORDER BY uses DESC, from_user, to_user LIMIT 20", EDGES)
ORACLE["mention_graph"] = q(
    """SELECT username, coalesce(i, 0) AS mentions_in, coalesce(o, 0) AS mentions_out, coalesce(i, 0) + coalesce(o, 0) AS degree
FROM (SELECT to_user AS username, count(*) AS i FROM edges GROUP BY 1)
FULL JOIN (SELECT from_user AS username, count(*) AS o FROM edges GROUP BY 1) USING (username)
ORDER BY degree DESC, username LIMIT 20""",
    EDGES,
)
ORACLE["mutual_mentions"] = q(
    """SELECT a.from_user AS user_a, a.to_user AS user_b, a.uses AS count_ab, b.uses AS count_ba, a.uses + b.uses AS total
FROM edge_counts a JOIN edge_counts b ON a.from_user = b.to_user AND a.to_user = b.from_user
WHERE a.from_user < a.to_user ORDER BY total DESC, user_a, user_b LIMIT 20""",
    EDGES,
)
ORACLE["replies"] = q("SELECT * FROM replies", EDGES, _replies(300))
ORACLE["replies_within_a_day"] = q("SELECT * FROM replies", EDGES, _replies(86400))
ORACLE["quote_reply_pairs"] = q(
    "SELECT from_user, to_user, count(*) AS uses FROM replies GROUP BY ALL ORDER BY uses DESC, from_user, to_user LIMIT 15",
    EDGES,
    _replies(300),
)
ORACLE["quote_reply_count"] = q("SELECT count(*) AS quote_reply_count FROM replies", EDGES, _replies(300))

# --- health and language
TEXTS = "texts AS (SELECT text, count(*) AS uses FROM messages GROUP BY text)"
ORACLE["duplicate_count"] = q("SELECT CAST(sum(uses - 1) AS BIGINT) AS duplicate_message_count FROM texts", TEXTS)
ORACLE["top_repeated"] = q(
    """SELECT text, uses
FROM (SELECT * FROM texts WHERE uses > 1 ORDER BY uses DESC, sha256(text) LIMIT 20)""",
    TEXTS,
)
REPEATED = "count(*) FILTER (WHERE same) AS self_repetition_count, round(count(*) FILTER (WHERE same) / count(*) * 100, 2) AS self_repetition_pct"
ORACLE["self_repetition"] = q(f"SELECT {REPEATED} FROM followed", _repeats(""))
ORACLE["self_repetition_per_channel"] = q(f"SELECT channel, {REPEATED} FROM followed GROUP BY channel", _repeats("channel"))
ORACLE["copy_paste_summary"] = q(
    "SELECT CAST(sum(occurrences) AS BIGINT) AS cross_user_copy_paste_count, count(*) AS cross_user_copy_paste_texts FROM chains",
    _chains(60),
)
CHAIN_TOP = "SELECT text, occurrences, distinct_users FROM (SELECT * FROM chains ORDER BY occurrences DESC, sha256(text) LIMIT {n})"
ORACLE["copy_paste_chains"] = q(CHAIN_TOP.format(n=10), _chains(60))
ORACLE["copy_paste_chains_slow"] = q(CHAIN_TOP.format(n=50), _chains(7200))
FOREIGN = r"length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))"
ORACLE["non_ascii"] = q(
    f"""SELECT round(sum({FOREIGN}) / sum(length(text)), 4)::DOUBLE AS non_ascii_ratio,
  count(*) FILTER (WHERE {FOREIGN} > 0) AS messages_with_non_ascii FROM messages"""
)
ORACLE["message_classes"] = q("SELECT * FROM class_counts", EMOTES, CATALOG, POOLED_CLASSES)
ORACLE["message_classes_by_join"] = ORACLE["message_classes"]
ORACLE["message_classes_per_channel"] = q(
    "SELECT * FROM class_counts",
    EMOTES,
    CATALOG,
    _classes(
        "channel",
        "emote_rows k WHERE k.channel = c.channel AND lower(k.name) = c.token",
        "catalog k WHERE k.channel = c.channel AND lower(k.name) = c.token",
    ),
)
FIGURES = """figures AS (
  SELECT count(*) AS total, avg(length(text)) AS l, count(*) FILTER (WHERE length(text) = 0) AS empty_texts,
         count(DISTINCT ts::DATE) AS active, max(ts)::DATE - min(ts)::DATE + 1 AS spanned, count(hour(ts)) AS hours FROM messages)"""
CHECKS = """SELECT 'avg_length_small' AS "check", l < 3 AS failed, CAST(round(l, 2) AS VARCHAR) AS detail FROM figures
UNION ALL SELECT 'avg_length_large', l > 400, CAST(round(l, 2) AS VARCHAR) FROM figures
UNION ALL SELECT 'days_missing', spanned < active, CAST(spanned AS VARCHAR) FROM figures
UNION ALL SELECT 'hours_do_not_add_up', hours <> total, CAST(hours AS VARCHAR) FROM figures
UNION ALL SELECT 'empty_texts', empty_texts > 0, CAST(empty_texts AS VARCHAR) FROM figures"""
ORACLE["data_checks"] = q(CHECKS, FIGURES)
ORACLE["broken_tables"] = q(
    CHECKS.replace("spanned < active, CAST(spanned AS VARCHAR)", "true, CAST(spanned - 1 AS VARCHAR)").replace(
        "hours <> total, CAST(hours AS VARCHAR)", "true, CAST(hours + 1 AS VARCHAR)"
    ),
    FIGURES,
)
ORACLE["arrival_checks"] = q(
    CHECKS
    + f"""
UNION ALL SELECT 'time_goes_back', count(*) > 0, CAST(count(*) AS VARCHAR)
FROM (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY n))) / 1000000 AS d FROM messages) WHERE d <= -1""",
    FIGURES,
)
LETTERED = rf"length(regexp_replace({CLEAN}, '[^\p{{L}}]', '', 'g')) >= 10"
ORACLE["language_breakdown"] = q(
    f"""SELECT lang AS language, round(count(*) / sum(count(*)) OVER () * 100, 2)::DOUBLE AS percentage
FROM (SELECT lang FROM messages WHERE {LETTERED}) GROUP BY lang"""
)
ORACLE["language_by_day"] = q(
    f"""SELECT day, language, percentage FROM (
  SELECT day, lang AS language, round(count(*) / sum(count(*)) OVER (PARTITION BY day) * 100, 2)::DOUBLE AS percentage
  FROM (SELECT ts::DATE AS day, lang FROM messages WHERE {LETTERED}) GROUP BY day, lang)
QUALIFY row_number() OVER (PARTITION BY day ORDER BY percentage DESC, language) = 1"""
)

# --- several sections, channels, periods
SECTIONS = {
    "overview": "overview_totals", "top_chatters": "top_chatters", "chatter_quantiles": "chatter_quantiles",
    "active_chatters": "active_chatters", "hourly": "hourly", "weekday_hour": "weekday_hour", "per_day": "per_day",
    "peaks_5m": "peaks_5m", "peak_concurrency": "peak_concurrency", "trend": "trend",
    "weekly_seasonality": "weekly_seasonality", "roles": "roles_seen", "first_message_hours": "first_message_hours",
    "top_emotes": "top_emotes", "emote_diversity": "emote_diversity", "top_words": "top_words",
    "vocabulary": "vocabulary", "zipf_slope": "zipf_slope", "non_ascii": "non_ascii",
    "self_repetition": "self_repetition", "warnings": "data_checks",
    "messages_with_commands": "messages_with_commands", "top_commands": "top_commands",
    "messages_with_links": "link_totals", "top_domains": "top_domains", "top_urls": "top_urls",
    "unique_urls": "link_totals", "platform_links": "platform_links", "all_urls": "all_urls",
    "messages_with_mentions": "messages_with_mentions", "top_mentions": "top_mentions",
    "top_mention_pairs": "top_mention_pairs", "duplicate_count": "duplicate_count", "top_repeated": "top_repeated",
    "sessions": "session_summary", "message_classes": "message_classes",
}
#: Columns that a section has besides those of its query, or the other way round.
ONLY = {"messages_with_links": "messages_with_links", "unique_urls": "unique_url_count"}


def _values(section: str, body: str) -> str:
    """The cells of a result as (section, key, value), numbers in thousandths."""
    picked = ONLY.get(section, "*")
    return f"""SELECT '{section}' AS section, key, CASE
    WHEN regexp_matches(value, '^-?[0-9]+([.][0-9]+)?([eE]-?[0-9]+)?$')
    THEN CAST(CAST(floor(CAST(value AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS VARCHAR)
    ELSE replace(regexp_replace(value, '^\\[|\\]$', '', 'g'), ', ', ',') END AS value
  FROM (UNPIVOT (SELECT coalesce(CAST(COLUMNS(*) AS VARCHAR), '(null)') FROM (SELECT {picked} FROM ({body})))
        ON COLUMNS(*) INTO NAME key VALUE value)"""


#: A run looks at the URLs of the messages alone, ends a session after 15 minutes, and has figures without messages too.
RUN = {
    "duplicate_count": f"SELECT coalesce(duplicate_message_count, 0) AS duplicate_message_count FROM ({ORACLE['duplicate_count']})",
    "self_repetition": f"""SELECT self_repetition_count,
  CASE WHEN NOT isnan(self_repetition_pct) THEN self_repetition_pct END AS self_repetition_pct FROM ({ORACLE['self_repetition']})""",
    "platform_links": q(f"SELECT {_platforms('url', C.PLATFORM_RES)} FROM (SELECT lower(url) AS url FROM url_rows)", URLS),
    "sessions": ORACLE["session_summary"].replace("< 7200 THEN", "< 900 THEN"),
}
ORACLE["chat_stats"] = (
    "SELECT section, key, value, count(*) AS n FROM ("
    + " UNION ALL ".join(_values(section, RUN.get(section, ORACLE[name])) for section, name in SECTIONS.items())
    + ") GROUP BY ALL"
)
PER_CHANNEL = (
    "hourly weekday_hour overview chatter_quantiles active_chatters non_ascii self_repetition "
    "messages_with_commands messages_with_links messages_with_mentions unique_urls platform_links duplicate_count sessions"
).split()


def _of_channel(sql: str, channel: str) -> str:
    """A statement over the messages of one channel only."""
    everyone = MESSAGES.replace("messages AS (", "everyone AS (", 1)
    return sql.replace(MESSAGES, everyone + f",\nmessages AS (SELECT * FROM everyone WHERE channel = '{channel}')", 1)


def _with_channel(section: str, channel: str) -> str:
    body = f"SELECT '{channel}' AS channel, {ONLY.get(section, '*')} FROM ({RUN.get(section, ORACLE[SECTIONS[section]])})"
    return _values("#" + section, _of_channel(body, channel)).replace("'#", "'")


ORACLE["per_channel_all"] = (
    "SELECT section, key, value, count(*) AS n FROM ("
    + " UNION ALL ".join(_with_channel(s, c) for s in PER_CHANNEL for c in ("ch1", "ghost"))
    + ") GROUP BY ALL"
)
TOP_ANOMALIES = ORACLE["anomalies_5m"] + " ORDER BY round(abs(z), 9) DESC, window_start LIMIT 50"
EVERY_CHANNEL = {k: v for k, v in SECTIONS.items() if k not in {"top_emotes", "top_words", "vocabulary", "zipf_slope", "message_classes", "all_urls"}}
for more in "emote_pairs emote_centrality emote_entropy lorenz mention_graph mutual_mentions new_returning staff_list subscriber_list subscriber_count length_trend copy_paste_summary copy_paste_chains top_phrases bot_scores cohort_retention quote_reply_count quote_reply_pairs".split():
    EVERY_CHANNEL[more] = more
EVERY_CHANNEL |= {"concentration": "concentration_of_users"}
EVERY_SQL = {n: ORACLE[n] for n in EVERY_CHANNEL.values()} | {
    "top_anomalies": TOP_ANOMALIES,
    "top_chatters": f"SELECT * EXCLUDE (channels) FROM ({ORACLE['top_chatters']})",
}
EVERY_CHANNEL |= {"anomalies": "top_anomalies"}
RUN_EVERY = [
    _values("#" + s, _of_channel(f"SELECT '{c}' AS channel, {ONLY.get(s, '*')} FROM ({RUN.get(s, EVERY_SQL[n])})", c)).replace("'#", "'")
    for s, n in EVERY_CHANNEL.items()
    for c in ("ch0", "ch1", "ch2")
]
ORACLE["per_channel_every"] = "SELECT section, key, value, count(*) AS n FROM (" + " UNION ALL ".join(RUN_EVERY) + ") GROUP BY ALL"
ORACLE["chat_stats_sizes"] = " UNION ALL ".join(
    f"SELECT '{section}' AS section, count(*) AS n FROM ({ORACLE[name]})" for section, name in SECTIONS.items()
)
ORACLE["chat_stats_of_user"] = q(
    "SELECT day, messages, (SELECT count(*) FROM messages) AS total_messages FROM daily",
    DAILY,
    base=MESSAGES.replace("messages AS (", "everyone AS (", 1) + ",\nmessages AS (SELECT * FROM everyone WHERE lower(username) = 'user7')",
)
ORACLE["per_channel_hours"] = q(
    """SELECT s.channel, CAST(slot // 24 AS INTEGER) AS weekday, CAST(slot % 24 AS INTEGER) AS hour, coalesce(messages, 0) AS messages
FROM (SELECT channel, unnest(range(168)) AS slot FROM (SELECT DISTINCT channel FROM messages)) s
LEFT JOIN (SELECT channel, (isodow(ts) - 1) * 24 + hour(ts) AS slot, count(*) AS messages FROM messages GROUP BY 1, 2) c USING (channel, slot)"""
)
ASKED = "asked AS (SELECT unnest(['ch0', 'ch1', 'ch2', 'ghost']) AS channel)"
CHANNEL_TOTALS = f"""{ASKED},
channel_totals AS (
  SELECT channel, coalesce(t.total_messages, 0) AS total_messages, coalesce(t.unique_chatters, 0) AS unique_chatters, t.first_message, t.last_message, p.peak_concurrent_chatters
  FROM asked
  LEFT JOIN (SELECT channel, count(*) AS total_messages, count(DISTINCT user_id) AS unique_chatters, min(ts) AS first_message, max(ts) AS last_message FROM messages GROUP BY 1) t USING (channel)
  LEFT JOIN (SELECT channel, max(u) AS peak_concurrent_chatters FROM (SELECT channel, {BIN} AS b, count(DISTINCT user_id) AS u FROM messages GROUP BY 1, 2) GROUP BY 1) p USING (channel)
)"""
ORACLE["channel_totals"] = q("SELECT * FROM channel_totals", CHANNEL_TOTALS)
ORACLE["channel_days"] = q(
    """SELECT s.channel, s.day, coalesce(c.messages, 0) AS messages FROM (SELECT channel, day FROM asked, daily) s
LEFT JOIN (SELECT channel, ts::DATE AS day, count(*) AS messages FROM messages GROUP BY 1, 2) c USING (channel, day)""",
    ASKED,
    DAILY,
)
ORACLE["channel_commands"] = q(
    """SELECT channel, name, count(*) AS uses, count(DISTINCT user_id) AS unique_users FROM commands WHERE name <> ''
GROUP BY channel, name QUALIFY row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, name) <= 10""",
    COMMANDS,
)
ORACLE["channel_domains"] = q(
    f"""SELECT channel, {DOMAIN} AS domain, count(*) AS uses
FROM ({_normal(f"SELECT channel, unnest(regexp_extract_all(text, {URL})) AS raw FROM messages")})
GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, domain) <= 10"""
)
ORACLE["channel_mentions"] = q(
    """SELECT channel, to_user AS username, count(*) AS uses FROM edges GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, username) <= 10""",
    EDGES,
)
ORACLE["channel_roles"] = q(
    "SELECT channel, role, count(*) AS messages, count(DISTINCT user_id) AS unique_users FROM messages GROUP BY 1, 2"
)
ORACLE["channel_share"] = q(
    """SELECT channel, round(count(*) / sum(count(*)) OVER () * 100, 2)::DOUBLE AS share_pct,
  round(count(*) / count(DISTINCT user_id), 1) AS messages_per_chatter FROM messages GROUP BY channel"""
)
ORACLE["reconcile"] = q(
    """SELECT 'totals_do_not_add_up' AS "check", sum(total_messages) <> (SELECT count(*) FROM messages) AS failed,
  CAST(sum(total_messages) AS VARCHAR) || ' of ' || (SELECT count(*) FROM messages) AS detail FROM channel_totals
UNION ALL SELECT 'silent_channels', count(*) > 0, string_agg(channel, ', ' ORDER BY channel) FROM channel_totals WHERE total_messages = 0
UNION ALL SELECT 'outside_history', true, 'ch2'""",
    CHANNEL_TOTALS,
)
PERIOD = f"CASE WHEN ts >= {MID} THEN 'current' ELSE 'previous' END"
IN_BOTH = f"ts >= {LOW} AND ts < {NOW}"
ORACLE["period_overview"] = q(f"SELECT {PERIOD} AS period, {TOTALS} FROM messages WHERE {IN_BOTH} GROUP BY 1")
ORACLE["period_hours"] = q(
    f"""SELECT s.period, CAST(s.hour AS INTEGER) AS hour, coalesce(c.messages, 0) AS messages
FROM (SELECT unnest(['current', 'previous']) AS period, range(24) AS hours) x, LATERAL (SELECT x.period, unnest(x.hours) AS hour) s
LEFT JOIN (SELECT {PERIOD} AS period, hour(ts) AS hour, count(*) AS messages FROM messages WHERE {IN_BOTH} GROUP BY 1, 2) c
  ON c.period = s.period AND c.hour = s.hour"""
)
ORACLE["top_movers"] = q(
    f"""SELECT CASE WHEN delta > 0 THEN 'gain' ELSE 'loss' END AS kind, user_id, username, current, previous, delta FROM (
  SELECT user_id, last(username ORDER BY ts, username) AS username, count(*) FILTER (WHERE ts >= {MID}) AS current, count(*) FILTER (WHERE ts < {MID}) AS previous,
         count(*) FILTER (WHERE ts >= {MID}) - count(*) FILTER (WHERE ts < {MID}) AS delta
  FROM messages WHERE {IN_BOTH} GROUP BY user_id)
WHERE delta <> 0 QUALIFY row_number() OVER (PARTITION BY delta > 0 ORDER BY abs(delta) DESC, user_id) <= 5"""
)
DELTAS = """CASE WHEN current IS NULL OR previous IS NULL THEN NULL WHEN current = previous THEN '±0' WHEN previous = 0 THEN 'new' WHEN current = 0 THEN 'gone'
    ELSE CASE WHEN current > previous THEN '▲ ' ELSE '▼ ' END || printf('%.1f%%', abs((current - previous) / previous * 100)) END"""
TONES = """CASE WHEN current IS NULL OR previous IS NULL THEN NULL WHEN current = previous THEN 'flat'
    WHEN previous = 0 THEN CASE WHEN direction = 'lower-is-better' THEN 'bad' ELSE 'good' END
    WHEN current = 0 THEN CASE WHEN direction = 'lower-is-better' THEN 'good' ELSE 'bad' END
    WHEN direction = 'neutral' THEN 'flat' WHEN (current > previous) = (direction = 'higher-is-better') THEN 'good' ELSE 'bad' END"""
PERIOD_BASE = MESSAGES.replace("messages AS (", "everything AS (", 1) + f",\nmessages AS (SELECT *, {PERIOD} AS period FROM everything WHERE {IN_BOTH})"
PERIOD_CLASSES = _classes(
    "period",
    "emote_rows k WHERE k.cur = (c.period = 'current') AND lower(k.name) = c.token",
    "catalog k WHERE lower(k.name) = c.token",
)


def _stack(section: str, table: str, metrics) -> str:
    return " UNION ALL ".join(
        f"SELECT period, '{section}' AS section, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {table}" for m in metrics
    )


PERIOD_URLS = f"""period_urls AS (
  SELECT period, lower(url) AS url FROM ({_normal(f"SELECT period, unnest(regexp_extract_all(text, {URL})) AS raw FROM messages")})),
period_platforms AS (SELECT period, {_platforms('url', C.PLATFORM_RES)} FROM period_urls GROUP BY period)"""
PERIOD_QUALITY = f"""
period_repeats AS (
  SELECT period, CAST(count(*) FILTER (WHERE same) AS BIGINT) AS self_repetition_count FROM (
    SELECT period, text = lag(text) OVER (PARTITION BY period, user_id ORDER BY ts, id) AS same FROM messages) GROUP BY period),
period_texts AS (SELECT period, sum(uses - 1) AS duplicate_message_count FROM (SELECT period, text, count(*) AS uses FROM messages GROUP BY ALL) GROUP BY period),
period_foreign AS (SELECT period, round(sum({FOREIGN}) / sum(length(text)), 4) AS non_ascii_ratio FROM messages GROUP BY period),
period_placed AS (
  SELECT period, user_id, lag(user_id) OVER w AS prev_user, {_seconds("lag(ts) OVER w", "ts")} AS gap, count(*) OVER (PARTITION BY period, text) AS uses
  FROM messages WINDOW w AS (PARTITION BY period, text ORDER BY ts, id)),
period_chains AS (
  SELECT period, count(*) FILTER (WHERE uses >= 3 AND prev_user <> user_id AND gap <= 60) AS cross_user_copy_paste_count FROM period_placed GROUP BY period)"""
CLASS_NAMES = ("questions", "exclamations", "all_caps", "emote_only", "short_messages", "long_messages")
ORACLE["comparison_table"] = q(
    f"""SELECT section, metric, current, previous, direction, {DELTAS} AS delta, {TONES} AS tone FROM (
  SELECT section, metric, coalesce(max(value) FILTER (WHERE period = 'current'), CASE WHEN section <> 'quality' THEN 0 END) AS current,
         coalesce(max(value) FILTER (WHERE period = 'previous'), CASE WHEN section <> 'quality' THEN 0 END) AS previous,
         CASE WHEN metric IN ('self_repetition_count', 'duplicate_message_count', 'cross_user_copy_paste_count') THEN 'lower-is-better' ELSE 'neutral' END AS direction
  FROM (SELECT period, 'role' AS section, role AS metric, CAST(count(*) AS DOUBLE) AS value FROM messages GROUP BY ALL
        UNION ALL {_stack('class', 'class_counts', CLASS_NAMES)}
        UNION ALL {_stack('platform', 'period_platforms', (*C.PLATFORM_RES, 'other'))}
        UNION ALL {_stack('quality', 'period_repeats', ['self_repetition_count'])}
        UNION ALL {_stack('quality', 'period_texts', ['duplicate_message_count'])}
        UNION ALL {_stack('quality', 'period_foreign', ['non_ascii_ratio'])}
        UNION ALL {_stack('quality', 'period_chains', ['cross_user_copy_paste_count'])})
  GROUP BY section, metric)""",
    EMOTES,
    CATALOG,
    PERIOD_CLASSES,
    PERIOD_URLS,
    PERIOD_QUALITY,
    base=PERIOD_BASE,
)
HEAD_TOTALS = ("total_messages", "unique_chatters", "days_spanned", "avg_message_length", "median_message_length", "max_message_length", "avg_words_per_message")
ORACLE["headline_table"] = q(
    f"""SELECT metric, round(current, 6) AS current, round(previous, 6) AS previous,
  CASE WHEN metric <> 'days_spanned' THEN {DELTAS} END AS delta, CASE WHEN metric <> 'days_spanned' THEN {TONES} END AS tone FROM (
  SELECT metric, max(value) FILTER (WHERE period = 'current') AS current, max(value) FILTER (WHERE period = 'previous') AS previous,
         CASE WHEN metric LIKE '%message_length' OR metric = 'avg_words_per_message' THEN 'neutral' ELSE 'higher-is-better' END AS direction
  FROM ({_stack('h', 'totals', HEAD_TOTALS)} UNION ALL {_stack('h', 'vocab', ['vocab_richness', 'unique_word_count'])}
        UNION ALL {_stack('h', 'peak', ['peak_concurrent_chatters'])}) GROUP BY metric)""",
    EMOTES,
    CATALOG,
    WORDS,
    f"totals AS (SELECT period, {TOTALS.replace('round(avg(length(text)), 6)', 'avg(length(text))').replace(', 6) AS avg_words', ', 12) AS avg_words')} FROM messages GROUP BY period)",
    f"peak AS (SELECT period, max(u) AS peak_concurrent_chatters FROM (SELECT period, {BIN} AS b, count(DISTINCT user_id) AS u FROM messages GROUP BY 1, 2) GROUP BY period)",
    f"""period_native AS (SELECT DISTINCT CASE WHEN cur THEN 'current' ELSE 'previous' END AS period, name FROM emote_rows),
period_tokens AS (SELECT DISTINCT period, name FROM (SELECT period, unnest(regexp_extract_all(text, {TOKEN})) AS name FROM messages)),
period_seen AS (
  SELECT period, lower(name) AS word FROM period_native
  UNION SELECT period, lower(name) FROM period_tokens WHERE name IN (SELECT name FROM catalog)),
vocab AS (
  SELECT period, round(count(*) / sum(uses), 4) AS vocab_richness, count(*) AS unique_word_count
  FROM (SELECT period, word, count(*) AS uses FROM word_rows w
        WHERE NOT EXISTS (SELECT 1 FROM period_seen s WHERE s.period = w.period AND s.word = w.word) GROUP BY ALL) GROUP BY period)""",
    base=PERIOD_BASE,
)
ORACLE["overlay_days"] = q(
    f"""SELECT c.idx, c.day, c.messages AS current, CASE WHEN c.days = p.days THEN p.messages END AS previous
FROM (SELECT CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS idx, day, messages, count(*) OVER () AS days FROM daily WHERE day >= {MID}) c
LEFT JOIN (SELECT CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS idx, messages, count(*) OVER () AS days FROM daily WHERE day < {MID}) p USING (idx)""",
    DAILY,
)
ORACLE["summary_text"] = q(
    """SELECT '**ch0+ch1+ch2** — 2024-01-16 → 2024-01-31' || chr(10)
  || (SELECT format('{:,}', count(*)) || ' messages · ' || format('{:,}', count(DISTINCT user_id)) || ' chatters · ' || (max(ts)::DATE - min(ts)::DATE + 1) || ' days' FROM messages) || chr(10)
  || (SELECT 'Top chatter: ' || username || ' (' || format('{:,}', message_count) || ')' FROM chatters ORDER BY message_count DESC, user_id LIMIT 1) || chr(10)
  || (SELECT 'Top emote: ' || name || ' (' || format('{:,}', uses) || ')' FROM emote_counts ORDER BY uses DESC, name LIMIT 1) || chr(10)
  || (SELECT 'Peak concurrent: ' || max(unique_chatters) || ' (5m window)' FROM bins) AS summary""",
    CHATTERS,
    EMOTES,
    CATALOG,
    TOKENS,
    EMOTE_COUNTS,
    BINS,
)
STAMPS = ("first_seen", "last_seen", "window_start")
EXPORTED = {
    "top_chatters": ("top_chatters", "user_id, username, message_count, active_days, first_seen, last_seen"),
    "top_words": ("top_words", "word, uses"), "top_emotes": ("top_emotes", "name, uses"),
    "emote_pairs": ("emote_pairs", "emote1, emote2, uses"), "top_commands": ("top_commands", "name, uses, unique_users"),
    "top_domains": ("top_domains", "domain, uses"), "top_urls": ("top_urls", "url, uses"), "top_mentions": ("top_mentions", "username, uses"),
    "per_day": ("per_day", "day, messages"), "roles": ("roles_seen", "role, messages, unique_users"),
    "staff_list": ("staff_list", "user_id, username, role, message_count, first_seen, last_seen"),
    "subscriber_list": ("subscriber_list", "user_id, username, message_count, first_seen, last_seen"),
    "anomalies": (TOP_ANOMALIES, "window_start, message_count, z_score"),
}


def _exported(section: str) -> str:
    body, columns = EXPORTED[section]
    iso = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS {c}" if c in STAMPS else c
    return _values("#" + section, f"SELECT {', '.join(map(iso, columns.split(', ')))} FROM ({ORACLE.get(body, body)})").replace("'#", "'")


ORACLE["exported_sections"] = (
    "SELECT section, key, value, count(*) AS n FROM (" + " UNION ALL ".join(map(_exported, EXPORTED)) + ") GROUP BY ALL"
)
ORACLE["message_lines"] = q(
    r"""SELECT '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z] ' || username || ': ' || text AS line
FROM tagged WHERE regexp_matches(text, '^\s*![A-Za-z0-9_-]+')""",
    base=TAGGED,
)

# --- filters
GROUPED = f"SELECT {COUNTED} FROM {{t}} WHERE {{w}} GROUP BY channel"
ORACLE["filter_window"] = q(GROUPED.format(t="messages", w="ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 12:00:00'"))
ORACLE["filter_user_login"] = q(GROUPED.format(t="messages", w="username = 'User7'"))
ORACLE["filter_user_id"] = q(GROUPED.format(t="messages", w="user_id = '7'"))
ORACLE["filter_one_channel"] = q(GROUPED.format(t="messages", w="channel = 'ch1'"))
ORACLE["filter_text"] = q(GROUPED.format(t="tagged", w="contains(lower(text), 'the')"), base=TAGGED)
ORACLE["filter_username"] = q(GROUPED.format(t="tagged", w="username ILIKE '%user1%'"), base=TAGGED)
ORACLE["filter_length"] = q(GROUPED.format(t="tagged", w="length(text) BETWEEN 19 AND 400"), base=TAGGED)
ORACLE["filter_combined"] = q(
    GROUPED.format(
        t="tagged",
        w=f"contains(lower(text), 'e') AND regexp_matches(text, {URL}) AND regexp_matches(text, '[0-9]') AND length(text) >= 10",
    ),
    base=TAGGED,
)
FLAGS = {
    "url": f"regexp_matches(text, {URL})",
    "mention": f"regexp_matches(text, {MENTION})",
    "command": r"regexp_matches(text, '^\s*![A-Za-z0-9_-]+')",
    "emote": "emotes_tag IS NOT NULL",
    "number": "regexp_matches(text, '[0-9]')",
    "reply": "reply",
    "first_msg": "first_msg",
    "returning": "returning_chatter",
}
ORACLE["predicate_counts"] = q(
    "SELECT " + ", ".join(f'count(*) FILTER (WHERE {test}) AS "{name}"' for name, test in FLAGS.items()) + " FROM tagged",
    base=TAGGED,
)
LABELS = {"url": "URL", "mention": "@", "command": "!cmd", "emote": "emote", "reply": "reply", "first_msg": "first", "returning": "returning"}
ORACLE["message_tag_counts"] = q(
    "SELECT concat_ws(',', "
    + ", ".join(f"CASE WHEN {FLAGS[k]} THEN '{v}' END" for k, v in LABELS.items())
    + ") AS labels, count(*) AS n FROM tagged GROUP BY 1",
    base=TAGGED,
)

# --- scalar functions
ORACLE["cleaned_text"] = q(f"SELECT id, md5(lower({CLEAN})) AS cleaned, CAST(length({CLEAN}) AS INTEGER) AS chars FROM messages")
ORACLE["parsed_emotes"] = q(
    """SELECT id, coalesce(array_to_string(flatten(list_transform(string_split(emotes_tag, '/'), lambda p: list_transform(string_split(split_part(p, ':', 2), ','),
  lambda r: substring(text, CAST(split_part(r, '-', 1) AS INTEGER) + 1, CAST(split_part(r, '-', 2) AS INTEGER) - CAST(split_part(r, '-', 1) AS INTEGER) + 1)))), '|'), '') AS emotes
FROM messages"""
)
NOISY = "SELECT page_id, replace(url, 'example', 'EXAMPLE') || ['', '?', '/.', '!)', '//'][page_id % 5 + 1] AS raw FROM pages"
ORACLE["url_parts"] = f"SELECT page_id, url, {DOMAIN} AS domain FROM ({_normal(NOISY)})"
ORACLE["character_counts"] = f"""SELECT doc_id, length(text) AS chars, {LETTERS} AS letters, {CAPITALS} AS capitals, {FOREIGN} AS non_ascii,
  length(rtrim(text, ' ' || chr(9) || chr(10))) AS stripped, CASE WHEN length(text) > 300 THEN 303 ELSE length(text) END AS shown,
  len(regexp_extract_all(lower({CLEAN}), {WORD})) AS words, len(regexp_extract_all(text, {TOKEN})) AS tokens FROM documents"""
ORACLE["calendar_parts"] = f"""SELECT event_id, ts::DATE AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  CAST(date_trunc('week', ts) AS DATE) AS monday, {BIN} AS bin, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso FROM events"""
ORACLE["poisson_tails"] = q(
    f"""SELECT k, round(least(1.0, 1 - list_sum(list_transform(range(0, k), lambda j: {POISSON}))), 6) AS upper,
  round(least(1.0, list_sum(list_transform(range(0, k + 1), lambda j: {POISSON}))), 6) AS lower
FROM (SELECT DISTINCT message_count AS k, (SELECT avg(message_count) FROM bins) AS lam FROM bins)""",
    BINS,
)

# --- log browser
ORACLE["list_channels"] = q("SELECT DISTINCT channel FROM messages")
ORACLE["available_days"] = q(
    "SELECT DISTINCT channel, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day FROM messages"
)
ORACLE["name_history"] = q(
    "SELECT username AS user_login, min(ts) AS first_timestamp, max(ts) AS last_timestamp FROM messages WHERE user_id = '7' GROUP BY 1"
)
ORACLE["user_stats"] = q(
    f"""SELECT user_id, last(username ORDER BY ts) AS user_login, count(*) AS message_count FROM messages
WHERE channel = 'ch1' AND lower(username) = 'user7' AND ts >= {MID} AND ts < {NOW} GROUP BY user_id"""
)
ORACLE["channel_stats"] = q(f"SELECT count(*) AS message_count FROM messages WHERE channel = 'ch1' AND ts >= {MID} AND ts < {NOW}")
ORACLE["channel_top_chatters"] = q(
    """SELECT user_id, last(username ORDER BY ts) AS user_login, count(*) AS message_count FROM messages
WHERE channel = 'ch1' GROUP BY user_id ORDER BY message_count DESC, user_id LIMIT 10"""
)
ORACLE["search_user"] = q(
    f"SELECT {SHOWN} FROM messages WHERE channel = 'ch1' AND user_id = '7' AND contains(lower(text), 'the') ORDER BY ts, id LIMIT 20"
)
ORACLE["channel_logs"] = q(
    f"SELECT {SHOWN} FROM messages WHERE channel = 'ch0' AND ts >= {MID} AND ts < {NOW} ORDER BY ts, id LIMIT 100 OFFSET 30"
)
ORACLE["channel_logs_deep"] = q(
    f"SELECT {SHOWN} FROM messages WHERE channel = 'ch0' ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 1500"
)
ORACLE["user_logs"] = q(
    f"SELECT {SHOWN} FROM messages WHERE channel = 'ch1' AND lower(username) = 'user7' ORDER BY ts DESC, id DESC LIMIT 25"
)
ORACLE["channel_logs_on"] = q(
    f"SELECT {SHOWN} FROM messages WHERE channel = 'ch2' AND ts::DATE = DATE '2024-01-12' ORDER BY ts, id LIMIT 1000"
)
ORACLE["user_logs_in"] = q(
    f"SELECT {SHOWN} FROM messages WHERE channel = 'ch1' AND user_id = '7' AND strftime(ts, '%Y-%m') = '2024-01' ORDER BY ts, id LIMIT 1000"
)
ORACLE["random_channel"] = q(f"SELECT {SHOWN} FROM messages WHERE channel = 'ch1' ORDER BY md5('42:' || id), id LIMIT 10")
ORACLE["random_user"] = q(
    f"SELECT {SHOWN} FROM messages WHERE channel = 'ch1' AND user_id = '7' ORDER BY md5('42:' || id), id LIMIT 5"
)
ORACLE["merged_pages"] = q(
    "SELECT DISTINCT CASE WHEN user_id <> '5' THEN id END AS id, ts, username, md5(text) AS text_md5 FROM messages"
)
ORACLE["random_without_ids"] = q(
    """SELECT id, ts, username, text_md5 FROM (
  SELECT *, coalesce(id, concat_ws('|', username, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00', text_md5)) AS name
  FROM (SELECT CASE WHEN n % 3 <> 0 THEN id END AS id, ts, username, md5(text) AS text_md5 FROM messages WHERE channel = 'ch2'))
ORDER BY md5('7:' || name), name LIMIT 20"""
)
ORACLE["run_any_case"] = q(f"SELECT {TOTALS} FROM messages WHERE channel = 'ch0' AND ts >= {MID} AND ts < {NOW}")
ORACLE["merged_last_arrival"] = q(
    "SELECT channel, 'aaa ' || role AS text, count(*) AS n, min(id) AS first_id FROM messages GROUP BY ALL"
)
ORACLE["raw_files"] = q(
    """SELECT channel, count(*) AS n FROM messages WHERE n % 10 <> 3 GROUP BY channel
UNION ALL SELECT 'unreadable', count(*) FROM messages WHERE n % 10 = 3"""
)
ORACLE["suggest_channels"] = q("SELECT DISTINCT channel FROM messages WHERE channel <> 'ch1' ORDER BY 1 LIMIT 20")

# --- sources and store
ORACLE["parsed_records"] = q(f"SELECT {COUNTED} FROM messages GROUP BY channel")
ORACLE["normalized_messages"] = q(
    "SELECT id, ts, user_id, username, emotes_tag, role, channel, CAST(length(text) AS INTEGER) AS chars FROM tagged", base=TAGGED
)
ORACLE["room_ids"] = q(
    "SELECT channel, first('room-' || (u % 3) ORDER BY ts, id) AS room_id FROM messages WHERE n % 4 <> 0 AND n % 97 <> 0 GROUP BY channel"
)
ORACLE["deduplicated"] = q(
    """SELECT user_id, CASE WHEN user_id = '4' THEN 2 * count(*) ELSE count(*) END AS rows, CASE WHEN user_id = '3' THEN count(*) ELSE 0 END AS edited
FROM messages GROUP BY user_id"""
)
ORACLE["pooled_channels"] = ORACLE["parsed_records"]
ORACLE["channel_keys"] = (
    r"SELECT DISTINCT 'channel_' || regexp_replace(lower(trim(source || '-É ' || lang)), '[^\p{L}\p{N}]', '_', 'g') AS channel_key FROM documents"
)
ORACLE["stored_months"] = q(
    GROUPED.format(t="messages", w="channel IN ('ch0', 'ch2') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-28'")
)
SPANS = """spans AS (
  SELECT channel, date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b, CASE WHEN channel = 'ch2' THEN 400 ELSE 0 END AS later FROM messages GROUP BY channel),
needs AS (SELECT channel, a::TIMESTAMP - INTERVAL 3 DAY + later * INTERVAL 1 DAY AS need_from, b::TIMESTAMP + INTERVAL 40 DAY + later * INTERVAL 1 DAY AS need_to, a, b FROM spans),
inner_needs AS (SELECT channel, a::TIMESTAMP + INTERVAL 2 DAY AS need_from, b::TIMESTAMP - INTERVAL 2 DAY AS need_to FROM spans)"""
ORACLE["months_touched"] = q(
    """SELECT channel, strftime(m, '%Y_%m') AS year_month, m::TIMESTAMP AS month_start, m::TIMESTAMP + INTERVAL 1 MONTH AS month_end
FROM (SELECT channel, unnest(generate_series(date_trunc('month', need_from)::TIMESTAMP, need_to, INTERVAL 1 MONTH)) AS m FROM needs)""",
    SPANS,
)


def _islands(minutes: int) -> str:
    return f"""stored AS (SELECT DISTINCT channel, time_bucket(INTERVAL '{minutes} minutes', ts) AS s FROM messages),
islands AS (
  SELECT channel, min(s) AS cov_from, max(s) + INTERVAL '{minutes} minutes' AS cov_to
  FROM (SELECT *, s - row_number() OVER (PARTITION BY channel ORDER BY s) * INTERVAL '{minutes} minutes' AS g FROM stored)
  GROUP BY channel, g)"""


GAP_ROWS = """gap_rows AS (
  SELECT channel, greatest(e, need_from) AS gap_from, least(s, need_to) AS gap_to, need_from, need_to FROM (
    SELECT i.channel, lag(i.cov_to, 1, TIMESTAMP '1900-01-01') OVER (PARTITION BY i.channel ORDER BY i.cov_from) AS e, i.cov_from AS s FROM islands i
    UNION ALL SELECT channel, max(cov_to), TIMESTAMP '2900-01-01' FROM islands GROUP BY channel) JOIN inner_needs USING (channel)
  WHERE greatest(e, need_from) < least(s, need_to))"""
ORACLE["coverage_merged"] = q("SELECT * FROM islands", _islands(30))
ORACLE["coverage_gaps"] = q("SELECT channel, gap_from, gap_to FROM gap_rows", SPANS, _islands(30), GAP_ROWS)
ORACLE["coverage_tests"] = q(
    """SELECT n.channel, strftime(n.day, '%d') AS d, n.day::TIMESTAMP AS need_from, n.day::TIMESTAMP + INTERVAL 1 DAY AS need_to,
  bool_or(i.cov_from <= n.day AND i.cov_to >= n.day + INTERVAL 1 DAY) AS covered
FROM (SELECT DISTINCT channel, ts::DATE AS day FROM messages) n JOIN islands i USING (channel) GROUP BY n.channel, n.day""",
    _islands(120),
)
ORACLE["coverage_after_fetch"] = q(
    """SELECT channel, min(f) AS cov_from, max(t) AS cov_to FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY channel ORDER BY f) AS g FROM (
    SELECT *, CASE WHEN lag(t) OVER (PARTITION BY channel ORDER BY f) >= f THEN 0 ELSE 1 END AS fresh FROM (
      SELECT channel, ts::DATE::TIMESTAMP AS f, CASE WHEN day(ts::DATE) % 3 = 0 THEN max(ts) ELSE ts::DATE::TIMESTAMP + INTERVAL 1 DAY END AS t
      FROM messages GROUP BY channel, ts::DATE))) GROUP BY channel, g"""
)
ORACLE["refresh_plan"] = q(
    """SELECT channel, CASE WHEN last_hole AND channel = 'ch0' AND t >= tail_from THEN least(f, tail_from) ELSE f END AS span_from,
  CASE WHEN last_hole AND channel = 'ch0' AND t >= tail_from THEN greatest(t, need_to) ELSE t END AS span_to FROM holes
UNION ALL SELECT channel, max(tail_from), max(need_to) FROM holes WHERE channel = 'ch0' AND last_hole AND t < tail_from GROUP BY channel
UNION ALL SELECT channel, need_from, need_to FROM inner_needs WHERE channel = 'ch2'""",
    SPANS,
    _islands(60),
    GAP_ROWS,
    """holes AS (
  SELECT channel, greatest(gap_from - INTERVAL 10 MINUTE, need_from) AS f, least(gap_to + INTERVAL 10 MINUTE, need_to) AS t, need_to,
         need_to - INTERVAL 5 DAY - INTERVAL 10 MINUTE AS tail_from, row_number() OVER (PARTITION BY channel ORDER BY gap_from DESC) = 1 AS last_hole
  FROM gap_rows WHERE channel <> 'ch2')""",
)
ORACLE["month_states"] = q(
    """SELECT channel, date_trunc('month', m) + INTERVAL 1 MONTH < TIMESTAMP '2024-01-30 23:15:00' AS immutable,
  NOT (date_trunc('month', m) + INTERVAL 1 MONTH < TIMESTAMP '2024-01-30 23:15:00') AND epoch(TIMESTAMP '2024-01-31 00:15:00') - epoch(m) >= 900 AS stale,
  channel <> 'ch1' AS complete FROM (SELECT channel, strftime(ts, '%Y_%m') AS ym, max(ts) AS m FROM messages GROUP BY ALL)"""
)
ORACLE["clamped_needs"] = q(
    """SELECT channel, need_from, need_to, greatest(need_from, a::TIMESTAMP) AS clamped_from, least(need_to, b::TIMESTAMP + INTERVAL 1 DAY) AS clamped_to,
  greatest(need_from, a::TIMESTAMP) >= least(need_to, b::TIMESTAMP + INTERVAL 1 DAY) AS outside FROM needs""",
    SPANS,
)
ORACLE["run_metadata"] = q("SELECT true AS truncated, true AS from_cache, max(ts) AS cached_at FROM messages")
ORACLE["emote_catalog"] = """
WITH entries AS (
  SELECT 'ch' || (p_size % 3) AS channel, p_partkey % 3 AS place, 0 AS pos, CAST(p_partkey AS VARCHAR) AS emote_id, p_name AS name FROM part
  UNION ALL SELECT 'ch' || (p_size % 3), p_partkey % 3, 1, 's' || (p_partkey % 50), p_brand FROM part)
SELECT channel, emote_id, ['7tv', 'bttv', 'ffz'][last(place ORDER BY place, pos, name) + 1] AS provider, last(name ORDER BY place, pos, name) AS name
FROM entries GROUP BY channel, emote_id"""
ORACLE["emote_catalog_union"] = f"""WITH {CATALOG}
SELECT 'e-' || name AS emote_id, last(name || '@' || channel ORDER BY list_position(['ch2', 'ch0', 'ch1'], channel)) AS name FROM catalog GROUP BY 1"""

# --- streaming: every row, however late, and sessions that are still open
ORACLE["live_bins"] = q("SELECT window_start, message_count, unique_chatters FROM bins", BINS)
ORACLE["live_sessions"] = ORACLE["session_table"]
ORACLE["ingest_stream"] = """SELECT 'channel_ch' || (user_id % 3) AS channel_key, strftime(ts, '%Y_%m') AS year_month, count(*) AS n,
  count(DISTINCT event_id) AS ids, count(*) AS second, CAST(sum(length(concat_ws(' ', event_type, props, '2'))) AS BIGINT) AS chars
FROM events GROUP BY ALL"""
ORACLE["stored_page"] = ORACLE["channel_logs_deep"]
