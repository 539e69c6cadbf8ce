"""Word lists, patterns and limits that decide results.

These are data, not logic: they have to equal the values users of chat
statistics already rely on, so they are written out plainly.
"""

# Words ignored by the word statistics (English, Polish, web).
STOPWORDS = tuple(
    """
    the a an and or but if then else for to of in on at by with from as is it this that these
    those i you he she we they them his her its our your their me him us my mine yours was were
    are be been being have has had do does did will would can could should not no yes so too very
    just like get got im dont what when where who how why all any out
    te ta ten go mu sie na co jak nie ale jest bo tak ty ja po ze dla oraz lub albo czy przy bez
    nad pod tylko bardzo mo ju tu tam za si
    https http com www
    """.split()
)

# Patterns. `(?U)` makes Java's \s and \w Unicode-aware. A mention needs an @ that does not
# follow a word character; looking back from the @ is cheaper than testing every position for a boundary.
URL_RE = r"""(?U)https?://[^\s<>()\[\]{}"',;!]+"""
URL_TRAILING_PUNCT_RE = r"""[.,;:!?)\]}"']+$"""
MENTION_RE = r"(?U)@(?<!\w@)[A-Za-z0-9_]+"
WORD_RE = r"[\p{L}\p{N}][\p{L}\p{N}']+"
EMOTE_TOKEN_RE = r"[A-Za-z0-9_]+"
COMMAND_RE = r"^!([A-Za-z0-9_\-]+)"
LOOSE_COMMAND_RE = r"(?U)^\s*![A-Za-z0-9_-]+"
# The Unicode blanks.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DOMAIN_RE = r"^(?:https?://)?(?:www\.)?([^/]+)"

# Link platforms, matched on the lower-cased URL. A URL may match several.
PLATFORM_RES = {
    "twitch_clips": r"clips\.twitch\.tv|twitch\.tv/\w+/clip/",
    "youtube": r"youtube\.com|youtu\.be",
    "discord": r"discord\.(gg|com)",
    "x_twitter": r"x\.com|twitter\.com",
    "kick": r"kick\.com",
}
# The same platforms, but matched on the host only.
PLATFORM_HOSTS = {
    "twitch_clips": r"^(?:clips\.twitch\.tv$|(?:www\.|m\.)?twitch\.tv$)",
    "youtube": r"(?:^|\.)(?:youtube\.com|youtu\.be)$",
    "discord": r"(?:^|\.)discord\.(?:gg|com)$",
    "x_twitter": r"(?:^|\.)(?:x|twitter)\.com$",
    "kick": r"(?:^|\.)kick\.com$",
}

# Roles.
ROLE_PRECEDENCE = ("broadcaster", "moderator", "vip", "subscriber")
DEFAULT_ROLE = "regular"
STAFF_ROLES = ("broadcaster", "moderator", "vip")
SUBSCRIBER_ROLES = ("subscriber",)

# Limits.
MAX_REPEAT_TEXT_LEN = 300
MAX_CHAIN_TEXT_LEN = 200
MAX_EMOTES_PER_MSG = 20
MIN_EMOTE_USES = 5
MIN_ALPHA_CHARS_FOR_LANG = 10
MIN_ALPHA_FOR_CAPS = 5
CAPS_SHARE = 0.8
SHORT_MESSAGE_LEN = 3
LONG_MESSAGE_LEN = 200
MAX_ANOMALIES = 50
MIN_ANOMALY_MESSAGES = 10
MIN_ANOMALY_BINS = 10
ZIPF_MAX_RANK = 1000
ZIPF_MIN_WORDS = 10
POISSON_NORMAL_APPROX_LAMBDA = 30.0
REPLY_WINDOW_S = 300
REPLY_TOP_N = 15
COPY_PASTE_MIN_OCCURRENCES = 3
COPY_PASTE_WINDOW_S = 60
COPY_PASTE_TOP_N = 10
MIN_PLAUSIBLE_AVG_MESSAGE_LEN = 3.0
MAX_PLAUSIBLE_AVG_MESSAGE_LEN = 400.0
LORENZ_FRACTIONS = (0.01, 0.05, 0.10, 0.25, 0.50)
TOP_SHARE_FRACTION = 0.10
CHATTER_QUANTILES = (0.50, 0.75, 0.90, 0.95, 0.99)
BOT_MIN_MESSAGES = 50
BOT_TOP_N = 50
BOT_WEIGHTS = {"regular_interval": 0.4, "low_diversity": 0.4, "command_spam": 0.2}
BOT_MAX_GAP_STD_S = 5.0
BOT_MAX_DIVERSITY = 0.3
BOT_MIN_COMMAND_RATIO = 0.5
COHORT_MAX_WEEKS = 8
BIN_MINUTES = 5
TREND_HALF_WIDTH = 3
MIN_TREND_DAYS = 7
SUMMARY_LIST_SIZE = 10
SUMMARY_TOP_SIZE = 5
MOVERS_TOP_N = 5
SUGGESTION_LIMIT = 20

# Freshness of stored months.
LIVE_TTL_S = 15 * 60
IMMUTABLE_MARGIN_S = 60 * 60
REFRESH_OVERLAP_MINUTES = 10
