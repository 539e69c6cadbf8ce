"""Validated parameters of a statistics run."""

from __future__ import annotations

from dataclasses import MISSING, Field, dataclass, field, fields, replace
from datetime import datetime, timedelta

# Section toggles and their defaults.
DEFAULT_ON = (
    "commands", "links", "mentions", "duplicates", "sessions", "concentration", "message_class",
    "new_returning", "emote_pairs", "engagement", "anomalies", "copy_paste_chains",
)
DEFAULT_OFF = (
    "phrases", "language", "mention_graph", "mutual_mentions", "emote_centrality", "emote_entropy", "lorenz",
    "bot_scores", "length_trend", "cohort_retention", "language_by_day", "quote_replies", "staff_list",
    "subscriber_list",
)

# Presets. Each names the sections it switches off or on.
_QUICK_OFF = (
    "concentration", "new_returning", "emote_pairs", "anomalies", "copy_paste_chains", "staff_list",
    "subscriber_list",
)
_EVERYTHING_ON = (
    "phrases", "mention_graph", "mutual_mentions", "emote_centrality", "emote_entropy", "lorenz", "bot_scores",
    "length_trend", "cohort_retention", "quote_replies",
)
PRESETS = ("quick", "standard", "everything")
COMPARISON_MODES = ("previous_period", "previous_week", "previous_month", "previous_year", "custom")


def _number(default, low, high):
    """A parameter between two bounds, both allowed."""
    return field(default=default, metadata={"low": low, "high": high})


def _choice(default: str, *others: str):
    """A parameter that is one of some words."""
    return field(default=default, metadata={"choices": (default, *others)})


def default_sections() -> frozenset[str]:
    return frozenset(DEFAULT_ON)


def preset_sections(preset: str, current: frozenset[str] | None = None) -> frozenset[str]:
    """Sections of a preset. Language sections are in no preset and stay as they are."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    base = set(DEFAULT_ON) | {"staff_list", "subscriber_list"}
    base |= {"language", "language_by_day"} & set(current or ())
    if preset == "quick":
        return frozenset(base - set(_QUICK_OFF))
    return frozenset(base | (set(_EVERYTHING_ON) if preset == "everything" else set()))


def unique_channels(names) -> tuple[str, ...]:
    """Trimmed names without blanks and without case-insensitive repeats, first spelling kept."""
    kept = {}
    for name in (n.strip() for n in names):
        if name:
            kept.setdefault(name.lower(), name)
    return tuple(kept.values())


@dataclass(frozen=True)
class Params:
    from_date: datetime
    to_date: datetime
    channels: tuple[str, ...] = ()
    channel: str | None = None
    channel_id_type: str = _choice("channel", "channelid")
    user: str | None = None
    user_id_type: str = _choice("user", "userid")
    user_everywhere: bool = False
    top_n: int = _number(20, 5, 100)
    top_words_n: int = _number(50, 10, 200)
    top_emotes_n: int = _number(50, 10, 200)
    top_phrases_n: int = _number(20, 0, 50)
    sections: frozenset[str] = field(default_factory=default_sections, metadata={"choices": (*DEFAULT_ON, *DEFAULT_OFF)})
    session_gap_minutes: int = _number(15, 2, 120)
    anomaly_sigma: float = _number(3.0, 1.0, 6.0)
    max_range_days: int = _number(366, 1, 3660)
    compare_previous: bool = False
    comparison_mode: str = _choice(*COMPARISON_MODES)
    compare_from_date: datetime | None = None
    compare_to_date: datetime | None = None

    def __post_init__(self):
        names = unique_channels(self.channels or ((self.channel,) if self.channel else ()))
        if not 1 <= len(names) <= 3:
            raise ValueError(f"between one and three channels are needed; got {len(names)}")
        object.__setattr__(self, "channels", names)
        object.__setattr__(self, "channel", names[0] if len(names) == 1 else None)
        object.__setattr__(self, "sections", frozenset(self.sections))
        for f in fields(self):
            _check(f, getattr(self, f.name))
        if self.from_date >= self.to_date:
            raise ValueError("from_date must be before to_date")
        if (self.to_date - self.from_date).days > self.max_range_days:
            raise ValueError(f"the range is longer than {self.max_range_days} days")
        if self.user is not None and not self.user.strip():
            raise ValueError("user must not be blank")
        if self.comparison_mode == "custom":
            low, high = self.compare_from_date, self.compare_to_date
            if low is None or high is None or low >= high:
                raise ValueError("a custom comparison needs two ordered dates")

    def on(self, *sections: str) -> bool:
        return any(s in self.sections for s in sections)

    def with_preset(self, preset: str) -> Params:
        return replace(self, sections=preset_sections(preset, self.sections))

    def comparison_window(self) -> tuple[datetime, datetime]:
        """The [from, to) window to compare with."""
        start = self.from_date
        if self.comparison_mode == "custom":
            return self.compare_from_date, self.compare_to_date
        if self.comparison_mode == "previous_year":
            leap_day = (start.month, start.day) == (2, 29)
            return start.replace(year=start.year - 1, day=28 if leap_day else start.day), start
        days = {"previous_week": timedelta(days=7), "previous_month": timedelta(days=30)}
        return start - days.get(self.comparison_mode, self.to_date - start), start


def _check(f: Field, value) -> None:
    """Raise ValueError where a value breaks what its field says."""
    if "low" in f.metadata and not f.metadata["low"] <= value <= f.metadata["high"]:
        raise ValueError(f"{f.name} must be between {f.metadata['low']} and {f.metadata['high']}")
    if "choices" in f.metadata:
        unknown = (set(value) if isinstance(value, frozenset) else {value}) - set(f.metadata["choices"])
        if unknown:
            raise ValueError(f"unknown {f.name}: {', '.join(sorted(map(str, unknown)))}")


def schema() -> list[dict]:
    """Name, type, default, bounds and choices of every parameter, from the fields that are validated; ``required`` ones have no default."""
    out = []
    for f in fields(Params):
        default = f.default if f.default_factory is MISSING else sorted(f.default_factory())
        limits = {"minimum": f.metadata.get("low"), "maximum": f.metadata.get("high"), "choices": list(f.metadata.get("choices", ())) or None}
        required = default is MISSING
        out.append({"name": f.name, "type": str(f.type), "required": required, "default": None if required else default, **limits})
    return out
