import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parley import session  # noqa: E402
from parley.schema import MESSAGES  # noqa: E402

START = datetime(2024, 1, 15, 10, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.build(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions=4,
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def chat(spark):
    """Messages from (user, text, seconds after the start or a time[, extra columns]) rows."""

    def make(*rows, **common):
        out = []
        for i, row in enumerate(rows):
            user, text, when, *rest = row
            extra = {**common, **(rest[0] if rest else {})}
            ts = when if isinstance(when, datetime) else START + timedelta(seconds=when)
            out.append(
                (
                    extra.get("id", f"m{i:04d}"),
                    ts,
                    extra.get("user_id", user),
                    user,
                    text,
                    extra.get("emotes"),
                    extra.get("role", "regular"),
                    extra.get("channel", "chan"),
                )
            )
        return spark.createDataFrame(out, MESSAGES)

    return make


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)


def one(df, *columns):
    found = rows(df, *columns)
    assert len(found) == 1, found
    return found[0] if len(found[0]) > 1 else found[0][0]
