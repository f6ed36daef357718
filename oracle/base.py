"""Helpers to write the checking SQL: bridge views as CTEs and number rules."""
from __future__ import annotations

import re

from parley.sources import bridge_sql

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _plain(text: str) -> str:
    """The same text with table markers removed and escapes undone."""
    text = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text)
    return text.replace("{{", "{").replace("}}", "}").replace("TIMESTAMP_NTZ", "TIMESTAMP").strip()


VIEWS = {name: _plain(text) for name, (_, text) in bridge_sql.VIEWS.items()}
VIEWS["chat_logs"] = (
    "select * exclude (event_id), cast(row_number() over (partition by session_id order by timestamp, event_id)"
    f" as bigint) as turn_number from ({_plain(bridge_sql.CHAT_LOGS)})")
ORDER = ["ev", "chat_turns_raw", "chat_logs", *[v for v in VIEWS if v not in ("ev", "chat_turns_raw", "chat_logs")]]


def register(name: str, text: str) -> None:
    """A further named view usable in later oracle texts."""
    VIEWS[name] = text.strip()
    ORDER.append(name)


def needs(text: str) -> set[str]:
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\b\w+\b", todo.pop()))
        for name in words & set(VIEWS) - found:
            found.add(name)
            todo.append(VIEWS[name])
    return found


def q(text: str) -> str:
    """``text`` preceded by the bridge views it uses."""
    used = needs(text)
    ctes = [f"{name} AS (\n{VIEWS[name]}\n)" for name in ORDER if name in used]
    if not ctes:
        return text
    text = text.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(head):
            return head + ",\n".join(ctes) + ",\n" + text[len(head):]
    return "WITH " + ",\n".join(ctes) + "\n" + text


def r(x: str, n: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,10)), {n}) AS DOUBLE)"


def cnt(p: str) -> str:
    return f"count(*) FILTER (WHERE {p})"


def pct(p: str, n: int = 2) -> str:
    return r(f"{cnt(p)}*100.0/nullif(count(*),0)", n)


def ia(c: str) -> str:
    return f"CAST(floor(avg({c}) + 0.5) AS BIGINT)"


def ia0(c: str) -> str:
    return ia(f"coalesce({c},0)")


def a0(c: str, n: int) -> str:
    return r(f"avg(coalesce({c},0))", n)


def pc(c: str, p: float) -> str:
    return f"CAST(quantile_disc({c}, {p}) AS BIGINT)"


def share(n: int = 2) -> str:
    return r("count(*)*100.0/sum(count(*)) OVER ()", n)


def win(days: int = 30, ts: str = "timestamp") -> str:
    return f"{ts} >= {AS_OF} - INTERVAL {days} DAY"


DATE = "CAST(timestamp AS DATE) AS date"
SESS = "count(DISTINCT session_id)"
