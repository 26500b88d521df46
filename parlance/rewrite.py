"""Rewriting of utterances before planning: a canonical form for holdings, and a guarded provider rewrite."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .functions.text import tokens
from .plans.planner import OWNED
from .providers import Provider

_QUERY = re.compile(r"(?is)^\s*(select|with|insert|update|delete|create|drop)\b|[{}]|;\s*$")
_AGGREGATE = re.compile(r"(?i)\b(count|how many|number of|sum|total|average|avg|maximum|minimum|max|min)\b")


@dataclass
class Rewrite:
    text: str
    changed: bool
    reason: str = ""


def canonical(text: str) -> str:
    """`how many X i own` and its like as one sentence; other texts as they are."""
    m = OWNED.search(text.lower())
    return f"how many {m[1]} do i own" if m else text


def guarded(original: str, made: str) -> str:
    """Why a rewrite is refused, or nothing: it must be a question, keep numbers and aggregates, and most words."""
    if not made.strip():
        return "empty"
    if _QUERY.search(made):
        return "query text"
    if sorted(re.findall(r"\d+(?:\.\d+)?", original)) != sorted(re.findall(r"\d+(?:\.\d+)?", made)):
        return "numbers differ"
    if bool(_AGGREGATE.search(original)) != bool(_AGGREGATE.search(made)):
        return "intent differs"
    a, b = set(tokens(original)), set(tokens(made))
    if a and len(a & b) / len(a) < 0.3:
        return "too few words kept"
    return ""


def rewrite(text: str, provider: Provider | None = None) -> Rewrite:
    """The canonical text, rewritten by the provider if it passes the guards."""
    base = canonical(text)
    if provider is None:
        return Rewrite(base, base != text)
    try:
        made = provider.complete("Rewrite the question plainly. Keep its meaning and its numbers.", base).strip().strip('"')
    except RuntimeError as e:
        return Rewrite(base, base != text, str(e))
    why = guarded(base, made)
    return Rewrite(base, base != text, why) if why else Rewrite(made, made != text)
