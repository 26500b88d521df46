"""Synthetic variants of questions: rewriting plugins by domain, ranked by confidence and novelty."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .evaluate import Example
from .functions.text import tokens
from .plans.catalog import Catalog

Plugin = Callable[[str], list[str]]
#: Substitutions by domain.
SWAPS: dict[str, dict[str, tuple[str, ...]]] = {
    "generic": {"show": ("list", "display", "give me"), "list": ("show", "display"), "how many": ("count of", "number of"), "top": ("first",), "with": ("having",)},
    "portfolio": {"holdings": ("positions",), "positions": ("holdings",), "shares": ("units",)},
    "banking": {"accounts": ("bank accounts",), "transactions": ("payments",), "balance": ("account balance",)},
    "crm": {"customers": ("clients",), "clients": ("customers",), "deals": ("opportunities",)},
    "healthcare": {"patients": ("people in care",), "visits": ("appointments",)},
    "ecommerce": {"orders": ("purchases",), "products": ("items",), "cart": ("basket",)},
}
MARKS = {d: set(w for k, vs in s.items() for p in (k, *vs) for w in p.split()) for d, s in SWAPS.items() if d != "generic"}
CONFIDENCE_WEIGHT, NOVELTY_WEIGHT = 0.6, 0.4
_FRAMES = ("please {}", "could you {}", "{} please", "I want to {}")


def domain(text: str, catalog: Catalog | None = None) -> str:
    """The domain with most marks in the question and the catalog; generic if none has any."""
    words = set(tokens(text)) | {w for e in (catalog.entities if catalog else ()) for w in tokens(e)}
    best = max(MARKS, key=lambda d: (len(MARKS[d] & words), -list(MARKS).index(d)))
    return best if MARKS[best] & words else "generic"


def swapper(name: str) -> Plugin:
    def swap(text: str) -> list[str]:
        out = []
        for old, news in SWAPS[name].items():
            for new in news:
                made = re.sub(rf"\b{old}\b", new, text, flags=re.I)
                if made != text:
                    out.append(made)
        return out

    return swap


def framed(text: str) -> list[str]:
    return [f.format(text[0].lower() + text[1:] if text else text) for f in _FRAMES]


PLUGINS: dict[str, Plugin] = {**{name: swapper(name) for name in SWAPS}, "frame": framed}


def distance(a: str, b: str) -> float:
    """One less the Jaccard similarity of the words."""
    x, y = set(tokens(a)), set(tokens(b))
    return 1 - len(x & y) / len(x | y) if x | y else 0.0


def known_enough(text: str, lexicon: set[str]) -> bool:
    """At most a third of the words may be unknown."""
    words = tokens(text)
    return not lexicon or not words or sum(w not in lexicon for w in words) * 3 <= len(words)


def rank(confidence: float, novelty: float) -> float:
    return min(1.0, max(0.0, CONFIDENCE_WEIGHT * confidence + NOVELTY_WEIGHT * novelty))


def variants(text: str, n: int = 3, plugins: Iterable[str | Plugin] = ("generic", "frame"), lexicon: set[str] | None = None, score: Callable[[str], float] | None = None, seed: int = 7) -> list[tuple[str, float]]:
    """The n best (text, rank) of the plugins' rewrites; equal ranks are shuffled by the seed."""
    made = dict.fromkeys(v for p in plugins for v in (PLUGINS[p] if isinstance(p, str) else p)(text) if v.strip().lower() != text.strip().lower())
    base = lexicon or set()
    kept = [v for v in made if known_enough(v, base)]
    random.Random(seed).shuffle(kept)
    return sorted(((v, rank(score(v) if score else 0.5, distance(v, text))) for v in kept), key=lambda x: -x[1])[:n]


def augment(examples: Iterable[Example], n: int = 3, **options) -> list[Example]:
    """The examples and their variants, which keep the expected query and tell their origin."""
    out = []
    for e in examples:
        out.append(e)
        names = options.get("plugins") or ("generic", domain(e.text), "frame")
        for text, value in variants(e.text, n, dict.fromkeys(names), options.get("lexicon"), options.get("score"), options.get("seed", 7)):
            out.append(replace(e, text=text, metadata={**e.metadata, "origin": e.text, "rank": round(value, 4)}))
    return out


def spread(questions: DataFrame, n: int = 3) -> DataFrame:
    """Variants of a table (req_id, text) in bulk: req_id, variant, text, rank. Each row is done where it lies."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(r, i, v, s) for r, t in zip(pdf["req_id"], pdf["text"], strict=True) for i, (v, s) in enumerate(variants(t or "", n, dict.fromkeys(("generic", domain(t or ""), "frame"))))]
            yield pd.DataFrame(rows, columns=["req_id", "variant", "text", "rank"])

    return questions.mapInPandas(run, "req_id long, variant int, text string, rank double")
