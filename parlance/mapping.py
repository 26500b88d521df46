"""Alias mappings from a catalog and from the data itself."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import label, tokens
from .operators.compile import name
from .plans.catalog import Catalog, plural, singular


def profile(df: DataFrame, most: int = 200) -> DataFrame:
    """(field, alias, value): the distinct values of every string column that has at most `most` of them.

    One pass counts all columns' values together with map-side partial sums; a column with more is left out whole.
    """
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not columns:
        return df.sparkSession.createDataFrame([], "field string, alias string, value string")
    sizes = df.agg(*[F.approx_count_distinct(name(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    likely = [c for i, c in enumerate(columns) if sizes[i] <= 2 * most + 10]
    if not likely:
        return df.sparkSession.createDataFrame([], "field string, alias string, value string")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(name(c)).alias("value")) for c in likely])).alias("p")).select("p.*")
    values = pairs.where("value IS NOT NULL").distinct()
    few = values.groupBy("field").count().where(F.col("count") <= most).select("field")
    return values.join(few, "field").select("field", F.lower("value").alias("alias"), "value")


def variants(phrase: str) -> list[str]:
    """Spellings of a name: words, snake, camel, singular and plural, and the initials of three words or more."""
    words = tokens(phrase)
    if not words:
        return []
    spaced = " ".join(words)
    out = [spaced, "_".join(words), words[0] + "".join(w.title() for w in words[1:]), " ".join(label(phrase))]
    out += [" ".join([*words[:-1], f(words[-1])]) for f in (singular, plural)]
    if len(words) >= 3:
        out.append("".join(w[0] for w in words))
    return list(dict.fromkeys(v for v in out if v and v != phrase))


def generate(catalog: Catalog, tables: Mapping[str, DataFrame] | None = None, overrides: Mapping[str, Any] | None = None, most: int = 200) -> dict[str, Any]:
    """A mapping with the provenance of every alias. Overrides win; an alias of two names is left out."""
    sections: dict[str, dict[str, str]] = {"entities": {}, "fields": {}}
    origin: dict[str, str] = {}
    seen: dict[tuple[str, str], set[str]] = {}
    for section, names in (("entities", catalog.entities), ("fields", sorted({c for e in catalog.entities for c in catalog.columns(e)}))):
        for n in names:
            for v in variants(n):
                seen.setdefault((section, v.lower()), set()).add(n)
    for (section, alias), names in seen.items():
        if len(names) == 1:
            sections[section][alias] = next(iter(names))
            origin[f"{section}.{alias}"] = "name"
    values: dict[str, dict[str, str]] = {}
    for df in (tables or {}).values():
        for r in profile(df, most).collect():
            values.setdefault(r["field"], {})[r["alias"]] = r["value"]
            origin[f"filter_values.{r['field']}.{r['alias']}"] = "data"
    out: dict[str, Any] = {**sections, "filter_values": values}
    for section, own in (overrides or {}).items():
        for k, v in own.items():
            out.setdefault(section, {})[k] = {**out.get(section, {}).get(k, {}), **v} if isinstance(v, Mapping) else v
            origin[f"{section}.{k}"] = "override"
    return out | {"provenance": origin}


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")
