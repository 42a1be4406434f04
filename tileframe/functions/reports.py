"""Reports in Markdown, made from templates that become one column expression: {name} is a column of a statistics record,
{name:,} with thousands separated, {name:.1f} with a decimal."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import TIERS, TIMELINES

FIELD = re.compile(r"\{(\w+)(?::([^}]*))?\}")

#: One summary for each tier.
SUMMARIES = (
    "Hardly any building shows damage: {destroyed:,} of {total_buildings:,} are lost. Keep the results on record.",
    "Damage is confined to a few places: {damaged:,} of {total_buildings:,} buildings. One team can confirm it.",
    "Damage is spread over the area: {damaged:,} buildings, {destroyed:,} of them lost. Several teams are needed.",
    "Large parts of the area are hit: {damaged:,} buildings damaged, {destroyed_pct:.1f} % lost. Help from outside is needed.",
    "Most of the area is lost: {destroyed:,} of {total_buildings:,} buildings ({destroyed_pct:.1f} %). Plan for a long recovery.",
)
COUNTS = (
    "| Class | Buildings | Share |",
    "|-|-|-|",
    "| No damage | {no_damage:,} | {no_damage_pct:.1f} % |",
    "| Minor | {minor_damage:,} | {minor_damage_pct:.1f} % |",
    "| Major | {major_damage:,} | {major_damage_pct:.1f} % |",
    "| Destroyed | {destroyed:,} | {destroyed_pct:.1f} % |",
)
PATTERN = (
    "# Damage pattern",
    "",
    "**Severity:** {severity}",
    "",
    *COUNTS,
    "",
    "- Prevailing class: {dominant}",
    "- Of the damaged buildings {skew_pct:.1f} % are destroyed: {skew}",
    "- Confidence: {note}",
)
SITUATION = (
    "# Situation report",
    "",
    "## Summary",
    "{summary}",
    "",
    "## Figures",
    *COUNTS,
    "",
    "- Area of major damage: {major_area:.1f} m2",
    "- Area of destroyed buildings: {destroyed_area:.1f} m2",
)
RESPONSE = ("# Response priorities", "", "**Severity:** {severity}", "**Time:** {timeline}", "", "{action_list}")
PAGE = "<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>{title}</title></head>\n<body>\n<p>{made}</p>\n{body}\n</body></html>"


def filled(template: str) -> Column:
    """The template's text with the columns that it names."""
    parts, at = [], 0
    for m in FIELD.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        value = F.col(m[1])
        parts.append(F.format_number(value, 0) if m[2] == "," else F.format_string(f"%{m[2]}", value.cast("double")) if m[2] else value.cast("string"))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def lines(template: tuple[str, ...]) -> Column:
    return F.concat_ws("\n", *(filled(line) for line in template))


def by_tier(texts: tuple[str, ...]) -> Column:
    """Of a text for each tier the one of the record's tier, filled."""
    out = F.when(F.col("tier") == 0, filled(texts[0]))
    for k, text in enumerate(texts[1:], 1):
        out = out.when(F.col("tier") == k, filled(text))
    return out


def summary() -> Column:
    return by_tier(SUMMARIES)


def response_columns(plan: tuple[tuple[str, ...], ...]) -> dict[str, Column]:
    """timeline and action_list of a record by its tier."""
    return {"timeline": by_tier(TIMELINES), "action_list": by_tier(tuple("\n".join(f"- {a}" for a in plan[k]) for k in range(len(TIERS))))}


def page(title: Column, body: Column, at: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """A report's HTML page with the time it was made, in the session's time zone."""
    head, rest = PAGE.split("{title}")
    middle, rest = rest.split("{made}")
    before, after = rest.split("{body}")
    return F.concat(F.lit(head), title, F.lit(middle), F.date_format(at, pattern), F.lit(before), body, F.lit(after))
