"""Text and data out of model replies kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = "array<struct<type:string,content:array<struct<type:string,text:string>>>>"
BLOCK = r"\{[\s\S]*\}|\[[\s\S]*\]"


def reply_text(reply: Column) -> Column:
    """Answer text of a reply in any of its four shapes; null if there is none."""
    v = F.try_parse_json(reply)
    outputs = F.filter(
        F.try_variant_get(v, "$.steps", STEPS), lambda s: s["type"] == "model_output")
    last = F.try_element_at(outputs, F.lit(-1))
    parts = F.filter(last["content"], lambda c: (c["type"] == "text") & c["text"].isNotNull())
    joined = F.array_join(F.transform(parts, lambda c: c["text"]), "")
    return F.coalesce(
        F.when(joined != "", joined),
        F.try_variant_get(v, "$.interaction.output_text", "string"),
        F.try_variant_get(v, "$.output_text", "string"),
        F.try_variant_get(v, "$.candidates[0].content.parts[0].text", "string"),
    )


def recover_json(text: Column) -> Column:
    """The JSON a text is, or holds amid prose; a null variant if it has none."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, BLOCK, 0)))
