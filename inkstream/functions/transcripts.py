"""Replies of image recognisers that may hold more than the page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trim

#: Marks, phrases and limits that recognisers' replies are held against.
NO_TEXT = "[[NO_TEXT]]"
INSTRUCTIONS = ["you are an ocr engine", "the exact characters visible in the image", "never add labels, headings, categories", "stop exactly where the page stops"]
COMMENTS = [
    r"(?i)\bas an ai\b",
    r"(?i)\bi (?:cannot|can'?t|can not|am unable to) (?:read|transcribe|make out|decipher|provide|assist|help|process|extract)\b",
    r"(?i)\bunable to (?:read|transcribe|extract|make out|decipher) (?:the|this|any)\b",
]
EDGE_COMMENTS = [
    r"(?i)\bi(?:'m| am) sorry\b",
    r"(?i)\b(?:the|this) (?:image|picture|photo|scan|page|document) (?:shows|show|depicts|appears|contains|seems|is a|is an)\b",
    r"(?i)\bhere (?:is|are) the (?:transcription|transcribed|text|content)\b",
    r"(?i)\bno (?:readable |legible |visible |discernible )?text (?:is |was |can be )?(?:visible|present|found|detected|seen|read)\b",
    r"(?i)\bi (?:don'?t|do not) (?:see|have) (?:any )?(?:readable )?text\b",
]
OPENER = r"(?i)^(?:sure|certainly|of course|okay|ok|alright)?[,.!:]?\s*(?:here(?:'s| is| are)\b|below (?:is|are)\b|the following is\b|transcription\b|transcribed text\b|ocr(?: output| result)?\b)"
SUBJECT = r"(?i)\b(?:transcription|transcribed|text|image|page|content|document|ocr)\b"
LABEL = r"(?mdi)^[ \t]*(?:title|subtitle|heading|header|footer|body[ \t]*text|running[ \t]*head|page(?:[ \t]*number)?|caption)[ \t]*:[ \t]*"
PAGE_CHARS, EDGE_CHARS, OPENER_CHARS, CONFIDENCE, INVENTED = 8000, 240, 120, 0.45, 0.8


def _any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def without_marks(c: Column) -> Column:
    """Without heading marks, doubled emphasis and code quotes; single stars and underlines stay."""
    for pattern in (r"(?md)^[ \t]{0,3}(#{1,6})[ \t]+", r"\*\*([^*]+)\*\*", r"__([^_]+)__", r"`{1,3}([^`\n]+)`{1,3}"):
        c = F.regexp_replace(c, pattern, "" if "#" in pattern else "$1")
    return c


def sanitise(replies: DataFrame, text: str, most: int = PAGE_CHARS) -> DataFrame:
    """Adds ``transcript, accepted, confidence, guards`` to recogniser replies.

    A fence, marks of formatting, an opening phrase and invented labels come
    off, and the guards say so.  A reply that is too long, repeats its
    instructions, talks about the page or holds an opening phrase alone is
    refused.  A null or blank reply and the mark for no text are a blank page,
    which is accepted with confidence 0.
    """
    c = F.col
    fence = r"(?s)^```[^\n]*\n(.*?)\n?```$"
    rows = replies.withColumn("_raw", trim(F.coalesce(c(text), F.lit("")))).withColumn("_fence", c("_raw").rlike(fence))
    rows = rows.withColumn("_t", F.when(c("_fence"), trim(F.regexp_extract("_raw", fence, 1))).otherwise(c("_raw")))
    echoed = reduce(lambda a, b: a | b, [F.contains(F.lower("_t"), F.lit(i)) for i in INSTRUCTIONS])
    rest = trim(F.replace(c("_t"), F.lit(NO_TEXT), F.lit(" ")))
    early = F.when(c("_t") == "", "blank_page").when(F.length("_t") > most, "over_long").when(echoed, "prompt_echo").when(rest == "", "blank_page")
    rows = rows.withColumns({"_early": early, "_rest": F.when(F.contains(c("_t"), F.lit(NO_TEXT)), rest).otherwise(c("_t"))})
    rows = rows.withColumn("_plain", F.when(c("_early").isNull(), without_marks(c("_rest"))))
    head = trim(F.substring_index("_plain", "\n", 1))
    tail = F.when(F.contains(c("_plain"), F.lit("\n")), F.regexp_replace("_plain", r"(?s)^[^\n]*\n", "")).otherwise("")
    rows = rows.withColumns({"_head": head, "_tail": tail, "_lead": F.regexp_extract(head, r"^([^:：]*)[:：]", 1)})
    opens = c("_head").rlike(OPENER) & c("_head").rlike(SUBJECT)
    split = c("_head").rlike("[:：]") & (F.length("_lead") <= OPENER_CHARS)
    same = F.regexp_replace("_head", r"^[^:：]*[:：]\s*", "")
    after = F.regexp_replace(F.array_join(F.filter(F.array(F.when(split, same).otherwise(""), c("_tail")), lambda x: x != ""), "\n"), r"^\s+", "")
    rows = rows.withColumn("_opens", F.coalesce(opens & (split | (F.length("_head") <= OPENER_CHARS)), F.lit(False)))
    rows = rows.withColumn("_body", F.when(c("_opens"), after).otherwise(c("_plain"))).withColumn("_labels", F.coalesce(c("_body").rlike(LABEL), F.lit(False)))
    rows = rows.withColumn("_text", trim(F.regexp_replace("_body", LABEL, "")))
    edges = F.when(F.length("_text") <= 2 * EDGE_CHARS, c("_text")).otherwise(F.concat(F.left("_text", F.lit(EDGE_CHARS)), F.lit("\n"), F.right("_text", F.lit(EDGE_CHARS))))
    late = F.when(c("_opens") & (trim(c("_body")) == ""), "meta_commentary").when(c("_text") == "", "blank_page").when(_any(c("_text"), COMMENTS) | _any(edges, EDGE_COMMENTS), "meta_commentary")
    rows = rows.withColumn("_verdict", F.coalesce("_early", late))
    noted = [F.when(c("_fence"), "code_fence_stripped"), F.when(c("_plain") != c("_rest"), "markdown_stripped"), F.when(c("_opens"), "preamble_stripped"), F.when(c("_labels"), "structural_labels_stripped"), c("_verdict")]
    confidence = F.when(c("_verdict").isNotNull(), 0.0).when(c("_opens") | c("_labels"), CONFIDENCE * INVENTED).otherwise(CONFIDENCE)
    out = {"transcript": F.when(c("_verdict").isNull(), c("_text")).otherwise(""), "accepted": c("_verdict").isNull() | (c("_verdict") == "blank_page"), "confidence": confidence, "guards": F.array_compact(F.array(*noted))}
    return rows.withColumns(out).select(*replies.columns, *out)
