"""Stored JSON documents of any shape: a book's structure and a task's script data, read through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def document(body: Column) -> Column:
    """A JSON object as VARIANT; null for what is no JSON or no object, and never an error."""
    return let(F.try_parse_json(body), lambda v: F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), v))


def structure(body: Column) -> Column:
    """``title, author, language, chapters, blocks`` of a book's structure; null where it cannot be read.

    Fields that are missing, or hold something else than they should, are null
    or empty; entries that are no objects are left out.  Chapters are
    ``id, title, level, order``, blocks ``id, chapter_id, kind, level, order, text``.
    """
    whole = lambda e, path: F.try_variant_get(e, path, "int")
    objects = lambda items: F.filter(items, lambda e: F.try_variant_get(e, "$", "map<string,variant>").isNotNull())

    def read(v: Column) -> Column:
        chapters = F.transform(objects(_items(v, "$.chapters")), lambda e: F.struct(_text(e, "$.id").alias("id"), _text(e, "$.title").alias("title"), whole(e, "$.level").alias("level"), whole(e, "$.order").alias("order")))
        blocks = F.transform(
            objects(_items(v, "$.blocks")),
            lambda e: F.struct(_text(e, "$.id").alias("id"), F.coalesce(_text(e, "$.chapterId"), _text(e, "$.chapter_id")).alias("chapter_id"), _text(e, "$.kind").alias("kind"), whole(e, "$.level").alias("level"), whole(e, "$.order").alias("order"), _text(e, "$.text").alias("text")),
        )
        return F.when(v.isNotNull(), F.struct(_text(v, "$.title").alias("title"), _text(v, "$.author").alias("author"), _text(v, "$.language").alias("language"), chapters.alias("chapters"), blocks.alias("blocks")))

    return let(document(body), read)


def script_data(body: Column) -> Column:
    """``script, search_terms, params, material_sources, more`` of a task's script data; params, sources and other fields stay VARIANT."""

    def read(v: Column) -> Column:
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        known = ("script", "search_terms", "params", "material_sources")
        terms = F.filter(F.transform(_items(v, "$.search_terms"), lambda e: _text(e, "$")), lambda t: t.isNotNull())
        more = F.map_filter(fields, lambda k, _: ~k.isin(*known))
        return F.when(v.isNotNull(), F.struct(_text(v, "$.script").alias("script"), terms.alias("search_terms"), F.try_variant_get(v, "$.params", "variant").alias("params"), _items(v, "$.material_sources").alias("material_sources"), more.alias("more")))

    return let(document(body), read)


def patched_script(body: Column, change: Column) -> Column:
    """Script data as JSON with a change's fields over its own; what cannot be read counts as empty."""
    fields = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    new = fields(change)
    return F.to_json(F.map_concat(F.map_filter(fields(body), lambda k, _: ~F.map_contains_key(new, k)), new))
