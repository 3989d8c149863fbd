"""Listings, excerpts and captions to publish, and settings read from what people typed or services stored."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .text import ass_escape, ass_time, clamp, fnv1a, tags_stopping, trim

TITLE_CHARS, DESCRIPTION_CHARS, TAGS, TAG_CHARS, ALL_TAGS_CHARS = 100, 5000, 12, 100, 500
EXCERPT_CHARS, PASSAGE_CHARS = 4000, 7000
#: Services that a voice name begins with, and names that ask for no voice.
SERVICES = ["siliconflow", "gemini", "mimo", "elevenlabs", "chatterbox", "kokoro"]
NO_VOICE = ["no-voice", "none"]


def one_line(c: Column) -> Column:
    return trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def within_chars(texts: Column, most: int, extra: int, least: int = 0) -> Column:
    """Texts on one line each while more than ``least`` characters are left; the one that crosses is cut and marked, and is the last.

    Each text uses its length and ``extra`` characters.
    """
    lines = F.filter(F.transform(texts, one_line), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(s: Column, x: Column) -> Column:
        left = F.lit(most) - s["used"]
        over = F.length(x) > left
        cut = F.when(over, F.concat(F.regexp_replace(F.substring(x, F.lit(1), left), r"(?U)\s+$", ""), F.lit("…"))).otherwise(x)
        taken = F.struct(F.concat(s["out"], F.array(cut)).alias("out"), (s["used"] + F.length(cut) + extra).alias("used"), over.alias("full"))
        return F.when(s["full"] | (left <= least), F.struct(s["out"].alias("out"), s["used"].alias("used"), F.lit(True).alias("full"))).otherwise(taken)

    return F.aggregate(lines, start, add)["out"]


def excerpt(texts: Column, most: int = EXCERPT_CHARS) -> Column:
    """The excerpt of a segment that a listing is written from."""
    return F.array_join(within_chars(texts, most, 2), "\n\n")


def passage_lines(texts: Column, most: int = PASSAGE_CHARS) -> Column:
    """The lines of a passage that a short piece is written from."""
    return within_chars(texts, most, 16, 80)


def joined(texts: Column) -> Column:
    """Texts with a blank line between them, blank ones left out."""
    return F.array_join(F.filter(F.transform(texts, lambda x: trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), "\n\n")


def tag_list(items: Column, count: int = TAGS, budget: int = ALL_TAGS_CHARS, most: int = TAG_CHARS) -> Column:
    """Distinct tags of a list within a budget of characters; one that does not fit is passed over."""
    parts = F.transform(items, lambda x: trim(F.substring(one_line(F.regexp_replace(x, "^#+", "")), 1, most)))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"))

    def add(s: Column, x: Column) -> Column:
        fits = (x != "") & ~F.exists(s["out"], lambda y: F.lower(y) == F.lower(x)) & (s["used"] + F.length(x) <= budget) & (F.size(s["out"]) < count)
        return F.when(fits, F.struct(F.concat(s["out"], F.array(x)).alias("out"), (s["used"] + F.length(x) + 1).alias("used"))).otherwise(s)

    return F.aggregate(parts, start, add)["out"]


def _or(c: Column, default: str) -> Column:
    return trim(F.coalesce(F.nullif(c, F.lit("")), F.lit(default)))


def _credit(book: Column, author: Column) -> Column:
    quoted = F.concat(F.lit('"'), book, F.lit('"'))
    return F.when(author != "", F.concat(quoted, F.lit(" by "), author)).otherwise(quoted)


#: Texts of listings are fixed values, as readers see them.
def upload_title(title: Column, episode: Column) -> Column:
    """A title of at most 100 characters that ends with its episode: the head is shortened, an episode already there stays."""
    line = one_line(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s*[—–]\s*", " - "))
    suffix = F.concat(F.lit(" | Episode "), episode.cast("string"))
    room = F.lit(TITLE_CHARS) - F.length(suffix)
    head = F.when(F.length(line) <= room, line).otherwise(F.concat(F.rtrim(F.substring(line, F.lit(1), F.greatest(F.lit(1), room - 1))), F.lit("…")))
    return F.when(line == "", cut_title(F.concat(F.lit("Episode "), episode.cast("string")))).when(line.rlike(r"(?i)(?:^|\s)\|\s*Episode\s+\d+\s*$"), cut_title(line)).otherwise(F.concat(head, suffix))


def cut_title(title: Column, fallback: str = "Untitled video") -> Column:
    """One line of at most 100 characters, the last of them an ellipsis if it was cut."""
    line = one_line(F.coalesce(title, F.lit("")))
    line = F.when(line != "", line).otherwise(F.lit(fallback))
    return F.when(F.length(line) <= TITLE_CHARS, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, TITLE_CHARS - 1)), F.lit("…")))


def upload_listing(book: Column, author: Column, chapter: Column, episode: Column) -> Column:
    """``title, description, tags`` of a segment's upload for which none were written."""
    line = lambda c, default: F.coalesce(F.nullif(one_line(F.coalesce(c, F.lit(""))), F.lit("")), F.lit(default))
    book, author, chapter = line(book, "Untitled"), line(author, ""), line(chapter, "Chapter")
    title = upload_title(F.when(book == chapter, book).otherwise(F.concat(book, F.lit(" - "), chapter)), episode)
    text = F.concat(chapter, F.lit("\n\nFrom "), _credit(book, author), F.lit(".\n\n#audiobook #books"))
    named = F.transform(F.array(book, author, chapter, F.lit("audiobook"), F.lit("books")), lambda x: trim(F.regexp_replace(x, "^#", "")))
    return F.struct(title.alias("title"), F.substring(text, 1, DESCRIPTION_CHARS).alias("description"), tags_stopping(F.filter(named, lambda x: x != "")).alias("tags"))


def segment_listing(book: Column, author: Column, chapter: Column, episode: Column) -> Column:
    """``title, description, tags`` of a segment for which none were written; an episode of 1 or more is named."""
    book, author, chapter = _or(book, "Untitled"), _or(author, ""), _or(chapter, "Chapter")
    base = F.when(book == chapter, book).otherwise(F.concat(book, F.lit(" - "), chapter))
    named = F.when(F.coalesce(episode, F.lit(0)) > 0, F.concat(base, F.lit(" | Episode "), episode.cast("string"))).otherwise(base)
    title = clamp(one_line(F.regexp_replace(named, r"(?U)\s*[—–]\s*", " - ")), TITLE_CHARS)
    text = F.concat(chapter, F.lit("\n\nFrom "), _credit(book, author), F.lit(".\n\n#audiobook #books"))
    return F.struct(title.alias("title"), clamp(text, DESCRIPTION_CHARS).alias("description"), tag_list(F.array(book, author, chapter, F.lit("audiobook"), F.lit("books"))).alias("tags"))


def short_listing(book: Column, author: Column, title: Column, hook: Column, script: Column) -> Column:
    """``title, description, tags`` of a short piece for which none were written."""
    book, author, title, hook, script = _or(book, "Untitled"), _or(author, ""), _or(title, ""), _or(hook, ""), _or(script, "")
    sentence = F.element_at(F.split(script, r"[.。!！?？\n]"), 1)
    name = F.coalesce(*[F.nullif(x, F.lit("")) for x in (title, hook, sentence)], book)
    tease = F.when(hook != "", hook).otherwise(clamp(script, 280))
    text = F.concat(tease, F.lit("\n\nA teaser from "), _credit(book, author), F.lit(". Watch the full book video.\n\n#shorts #books #audiobook"))
    words = [F.lit(x) for x in ("audiobook", "booktok", "shorts", "book trailer")]
    return F.struct(clamp(name, TITLE_CHARS).alias("title"), clamp(text, DESCRIPTION_CHARS).alias("description"), tag_list(F.array(book, author, *words, title)).alias("tags"))


def finished_listing(reply: Column, fallback: Column, keeps_title: bool = False) -> Column:
    """``title, description, tags`` of a JSON reply, gaps filled from a fallback; null where the reply has nothing to say.

    Tags may be a list or one text; ``keeps_title`` takes the fallback's title whatever the reply calls it.
    """
    at = lambda *names: F.coalesce(*[F.get_json_object(reply, f"$.{n}") for n in names], F.lit(""))
    title, text = clamp(at("youtube_title", "title"), TITLE_CHARS), clamp(at("description", "caption"), DESCRIPTION_CHARS)
    raw = at("tags", "hashtags")
    tags = tag_list(F.coalesce(F.from_json(raw, "array<string>"), F.split(raw, r"[,;\n]+")))
    empty = (text == "") if keeps_title else (title == "") & (text == "")
    chosen = lambda x, y: F.when(x != "", x).otherwise(y)
    name = fallback["title"] if keeps_title else chosen(title, fallback["title"])
    full = F.struct(name.alias("title"), chosen(text, fallback["description"]).alias("description"), F.when(F.size(tags) > 0, tags).otherwise(fallback["tags"]).alias("tags"))
    return F.when(~empty, full)


#: Letters of titles and captions and the number of hashtags of each platform, and hashtags for any video.
PLATFORMS = {"tiktok": (100, 2200, 5), "youtube_shorts": (100, 5000, 6), "instagram_reels": (125, 2200, 8), "facebook_reels": (125, 2200, 5)}
ANY_VIDEO = ["#shorts", "#viral", "#trending", "#fyp", "#video", "#reels", "#creator", "#content"]


def _limits(platform: Column) -> Column:
    known = F.create_map(*[x for name, spec in PLATFORMS.items() for x in (F.lit(name), F.struct(*[F.lit(v).alias(k) for k, v in zip(("title", "caption", "tags"), spec)]))])
    return F.coalesce(F.try_element_at(known, F.lower(trim(F.coalesce(platform, F.lit(""))))), known["tiktok"])


def _cut(c: Column, most: Column) -> Column:
    t = trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) > most, F.regexp_replace(F.substring(t, F.lit(1), most), r"(?U)\s+$", "")).otherwise(t)


def social_metadata(reply: Column, platform: Column) -> Column:
    """``title, caption, hashtags`` of a JSON reply within a platform's limits; null where it has neither title nor caption.

    Hashtags may be a list or one text; letters, digits and underscores make one, and no two differ in case alone.
    """
    at = lambda name: F.coalesce(F.get_json_object(reply, f"$.{name}"), F.lit(""))

    def read(spec: Column) -> Column:
        raw = at("hashtags")
        given = F.coalesce(F.from_json(raw, "array<string>"), F.split(raw, r"[\s,]+"))
        tags = F.filter(F.transform(given, lambda x: F.regexp_replace(F.coalesce(x, F.lit("null")), r"[^\p{L}\p{N}_]", "")), lambda x: x != "")
        low = F.transform(tags, F.lower)
        first = F.filter(tags, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
        title, caption = _cut(at("title"), spec["title"]), _cut(at("caption"), spec["caption"])
        full = F.struct(title.alias("title"), caption.alias("caption"), F.slice(F.transform(first, lambda x: F.concat(F.lit("#"), x)), F.lit(1), spec["tags"]).alias("hashtags"))
        return F.when((title != "") | (caption != ""), full)

    return let(_limits(platform), read)


def social_fallback(subject: Column, script: Column, platform: Column) -> Column:
    """``title, caption, hashtags`` where no reply is to be had: the subject or the script's first sentence, and the script."""

    def made(spec: Column) -> Column:
        subject_, script_ = trim(F.coalesce(subject, F.lit(""))), trim(F.coalesce(script, F.lit("")))
        sentence = trim(F.element_at(F.split(script_, r"[.。!！?？\n]"), 1))
        title = F.coalesce(F.nullif(subject_, F.lit("")), F.nullif(sentence, F.lit("")), F.lit("Short video"))
        caption = F.when(script_ != "", _cut(script_, F.greatest(spec["caption"] - 60, F.lit(60)))).otherwise(F.concat(title, F.lit(" — watch to the end and follow for more.")))
        return F.struct(_cut(title, spec["title"]).alias("title"), _cut(caption, spec["caption"]).alias("caption"), F.slice(F.array(*map(F.lit, ANY_VIDEO)), F.lit(1), spec["tags"]).alias("hashtags"))

    return let(_limits(platform), made)


_CUE = "struct<index:double,start:double,end:double,text:string>"
CHUNKS = f"array<struct<index:double,hash:string,file:string,duration:double,codec:string,sampleRate:double,channels:double,cues:array<{_CUE}>>>"
MANIFEST = f"struct<version:int,chunks:{CHUNKS}>"


def manifest_chunks(body: Column, version: int = 1) -> Column:
    """The sound entries of a chunk manifest; null where it is no manifest of this version, and never an error."""
    parsed = F.from_json(body, MANIFEST, {"mode": "PERMISSIVE"})
    cue = lambda c: c["index"].isNotNull() & c["start"].isNotNull() & c["end"].isNotNull() & c["text"].isNotNull()
    name = lambda c: F.coalesce(c, F.lit(""))

    def sound(e: Column) -> Column:
        whole = (e["index"] >= 0) & (e["index"] == F.floor(e["index"]))
        named = (name(e["hash"]) != "") & (name(e["file"]) != "") & ~F.contains(name(e["file"]), F.lit("/"))
        told = e["codec"].isNotNull() & e["sampleRate"].isNotNull() & e["channels"].isNotNull() & e["cues"].isNotNull()
        return F.coalesce(whole & named & (e["duration"] > 0) & told & F.forall(e["cues"], cue), F.lit(False))

    return F.when((parsed["version"] == version) & parsed["chunks"].isNotNull(), F.filter(parsed["chunks"], sound))


def _literal(value: str) -> tuple[str, str]:
    try:
        found = ast.literal_eval(value)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        found = int(value) if value.isdecimal() else value
        kind = "integer" if isinstance(found, int) else "text"
    else:
        kind = next((name for types, name in _KINDS if isinstance(found, types)), "other")
    if kind == "list":
        found = sorted(found, key=repr) if isinstance(found, set) else list(found)
    return kind, json.dumps(found, ensure_ascii=False, separators=(",", ":"), default=repr)


_KINDS = [(type(None), "none"), (bool, "boolean"), (int, "integer"), (float, "float"), (str, "string"), ((list, tuple, set), "list"), (dict, "map")]


def typed(value: Column) -> Column:
    """``kind, json`` of a stored text: what literal it is (none, boolean, integer, float, string, list, map) and its value as JSON; else ``text``.

    Tuples and sets are lists, digits with leading zeros a number; null stays null.
    """

    @F.pandas_udf("kind string, json string")
    def decode(stored: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else _literal(x) for x in stored], columns=["kind", "json"])

    return decode(value.cast("string"))


def music_wanted(kind: Column, volume: Column) -> Column:
    """A kind of music is chosen and its volume is above nothing."""
    v = F.coalesce(volume.cast("double"), F.lit(0.0))
    return (trim(F.coalesce(kind, F.lit(""))) != "") & ~F.isnan(v) & (v > 0) & (v < float("inf"))


def extraction_outcome(blocks: Column, scanned: Column, recogniser: Column) -> Column:
    """``action, pages``: accept what has blocks, recognise the scanned pages in order if that is possible, else reject."""
    pages = F.array_sort(F.coalesce(scanned, F.array().cast("array<int>")))
    action = F.when(blocks > 0, "accept").when(F.size(pages) == 0, "reject").when(~recogniser, "reject: recogniser off").otherwise("recognise")
    return F.struct(action.alias("action"), F.when(action == "recognise", pages).alias("pages"))


def plain_voice(c: Column) -> Column:
    """A voice name without the gender that lists show behind it."""
    return trim(F.regexp_replace(F.coalesce(c, F.lit("")), "-Female|-Male", ""))


def second_version(c: Column) -> Column:
    """The base name of a voice of the second version, else an empty text."""
    v = plain_voice(c)
    return F.when(v.endswith("-V2"), trim(F.regexp_replace(v, "^(.*?)-V2", "$1"))).otherwise(F.lit(""))


def voice_service(c: Column) -> Column:
    """The speech service that a voice name implies."""
    out = F.when(second_version(c) != "", "azure-tts-v2").otherwise("azure-tts-v1")
    for s in reversed(SERVICES):
        out = F.when(F.startswith(F.coalesce(c, F.lit("")), F.lit(f"{s}:")), s).otherwise(out)
    return out


def no_voice(c: Column) -> Column:
    """Silence was asked for; an empty name did not ask for it."""
    return F.lower(trim(F.coalesce(c, F.lit("")))).isin(NO_VOICE)


def listed_voices(name: Column, gender: Column, locales: list[str], second: bool) -> Column:
    """The name in lists of a voice of these locales and this version, else null."""
    shown = F.concat(name, F.lit("-"), gender)
    there = F.lit(False)
    for prefix in locales:
        there = there | F.startswith(F.lower(name), F.lit(prefix.lower()))
    return F.when(there & (F.contains(shown, F.lit("V2")) == F.lit(second)), shown)


def staged_progress(done: Column, total: Column, floor: float = 5.0, share: float = 0.7) -> Column:
    """The percentage of a job whose first stage takes ``share`` of what is above ``floor``."""
    part = F.when(total > 0, done / total).otherwise(F.lit(0.0))
    return F.lit(floor) + part * (100.0 - floor) * share


#: Stages in the order in which they run: fixed values.
STAGES = ["script", "terms", "audio", "subtitle", "materials", "video"]


def runs_stage(stage: Column, stop_at: Column) -> Column:
    """Whether a stage runs in a job that stops after another; unknown stages do not run, unknown ends stop nothing."""
    place = lambda c: F.array_position(F.array(*map(F.lit, STAGES)), c)
    last = F.coalesce(F.nullif(place(stop_at), F.lit(0)), F.lit(len(STAGES)))
    return F.coalesce((place(stage) > 0) & (place(stage) <= last), F.lit(False))


def ass_colour(colour: Column, transparency: int = 0) -> Column:
    """``&HAABBGGRR`` of ``#RRGGBB`` or ``#RGB``; what is no colour is white."""
    h = F.upper(F.regexp_extract(F.coalesce(colour, F.lit("")), r"^\s*#?([0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})\s*$", 1))
    h = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).when(h == "", F.lit("FFFFFF")).otherwise(h)
    return F.concat(F.lit(f"&H{transparency:02X}"), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


#: Fixed values of the subtitle format.
STYLE_FIELDS = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
ALIGNMENT = {"top": 8, "bottom": 2}


def ass_dialogue(start: Column, end: Column, text: Column, style: str = "Default") -> Column:
    """A cue as a line of the subtitle format; null without text."""
    body = ass_escape(text)
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit("Dialogue: 0,"), ass_time(start), F.lit(","), ass_time(end), F.lit(f",{style},,0,0,0,,"), body))


def ass_head(width: int, height: int, font: str = "Arial", size: int = 60, colour: str = "#FFFFFF", stroke: str = "#000000", outline: int = 1, position: str = "bottom", style: str = "Default") -> Column:
    """What stands before the cues of a subtitle document: frame size and one style."""
    fore, edge = ass_colour(F.lit(colour)), ass_colour(F.lit(stroke))
    side, foot = round(width * 0.05), round(height * 0.05)
    line = F.concat_ws(",", F.lit(style), F.lit(font), F.lit(str(size)), fore, fore, edge, ass_colour(F.lit("#000000")), F.lit(f"0,0,0,0,100,100,0,0,1,{outline},0,{ALIGNMENT.get(position, 5)},{side},{side},{foot},1"))
    top = f"[Script Info]\nScriptType: v4.00+\nWrapStyle: 0\nScaledBorderAndShadow: yes\nYCbCr Matrix: None\nPlayResX: {width}\nPlayResY: {height}\n\n[V4+ Styles]\nFormat: {STYLE_FIELDS}\nStyle: "
    return F.concat(F.lit(top), line, F.lit(f"\n\n[Events]\nFormat: {EVENT_FIELDS}\n"))


SPEEDS = (0.5, 2.0)


def clip_speed(value: Column, default: float = 1.0) -> Column:
    """A playable speed: what is none falls back, the rest is held within bounds."""
    v = value.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf")), F.least(F.greatest(v, F.lit(SPEEDS[0])), F.lit(SPEEDS[1]))).otherwise(F.lit(default))


def needed_seconds(audio: Column, margin: float = 0.1) -> Column:
    """How long the picture must last for a recording."""
    return F.greatest(F.lit(0.0), audio + F.lit(margin))


def subtitle_top(position: Column, percent: Column, height: Column, cue: Column) -> Column:
    """The upper edge of a cue; a place of one's own stays wholly on screen."""
    own = F.greatest(F.lit(10.0), F.least((height - cue) * (percent / 100), height - cue - 10))
    return F.when(position == "bottom", height * 0.95 - cue).when(position == "top", height * 0.05).when(position == "custom", own).otherwise((height - cue) / 2)


def rotated(keys: Column, use: Column) -> Column:
    """The key for the ``use``-th call, from 1 on; one key alone serves all."""
    return F.get(keys, F.when(F.size(keys) > 1, F.pmod(use, F.size(keys))).otherwise(0).cast("int"))


def pool_key(terms: Column, source: Column, aspect: Column) -> Column:
    """What a pool of clips was built from, whatever the order of its terms."""
    return fnv1a(F.to_json(F.struct(F.array_sort(terms).alias("terms"), source.alias("source"), aspect.alias("aspect")))).cast("string")
