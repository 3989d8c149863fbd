"""Parts of replies, headers and settings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

#: Two-letter to three-letter language codes of subtitle tracks.
TRACK_CODES = {"en": "eng", "de": "ger", "fr": "fre", "es": "spa", "it": "ita", "pt": "por", "ru": "rus", "zh": "chi", "ja": "jpn", "ko": "kor", "ar": "ara", "vi": "vie", "tr": "tur", "id": "ind"}
TICKS = 10_000_000


def byte_range(header: Column, size: Column) -> Column:
    """``start, end`` of a single ``bytes=`` range within a file; null if it cannot be served."""
    a, b = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    first, last = a.try_cast("long"), b.try_cast("long")
    pair = lambda s, e: F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"))
    return (
        F.when(size <= 0, F.lit(None))
        .when(header.isNull() | (header == ""), pair(F.lit(0), size - 1))
        .when((a == "") & (last > 0), pair(F.greatest(size - last, F.lit(0)), size - 1))
        .when((a != "") & (first < size) & ((b == "") | (last >= first)), pair(first, F.least(F.coalesce(last, size - 1), size - 1)))
    )


def progress_of(line: Column) -> Column:
    """A share from 0 to 1 out of a JSON progress line: percentages, then shares, then done of total; else null."""
    number = lambda *keys: F.coalesce(*[F.get_json_object(line, f"$.{k}").try_cast("double") for k in keys])
    percent = number("percent", "percentage", "progressPercent") / 100
    share = number("progress", "fraction", "ratio")
    share = F.when(share > 1, share / 100).otherwise(share)
    done, total = number("frame", "frames", "framesRendered", "completed", "current"), number("totalFrames", "frameCount", "total")
    ratio = F.when(total > 0, done / total)
    found = F.coalesce(percent, share, ratio)
    return F.when(trim(line).startswith("{") & found.isNotNull(), F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0)))


def spoken_cues(frame: Column) -> Column:
    """Array of ``start, end, content`` from a voice service's metadata frame: headers, blank line, JSON body."""
    body = F.regexp_extract(frame, r"(?s)^.*?\r?\n\r?\n(.*)$", 1)
    kind = "struct<Metadata:array<struct<Type:string,Data:struct<Offset:bigint,Duration:bigint,text:struct<Text:string>>>>>"
    ok = F.filter(F.from_json(body, kind)["Metadata"], lambda m: m["Type"].isin("WordBoundary", "SentenceBoundary") & m["Data"]["Offset"].isNotNull() & m["Data"]["text"]["Text"].isNotNull())
    cue = lambda m: F.struct((m["Data"]["Offset"] / TICKS).alias("start"), ((m["Data"]["Offset"] + F.coalesce(m["Data"]["Duration"], F.lit(0))) / TICKS).alias("end"), m["Data"]["text"]["Text"].alias("content"))
    return F.when(frame.rlike(r"(?m)^Path:\s*audio\.metadata\s*$"), F.transform(ok, cue))


def playlists(body: Column) -> Column:
    """Array of ``id, title, item_count`` from a list reply, without system lists and untitled ones."""
    kind = "struct<items:array<struct<id:string,snippet:struct<title:string>,contentDetails:struct<itemCount:bigint>>>>"
    system = lambda i: F.upper(i).isin("WL", "LL", "FL") | F.upper(i).startswith("UU")
    ok = F.filter(F.from_json(body, kind)["items"], lambda p: (trim(p["id"]) != "") & ~system(p["id"]) & (trim(p["snippet"]["title"]) != ""))
    return F.transform(ok, lambda p: F.struct(p["id"].alias("id"), trim(p["snippet"]["title"]).alias("title"), F.coalesce(p["contentDetails"]["itemCount"], F.lit(0)).alias("item_count")))


def selected_playlists(by_channel: Column, channels: Column) -> Column:
    """The entries of a channel-to-playlist map for the chosen channels, without blank values."""
    return F.map_filter(by_channel, lambda k, v: F.array_contains(channels, k) & (trim(v) != ""))


def masked(value: Column, mark: str = "********") -> Column:
    """A secret that is not empty as a mark."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.lit(mark)).otherwise(value)


def masked_list(values: Column, mark: str = "********") -> Column:
    return F.transform(values, lambda v: masked(v, mark))


def merged_settings(old: Column, new: Column, mark: str = "********") -> Column:
    """A section's map with the new values over the old; a masked value means no change."""
    changes = F.map_filter(new, lambda k, v: v != mark)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(changes, k)), changes)


def language_of(saved: Column, browser: Column, supported: list[str], default: str = "en") -> Column:
    """The first of saved, browser and default that is supported as it is or by its base code."""
    known = F.create_map(*[F.lit(x) for s in supported for x in (s.lower(), s)])

    def match(c: Column) -> Column:
        code = F.lower(F.replace(trim(c), F.lit("_"), F.lit("-")))
        return F.coalesce(F.try_element_at(known, code), F.try_element_at(known, F.substring_index(code, "-", 1)))

    return F.coalesce(match(saved), match(browser), match(F.lit(default)), F.lit(supported[0] if supported else default))


def track_code(language: Column) -> Column:
    """The three-letter code of a language tag; three letters stay, what is unknown is ``und``."""
    codes = F.create_map(*[F.lit(x) for kv in TRACK_CODES.items() for x in kv])
    tag = F.replace(F.lower(F.trim(F.coalesce(language, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(tag.rlike("^[a-z]{3}$"), tag).otherwise(F.coalesce(F.try_element_at(codes, F.substring_index(tag, "-", 1)), F.lit("und")))


def sidecar(video: Column) -> Column:
    """The caption file beside a video: its name with another extension."""
    return F.concat(F.regexp_replace(video, r"(?<=[^/])\.[^./]*$", ""), F.lit(".srt"))


def terms(c: Column) -> Column:
    """Search terms between ASCII or full-width commas."""
    return F.filter(F.transform(F.split(c, "[,，]"), trim), lambda x: x != "")


def unescape(c: Column) -> Column:
    """The five XML entities; the ampersand last, so nothing is undone twice."""
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(char))
    return c


def plain_arabic(c: Column) -> Column:
    """Without diacritics, and with one form for each letter."""
    bare = F.regexp_replace(c, r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{0640}\x{06D6}-\x{06ED}]", "")
    return F.translate(bare, "أإآٱىئةؤ", "ااااييهو")


def publish_time(c: Column, now: Column, lead_seconds: int = 900) -> Column:
    """A time in RFC 3339 form that lies far enough ahead; else null."""
    t = F.try_to_timestamp(c)
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$") & (t >= now + F.make_interval(secs=F.lit(lead_seconds))), t)


def listing(requested: Column, stored: Column, generated: Column, blank_falls_through: bool) -> Column:
    """Request, then what is stored, then what was generated; a title falls through when blank, other fields only when null."""
    pick = (lambda c: F.nullif(trim(c), F.lit(""))) if blank_falls_through else (lambda c: c)
    return F.coalesce(pick(requested), pick(stored), generated)


def resolution(aspect: Column) -> Column:
    """``width, height`` of an aspect."""
    size = lambda w, h: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))
    return F.when(aspect == "16:9", size(1920, 1080)).when(aspect == "1:1", size(1080, 1080)).otherwise(size(1080, 1920))


def large_enough(width: Column, height: Column, floor: int = 480, slack: int = 10) -> Column:
    return F.coalesce((width >= floor - slack) & (height >= floor - slack), F.lit(False))


def subtitle_strategy(requested: Column, library: Column, cues: Column, most: int = 64) -> Column:
    """How subtitles are drawn: as asked if the library is there, else overlays up to a number of cues, else a separate track."""
    return F.when(requested == "none", "none").when(requested == "soft", "soft").when(library, "burned").when(cues <= most, "overlay").otherwise("soft")


def renamed(path: Column, old: str, new: str) -> Column:
    """A path under the old folder moved under the new one; other paths stay."""
    inside = (path == old) | path.startswith(old.rstrip("/") + "/")
    return F.when(inside, F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)
