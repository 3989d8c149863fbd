"""Scalar text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

#: Caption boundaries, where a point or comma between digits is none.
_MARK = r"(?:[\n!,.:;?]|[\x{80}-\x{FFFF}&&[…、？，。；：！،؛؟]])"
BOUNDARY = _MARK + r"(?:(?<![0-9][.,])|(?![0-9]))"
_BLANK = r"[\s&&[^\n]]"
#: What lies between two parts: boundaries with all white space around them; nothing but white space at either end of the text.
_CUT = BOUNDARY + r"[\s!,.:;?…、？，。；：！،؛؟]*+"
_BETWEEN_PARTS = rf"(?U){_CUT}|{_BLANK}(?<!{_BLANK}{{2}}){_BLANK}*+(?:{_CUT}|\z)|\A\s++"
#: A boundary with all boundaries and white space after it, and something behind them.
_BETWEEN = rf"(?U){BOUNDARY}(?:\s|{BOUNDARY})*+(?!\z)"
#: Fixed rates: characters or words spoken per second, and the pause between sentences.
CJK_RATE, LATIN_RATE, OTHER_RATE, PAUSE, BASE_WPM = 4.2, 2.7, 4.0, 0.35, 150


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))  # most texts have none, and need no pass
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def filled(c: Column) -> Column:
    """Whether anything is left of a text when it is trimmed."""
    return c.rlike(r"(?U)\S")


def single_spaces(c: Column) -> Column:
    """Every run of white space as one space; a space that stands alone is no match."""
    return F.regexp_replace(c, r"(?U) \s+|[\s&&[^ ]]\s*", " ")


def word_count(c: Column) -> Column:
    words = F.length(F.regexp_replace(c, r"(?U)\s*+\S++\s*+", "x"))  # a letter for each word
    return F.when(filled(c), words).when(c.isNotNull(), 0).cast("long")


def caption_lines(c: Column) -> Column:
    """The parts between boundaries, trimmed, without empty ones; white space goes with the boundaries, so no part is looked at again."""
    return F.filter(F.split(c, _BETWEEN_PARTS), lambda x: x != "")


def has_punctuation(c: Column) -> Column:
    return c.rlike("[?,.、;:!…？，。；：！،؛؟]")


def spoken_seconds(c: Column, wpm: int = BASE_WPM) -> Column:
    """Narration time: each script has its own rate, and sentences their pauses."""
    # what is counted stays, or becomes one letter, so no list of it is made
    foreign = F.octet_length(c) > F.length(c)
    count = lambda others: F.when(foreign, F.length(F.regexp_replace(c, others, ""))).otherwise(0)
    cjk, others = count(r"[^\x{4E00}-\x{9FFF}]+"), count(r"[\x00-\x7F]+|[^\p{L}\p{N}]+|[\x{4E00}-\x{9FFF}]+")
    words = F.when(c.rlike("[A-Za-z0-9]"), F.length(F.regexp_replace(c, r"[^A-Za-z0-9]*+[A-Za-z0-9]++[^A-Za-z0-9]*+", "x"))).otherwise(0)
    pauses = F.greatest(F.regexp_count(c, F.lit(_BETWEEN)) - c.rlike(rf"(?U)\A\s*{_MARK}").cast("int"), F.lit(0))
    seconds = cjk / F.lit(CJK_RATE) + words / F.lit(LATIN_RATE) + others / F.lit(OTHER_RATE) + pauses * F.lit(PAUSE)
    return F.when(filled(c), seconds * F.lit(BASE_WPM / (wpm if wpm > 0 else BASE_WPM))).when(c.isNotNull(), F.lit(0.0))


def repeat_key(c: Column) -> Column:
    """Small letters, single spaces, no trailing number or leader."""
    line = trim(single_spaces(F.lower(c)))
    return trim(F.when(F.substring(line, -1, 1).rlike("[0-9]"), F.regexp_replace(line, r"[\s.·•]*\d+$", "")).otherwise(line))


def script_lines(c: Column) -> Column:
    """Without underscores and rules of three or more marks; lines trimmed."""
    lines = F.transform(F.split(F.replace(c, F.lit("_"), F.lit("")), r"\r?\n"), trim)
    return trim(F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^[-*_]{3,}$")), "\n"))


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length, in small letters; 1 for two empty texts."""
    a, b = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``; parts are cut, not rounded."""
    s = F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))
    whole = F.floor(s)
    hours, padded = F.floor(whole / 3600), lambda n, k: F.lpad(n.cast("string"), k, "0")
    return F.concat(F.when(hours < 100, padded(hours, 2)).otherwise(hours.cast("string")), F.lit(":"), padded(F.floor((whole % 3600) / 60), 2), F.lit(":"), padded(whole % 60, 2), F.lit(","), padded(F.floor(s * 1000) % 1000, 3))


def srt_seconds(c: Column) -> Column:
    part = lambda k: F.regexp_extract(c, r"(\d+):(\d+):(\d+)[,.](\d+)", k)
    value = part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double") + part(4).cast("double") / 1000
    return F.when(part(1) == "", F.lit(0.0)).otherwise(value)


def clamp(c: Column, most: int) -> Column:
    """Trimmed, cut, and trimmed at the end again."""
    t = trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) > most, F.regexp_replace(F.substring(t, 1, most), r"(?U)\s+$", "")).otherwise(t)


def first_of_each(items: Column, key, count: int = 0) -> Column:
    """Distinct by key, first wins, order kept; only the first ``count``, if given.  Keys are sorted, never held against all others."""

    def firsts(keyed: Column) -> Column:
        new = lambda k: F.filter(k, lambda p, j: (j == 0) | ~p["key"].eqNullSafe(F.get(k, j - 1)["key"]))
        at = F.array_sort(F.transform(let(F.array_sort(keyed), new), lambda p: p["i"]))
        return F.slice(at, 1, count) if count else at

    keyed = lambda x: F.transform(x, lambda v, i: F.struct(key(v).alias("key"), i.alias("i")))
    return let(items, lambda x: F.transform(let(keyed(x), firsts), lambda i: F.get(x, i)))


def hashtags(c: Column, count: int = 0) -> Column:
    """Words as ``#tag`` of letters, digits and underscores, distinct without case."""
    tags = F.filter(F.transform(F.split(c, r"[\s,]+"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}_]", "")), lambda x: x != "")
    return F.transform(first_of_each(tags, F.lower, count), lambda x: F.concat(F.lit("#"), x))


def tags_skipping(c: Column, count: int, budget: int = 500, most: int = 100) -> Column:
    """Phrases within a budget of characters; one that does not fit is passed over and later ones still may."""
    parts = F.transform(F.split(c, r"[,;\n]+"), lambda x: trim(F.substring(trim(F.regexp_replace(F.regexp_replace(x, "^#+", ""), r"(?U)\s+", " ")), 1, most)))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"))

    def add(s: Column, x: Column) -> Column:
        fits = (x != "") & ~F.exists(s["out"], lambda y: F.lower(y) == F.lower(x)) & (s["used"] + F.length(x) <= budget) & (F.size(s["out"]) < count)
        return F.when(fits, F.struct(F.concat(s["out"], F.array(x)).alias("out"), (s["used"] + F.length(x) + 1).alias("used"))).otherwise(s)

    return F.aggregate(parts, start, add)["out"]


def tags_stopping(tags: Column, budget: int = 500) -> Column:
    """The tags before the first that does not fit in the budget with its separator."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(s: Column, x: Column) -> Column:
        more = F.length(x) + F.when(F.size(s["out"]) > 0, 1).otherwise(0)
        fits = ~s["full"] & (s["used"] + more <= budget)
        return F.when(fits, F.struct(F.concat(s["out"], F.array(x)).alias("out"), (s["used"] + more).alias("used"), F.lit(False).alias("full"))).otherwise(
            F.struct(s["out"].alias("out"), s["used"].alias("used"), F.lit(True).alias("full"))
        )

    return F.aggregate(tags, start, add)["out"]


def public_url(c: Column) -> Column:
    """Scheme, host and path of a web address without user data; else null."""
    host, scheme = F.try_parse_url(c, F.lit("HOST")), F.lower(F.try_parse_url(c, F.lit("PROTOCOL")))
    ok = scheme.isin("http", "https") & host.isNotNull() & F.try_parse_url(c, F.lit("USERINFO")).isNull()
    return F.when(ok, F.concat(scheme, F.lit("://"), host, F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))))


def host_of(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def content_key(*parts: Column) -> Column:
    """sha256 of the parts, NUL between them."""
    return F.sha2(F.array_join(F.array(*parts), "\x00"), 256)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text."""
    unit = lambda data, k: F.conv(F.hex(F.substring(data, k, F.lit(2))), 16, 10).cast("long")
    read = lambda data: F.when(F.octet_length(data) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(data), F.lit(2)), lambda k: unit(data, k))).otherwise(F.array().cast("array<bigint>"))
    units = let(F.encode(c, "UTF-16BE"), read)
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)) % F.lit(4294967296))


def strip_fence(c: Column) -> Column:
    """Without a Markdown code fence around the whole text."""
    return trim(F.regexp_replace(trim(c), r"^```[A-Za-z0-9_-]*\s*\n?|\n?```$", ""))


def spoken_reply(c: Column) -> Column:
    """A model's reply as a script: no thinking, no marks of emphasis or headings, no bracketed asides."""
    t = trim(F.regexp_replace(c, r"(?is)<think>.*?</think>|<think>.*$", ""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[*#]", ""), r"\[[^\n\]]*\]", ""), r"\([^\n)]*\)", "")
    return F.array_join(F.filter(F.transform(F.split(bare, r"\n{2,}"), trim), lambda x: x != ""), "\n\n")


def sentences(c: Column) -> Column:
    """Split after ``. ! ?`` and the following white space."""
    return F.filter(F.split(trim(c), r"(?<=[.!?])\s+"), lambda x: x != "")


def clamp_script(c: Column, words: int) -> Column:
    """A script without marks, on one line, in whole sentences within a budget of words; the first always stays, and no budget keeps all."""
    plain = trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\*", ""), r"(?m)^#+\s+", ""), r"(?U)\s+", " "))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"))

    def add(s: Column, x: Column) -> Column:
        n = word_count(x)
        over = s["full"] | (F.size(s["out"]) > 0) & (s["used"] + n > words)
        taken = F.struct(F.concat(s["out"], F.array(x)).alias("out"), (s["used"] + n).alias("used"), (s["used"] + n >= words).alias("full"))
        return F.when(over, F.struct(s["out"].alias("out"), s["used"].alias("used"), F.lit(True).alias("full"))).otherwise(taken)

    def cut(text: Column) -> Column:
        parts = F.filter(F.split(text, r"(?<=[.!?。！？])\s+"), lambda x: x != "")
        return F.when((word_count(text) <= words) | F.lit(words <= 0), text).otherwise(F.array_join(F.aggregate(parts, start, add)["out"], " "))

    return let(plain, cut)


#: Letters of a hook, and bounds of a short piece in seconds and words.
HOOK_CHARS, SHORT_SECONDS, SHORT_WORDS = 220, (30, 90), 80


def first_sentence(c: Column) -> Column:
    """A text up to its first stop; the text itself where it begins with one."""
    t = trim(F.coalesce(c, F.lit("")))
    found = F.regexp_extract(t, r"^[^.!?。！？\n]+[.!?。！？]?", 0)
    return clamp(F.when(found != "", found).otherwise(t), HOOK_CHARS)


def target_words(seconds: Column, per_minute: Column) -> Column:
    """Words that a short piece of so many seconds has, at a rate of speech."""
    held = F.greatest(F.lit(SHORT_SECONDS[0]), F.least(F.lit(SHORT_SECONDS[1]), seconds))
    return F.greatest(F.lit(SHORT_WORDS).cast("long"), F.floor(held * per_minute / 60 + F.lit(0.5)))


def redact(c: Column, *secrets: str) -> Column:
    for s in secrets:
        c = F.replace(c, F.lit(s), F.lit("***")) if s else c
    return F.regexp_replace(c, r"(?i)(://)[^/@\s]+@", "$1***@")


def safe_name(c: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}._-]+", "_"), r"^[._]+|[._]+$", "")


#: Device names that no file may have.
DEVICES = ["CON", "PRN", "AUX", "NUL", *[f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10)]]
MUSIC = ["mp3", "m4a", "aac", "wav", "flac", "ogg", "opus", "wma"]


def output_name(c: Column, fallback: str = "untitled", most: int = 120) -> Column:
    """A title as the name of a folder: what no file system takes goes, device names get the fallback in front."""
    clean = trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[/\\]+", " "), r"(?U)\s+", " "))
    clean = F.regexp_replace(F.regexp_replace(clean, r"[<>:\"/\\|?*\x00-\x1f]", ""), r"^[. ]+|[. ]+$", "")
    clean = F.when(clean == "", F.lit(fallback)).otherwise(clean)
    clean = F.when(F.upper(F.substring_index(clean, ".", 1)).isin(DEVICES), F.concat(F.lit(f"{fallback} "), clean)).otherwise(clean)
    cut = F.regexp_replace(F.substring(clean, 1, most), r"[. ]+$", "")
    return F.coalesce(F.nullif(F.when(F.length(clean) > most, cut).otherwise(clean), F.lit("")), F.lit(fallback))


def music_name(c: Column) -> Column:
    """The bare name of an uploaded piece of music; null where it is no safe name of a known format."""
    name = trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", "/"), "^.*/", ""))
    device = F.upper(F.regexp_replace(F.substring_index(name, ".", 1), r"[ .]+$", "")).isin(DEVICES)
    wrong = (F.length(name) > 255) | name.rlike(r"[<>:\"|?*\x00-\x1f]") | F.startswith(F.lower(name), F.lit(".bgm-upload-")) | device
    return F.when(~wrong & F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)).isin(MUSIC), name)


def silent_seconds(c: Column) -> Column:
    """How long a text is shown when nobody reads it: as long as reading takes, and three seconds at least."""
    return F.greatest(F.lit(3.0), spoken_seconds(F.coalesce(c, F.lit(""))))


def before_first(c: Column, mark: str = ":") -> Column:
    return F.substring_index(c, mark, 1)


def after_first(c: Column, mark: str = ":") -> Column:
    return F.when(F.instr(c, mark) > 0, F.substring(c, F.instr(c, mark) + F.lit(len(mark)), F.length(c))).otherwise(F.lit(""))


def ass_time(seconds: Column) -> Column:
    """``H:MM:SS.cc``."""
    cs = F.round(F.greatest(seconds, F.lit(0.0)) * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def ass_escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), r"([{}])", r"\\$1"), r"\r?\n", r"\\N")
