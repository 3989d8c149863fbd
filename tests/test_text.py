import pytest
from pyspark.sql import functions as F

from inkstream.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Hello world. How are you?", ["Hello world", "How are you"]),
        ("你好，世界。再见！", ["你好", "世界", "再见"]),
        ("charged at 2.5% fee", ["charged at 2.5% fee"]),
        ("it lasted 1,000 years", ["it lasted 1,000 years"]),
        ("one\n\ntwo", ["one", "two"]),
        ("1.2.3, end.", ["1.2.3", "end"]),
        ("", []),
    ],
)
def test_caption_lines(spark, text, parts):
    assert one(spark, text, T.caption_lines) == parts


@pytest.mark.parametrize(("seconds", "stamp"), [(0.0, "00:00:00,000"), (1.5, "00:00:01,500"), (61.25, "00:01:01,250"), (3661.007, "01:01:01,007"), (-3.0, "00:00:00,000"), (None, "00:00:00,000")])
def test_srt_time(spark, seconds, stamp):
    assert spark.createDataFrame([(seconds,)], "s double").select(T.srt_time(F.col("s"))).first()[0] == stamp


def test_srt_seconds(spark):
    assert one(spark, "01:01:01,007", T.srt_seconds) == pytest.approx(3661.007)
    assert one(spark, "nothing", T.srt_seconds) == 0


@pytest.mark.parametrize(("text", "n"), [("", 0), ("  ", 0), ("a b c\n d", 4), ("one", 1)])
def test_word_count(spark, text, n):
    assert one(spark, text, T.word_count) == n


def test_spoken_seconds(spark):
    assert one(spark, " ".join(["w"] * 27), T.spoken_seconds) == pytest.approx(10.0)
    assert one(spark, "你好世界", T.spoken_seconds) == pytest.approx(4 / 4.2)
    assert one(spark, "a. b", T.spoken_seconds) == pytest.approx(2 / 2.7 + 0.35)
    assert one(spark, "  ", T.spoken_seconds) == 0
    assert one(spark, " ".join(["w"] * 27), lambda c: T.spoken_seconds(c, 300)) == pytest.approx(5.0)


@pytest.mark.parametrize(("text", "key"), [("The Harbour   47", "the harbour"), ("  A  B ", "a b"), ("Title . . . 12", "title"), ("12", "")])
def test_repeat_key(spark, text, key):
    assert one(spark, text, T.repeat_key) == key


def test_hashtags_and_tags(spark):
    assert one(spark, "#Sea, sea du-lich  !!! Été", lambda c: T.hashtags(c, 3)) == ["#Sea", "#dulich", "#Été"]
    long = "x" * 90
    text = ",".join([long + str(k) for k in range(7)] + ["tail", "TAIL", "#b  c"])
    assert one(spark, text, lambda c: T.tags_skipping(c, 15)) == [long + str(k) for k in range(5)] + ["tail", "b c"]
    tags = spark.createDataFrame([([long + str(k) for k in range(7)] + ["tail"],)], "t array<string>")
    assert tags.select(T.tags_stopping(F.col("t"))).first()[0] == [long + str(k) for k in range(5)]


def test_replies(spark):
    assert one(spark, "<think>hm\nhm</think># Title *bold* (aside) [cue]\n\nText", T.spoken_reply) == "Title bold\n\nText"
    assert one(spark, "```json\n{}\n```", T.strip_fence) == "{}"
    assert one(spark, "a_b\n***\n  c ", T.script_lines) == "ab\nc"
    assert one(spark, "One two. Three four five! Six?", lambda c: T.clamp_script(c, 5)) == "One two. Three four five!"
    assert one(spark, "One two three four.", lambda c: T.clamp_script(c, 1)) == "One two three four."


@pytest.mark.parametrize(("url", "clean"), [("https://a.example/p/q?x=1#y", "https://a.example/p/q"), ("ftp://a.example/", None), ("https://u:p@a.example/", None), ("nonsense", None), (None, None)])
def test_public_url(spark, url, clean):
    assert one(spark, url, T.public_url) == clean


def test_keys_and_names(spark):
    assert one(spark, "a", T.fnv1a) == 0xE40C292C and one(spark, "foobar", T.fnv1a) == 0xBF9CF968
    assert one(spark, "12:3:4", T.before_first) == "12" and one(spark, "12:3:4", T.after_first) == "3:4" and one(spark, "x", T.after_first) == ""
    assert one(spark, "../we ird/näme?.mp4", T.safe_name) == "we_ird_näme_.mp4"
    assert one(spark, "mongodb://u:p@h/x key1", lambda c: T.redact(c, "key1")) == "mongodb://***@h/x ***"
    assert one(spark, "  abc  def ", lambda c: T.clamp(c, 4)) == "abc"
    assert one(spark, "kitten", lambda c: T.similarity(c, F.lit("Sitting"))) == pytest.approx(1 - 3 / 7)


def test_styled_subtitle_parts(spark):
    assert spark.range(1).select(T.ass_time(F.lit(3661.239))).first()[0] == "1:01:01.24"
    assert one(spark, "a{b}\nc", T.ass_escape) == "a\\{b\\}\\Nc"


def test_short_scripts_and_hooks(spark):
    cut = lambda text, n: one(spark, text, lambda c: T.clamp_script(c, n))
    assert cut("# Head\n*One* two.  Three!\nFour five six.", 4) == "Head One two. Three!" and cut("One two. Three.", 0) == "One two. Three." and cut(" ", 3) == ""
    assert cut("一 二。 三 四。", 2) == "一 二。" and cut("One two three four. Five.", 2) == "One two three four."
    assert one(spark, "  What now? More.", T.first_sentence) == "What now?" and one(spark, "...", T.first_sentence) == "..." and len(one(spark, "x" * 400, T.first_sentence)) == 220
    row = spark.range(1).select(T.target_words(F.lit(10), F.lit(150)), T.target_words(F.lit(200), F.lit(150)), T.target_words(F.lit(61), F.lit(150))).first()
    assert tuple(row) == (80, 225, 153)
