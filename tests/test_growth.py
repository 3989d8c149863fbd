"""Work that has to grow no faster than its input."""

import random
import time

from pyspark.sql import functions as F

from inkstream.functions import text as T
from inkstream.operators import cues as C
from inkstream.operators import layout as L
from inkstream.operators import narration as N
from inkstream.plans import job_queries, more_queries, title_queries  # noqa: F401  register queries
from inkstream.plans import queries as Q


def test_hashtags_of_many_words(spark):
    words = [f"W{k % 4000}" if k % 3 else f"w{k % 4000}" for k in range(6000)]
    rows = spark.createDataFrame([(" ".join(words),), ("a, B b A c!",), ("",), (None,)], "text string").repartition(1)
    begin = time.time()
    got = [r.tags for r in rows.select(T.hashtags(F.col("text")).alias("tags"), T.hashtags(F.col("text"), 2).alias("two")).select("tags").collect()]
    assert time.time() - begin < 20  # every word was held against a list made anew
    first = {}
    for w in words:
        first.setdefault(w.lower(), f"#{w}")
    assert sorted(map(str, got)) == sorted(map(str, [list(first.values()), ["#a", "#B", "#c"], [], None]))
    two = [r.two for r in rows.select(T.hashtags(F.col("text"), 2).alias("two")).collect()]
    assert sorted(map(str, two)) == sorted(map(str, [list(first.values())[:2], ["#a", "#B"], [], None]))


def test_seconds_without_lists_of_letters(spark):
    """The plain form of the rates, on texts of marks, spaces and scripts; letters and words are counted without a list of them."""
    rng = random.Random(5)
    signs = [*"ab Z9 01.,?;:!…、？，\n\r\t 　 \u0085中文鿿éßЖ٣Ⅷ😀-'", "3.5", "1,000", "Chapter "]
    rows = ["".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 2, 5, 9, 40]))) for _ in range(3000)] + ["", " ", "\n", "a \n", None]
    c = F.col("text")
    t = T.trim(c)
    marks = r"(?<![0-9])[.,]|[.,](?![0-9])|[?;:!…、？，。；：！،؛؟\n]"
    count = lambda p: F.regexp_count(t, F.lit(p))
    parts = F.size(F.filter(F.split(t, marks), lambda x: x.rlike(r"(?U)\S")))
    plain = count(r"[\x{4E00}-\x{9FFF}]") / 4.2 + count("[A-Za-z0-9]+") / 2.7 + count(r"[\p{L}\p{N}&&[^A-Za-z0-9\x{4E00}-\x{9FFF}]]") / 4.0 + F.greatest(parts - 1, F.lit(0)) * F.lit(0.35)
    words = F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))
    got = spark.createDataFrame([(x,) for x in rows], "text string").select("text", T.spoken_seconds(c).alias("s"), F.when(t == "", 0.0).otherwise(plain).alias("p"), T.word_count(c).alias("w"), words.alias("q"))
    assert got.filter("not (round(s, 9) <=> round(p, 9)) or not (w <=> q)").count() == 0
    made = got.select(T.spoken_seconds(c))._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("regexp_extract_all") <= 1  # there were three lists, over a text trimmed for each


def test_books_are_classified_once(spark):
    """What follows starts from written blocks; documents come again for the chapters alone."""
    for name in ("smart_segments", "proposed_sections"):
        plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode(split(text" not in plan, name  # lines of documents


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_lines_and_cues_meet_within_a_row(spark):
    """Cues are brought together once; there were windows, aggregates and joins of lines with cues, one after another."""
    rng = random.Random(8)
    cues, scripts, want = [], [], []
    for d in range(40):
        words = ["".join(rng.choice("abé9") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 300))]
        said = [w if rng.random() < 0.9 else "?!" for w in words]
        heard = [w for w in said if w != "?!"]
        cuts = [rng.random() < 0.3 for _ in heard]
        scripts.append((d, " ".join(w + ("." if c else "") for w, c in zip(heard, cuts)) + (" odd" if d % 5 == 0 else "")))
        cues += [(d, k, k + 0.0, k + 0.5, w) for k, w in enumerate(said)]
        lines, at, last = [], [k for k, w in enumerate(said) if w != "?!"], -1
        for j, k in enumerate(at):
            if cuts[j] or j == len(at) - 1:
                part = [i for i in at if last < i <= k]
                lines.append((d, len(lines) + 1, last + 1.0, k + 0.5, " ".join(said[i] for i in part)))
                last = k
        want += [] if d % 5 == 0 else lines
    c = spark.createDataFrame(cues, "d int, seq int, start double, end double, content string").repartition(3)
    s = spark.createDataFrame(scripts, "d int, script string")
    got = N.aligned(c, s, "d")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500
    assert "Window" not in _plan(got)
    for name in ("aligned_cues", "chunk_cues"):
        assert "Window" not in _plan(Q.QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_blocks_are_dealt_by_book_alone(spark):
    """Chapters too many to broadcast dealt all blocks and their texts anew, to classify them and again for the outline."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = Q._kept(spark, "/root/testdata/sf0.001")[0]
        dealt = [x for x in _plan(kept).split("\n") if "hashpartitioning" in x]
        assert dealt and not any("chapter_id#" in x for x in dealt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_of_a_page_are_made_within_its_row(spark):
    """A page's items come together once; they were sorted, grouped and joined again for every line."""
    rng = random.Random(9)
    items = [(p, -float(y), float(x), 5.0, rng.choice([10.0, 10.0, 12.0]), f"w{x}") for p in range(30) for y in range(0, 90, 30) for x in rng.sample(range(0, 200, 10), 6)]
    got = L.lines(spark.createDataFrame(items, "page int, y double, x double, width double, font_size double, text string"))
    plan = _plan(got)
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = []
    for p in range(30):
        for k, y in enumerate(range(0, 90, 30)):
            row = sorted((x, f, t) for q, v, x, _, f, t in items if (q, v) == (p, -float(y)))
            sizes = [f for _, f, _ in row]
            weight = lambda z, row=row: sum(len(t) for _, f, t in row if f == z)
            want.append((p, k, " ".join(t for *_, t in row), row[0][0], row[-1][0] + 5, -float(y), max(dict.fromkeys(sizes), key=weight)))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_subtitles_are_read_within_a_row(spark):
    """Cues were dealt by document to be written, and lines dealt and sorted to be read again."""
    assert "Exchange hashpartitioning" not in _plan(Q.QUERIES["srt_round_trip"](spark, "/root/testdata/sf0.001"))


def test_cues_meet_times_within_a_row(spark):
    """Times and cues were dealt by document and bucket of seconds, joined and dealt again."""
    plan = _plan(Q.QUERIES["active_cue"](spark, "/root/testdata/sf0.001"))
    assert "Exchange hashpartitioning" not in plan and "Join" not in plan
    cues = [(1, [(1, 0.0, 12.0, "a"), (2, 12.0, 30.0, "b"), (3, 40.0, 41.0, "c")]), (2, []), (3, None)]
    rows = spark.createDataFrame(cues, "d int, cues array<struct<idx: int, start: double, end: double, content: string>>")
    times = F.array(*map(F.lit, (0.0, 12.0, 29.9, 35.0, 41.0)))
    got = rows.select("d", F.inline(C.active_in(F.col("cues"), times)))
    assert sorted(map(tuple, got.collect())) == [(1, 0.0, 1, "a"), (1, 12.0, 2, "b"), (1, 29.9, 2, "b"), (1, 41.0, 3, "c")]


def test_times_in_batches_equal_times_by_expressions(spark):
    rng = random.Random(11)
    texts = [(k, "".join(rng.choice("ab é中😀 .,\n0") for _ in range(rng.choice([1, 4, 30, 900]))), rng.choice([0.0, None, rng.uniform(0, 60)])) for k in range(300)]
    rows = spark.createDataFrame([*texts, (300, None, 1.0), (301, " \n", 1.0)], "k int, text string, s double").repartition(3)
    want = rows.filter(T.filled(F.col("text"))).select("k", F.inline(C.proportional_in(F.col("text"), F.col("s"))))
    assert sorted(map(tuple, C.proportional(rows, "k", "text", "s").collect())) == sorted(map(tuple, want.collect()))
    plan = _plan(C.proportional(rows, "k", "text", "s"))
    assert "MapInArrow" in plan and "aggregate(" not in plan  # totals were lists copied number by number


def test_parts_between_boundaries_are_looked_at_once(spark):
    """Each part was trimmed for itself; white space goes with the boundaries now, and gives the same parts."""
    rng = random.Random(12)
    signs = [*"ab Z9 01.,?;:!…、？，\n\n\r\t 　 \u0085中😀-\x1c", "3.5", "1,000"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 40]))) for _ in range(5000)] + ["", None, " " * 9000, "\n" * 9000, "." * 9000, "a" + " " * 9000 + "b", "1." * 9000]
    c = F.col("text")
    plain = F.filter(F.transform(F.split(c, T.BOUNDARY), T.trim), lambda x: x != "")
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(T.caption_lines(c).alias("got"), plain.alias("want"))
    assert rows.filter("not (got <=> want)").count() == 0
    assert "transform(" not in _plan(rows.select("got"))


def test_tasks_read_their_share(spark, tmp_path, monkeypatch):
    """A large table in few row groups was read by as few tasks, and others by tasks of 128 MB."""
    from inkstream import session

    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) <= 16 << 20
    monkeypatch.setattr(session, "SPREAD_BYTES", 0)
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    spark.range(5000).coalesce(1).write.parquet(one)
    spark.range(5000).repartition(8).write.parquet(many)
    dealt, left = session.spread(spark.read.parquet(one)), session.spread(spark.read.parquet(many))
    assert "RoundRobinPartitioning" in _plan(dealt) and dealt.count() == 5000
    assert "RoundRobinPartitioning" not in _plan(left)
