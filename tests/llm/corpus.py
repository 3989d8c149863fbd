"""Small made-up tables with the cases that operators must bear."""

import random

WORDS = "amber basil cedar delta ember fjord grove haven inlet jolly kiosk lunar mango noble ocean pearl quilt river solar tulip umber vivid waltz xenon yacht zebra".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def prose(seed, sentences):
    rng = random.Random(seed)
    return " ".join(sentence(rng, rng.randint(5, 12)) for _ in range(sentences))


def docs(spark, rows):
    """Documents with a further column whose name operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, span string"
    return spark.createDataFrame([(i, t, "xx", "s", len(t or ""), 7, "clash") for i, t in rows], schema)


def corpus():
    base = prose(1, 12)
    words = base.split()
    near = " ".join(words[:40] + ["changed"] + words[41:])
    passage = prose(2, 9)
    rows = [(1, base), (2, near), (3, base), (3, base), (4, prose(3, 10)), (5, None), (6, ""), (7, "   \n\t "), (8, "one"), (9, "one"), (10, "a b c")]
    rows += [(11, prose(4, 4) + " " + passage + " " + prose(5, 4)), (12, prose(6, 3) + "\n" + passage + "\n" + prose(7, 5)), (13, passage + " " + passage), (14, "ab" * 400), (15, "é" * 230 + "x" + "é" * 230), (None, prose(8, 3))]
    rows += [(20 + k, " ".join(random.Random(k).choice([w, w, w, w, w, w, w, "new"]) for w in words)) for k in range(12)]
    return rows
