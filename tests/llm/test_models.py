import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstream.llm import langid, licences, split, toxicity

from . import corpus as K

SYLLABLES = {"aa": ["ka", "lo", "mi", "ru", "te"], "bb": ["sch", "eun", "gar", "tz", "ber"], "cc": ["oux", "elle", "ique", "tre", "né"]}


def talk(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_split_follows_crc32(spark):
    got = spark.range(200).select("id", split.held_out("id").alias("h")).collect()
    assert all(r.h == held(r.id) for r in got)


def test_languages_of_held_out_rows(spark):
    langs = list(SYLLABLES)
    rows = [(k, talk(langs[k % 3], k), langs[k % 3]) for k in range(240)] + [(900, None, "aa"), (901, "12 .. 34", "bb"), (902, "", None), (903, talk("cc", 1), None), (None, talk("aa", 2), "bb"), (1, talk("bb", 1), "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs)
    assert sorted(model.languages) == langs
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == langs[k % 3] for k in range(2, 240))
    assert by[900].lang_pred == by[901].lang_pred == by[902].lang_pred == "und" and by[901].score == 0 and by[901].ambiguous
    assert by[903].lang_pred == "cc" and by[None].lang_pred == "aa" and by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.drop_unidentified(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_language_mixture_is_ambiguous(spark):
    langs = list(SYLLABLES)
    docs = spark.createDataFrame([(k, talk(langs[k % 3], k), langs[k % 3]) for k in range(90)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    rng = random.Random(4)
    mixed, pure = [], []
    for k in range(60):
        one, two, n = langs[k % 3], langs[(k + 1) % 3], 4 + k % 5
        words = talk(one, 500 + k, n).split() + talk(two, 700 + k, n).split()
        rng.shuffle(words)
        mixed.append((k, " ".join(words), one))
        pure.append((k, talk(one, 900 + k, 2 * n), one))
    ask = lambda rows: langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert not any(r.ambiguous for r in ask(pure)) and all(r.score > 0.9 for r in ask(pure))
    flagged = [r.ambiguous for r in ask(mixed)]
    assert sum(flagged) >= 10  # the languages weigh unevenly in bytes, so half the words are not half the evidence
    # a gap of the two best below the margin is what the flag says
    got = model.decode(*model.margins(*langid.B.text_arrays(pa.array([t for _, t, _ in mixed], type=pa.large_string()))))[2]
    assert flagged == (got < langid.MARGIN).tolist()


def test_texts_of_no_one_language_go(spark):
    langs = list(SYLLABLES)
    docs = spark.createDataFrame([(k, talk(langs[k % 3], k), langs[k % 3]) for k in range(90)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    rng, rows = random.Random(4), []
    for k in range(60):
        words = talk(langs[k % 3], 500 + k, 4 + k % 5).split() + talk(langs[(k + 1) % 3], 700 + k, 4 + k % 5).split()
        rng.shuffle(words)
        rows.append((k, " ".join(words), None))
    texts = spark.createDataFrame(rows + [(90, "12 34", None), (91, talk("bb", 950), None)], docs.schema)
    stay = {r.doc_id for r in langid.predict(texts, model).collect() if not r.ambiguous}
    assert {r.doc_id for r in langid.drop_unidentified(texts, model).collect()} == stay and 91 in stay and len(stay) < 52
    alone = langid.fit(docs.filter("lang = 'aa'"))  # nothing to be told from
    assert langid.drop_unidentified(texts, alone).count() == 61


def test_long_texts_are_read_a_stretch_at_a_time(spark, monkeypatch):
    langs = list(SYLLABLES)
    docs = spark.createDataFrame([(k, talk(langs[k % 3], k), langs[k % 3]) for k in range(90)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    buf, offs = langid.B.text_arrays(pa.array(["", talk("bb", 1, 3000), "x", None, talk("cc", 2, 50)], type=pa.large_string()))
    want, n = model.margins(buf, offs)
    monkeypatch.setattr(langid, "_STRETCH", 777)
    again, m = model.margins(buf, offs)
    assert np.allclose(again, want) and n.tolist() == m.tolist()


def test_every_language_of_the_sample_is_learned(spark):
    rows = [(k, talk("aa", k), "aa") for k in range(60)] + [(100 + k, talk("bb", k), "bb") for k in range(50)] + [(200 + k, talk("cc", k), f"rare{k % 300}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r.lang for r in docs.filter(~langid.held_out("doc_id")).select("lang").distinct().collect()}
    model = langid.fit(docs)
    assert set(model.languages) == learned and len(learned) > 290 and model.languages[:2] == ["aa", "bb"]
    assert {r.lang_pred for r in langid.predict(docs.filter("doc_id < 100"), model).collect()} == {"aa"}
    fewer = langid.fit(docs, learn_total=40)
    assert set(fewer.languages) < learned


def test_weights_equal_a_plain_sum(spark):
    rows = [(k, talk(x, k), x) for k in range(90) for x in ("aa", "bb", "cc")]
    docs = spark.createDataFrame([(i, t, x) for i, (_, t, x) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    model = langid.fit(docs)
    table = np.zeros((3, langid.BUCKETS))
    for r in docs.filter(~langid.held_out("doc_id")).collect():
        two, three, good = langid._grams(*langid.B.text_arrays(pa.array([r.text], type=pa.large_string())))
        for g in (two[good], three[good]):
            table[model.languages.index(r.lang)] += np.bincount(g, minlength=langid.BUCKETS)
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * langid.BUCKETS)
    want = np.array([np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0)) for bit in model.code.T]).T
    assert np.allclose(model.weights, want, rtol=1e-5)
    assert np.allclose(model.apart, [2 * min(abs(x @ w) for x in share) for w in want.T])
    # decoding by agreement equals adding up the loss of every bit
    margins = np.array([[0.3, -1.2, 2.0][: model.code.shape[1]], [-0.1, 0.0, 0.5][: model.code.shape[1]]])
    loss = np.logaddexp(0.0, -margins[:, None, :] * model.code[None]) @ model.trust
    odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
    best, score, _ = model.decode(margins, np.array([5.0, 9.0]))
    assert best.tolist() == loss.argmin(axis=1).tolist() and np.allclose(score, (odds / odds.sum(axis=1, keepdims=True)).max(axis=1))


def test_languages_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()] == ["und"]
    assert langid.predict(docs.filter("false"), langid.fit(docs.filter("false"))).count() == 0


@pytest.mark.parametrize("n", [2, 3, 6, 9, 20])
def test_codewords_lie_apart(n):
    code = langid.codewords(n)
    apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert apart >= (1 if n == 2 else 2) and set(np.unique(code)) <= {-1.0, 1.0}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = {"grumble": 2.0, "snarl": 1.5, "mock": 1.0, "jeer*": 1.0}
    lexicon = toxicity.Lexicon(terms)
    rng = random.Random(0)
    letters = "grumblesnajckoi"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    for t in ("grumble", "snarl", "mock", "jeer"):
        for k in range(len(t)):
            words += [t[:k] + t[k + 1 :], t[:k] + "x" + t[k:], t[:k] + "q" + t[k + 1 :], t + "s", "s" + t]
    for w in words + list(terms):
        w = w.rstrip("*")
        hit = lexicon.match(w)
        exact = [t for t in terms if (w == t or t.endswith("*") and w.startswith(t[:-1]))]
        near = [t for t in terms if not t.endswith("*") and len(t) >= toxicity.FUZZY_FROM and edit_distance(w, t) == 1]
        if exact:
            assert hit and hit[1] == 0 and hit[0] in exact
        elif near:
            assert hit and hit[1] == 1 and hit[0] in near
        else:
            assert hit is None, (w, hit)


MISSPELLED = [lambda t: t[1:], lambda t: t[0] + t, lambda t: "x" + t[1:], lambda t: t[:2] + t[3:], lambda t: t[:3] + "q" + t[3:], lambda t: t[:-1]]


def test_every_toxic_term_may_be_misspelled(spark):
    bad = ["grumpoid", "snarlface", "yuckhead", "mockster", "idjot"]
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(1200):
        words = K.prose(k, 4).split()
        if k % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        elif k % 3 == 1:
            words.insert(3, rng.choice(["ockster", "mockery", "snarling"]))  # clean words beside a term or with its beginning
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    model = toxicity.fit(K.docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(bad) <= set(model.lexicon) and "ockster" in model.spared
    finder = toxicity.Finder(toxicity.Lexicon(model.lexicon), model.spared, model.inexact)
    score = lambda text: float(model.score(np.array([finder.features(text)]))[0])
    for k, term in enumerate(bad):
        for j, wrong in enumerate(MISSPELLED):
            words = K.prose(5000 + k, 4).split()
            for at, t in ((2, term), (9, bad[(k + 1) % 5]), (16, bad[(k + 2) % 5])):
                words.insert(at, MISSPELLED[(j + 1) % 6](t) if wrong(t) in model.spared else wrong(t))
            assert score(" ".join(words)) >= 0.5, (term, j)
    for clean in ("ockster", "snarling", "grumpy", "mockery yucca"):
        assert score(K.prose(6000, 4) + " " + clean) < 0.5
    assert finder.match("1djot") == finder.match("idj0t") == ("idjot", 0) and finder.match("idjot7")[0] == "idjot" and finder.match("2024") is None


def test_a_beginning_beside_its_word_still_stands_for_inflections():
    lexicon = toxicity.Lexicon({"grump": 3.0, "grump*": 2.0})
    assert lexicon.match("grumpish") == ("grump*", 0) and lexicon.match("grumpy") == ("grump*", 0) and lexicon.match("rump") == ("grump", 1)


def test_toxicity_learns_terms_and_scores_held_out_rows(spark):
    bad = ["grumpoid", "snarlface", "yuckhead"]
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        words = K.prose(k, 4).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "grumpoid"), (5, rows[5][1]), (2002, "that grumpoidd and that snarlfce and yuckhead")]
    docs = K.docs(spark, rows)
    truth = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, truth)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 1000)
    by = {r.doc_id: r for r in got}
    assert by[2000].predicted == by[2001].predicted == 0 and 0 <= by[2000].score <= 1
    assert by[2002].score > by[2001].score and all(r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(docs.filter("false"), model).count() == 0
    nothing = toxicity.fit(docs, truth.filter("false"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, nothing).collect())


def test_quotation_weighs_less():
    finder = toxicity.Finder(toxicity.Lexicon({"grumpoid": 3.0}))
    plain, quoted, told = (finder.features(t) for t in ("you grumpoid go away", 'he wrote "you grumpoid" to her', "she said grumpoid once"))
    assert plain[0] > quoted[0] == told[0] > 0


def test_licences_are_found_and_confirmed(spark):
    rows = [(k, K.prose(k, 12) + "\n" + K.prose(k + 500, 6)) for k in range(60)]
    notices = [(100 + k, K.prose(k, 5) + "\n" + t[0] + "\n" + K.prose(k + 9, 5)) for k, t in enumerate(licences.TEMPLATES[f] for f in licences.NOTICES)]
    odd = [(300, None), (301, ""), (302, "... !!"), (303, "licensed license licence version"), (None, licences.TEMPLATES["MIT"][0])]
    docs = K.docs(spark, rows + notices + odd)
    got = {r.doc_id: r for r in licences.report(licences.scan(docs, licences.fit(docs))).collect()}
    assert len(got) == len(rows + notices + odd)
    assert all(got[100 + k].licences == f for k, f in enumerate(licences.NOTICES))
    assert all(got[k].licences == "" for k in range(60)) and got[303].licences == ""
    assert got[300].n_paragraphs == got[301].n_paragraphs == got[302].n_paragraphs == 0
    assert got[None].licences == "MIT"
    assert licences.scan(docs.filter("false"), licences.fit(docs.filter("false"))).count() == 0


GPL3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""


def test_licences_in_wrapped_lines_and_inside_prose(spark):
    learn = K.docs(spark, [(k, K.prose(k, 12) + "\n" + K.prose(k + 500, 6)) for k in range(60)])
    model = licences.fit(learn)
    inside = [("MIT", "distributed under the terms of the MIT license"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("GPL-2.0", "released under the GNU General Public License, version 2"), ("MPL-2.0", "available under the Mozilla Public License, Version 2.0"), ("CC-BY-SA", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License")]
    rows, want = [(1, GPL3), (2, K.prose(3, 9) + "\n\n" + GPL3 + "\n" + K.prose(5, 9)), (3, "see " + licences.NOTICES["ISC"][0])], {1: "GPL-3.0", 2: "GPL-3.0", 3: "ISC"}
    for f, (family, notice) in enumerate(inside):
        for k, n in enumerate((10, 20, 30, 50)):
            i = 100 + 10 * f + k
            around = K.prose(i, n).split()
            rows.append((i, " ".join([*around[:n], notice, *around[n : 2 * n]])))
            want[i] = family
    got = {r.doc_id: r.licences for r in licences.report(licences.scan(K.docs(spark, rows), model)).collect()}
    assert got == want
    again = licences.fit(learn.repartition(7).orderBy(F.rand(3)))
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature


def test_paragraph_windows_cover_every_word():
    text = " ".join(f"w{k}" for k in range(300)) + "\nshort line\n\n" + "x"
    from inkstream.llm import buffers as B

    words, at, to, row, nth = licences.paragraphs(*B.text_arrays(pa.array([text, "", "y z"], type=pa.large_string())))
    for width in licences.WIDTHS:
        covered = np.zeros(len(words), dtype=bool)
        for a, b in zip(at, to):
            assert b - a <= licences.WINDOW_WORDS
            if b - a <= width:
                covered[a:b] = True
        assert covered.all()
    assert row.tolist()[-1] == 2 and nth[0] == 0 and nth[-1] == 0 and set(nth[row == 0].tolist()) == {0, 1}
    assert any(b - a == 2 and a == 300 for a, b in zip(at, to))  # a line of its own


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This is not distributed under the terms of the MIT license but is proprietary.", ""),
        ("We walked home. All rights reserved.", ""),
        ("All rights reserved.", "Proprietary"),
        ("Dual licensed under Apache 2.0 or MIT at your option.", "Apache-2.0,MIT"),
        ("Licensed under either of MIT or Apache License, Version 2.0 at your option.", "Apache-2.0,MIT"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("Released under the zlib License.", "Zlib"),
        ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "BSL-1.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA"),
        ("You may not use this file except in compliance with the License. Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache-2.0"),
        ("The driver never had a licence to drive the old bus.", ""),
    ],
)
def test_families_denials_and_choices(spark, text, want):
    global _licence_model
    if "_licence_model" not in globals():
        _licence_model = licences.fit(K.docs(spark, [(k, K.prose(900 + k, 6)) for k in range(60)]))
    got = licences.report(licences.scan(K.docs(spark, [(1, text)]), _licence_model)).first()
    assert got.licences == want


def test_every_name_of_a_family_is_found(spark):
    model = licences.fit(K.docs(spark, [(k, K.prose(900 + k, 6)) for k in range(60)]))
    rows = [(k, f"Released under the {names[0]}.", family) for k, (family, names) in enumerate(licences.NAMES.items())]
    got = {r.doc_id: r.licences for r in licences.report(licences.scan(K.docs(spark, [r[:2] for r in rows]), model)).collect()}
    wrong = [(family, got[k]) for k, _, family in rows if got[k] != family]
    assert wrong == [] and len(rows) >= 28
