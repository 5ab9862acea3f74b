import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textloom.llm import decontaminate, language_id, licenses

from .conftest import sentence

ALPHABETS = {"aa": "abcde", "bb": "efghi", "cc": "ijklm", "dd": "mnopq", "ee": "qrstu"}


def text_in(lang, seed, n=40):
    r = np.random.default_rng([seed, *lang.encode()])
    return " ".join("".join(r.choice(list(ALPHABETS[lang]), r.integers(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, text_in(lang, i), lang, lang) for i, lang in enumerate(sorted(ALPHABETS) * 40)]
    odd = [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "12 3!", "bb", ""), (1003, text_in("cc", 1), None, ""),
           (None, text_in("dd", 2), "dd", ""), (1004, "a" * 100_000, None, ""), (1004, "a" * 100_000, None, "")]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, held_out string")


def test_languages(labelled):
    found = {}
    for r in language_id.identify(labelled).collect():
        found.setdefault(r.doc_id, r)
    assert all(found[i].lang_pred == lang for i, lang in enumerate(sorted(ALPHABETS) * 40))
    assert [found[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004, None)] == ["und"] * 3 + ["cc", "aa", "dd"]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[1000].score == 0
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items() if i is not None)
    assert found[None].held_out
    assert language_id.identify(labelled).count() == labelled.count()


def test_prediction_sees_the_text_alone(labelled):
    model = language_id.train(labelled)
    mixed = labelled.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") * 7)
    plain = sorted(r.lang_pred for r in language_id.predict(labelled, model).collect())
    assert plain == sorted(r.lang_pred for r in language_id.predict(mixed, model).collect())


def test_one_language_and_none(spark, labelled):
    one = language_id.identify(labelled.where("lang = 'aa' or lang is null")).collect()
    assert {r.lang_pred for r in one} == {"aa", "und"}
    assert {r.lang_pred for r in language_id.identify(labelled.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(labelled.limit(0)).count() == 0


def test_rejected(labelled):
    model = language_id.train(labelled)
    flagged = {r.doc_id: r._rejected for r in language_id.flag_rejected(labelled, model).collect()}
    texts = {r.doc_id: r.text for r in labelled.collect()}
    assert flagged == {i: not language_id.has_letter(t) or model.judge(t)[2] <= model.bound for i, t in texts.items()}
    assert all(flagged[i] for i in (1000, 1001, 1002)) and sum(flagged.values()) <= 6


def test_texts_between_languages_are_ambiguous(spark):
    """Gibberish, code and scripts that were never learned are flagged, of clean held-out texts less than one in a hundred."""
    rows = [(i, text_in(lang, i, 150), lang) for i, lang in enumerate(sorted(ALPHABETS) * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    odd = ["zvwy wzxv yxzw vvxy " * 20, "{x[0]+=1;} != (y<<2)&0xff; " * 20, "Это текст о погоде и природе. " * 20, "这是一个中文文本 " * 30]
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    said = language_id.predict(docs.unionByName(spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(odd)], docs.schema)), model)
    flags = {r.doc_id: (r.ambiguous, r.held_out) for r in said.collect()}
    assert model.bound > 0 and all(flags[-1 - k][0] for k in range(len(odd)))
    clean = [flag for i, (flag, out) in flags.items() if i >= 0 and out]
    assert len(clean) > 200 and sum(clean) < 0.01 * len(clean)


def brute_judge(counts, text):
    """Naive Bayes per bit and the loss-weighted nearest codeword, gram by gram in plain Python."""
    langs = sorted(counts)
    code = language_id.codewords(langs)
    share = {k: (counts[k] + 0.5) / (counts[k] + 0.5).sum() for k in langs}
    grams = [int(g) for part in language_id.buckets_of(text) for g in part]
    losses, trusts = [], []
    for bit in range(code.shape[1]):
        one = [share[k] for k, c in zip(langs, code[:, bit]) if c > 0]
        zero = [share[k] for k, c in zip(langs, code[:, bit]) if c < 0]
        weight = np.log(sum(one) / len(one)) - np.log(sum(zero) / len(zero))
        means = np.array([float((share[k] * weight).sum()) for k in langs])
        trusts.append(max(1e-6, (means * code[:, bit]).min()))
        margin = sum(float(weight[g]) for g in grams) / len(grams) / (np.abs(means).mean() + 1e-9)
        losses.append([np.log1p(np.exp(-2 * margin * c)) for c in code[:, bit]])
    loss = (np.array(trusts)[:, None] * np.array(losses)).sum(axis=0) / sum(trusts)
    return langs[int(loss.argmin())], float(np.sort(loss)[1] - np.sort(loss)[0])


def test_decoding_by_brute_force(labelled):
    model, counts = language_id.train(labelled), {}
    for r in labelled.where("lang is not null and text is not null").collect():
        if language_id.has_letter(r.text):
            for part in language_id.buckets_of(r.text):
                counts[r.lang] = counts.get(r.lang, 0) + np.bincount(part, minlength=language_id.BUCKETS).astype(float)
    for lang in ALPHABETS:
        for text in (text_in(lang, 900), text_in(lang, 901, 3), text_in(lang, 902, 600), text_in(lang, 1) + text_in("aa", 2)):
            said, score, nearer = model.judge(text)
            want, apart = brute_judge(counts, text)
            assert said == want and nearer == pytest.approx(apart, rel=1e-3, abs=1e-4) and 0 <= score <= 1


def test_too_many_labels(labelled):
    with pytest.raises(ValueError, match="more than 3 languages"):
        language_id.train(labelled, max_langs=3)


def test_string_ids(labelled):
    named = labelled.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    found = language_id.identify(named)
    assert found.schema["doc_id"].dataType.simpleString() == "string" and found.count() == labelled.count()


@pytest.mark.parametrize("n", [2, 4, 7, 8, 40])
def test_codewords_differ(n):
    code = language_id.codewords([f"l{i}" for i in range(n)])
    apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)[~np.eye(n, dtype=bool)]
    assert apart.min() >= (1 if n == 2 else 2 if n < 4 else 4)


def test_stretches_give_all_ngrams(monkeypatch):
    text = sentence(1, 100)
    whole = sum(np.bincount(b, minlength=language_id.BUCKETS) for b in language_id.buckets_of(text))
    monkeypatch.setattr(language_id, "STRETCH", 17)
    assert (whole == sum(np.bincount(b, minlength=language_id.BUCKETS) for b in language_id.buckets_of(text))).all()


ITEMS = [
    (1, "Alice has 3 apples and gives 2 apples to Bob before the long walk home with Alice"),
    (2, "Carol has 7 apples and gives 5 apples to Dave before the long walk home with Carol"),
    (3, sentence(1, 30)),
    (4, "short item"),
    (5, None),
    (6, "..."),
    (None, sentence(2, 20)),
    (8, sentence(9, 60)),
]
PLAIN = sentence(50, 60)


def leaks(spark, texts, items=ITEMS, **options):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, item_id string, hash string")
    known = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return docs, known


def test_leaks(spark):
    item = ITEMS[0][1]
    cases = {
        10: (f"{PLAIN} {item} {PLAIN}", (1, True)),
        11: (f"{PLAIN} Eve has 30 apples and gives 11 apples to Mallory before the long walk home with Eve", (1, False)),
        # Alice is two people here: the values do not follow from the item's.
        12: ("Eve has 30 apples and gives 11 apples to Mallory before the long walk home with Trent", None),
        13: (PLAIN, None),
        14: (None, None),
        15: ("", None),
        16: (f"{ITEMS[2][1].upper()}", None),
        17: (f"x {ITEMS[2][1]}, y", (3, True)),
        18: (" ".join(ITEMS[2][1].split()[:18]), (3, True)),
        19: (" ".join(ITEMS[2][1].split()[:12]), None),
        20: ("a short item here", (4, True)),
        21: (f"{ITEMS[6][1]}", (None, True)),
        22: (f"{PLAIN} {' '.join(ITEMS[7][1].split()[20:33])} {PLAIN}", (8, True)),
        23: (f"{PLAIN} {' '.join(ITEMS[7][1].split()[20:32])} {PLAIN}", None),
    }
    texts = [(i, t) for i, (t, _) in cases.items()] + [(10, cases[10][0]), (None, cases[10][0])]
    docs, known = leaks(spark, texts)
    found = {r.doc_id: (r.item_id, r.exact) for r in decontaminate.find_leaks(docs, known).collect()}
    assert found.pop(None) == (1, True)
    assert found == {i: want for i, (_, want) in cases.items() if want}
    two = decontaminate.find_leaks(docs, known).where("doc_id = 10").collect()
    assert [(r.item_id, r.n_items, r.covered, r.contaminated) for r in two] == [(1, 2, 1.0, True)] * 2
    kept = decontaminate.drop_leaks(docs, known)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, (_, want) in cases.items() if not want]


def test_verbatim_words_beside_a_conflict(spark):
    """A passage copied word for word counts, though one of two equal values beside it was changed."""
    asked = f"Alice has 3 pens and 3 cups in the house {sentence(60, 30)} as she said to Bob before the long walk"
    changed = asked.replace("3 cups", "4 cups")
    swapped = asked.replace("to Bob", "to Alice")
    few = " ".join(asked.split()[:9] + asked.split()[10:12]).replace("3 cups", "4 cups")
    docs, known = leaks(spark, [(1, changed), (2, swapped), (3, few), (4, PLAIN)], [(1, asked)])
    found = {r.doc_id: (r.item_id, r.exact) for r in decontaminate.find_leaks(docs, known).collect()}
    assert found == {1: (1, False), 2: (1, False)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, known).collect()) == [3, 4]


@pytest.mark.parametrize("change", [str.upper, str.lower, str.title])
def test_copies_in_another_case(spark, change):
    """Every item is found in any case, also one that another item stands for; other words are not."""
    names = "Alice Bob Carol Dave Eve Mallory".split()
    asked = [" ".join(w if k % 3 else f"{names[(i + k) % 6]}" for k, w in enumerate(sentence(70 + i, 24).split())) for i in range(4)]
    asked += [ITEMS[0][1], ITEMS[1][1], "Short Item of Words"]
    cases = [(i, f"{PLAIN} {change(t)} {PLAIN}") for i, t in enumerate(asked)] + [(50, change(PLAIN))]
    docs, known = leaks(spark, cases, list(enumerate(asked)))
    found = {r.doc_id: r.item_id for r in decontaminate.find_leaks(docs, known, any_case=True).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, known, any_case=True).collect()} == {50}


def test_runs_of_names_and_numbers(spark):
    """A name of several words stands for one of one word, and the other way round; so do numbers in words."""
    far = "before the long walk home with"
    docs, known = leaks(
        spark,
        [
            (1, f"{PLAIN}. Mary Ann has 30 apples and gives twenty five apples to Mallory {far} Mary Ann"),
            (2, f"{PLAIN}. Eve has 30 apples and gives 11 apples to Peter van Dyk {far} Eve"),
            (3, f"{PLAIN}. Mary Ann has 30 apples and gives 11 apples to Mallory {far} Mary Lou"),
            (4, f"{PLAIN}. Alice has 3 apples and gives 2 apples to Bob {far} Alice"),
            (5, f"{PLAIN}. Mary Ann has thirty apples and runs for hours"),
            (6, f"Jim, my Al Gore Jr, has nine pens in the red box and my Al Gore Jr has them all"),
        ],
        [*ITEMS[:2], (9, "Tom, my Sue, has 9 pens in the red box and my Sue has them all")],
    )
    found = {r.doc_id: (r.item_id, r.exact) for r in decontaminate.find_leaks(docs, known).collect()}
    assert found == {1: (1, False), 2: (1, False), 4: (1, True), 6: (9, False)}


WORDS = st.lists(st.sampled_from(["Ann", "Lee,", "Bob", "x", "3", "four", "seven.", "5kg", "km", "The", "..."]), max_size=30)


@settings(deadline=None, max_examples=300)
@given(WORDS)
def test_template_words_begin_where_a_plain_loop_says(told):
    kinds = [decontaminate.canonical(w)[0] if decontaminate.canonical(w)[1] else "" for w in told]
    starts, i = [], 0
    while i < len(told):
        j = i + 1
        while j < len(told) and kinds[j] == kinds[i] and told[j - 1][-1] not in ",;:.!?)]}\"":
            j += 1
        joined = kinds[i] in ("#name", "#number") and j - i <= decontaminate.RUN
        starts += [i] if joined else range(i, j)
        i = j
    words = decontaminate.Vocabulary().read(" ".join(told).encode())
    assert words.starts.tolist() == starts
    ends = [*starts[1:], len(told)]
    values = [f"{kinds[a]}={' '.join(decontaminate.canonical(w)[1] for w in told[a:b])}" for a, b in zip(starts, ends) if kinds[a]]
    assert words.values(0, len(starts)) == values


def test_a_vocabulary_that_is_emptied_reads_the_same(monkeypatch):
    monkeypatch.setattr(decontaminate, "HELD", 3)
    few, many = decontaminate.Vocabulary(), decontaminate.Vocabulary()
    for k in range(50):
        text = f"Ann Lee has {k} pens{k % 7} in 4 boxes " + " ".join(f"w{j}" for j in range(k * 200))
        a, b = few.read(text.encode()), many.read(text.encode())
        assert all((a.hashes(f) == b.hashes(f)).all() for f in (False, True)) and a.values(0, 9) == b.values(0, 9)


def test_windows_too_many_to_broadcast(spark, monkeypatch):
    """One boilerplate window in all documents and a third of the items: the split join gives the rows of the broadcast one."""
    shared = "please read the following question and choose the best answer below"
    items = [(i, f"{shared} {sentence(i, 20)}" if i % 3 else sentence(i, 20)) for i in range(30)]
    docs = [(i, f"{sentence(i + 500, 15)} {shared} {items[i % 30][1] if i % 2 else sentence(i + 900, 15)}", i) for i in range(200)]
    docs += [(200, None, 0), (201, "", 0), (202, docs[1][1], 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, _part int")
    known = spark.createDataFrame(items, "item_id long, text string")

    def leaks():
        rows = decontaminate.find_leaks(docs, known, any_case=True).collect()
        return sorted((r.doc_id, r.item_id, r.n_items, r.covered, r.exact) for r in rows)

    expected = leaks()
    assert {r[0] for r in expected} >= {*range(1, 200, 2), 202}
    monkeypatch.setattr(decontaminate, "fits_broadcast", lambda df: False)
    assert leaks() == expected


def test_leaks_without_rows(spark):
    docs, known = leaks(spark, [(1, PLAIN)])
    assert decontaminate.find_leaks(docs.limit(0), known).count() == 0
    assert decontaminate.find_leaks(docs, known.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, known.limit(0)).count() == 1


def test_placeholders():
    kinds = {w: decontaminate.canonical(w)[0] for w in ("3", "3,000.50", "$5", "50%", "seven", "5kg", "hours", "Bob's,", "The", "apple.")}
    assert list(kinds.values()) == ["#number"] * 5 + ["#measure", "#unit", "#name", "the", "apple"]


def test_licenses(spark):
    templates = spark.createDataFrame([*licenses.NOTICES, ("none", ""), ("null", None), ("short", "public domain")], "license string, text string")
    bsd = licenses.NOTICES[1][1]
    cases = {
        1: (f"{PLAIN}\nReleased under the MIT License.\n{PLAIN}", {"MIT"}),
        2: (bsd.upper(), {"BSD"}),
        3: (" ".join(bsd.split()[:18]), {"BSD"}),
        4: (" ".join(bsd.split()[:14]), set()),
        5: (f"{bsd} Licensed under CC BY-NC 4.0", {"BSD", "CC-BY-NC-4.0"}),
        6: (f"permission license {PLAIN}", set()),
        7: (None, set()),
        8: ("", set()),
        9: ("PUBLIC domain", {"short"}),
        11: (f"{PLAIN} {sentence(5, 60_000)} {licenses.NOTICES[15][1]}", {"MIT"}),
        12: (f"under the {licenses.NOTICES[10][1]}, or (at your option) any later version.", {"GPL-3.0"}),
        13: (f"under the {licenses.NOTICES[9][1]}, or (at your option) any later version.", {"GPL-2.0"}),
        14: (f"{PLAIN} {licenses.NOTICES[12][1]}", {"LGPL-3.0"}),
        15: (f"{PLAIN} {licenses.NOTICES[13][1]} {PLAIN}", {"AGPL-3.0"}),
        16: (f"{licenses.NOTICES[16][1]} {licenses.NOTICES[17][1]}", {"BSD", "BSD-3-Clause"}),
        17: (f"/* {licenses.NOTICES[14][1].lower()} */", {"Apache-2.0"}),
        18: (f"{licenses.NOTICES[18][1]} {PLAIN}", {"ISC"}),
        19: (f"{licenses.NOTICES[19][1]} {licenses.NOTICES[20][1]}", {"Unlicense", "CC0-1.0", "short"}),
        20: (f"{PLAIN} {licenses.NOTICES[21][1]}", {"Zlib"}),
        21: (f"{PLAIN} noninfringement merchantability sublicense unencumbered", set()),
        10: (f"{sentence(3, 3000)} {licenses.NOTICES[4][1]} {sentence(4, 3000)}", {"CC-BY-4.0"}),
    }
    rows = [(i, t, "l", "h") for i, (t, _) in cases.items()] + [(1, cases[1][0], "l", "h"), (None, cases[1][0], "l", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, hash string")
    found = licenses.scan_licenses(docs, templates).collect()
    assert {i: {r.license for r in found if r.doc_id == i} for i in cases} == {i: want for i, (_, want) in cases.items()}
    assert len([r for r in found if r.doc_id in (1, None)]) == 3
    assert [r.start for r in found if r.doc_id == 2] == [0]
    assert licenses.scan_licenses(docs.limit(0), templates).count() == 0
    assert licenses.scan_licenses(docs, templates.limit(0)).count() == 0


def test_bands_guarantee():
    for c in licenses.length_classes([2, 5, 7, 9, 14, 21, 100, 149]):
        for n in range(c.least, c.most + 1):
            template = n - c.size + 1
            shared = -(-4 * template // 5)
            similar = shared / (template + c.window - c.size + 1 - shared)
            assert 1 - (1 - similar) ** c.bands() >= licenses.FOUND
        assert all(any(s <= p and p + c.most <= s + c.window for s in range(0, 400, c.step)) for p in range(300))
