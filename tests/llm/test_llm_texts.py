"""Leak detection, mixing and languages on small and dirty texts."""

import random

import numpy as np
import pytest

from hashloom.llm import contamination, language, mixing
from hashloom.llm.words import words

WORDS = [f"w{i}" for i in range(400)]


def test_words():
    assert words("Élan (a (b) c) d'Été [x]  STRASSE Straße 3,5") == ["elan", "d", "ete", "strasse", "strasse", "3", "5"]
    assert words("(open a] b)") == [] and words("(never closed") == ["never", "closed"] and words(None) == [] and words("") == []
    assert words("été _x_") == ["ete", "x"]


def brute_leaks(items, docs, run):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - run + 1):
            grams.setdefault(tuple(w[i : i + run]), set()).add(item)
    out = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - run + 1):
            for item in grams.get(tuple(w[i : i + run]), ()):
                out.setdefault((item, doc), set()).add(i)
    return {(*k, len(v)) for k, v in out.items()}


@pytest.mark.parametrize("slice_chars", [10**9, 3000])
def test_leaks(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(contamination, "SLICE_CHARS", slice_chars)
    rnd = random.Random(1)
    text = lambda n: [rnd.choice(WORDS[: rnd.choice([30, 400])]) for _ in range(n)]
    items = [(i, text(rnd.randint(5, 60))) for i in range(40)]
    docs = []
    for d in range(150):
        w = text(rnd.randint(0, 90))
        if d % 3 == 0:
            _, item = rnd.choice(items)
            start, size = rnd.randint(0, max(0, len(item) - 10)), rnd.randint(8, 30)
            at = rnd.randint(0, len(w))
            w[at:at] = item[start : start + size]
        joined = " ".join(x.upper() if rnd.random() < 0.2 else x for x in w)
        docs.append((d, joined.replace(" w3 ", " (zwischen ruf) w3, ")))
    items = [(i, " ".join(w)) for i, w in items] + [(50, None), (51, ""), (None, "a b"), (0, " ".join(items[0][1]))]
    docs += [(900, None), (901, ""), (902, (" ".join(WORDS) + " ") * 500 + items[3][1] + " x" * 5000), (None, items[1][1]), docs[0]]
    frame = lambda rows: spark.createDataFrame([(k, v, "z") for k, v in rows], "id bigint, text string, doc_id string")
    for run in (8, 15):
        found = contamination.leaks(frame(items), "id", "text", frame(docs), "id", "text", run).collect()
        want = brute_leaks([i for i in items if i[0] is not None], [d for d in docs if d[0] is not None], run)
        assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert contamination.leaks(frame(items).limit(0), "id", "text", frame(docs), "id", "text").collect() == []
    assert contamination.leaks(frame(items), "id", "text", frame(docs).limit(0), "id", "text").collect() == []


def test_retrieval_equals_full_scoring(monkeypatch):
    monkeypatch.setattr(contamination, "STEP", 7)
    monkeypatch.setattr(contamination, "BLOCK", 3)
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choice(WORDS[:9]) for _ in range(rnd.randint(15, 40)))) for i in range(50)]
    index = contamination.build_index(items, 15)
    count = len(index.terms)
    passages = [sorted({rnd.randrange(count) for _ in range(rnd.randint(1, 400))}) for _ in range(60)]
    # Some hold a whole unit, some most of one.
    for unit in range(0, len(index.item_of), 9):
        own = np.flatnonzero(index.unit == unit)
        terms = np.searchsorted(index.start, own, side="right") - 1
        passages.append(sorted(rnd.sample(terms.tolist(), rnd.randint(len(terms) // 2, len(terms)))))
    p = np.repeat(np.arange(len(passages)), [len(x) for x in passages])
    got = list(zip(*(x.tolist() for x in contamination.retrieve(index, p, np.concatenate(passages))), strict=True))
    want = set()
    for number, terms in enumerate(passages):
        score = np.zeros(len(index.item_of))
        for t in terms:
            at = slice(index.start[t], index.start[t + 1])
            score[index.unit[at]] += index.impact[at]
        want |= {(number, int(i)) for i in np.flatnonzero(score >= contamination.ENOUGH)}
    assert set(got) == want and len(got) == len(want) > 30


def test_retrieval_prunes_and_verifies_retrieved_pairs_only():
    rnd = random.Random(4)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(60))) for i in range(30)]
    index = contamination.build_index(items, 15)
    texts = [[rnd.choice(WORDS) for _ in range(100)] for _ in range(50)] + [words(items[3][1])[20:50]]
    counts = {}
    found, runs = contamination.search_texts(index, texts, counts)
    assert found.tolist() == [3 * len(texts) + 50] and runs.tolist() == [16]
    assert counts["verified"] <= counts["pairs"] and counts["retrieved"] < 0.1 * counts["passages"]


def test_tokens_of_pieces(monkeypatch):
    """Counts don't depend on where long texts are cut, and runs of any length have theirs."""
    import base64

    import tiktoken

    with open(mixing.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.read().splitlines())}
    encoder = tiktoken.Encoding("own", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", " \n ", "\t", "a", "word", "it's", "12", "...", "é", "今天", "x" * 9, "\u00a0", "'ll "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80))) for _ in range(300)] + [" " * 70 + "a", "a" + "\n" * 70, "b" * 70, " " * 50 + "a " + "!" * 60 + "   b"]
    want = [len(encoder.encode_ordinary(t)) for t in texts]
    for piece in (1, 2, 7, 30):
        monkeypatch.setattr(mixing, "PIECE", piece)
        assert [mixing.count_tokens(encoder, t) for t in texts] == want
        assert all("".join(mixing._pieces(t)) == t for t in texts)
    monkeypatch.undo()
    assert mixing.count_tokens(encoder, " " * 1_500_000 + "a") == 1_500_000
    assert mixing.count_tokens(encoder, "word " * 100_000) == len(encoder.encode_ordinary("word " * 100_000))


def test_fill_targets():
    fill = mixing.fill_targets
    assert fill(100, [("a", 1, 9, 50), ("b", 3, 9, 50)]) == {"a": 25.0, "b": 75.0}
    assert fill(100, [("a", 1, 1, 10), ("b", 1, 9, 50)]) == {"a": 10.0, "b": 90.0}
    assert fill(100, [("a", 1, 1, 10), ("b", 1, 1, 50)]) == {"a": 10.0, "b": 50.0}
    assert fill(100, [("a", 0.5, 2, 0), ("b", 0.5, 2, 80)]) == {"a": 0.0, "b": 100.0}
    assert fill(0, [("a", 1, 1, 10)]) == {"a": 0.0} and fill(100, []) == {}


def test_mixture(spark):
    rnd = random.Random(3)
    docs = [(i, rnd.choice(["Big-One", "big_one", " BIG one ", "small", "other", None]), "word " * rnd.randint(1, 60), 0) for i in range(1200)]
    docs += [(5000, "small", None, 0), (5001, "small", "", 0), (5002, "small", "x" * 300_000, 0)] + docs[:5]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("small", 0.5, 3), ("other", None, 5), ("empty", 0.2, None)], "source string, weight double, max_repeats bigint")
    chosen, planned = mixing.mixture(frame, targets, "doc_id", "source", "text")
    rows = chosen.collect()
    assert {r.source for r in rows} == {"big_one", "small"}
    assert max(r.copies for r in rows if r.source == "big_one") == 1 and max(r.copies for r in rows if r.source == "small") <= 3
    assert {tuple(r) for r in mixing.mixture(frame, targets, "doc_id", "source", "text")[0].collect()} == {tuple(r) for r in rows}
    for r in mixing.shares(chosen, planned).collect():
        assert abs(r.tokens - r.target_tokens) <= max(0.02 * r.target_tokens, 37_600), r
    again = {r.source: r for r in mixing.shares(chosen, planned).collect()}
    assert again["empty"].tokens == 0 and again["empty"].copies == 0
    none, plan = mixing.mixture(frame.limit(0), targets, "doc_id", "source", "text")
    assert none.collect() == [] and mixing.shares(none, plan).count() == 3


def test_copies_are_integer_crossings(spark):
    counted = spark.range(1000).selectExpr("id as doc_id", "'s' as source", "id % 37 + 1 as n_tokens")
    planned = spark.createDataFrame([("s", 2.3, 0.9)], "source string, rate double, offset double")
    rows = mixing.copies(counted, planned, "doc_id").collect()
    assert {r.copies for r in rows} == {2, 3} and sum(r.copies for r in rows) in (2300, 2301)
    size = sum(r.copies * r.n_tokens for r in rows)
    assert abs(size - 2.3 * sum(i % 37 + 1 for i in range(1000))) < 40


def samples(spark):
    return spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet")


def test_held_out_language_accuracy(spark):
    rows = [(r.lang, r.text) for r in samples(spark).orderBy("sample_id").collect()]
    for train, test in ((rows[::2], rows[1::2]), (rows[1::2], rows[::2])):
        profiles = language.fit_profiles(train)
        text, _, size, number, _ = language.segment_texts(profiles, [t for _, t in test])
        share = np.zeros((len(test), 6))
        np.add.at(share, (text, number), size)
        right = [profiles.languages[k] == lang for k, (lang, _) in zip(share.argmax(axis=1), test, strict=True)]
        assert np.mean(right) >= 0.99


def test_languages_of_mixed_and_dirty_texts(spark):
    profiles = language.train(samples(spark), "sample_id", "lang", "text")
    de = "Niemand bestreitet, dass wir die Brücke brauchen, aber die Last auf kleine Gemeinden zu schieben ist schlicht falsch. "
    en = "Nobody disputes that the bridge is needed, but the way it shifts the burden onto small towns is simply wrong. "
    docs = [
        (1, en * 3, "en_us"), (2, en * 3, "deu"), (3, en * 3, None), (4, en * 2 + de, "EN"), (5, de.upper() * 2, "ger"), (6, None, "en"), (7, "", "en"), (8, "1234 !!", "und"),
        (9, en * 20_000, "eng"), (10, "Привет мир", "xx"), (11, en * 9 + "Ja, gut. ", "en"), (12, de * 2 + en * 2 + de, "german"), (13, de, ""),
    ]
    frame = spark.createDataFrame(docs + [docs[1]], "doc_id bigint, text string, lang string").withColumnRenamed("lang", "label")
    got = {}
    for r in language.wrong_labels(profiles, frame, "doc_id", "text", "label").collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
        assert 0 <= r.confidence <= 1 and 0.1 <= r.share <= 1
    assert got == {2: {"en"}, 3: {"en"}, 4: {"en", "de"}, 12: {"de", "en"}, 13: {"de"}}
    parts = {}
    for r in language.segments(profiles, frame.where("doc_id in (4, 8, 12)"), "doc_id", "text").orderBy("doc_id", "segment").collect():
        parts.setdefault(r.doc_id, []).append((r.lang, r.begin, r.chars))
    assert [p[0] for p in parts[4]] == ["en", "de"] and [p[0] for p in parts[12]] == ["de", "en", "de"] and 8 not in parts
    assert parts[4][1][1] == len(en) * 2 and sum(p[2] for p in parts[4]) == len(en) * 2 + len(de)
    assert language.wrong_labels(profiles, frame.limit(0), "doc_id", "text", "label").collect() == []


@pytest.mark.parametrize("step", [40, 700, 3000])
def test_steps_change_nothing(spark, monkeypatch, step):
    """Texts cut into pieces, and texts that share a step with others, give what they give alone and whole."""
    profiles = language.train(samples(spark), "sample_id", "lang", "text")
    texts = [r.text for r in samples(spark).orderBy("sample_id").limit(40).collect()]
    calm = texts[3].replace(".", "").replace(",", "")
    long = ["\n".join(texts[:20]), texts[20], "x" * 5000, "", "..! ?", (calm + " ") * 9, "a  b \t " + calm, " ".join(texts[21:]), "Это другой язык. " * 60 + texts[2] + " - " * 400 + texts[2], texts[5] + "."]
    alone = [language.segment_texts(profiles, [t]) for t in long]
    monkeypatch.setattr(language, "STEP_CHARS", step)
    for found in (language.segment_texts(profiles, long), [np.concatenate([np.full(len(x[0]), i) if k == 0 else x[k] for i, x in enumerate(language.segment_texts(profiles, [t]) for t in long)]) for k in range(5)]):
        for i, whole in enumerate(alone):
            own = found[0] == i
            for k in range(1, 4):
                assert found[k][own].tolist() == whole[k].tolist(), (i, k)
            assert np.allclose(found[4][own], whole[4])


SCRIPTS = {
    "ru": "Сегодня мы обсуждаем бюджет города и дороги, которые давно пора починить. Никто не спорит с этим решением. ",
    "uk": "Сьогодні ми обговорюємо бюджет міста і дороги, які давно час полагодити. Ніхто не заперечує цього рішення. ",
    "el": "Σήμερα συζητάμε τον προϋπολογισμό της πόλης και τους δρόμους που πρέπει να επισκευαστούν. Κανείς δεν διαφωνεί. ",
    "ar": "نناقش اليوم ميزانية المدينة والطرق التي يجب إصلاحها منذ زمن طويل. لا أحد يعترض على هذا القرار. ",
    "zh": "今天我们讨论城市的预算和早就应该修理的道路。没有人反对这个决定。我们希望尽快开始工作。",
    "ja": "今日は市の予算と、ずっと前に修理するべきだった道路について話し合います。この決定に反対する人はいません。",
    "ko": "오늘 우리는 도시의 예산과 오래전에 고쳤어야 할 도로를 논의합니다. 아무도 이 결정에 반대하지 않습니다. ",
    "hi": "आज हम शहर के बजट और उन सड़कों पर चर्चा करते हैं जिनकी मरम्मत होनी चाहिए। कोई भी इस निर्णय का विरोध नहीं करता। ",
}


@pytest.mark.parametrize("code", sorted(SCRIPTS))
def test_scripts_without_a_profile(spark, code):
    profiles = language.train(samples(spark), "sample_id", "lang", "text")
    en = "Nobody disputes that the bridge is needed, but the way it shifts the burden onto small towns is simply wrong. "
    other = SCRIPTS[code] * 2
    frame = spark.createDataFrame([(1, other, "xx"), (2, en * 2 + other, "en"), (3, en * 9 + SCRIPTS[code][:4] + ". " + en, "en")], "doc_id bigint, text string, label string")
    parts = {}
    for r in language.segments(profiles, frame, "doc_id", "text").orderBy("doc_id", "segment").collect():
        parts.setdefault(r.doc_id, []).append((r.lang, r.begin, r.chars))
    assert parts[1] == [("und", 0, len(other))]
    assert parts[2] == [("en", 0, len(en) * 2), ("und", len(en) * 2, len(other))]
    found = {(r.doc_id, r.lang, r.main_lang, r.several) for r in language.document_languages(profiles, frame, "doc_id", "text", "label").collect()}
    assert (1, "und", "und", False) in found and {("en", True), ("und", True)} == {(x[1], x[3]) for x in found if x[0] == 2} and [x[1:] for x in found if x[0] == 3] == [("en", "en", False)]
    assert {(r.doc_id, r.lang) for r in language.wrong_labels(profiles, frame, "doc_id", "text", "label").collect()} <= {(2, "en")}


def test_scripts_with_profiles():
    """Profiles of any script: languages of one script are told apart, and labels of all are known."""
    english = "Nobody disputes that the bridge is needed, but the way it shifts the burden onto small towns is simply wrong. "
    profiles = language.fit_profiles([*SCRIPTS.items(), ("en", english)])
    texts = [t * 3 for t in SCRIPTS.values()] + [SCRIPTS["ru"] + english * 2 + SCRIPTS["zh"], SCRIPTS["ru"].upper()]
    text, begin, size, number, _ = language.segment_texts(profiles, texts)
    named = [[profiles.languages[n] for n in number[text == i]] for i in range(len(texts))]
    assert named == [[code] for code in SCRIPTS] + [["ru", "en", "zh"], ["ru"]]
    assert all(size[text == i].sum() == len(t) for i, t in enumerate(texts))


def test_many_languages_in_sequence():
    cost = np.full((400, 200), 9.0)
    cost[np.arange(400), np.repeat(np.arange(200), 2)] = 0
    assert language.best_sequences(cost, np.zeros(400, np.int64)).tolist() == np.repeat(np.arange(200), 2).tolist()


def test_labels(spark):
    rows = [("EN", "en"), ("en_us", "en"), ("es-419", "es"), ("ger", "de"), ("n/a", None), ("und", None), ("", None), (None, None), ("dut", "nl"), ("Italian", "it")]
    frame = spark.createDataFrame(rows, "label string, want string")
    assert all(r.got == r.want for r in frame.withColumn("got", language.label_code(frame.label)).collect())


def test_every_document_has_a_language_row(spark):
    from hashloom.llm import registry

    rows = registry.queries()["p10_documents"](spark, "/root/testdata/sf0.001").collect()
    texts = registry.table(spark, "/root/testdata/sf0.001", "documents").selectExpr("doc_id", "coalesce(length(text), 0) > 0 AS has_text").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in texts}
    mains = [r.doc_id for r in rows if r.main]
    assert len(mains) == len(set(mains)) and set(mains) <= {r.doc_id for r in texts if r.has_text}
    assert all(0 < r.share <= 1 and 0 <= r.confidence <= 1 for r in rows if r.lang is not None)
    found = {(r.doc_id, r.lang) for r in registry.queries()["p10_found"](spark, "/root/testdata/sf0.001").collect()}
    assert found <= {(r.doc_id, r.lang) for r in rows}
