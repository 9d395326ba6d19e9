import pytest
from hypothesis import given, settings, strategies as st

from leafmill.llm import sentences as S

#: A corpus to learn from: abbreviations before names, figures and lower case; sentences that start in many ways.
STARTS = ["The reactor ran", "We saw growth", "In most runs, cells fell", "A new strain grew", "No change was seen", "Because it rained, flow rose", "Results were clear", "By then, all had ended"]
ENDS = ["over time", "at once", "in the vessel", "during the week", "for hours", "after harvest"]


def corpus():
    import random

    r = random.Random(4)
    out = []
    for i in range(160):
        s = [f"{r.choice(STARTS)} {r.choice(ENDS)}{r.choice(['.', '.', '.', '!', '?'])}" for _ in range(6)]
        s.insert(2, f"As shown in Fig. {i % 9}, {r.choice(ENDS)} it went.")
        s.insert(4, f"Then Dr. {r.choice(['Thal', 'Quil', 'Bri', 'Zim', 'Osk'])}{r.choice(['ota', 'nik', 'sen', 'vard'])} said, e.g. here, it held.")
        out.append(" ".join(s))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return S.train(spark.createDataFrame([(t,) for t in corpus()] + [(None,), ("",)], "text STRING"))


def split(model, text):
    return [text[a:b] for a, b in model.spans(text)]


def test_abbreviations_figures_and_ends(model):
    assert split(model, "As shown in Fig. 3, it went. The reactor ran at once.") == ["As shown in Fig. 3, it went.", "The reactor ran at once."]
    assert split(model, "Then Dr. Thalnik said, e.g. here, it held. We saw growth of 3.5 over time.") == ["Then Dr. Thalnik said, e.g. here, it held.", "We saw growth of 3.5 over time."]
    assert split(model, "It fell! We saw growth? In most runs, cells fell for hours.") == ["It fell!", "We saw growth?", "In most runs, cells fell for hours."]


def test_headings_and_line_breaks(model):
    assert split(model, "2.1 Methods\n\nThe reactor ran\nfor hours. We saw growth\n \t\nand a rest") == ["2.1 Methods", "The reactor ran\nfor hours.", "We saw growth", "and a rest"]
    assert split(model, "One\r\n\r\nTwo\r\nthree") == ["One", "Two\r\nthree"]


def test_quotations(model):
    assert split(model, 'They asked "Is it stable?" and left at once. The reactor ran.') == ['They asked "Is it stable?" and left at once.', "The reactor ran."]
    assert split(model, "(It ran for hours.) We saw growth.") == ["(It ran for hours.)", "We saw growth."]


def test_scripts_without_spaces_or_periods(model):
    assert split(model, "浊度为3.31！为什么？如图1所示，它延缓了压降。") == ["浊度为3.31！", "为什么？", "如图1所示，它延缓了压降。"]
    assert split(model, "ถังลดความขุ่น สายพันธุ์เพิ่ม 46 เปอร์เซ็นต์ แผ่นกรอง") == ["ถังลดความขุ่น", "สายพันธุ์เพิ่ม 46 เปอร์เซ็นต์", "แผ่นกรอง"]
    assert split(model, "यह बदलता है। नया स्तंभ बढ़ता है।") == ["यह बदलता है।", "नया स्तंभ बढ़ता है।"]


@settings(max_examples=200, deadline=None)
@given(st.text("aB.!? \n\r\t \"')。ก1,é", max_size=60))
def test_every_character_is_in_one_sentence(model, text):
    spans = model.spans(text)
    inside = [i for a, b in spans for i in range(a, b)]
    assert len(inside) == len(set(inside)) and {i for i, c in enumerate(text) if not c.isspace()} <= set(inside)
    assert all(text[a:b] == text[a:b].strip() != "" for a, b in spans) and spans == sorted(spans)


def test_held_out_accuracy(model):
    import random

    r, right, total = random.Random(11), 0, 0
    for _ in range(60):
        parts = [f"{r.choice(STARTS)} near {r.choice(ENDS)}." for _ in range(4)] + [f"As shown in Fig. {r.randint(1, 9)}, it went.", f"Then Dr. {r.choice(['Fenota', 'Lodnik', 'Kelsen'])} said, e.g. now, it held."]
        r.shuffle(parts)
        got = split(model, " ".join(parts))
        right += len(set(got) & set(parts))
        total += len(parts)
    assert right / total > 0.95


def test_frame(spark, model):
    d = spark.createDataFrame([(1, "The reactor ran. We saw growth.", "x"), (2, None, "x"), (3, "", "x"), (4, " \n ", "x"), (5, "A " * 60_000, "x")], "doc_id BIGINT, text STRING, sent_start STRING")
    got = sorted(tuple(r) for r in S.sentences(d, model=model).collect())
    assert got[:2] == [(1, 0, 16), (1, 17, 31)] and got[2:] == [(5, 0, 119_999)]


def test_without_any_text(spark):
    assert S.sentences(spark.createDataFrame([(1, None)], "doc_id BIGINT, text STRING")).count() == 0


def test_words_that_no_worker_holds_come_by_a_join(spark, monkeypatch):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(corpus()[:60])] + [(90, None), (91, "")], "doc_id BIGINT, text STRING")
    whole = sorted(tuple(r) for r in S.sentences(d).collect())
    monkeypatch.setattr(S, "MODEL_ROWS", 3)
    small = S.train(d)
    assert small.rest is not None and len(small.steps) <= 3 and len(small.lefts) <= 3
    assert sorted(tuple(r) for r in S.sentences(d, model=small).collect()) == whole


def test_long_words_are_counted_whole():
    long = "deoxyribonucleotidyltransferases"
    c = S.Counts()
    c.add(f"It was seen in {long}a. The {long}b ran. {long}c ran. Then it fell.")
    got = {(w, r) for w, r, _, _ in c.rows()}
    assert (long + "a", "The") in got and ("\x02", long + "b") in got and ("ran", long + "c") in got


def test_rare_strays_among_many_places_change_nothing():
    import numpy as np

    start, inside = np.array([0.6, 0.3, 0.0999, 1e-4]), np.array([0.05, 0.15, 0.1, 0.7])
    for n in (50, 500, 50_000, 5_000_000):
        p, odds, _ = S.fit_events(np.array([[0.6, 0.29, 0.1, 0.01]]) * n, start, inside, np.array([0.5]))
        assert p[0] > 0.8 and odds[0, 0] > 0, n


def test_marks_that_need_no_space_may_stand_before_figures(model):
    assert [m for m, _, _ in S.all_places("它降低了浊度。2023年它上升了。浊度为３．５。")] == [7, 17]


def test_odds_of_spaces_are_learned(spark):
    text = "ถังลดความขุ่น สายพันธุ์เพิ่ม 46 เปอร์เซ็นต์ แผ่นกรอง"
    m = S.train(spark.createDataFrame([(text,)] * 40, "text STRING"))
    counts = {("\x00spaces", "oo"): 80, ("\x00spaces", "o#"): 40, ("\x00spaces", "#o"): 40, ("\x00start", "o"): 40, ("\x00end", "o"): 40}
    assert m.spaces == S.fit_spaces(counts) != S.fit_spaces({})
    w, r = S.all_places(text)[0][1:]
    assert m.odds(w, r) == m.spaces["oo"] > 0 > m.spaces["o#"]
    figures = {**counts, ("\x00start", "o"): 10, ("\x00start", "#"): 30}
    assert S.fit_spaces(figures)["o#"] > S.fit_spaces(counts)["o#"] and S.fit_spaces(figures)["oo"] < S.fit_spaces(counts)["oo"]
