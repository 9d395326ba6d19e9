import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leafmill.llm import lookalikes as L
from tests.conftest import block

SAME = [
    ("Total", "Τοtal"), ("café", "café"), ("filter", "ﬁlter"), ("but 10", "ｂｕｔ １０"), ("on it", "о​n it"), ("Биомасса", "Биoмaccа"), ("pH", "рН"),
    ("5 µm", "5 μm"), ("-2.45", "‐2.45"), ("A B", "A B"), ("Å", "Å"), ("", "​"), ("co­op", "coop"), ("мёд", "мёд"), ("，", ","),
]
DIFFERENT = [("m²", "m2"), ("CO₂", "CO2"), ("Abc", "abc"), ("a\nb", "a b"), ("b0x", "box"), ("1", "l"), ("19–20", "19-20")]


def test_looks():
    assert all(L.canonical(a) == L.canonical(b) for a, b in SAME)
    assert all(L.canonical(a) != L.canonical(b) for a, b in DIFFERENT)
    assert L.canonical("Τοtal") == "Total" and L.canonical("Биoмaccа") == "Биомасса"


def test_whole_script_tokens_follow_the_text():
    assert L.canonical("это сop и cop") == L.canonical("это сор и сор") == "это сор и сор"
    assert L.canonical("the сор said") == "the cop said"


alphabet = st.sampled_from("abeocpxhTKMдижлш 0é²\n" + "аеосрхһТКМ" + "οΤν" + "​ ́ﬁｅ，µΩ‐­")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet, max_size=30))
def test_one_form_is_a_fixed_point_and_the_shortcut_changes_nothing(t):
    c = L.canonical(t)
    assert L.canonical(c) == c == L.resolve(t) and unicodedata.normalize("NFC", c) == c


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet, max_size=20), st.data())
def test_swapping_lookalikes_changes_nothing(t, data):
    swapped = "".join(data.draw(st.sampled_from(sorted(L.SPELLINGS[c].values()))) if c in L.SPELLINGS else c for c in t)
    assert L.canonical(swapped) == L.canonical(t)


def rows():
    return [
        {"record_id": 1, "paper_id": "p", "blocks": [block("Total heat", order=0), block("same", order=1), block("x", "table", 1, 2), block(None, order=3), block("", order=4)], "tables": [(1, 1, 2, [["Sum", None], None], None)]},
        {"record_id": 1, "paper_id": "p", "blocks": [block("Total heat", order=0), block("same", order=1), block("x", "table", 1, 2), block(None, order=3), block("", order=4)], "tables": [(1, 1, 2, [["Sum", None], None], None)]},
        {"record_id": 2, "paper_id": "p", "blocks": [block("Τοtal heat", order=0), block("same", order=1), block("х", "table", 1, 2), block("Total heat", page=2, order=3), block("​", order=4)], "tables": [(1, 1, 2, [["Ѕum", ""]], None)]},
        {"record_id": 3, "paper_id": "q", "blocks": [block("Τotal heat", order=0)]},
        {"record_id": 4, "paper_id": None, "blocks": [block("Τotal heat", order=0)]},
        {"record_id": 5, "paper_id": "p"},
    ]


def test_pairs(records):
    got = sorted(tuple(r) for r in L.identical_pairs(records(*rows())).collect())
    assert got == [("1/b/0", "2/b/0"), ("1/b/4", "2/b/4"), ("1/t/0/0/0", "2/t/0/0/0")]
    assert L.identical_pairs(records(*rows()).limit(0)).count() == 0


def test_column_keeps_null_and_long_texts(spark):
    d = spark.createDataFrame([(None,), ("",), ("plain",), ("о" * 100_000 + "z",)], "t STRING")
    assert [r[0] for r in d.select(L.one_form(F.col("t"))).collect()] == [None, "", "plain", "o" * 100_000 + "z"]


def test_scripts_beside_the_planted_ones():
    from leafmill.llm.lookalikes import canonical

    assert canonical("The ᏢᎪᎡᎢ of the rеасtօr") == "The PART of the reactor"
    assert canonical("LS մեկ երկու") == canonical("ԼՏ մեկ երկու") == "ԼՏ մեկ երկու"
    assert canonical("մի հոսք") == "մի հոսք"
