import collections
import re

from hypothesis import given, settings, strategies as st

from leafmill.llm.repeats import chunk_lines, repeated_places, without_repeated_lines
from tests.conftest import block

SITE = "Downloaded from the site on day {}"


def brute(rows):
    norm = lambda s: " ".join(re.sub(r"\d", "", s).lower().split())
    where, papers = collections.defaultdict(set), collections.defaultdict(set)
    lines = []
    for r in rows:
        if r.get("source") is None:
            continue
        papers[r["source"]].add(r["paper_id"])
        for p, kind, t, _, o in r.get("blocks") or []:
            if t is None or kind in ("section_header", "table"):
                continue
            for n, line in enumerate(t.split("\n")):
                if len(re.findall(r"[^\W\d_]+", norm(line))) >= 3:
                    where[r["source"], norm(line)].add(r["paper_id"])
                    lines.append((r["record_id"], o, n, r["source"], norm(line)))
    hit = {k for k, p in where.items() if len(p) >= 3 and 5 * len(p) >= len(papers[k[0]])}
    return sorted({x[:3] for x in lines if x[3:] in hit})


def rows(n=12):
    out = []
    for i in range(n):
        name = "abcdefghijklmnop"[i] * 4
        text = f"Only paper {name} says what is said in this long paragraph of {name}, word for word.\n" + SITE.format(i)
        bs = [block(text if i % 2 else text.upper(), order=0), block("Share this story with friends" if i < 3 else "x", "other", 1, 1), block(SITE.format(i), "section_header", 1, 2), block(None, order=3), block("", order=4)]
        out.append({"record_id": i, "paper_id": f"p{i}", "source": "s" if i < n - 1 else None, "blocks": bs})
    out += [dict(out[0]), {"record_id": 99, "paper_id": None, "source": "s", "blocks": [block(SITE.format(1), order=0)]}, {"record_id": 98, "paper_id": "z", "source": "t"}]
    return out


def test_found_matches_a_loop(records):
    r = rows()
    want = [x for x in brute([x for x in r if x["paper_id"] is not None])]
    got = sorted(tuple(x) for x in repeated_places(records(*r)).collect())
    assert [g for g in got if g[0] != 99] == want and (99, 0, 0) in got and (0, 1, 0) in got


def test_blocks_come_out_without_their_lines(records):
    got = {(r.record_id, r.block_order): r.text for r in without_repeated_lines(records(*rows()[:11])).collect()}
    assert got[1, 0].startswith("Only paper bbbb") and "Downloaded" not in got[1, 0]
    assert got[0, 1] == "" and got[5, 1] == "x" and got[0, 2] == SITE.format(0) and got[0, 3] is None and got[0, 4] == ""


def test_nothing_repeats_in_an_empty_table(records):
    assert repeated_places(records(*rows()[:1]).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=200), max_size=6), st.text(min_size=1, max_size=300))
def test_equal_lines_have_equal_chunks(others, line):
    h, o = chunk_lines([*others, line])
    h2, o2 = chunk_lines([line, *others])
    assert list(h[o[-2] : o[-1]]) == list(h2[o2[0] : o2[1]]) and o[-1] > o[-2]
    assert len(o) == len(others) + 2


def test_long_lines_are_cut_by_content():
    import random

    rnd = random.Random(1)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    h, _ = chunk_lines([a])
    g, _ = chunk_lines(["changed" + a[5000:]])
    assert len(h) > 100 and len(set(h) & set(g)) > 0.9 * len(g)
