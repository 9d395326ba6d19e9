import random

import numpy as np

from leafmill.llm.truncation import censoring, cut_blocks, shares
from tests.conftest import block


def test_posterior_of_a_pile():
    rng = np.random.default_rng(0)
    true = np.round(np.exp(rng.normal(5.3, 0.5, 20_000))).astype(int)
    seen = np.where((true > 255) & (rng.random(len(true)) < 0.6), 255, true)
    cut, open_ = seen == 255, (seen == 255) & (true > 255)
    length, ended, n = [], [], []
    for v in np.unique(seen):
        for e, mask in ((True, (seen == v) & ~open_), (False, (seen == v) & open_)):
            if mask.sum():
                length.append(v), ended.append(e), n.append(mask.sum())
    p, limits = censoring(np.array(length), np.array(ended), np.array(n, float))
    assert limits == [255] and cut.sum() > 100
    by = {(v, e): x for v, e, x in zip(length, ended, p)}
    assert by[255, False] > 0.95 and by.get((255, True), 0) < 0.5 and all(x == 0 for (v, _), x in by.items() if v != 255)


def test_no_pile_no_limit():
    length = np.arange(50, 200)
    p, limits = censoring(length, np.zeros(150, bool), np.full(150, 3.0))
    assert limits == [] and not p.any()


def rows():
    r, out = random.Random(2), []
    for i in range(60):
        words = " ".join(r.choice(["flow", "cells", "growth", "reactor", "vessel", "slowly", "heat"]) for _ in range(30))
        whole = f"Paper {i} has its own beginning {words} to the very end of it."
        for k in range(2):
            text = whole[:120] if k == 0 and i % 3 == 0 else whole
            bs = [block(text, order=0), block("Figure 1. Heat over time", "caption", 1, 1), block(f"Runs on to the next {words}", page=1, order=2), block("page where it goes on.", page=2, order=3), block(None, order=4), block("", order=5)]
            out.append({"record_id": 2 * i + k, "paper_id": f"p{i}", "source": "limited" if i % 2 else None, "blocks": bs})
    return [*out, dict(out[0])]


def test_cut_blocks(records):
    got = {(r.record_id, r.block_order) for r in cut_blocks(records(*rows())).collect()}
    assert {(2 * i, 0) for i in range(0, 60, 3)} <= got
    assert not {g for g in got if g[1] in (2, 3, 4, 5)} and not {(2 * i + 1, 0) for i in range(60)} & got


def test_shares_and_empty(records):
    s = {r.source: r for r in shares(records(*rows())).collect()}
    assert set(s) == {None, "limited"} and 0 < s["limited"].cut_share < 0.5 and s[None].blocks == 240
    assert cut_blocks(records(*rows()[:1]).limit(0)).count() == 0


def test_proper_ends_are_compared_too(records):
    whole = "The stirred vessel was warmed slowly and its growth was measured after the change (Eqs. 1.1 and 6.2), so that it held."
    first, rest = "The second vessel was left without any stirring for the whole of the night.", " Then its growth was measured again with the same device."
    record = lambda i, *texts: {"record_id": i, "paper_id": "p", "source": "s", "blocks": [block(x, order=n) for n, x in enumerate(texts)]}
    got = cut_blocks(records(record(1, whole[: whole.index(" 1.1")], first, rest), record(2, whole, first + rest))).collect()
    assert {(r.record_id, r.block_order) for r in got} == {(1, 0)}


def test_every_version_and_short_beginnings_are_asked(records):
    whole = "The stirred vessel was warmed slowly in the light and its growth was measured after the change of the water."
    misread = whole.replace("growth", "qrowth") + " Then it was left alone."
    short = "Another aerosol was run with these gradients for two weeks in the dark vessel."
    record = lambda i, *texts: {"record_id": i, "paper_id": "p", "source": "s", "blocks": [block(x, order=n) for n, x in enumerate(texts)]}
    alike = whole[:90].replace("e", "е")
    first, rest = "Зернистый реактор снизил объём пены по всей высоте колонны.", " После каждого сбора он ограничил рост клеток."
    got = cut_blocks(records(record(1, alike, short[:30], first, rest), record(2, whole, short, first + rest), record(3, misread, short))).collect()
    assert {(r.record_id, r.block_order) for r in got if r.score > 0.99} >= {(1, 0), (1, 1)}
    assert not {(2, 1), (3, 1), (1, 2)} & {(r.record_id, r.block_order) for r in got}


def test_long_lines_of_the_site_end_no_block(records):
    site = "This article is distributed under an open licence which permits any use in any medium as long as the source is named and every change is shown to the reader"
    text = lambda i: f"Paper {i} was read with great care and nothing else was found in it.\n{site}"
    rows = [{"record_id": i, "paper_id": f"p{i}", "source": "s", "blocks": [block(text(i), order=0), block(site, order=1), block(f"The {chr(97 + i) * 5} sample was cut in the mid", order=2)]} for i in range(12)]
    assert {r.block_order for r in cut_blocks(records(*rows)).collect()} == {2}


def test_a_text_that_runs_on_at_a_limit_is_whole(records):
    r, rows = random.Random(3), []
    words = ["flow", "cells", "growth", "reactor", "vessel", "slowly", "heat"]
    for i in range(80):
        long = f"Paper {i} " + " ".join(r.choice(words) for _ in range(60))
        on = long[:99].rstrip() + "s" * (100 - len(long[:99].rstrip())) if i % 40 == 0 else f"Paper {i} runs on " + " ".join(r.choice(words) for _ in range(r.randrange(6, 20)))
        rows.append({"record_id": i, "paper_id": f"p{i}", "source": "s", "blocks": [block(long[:100], order=0), block("A whole one stands here.", order=1), block(on, order=2), block("where it goes on at once.", page=2, order=3)]})
    got = {(x.record_id, x.block_order) for x in cut_blocks(records(*rows)).collect()}
    assert len({g for g in got if g[1] == 0}) > 75 and not {g for g in got if g[1] != 0}
