"""Sentence boundaries across languages and scripts by a hidden-event language model.

A text is a sequence of words with hidden boundary events between them. Events are possible after end marks, in scripts
without them (Thai) at spaces, and certain at blank lines. For a possible place with the left word w and the right word r
the model compares

    P(event | w) P(r | sentence start)   with   P(no event | w) P(r | w, no event).

r is seen through its class (case, figure, uncased letter) and how much more often it starts sentences than it stands
inside them. Certain starts (after ! ? and their like) and insides are counted over the whole corpus first; then EM over
the counts of (w, r) finds for each w how often an event follows it and what follows it otherwise, shrunk towards what
follows all words without an event. Words that end sentences are followed as sentences start; abbreviations, initials and
ordinals of any language show themselves by a following of their own. A short sentence between two events makes both less
likely; forward-backward over the places of a paragraph gives each one's posterior.

Defined cases: null, empty and blank texts have no sentences; very long texts and words are handled whole; every character
that isn't white space is in exactly one sentence; offsets are code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from copy import copy
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from leafmill.session import cut

#: End marks, those of scripts that need no space after them, what closes or opens a quotation or bracket,
#: marks after which nothing begins.
MARKS = ".!?…؟۔।॥。！？｡．"
FULL = "।॥。！？｡．"
CLOSING = "\"'”’»)]}」』）】〉》＂"
SPACE = "\x03 "
STRONG, ABLE = "!?؟" + FULL, "UXo#"
OPENING = "\"'“„‘«‹([{¿¡「『（【〈《`"
GOES_ON = ",;:，、；：،؛)%/–—-"
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"

#: Log-ratio steps in which words are told apart, EM rounds over all words and for each word, pseudo-counts with which what
#: follows a word without, and with, an event is shrunk towards what does so for all words (sentences start differently
#: in different languages and fields, but less differently than abbreviations go on).
STEPS, ROUNDS, INNER, SHRINK, STARTS, MIXED = 5, 4, 20, 1.5, 5.0, 0.03
#: Places as which a left word's following counts at most, and the share of inside words that may stray among starts.
ENOUGH, STRAY = 200.0, 0.03
#: Rows of a word table that a worker keeps in memory, the most frequent; the others come to their places by a join.
MODEL_ROWS = 200_000
#: Places of each kind by which models are taught the rule of spaces.
SPACES = 20.0
#: Distinct keys a task keeps before it hands on its counts, or that a worker remembers.
FLUSH = 300_000
#: Upper bounds, in characters, of the classes of sentence lengths.
SHORT = (4, 10, 20, 40)

_BLANK = re.compile(r"(?>\r\n|\n|\r)[^\S\r\n]*(?>\r\n|\n|\r)\s*")
_PLACE = re.compile(rf"[{re.escape(MARKS)}]+(?:[{re.escape(MARKS + CLOSING)}]|[   ]»)*")
_RIGHT = re.compile(rf"\s*[{re.escape(OPENING)}]*\s?([{CJK}]|[^\s{CJK}]+)?")
_AFTER_CJK = re.compile(rf"[{CJK}]$|[^{CJK}]*$")
_SPACES, _FULL = re.compile("[\u00a0\u202f ]+"), frozenset(FULL)
_GLUED = re.compile(r"(?<=[^\W\d_A-Z]{2}|[\d)]{2})[.!?](?=[^\W\d_])")
_IDEOGRAPH = re.compile(f"[{CJK}]")
_TOKEN = re.compile(rf"[{CJK}]|[^\s{CJK}]+")
_FIGURE = re.compile(r"\d+(?:[.,]\d+)*")
_THAI, _LETTERS = re.compile(r"[ก-ฺเ-๎]+"), re.compile(r"[^\W\d_]+")
#: Blocks of scripts without case.
_CASELESS = re.compile(r"[\u0590-\u109f\u1100-\u139f\u1700-\u1cff\u3040-\u9fff\ua000-\ua63f\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]+")


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines, without white space at their ends."""
    out, at = [], 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        piece = text[at:end]
        if piece.strip():
            out.append((at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip())))
        at = m.end() if m else end
    return out


def _size(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def script(par: str) -> str:
    """"thai" or "caseless" if most letters of a paragraph are Thai (vowel signs count as letters here), or of scripts
    without case; else "cased". The last two have words and statistics of their own."""
    if par.isascii() or not _CASELESS.search(par):
        return "cased"
    letters = _size(_LETTERS, par)
    return "thai" if 2 * _size(_THAI, par) > letters else "caseless" if 2 * _size(_CASELESS, par) > letters else "cased"


@lru_cache(1 << 17)
def word(token: str) -> str:
    """The form in which a right word is counted."""
    return _FIGURE.sub("#", token.rstrip("".join((MARKS, CLOSING, ",;:，、；：،؛")))) or token[:1]


@lru_cache(1 << 16)
def kind(r: str) -> str:
    """The class of a right word: figure, upper, lower, mixed with figures, uncased letter, other."""
    if r[:1] == "\x03":
        return "\x03" + kind(r[1:])
    c = r[:1]
    if c in "#" or c.isdigit():
        return "#"
    if c.isupper():
        return "X" if "#" in r or len(r) > 1 and r.isupper() else "U"
    if c.islower():
        return "l"
    return "o" if c.isalpha() else "-"


def ends_surely(w: str) -> bool:
    """Whether a left word is an end mark other than the full stop, with nothing closed after it: where the right word
    isn't in lower case, such marks are the certain ends from which starts are learned."""
    return w.lstrip("\x03")[:1] in STRONG and not any(c in CLOSING for c in w)


def left_kind(w: str) -> str:
    """The class of a left word."""
    if w[:1] == "\x03":
        return "\x03" + left_kind(w[1:])
    if not w or w[0] in MARKS:
        return w or "-"
    spaced = "" if w[-1] != "\x01" else "\x01"
    w = w.rstrip("\x01")
    if w[1:2] == "|":
        return w[:2] + ("#" if "#" in w[2:] else "1" if w[2:3].isupper() else "a") + spaced
    if "#" in w:
        return "#" + spaced
    return ("." if "." in w else "U" if w[0].isupper() else "o") + str(min(len(w), 5)) + spaced


def _left_token(par: str, end: int) -> str:
    """The run of characters without white space, and from the last ideograph on, that ends at ``end``."""
    window = 64
    while True:
        piece = par[max(0, end - window) : end]
        if not piece or piece[-1].isspace():
            return ""
        left = piece.rsplit(None, 1)[-1]
        if len(left) < len(piece) or window >= end:
            break
        window *= 8
    return left if left.isascii() else _AFTER_CJK.search(left)[0]


@lru_cache(1 << 16)
def _left_form(token: str) -> str:
    """The form in which the word before a full stop is counted."""
    return _FIGURE.sub("#", _GLUED.split(token)[-1].lstrip(OPENING)) or "."


@lru_cache(1 << 10)
def _marks_form(marks: str) -> str:
    return "".join(dict.fromkeys(_SPACES.sub("", marks)))


def marks_of(par: str) -> Iterator[tuple[re.Match, str, str, bool]]:
    """(match, right token, right word, whether a word can end there) of each run of end marks but that at the end."""
    for m in _PLACE.finditer(par):
        end = m.end()
        if end >= len(par):
            break
        r = _RIGHT.match(par, end)[1] or ""
        yield m, r, word(r) if r else "", par[end].isspace()


def places(par: str, pre: str, marks: Iterable | None = None) -> list[tuple[int, str, str]]:
    """(end, w, r) of each place in a paragraph where a sentence could end before its last character.

    w is the word before a full stop (with a sign of what stands before it, if it is short), or the marks themselves where they say more than the word; a place without a space
    is a kind of its own (\x01); ``pre`` stands before words, \x03 in caseless paragraphs.
    """
    out = []
    for m, token, r, spaced in marks_of(par) if marks is None else marks:
        end, marks_, after = m.end(), m[0], par[m.end()]
        if not token or token[0] in GOES_ON and not (token[0] == "-" and token[1:2].isdigit()) or after in GOES_ON:
            continue
        full = not _FULL.isdisjoint(marks_)
        if not spaced:
            before = par[m.start() - 1 : m.start()]
            if after.isdigit() and (not full or "．" in marks_) or not full and not (after.isupper() or after in OPENING or kind(r) == "o") or not before or before.isspace():
                continue
        left = _left_token(par, m.start()) if marks_ == "." else ""
        if left:
            w = _left_form(left)
            if len(w) < 3:  # what a letter or figure means shows in what stands before it: "z. B.", "reactor B.", "5 h."
                c = par[: m.start() - len(left)][-64:].rstrip()[-1:] or par[: m.start() - len(left)].rstrip()[-1:] or "^"
                w = ("." if c == "." else "#" if c.isdigit() else "^" if c == "^" else "w") + "|" + w
        else:
            w = _marks_form(marks_) if marks_ != "..." else "..."
        out.append((end, pre + (w if spaced or full else w + "\x01"), pre + r))
    return out


def all_places(par: str) -> list[tuple[int, str, str]]:
    """``places``, or those of a paragraph whose script ends its sentences with spaces: there each space is one, its words
    the signs of whether figures stand beside it."""
    of = script(par)
    if of != "thai":
        return places(par, "\x03" if of == "caseless" else "")
    return [(m.start(), SPACE + _figured(par[m.start() - 1]), _figured(par[m.end() : m.end() + 1])) for m in re.finditer(r"[^\S\r\n]+", par)]


def _figured(c: str) -> str:
    """The class of a word beside a space that may end a sentence: figure or other."""
    return "#" if c.isdigit() else "o"


def length_class(n: int, w: str) -> int:
    """The class of a length before left word ``w``; caseless scripts say as much in a third of the characters."""
    n = 3 * n if w[0] == "\x03" else n
    return sum(n > s for s in SHORT)


_MARKS = frozenset(MARKS)


class Counts:
    """What a task counts of its texts: tokens, words after an end mark and words that certainly start sentences (the first,
    or after ! ? and their like where no lower case follows), pairs of left and right words, lengths between places."""

    def __init__(self) -> None:
        self.tokens, self.after, self.starts = ([Counter(), Counter()] for _ in range(3))
        self.pairs: Counter = Counter()

    def __len__(self) -> int:
        return len(self.pairs) + len(self.tokens[0]) + len(self.tokens[1])

    def add(self, text: str) -> None:
        for a, b in paragraphs(text):
            par = text[a:b]
            of = script(par)
            if of == "thai":
                spots = all_places(par)
                self.pairs.update(("\x00spaces", w[-1] + r) for _, w, r in spots)
                if spots:  # else it may be a heading
                    self.pairs.update((("\x00end", _figured(par[-1])), ("\x00start", _figured(par[0]))))
                continue
            group = of == "caseless"
            tokens = par.split() if par.isascii() or not _IDEOGRAPH.search(par) else _TOKEN.findall(par)
            after, starts = self.after[group], self.starts[group]
            self.tokens[group].update(tokens)
            first = word(tokens[0].lstrip(OPENING))
            after[first] += 1
            if not _MARKS.isdisjoint(par[-4:]):  # else it may be a heading
                starts[first] += 1
            marks, pre = list(marks_of(par)), "\x03" if group else ""
            for m, token, r, spaced in marks:
                if token and (spaced or m[0][-1] in FULL):
                    after[r] += 1
                    if m[0][-1] in STRONG and kind(r) in ABLE:
                        starts[r] += 1
            last, sure, pairs = 0, True, self.pairs
            for end, w, r in places(par, pre, marks):
                g = str(length_class(end - last, w))
                now = ends_surely(w) and kind(r)[-1] != "l"
                pairs["\x00all", g] += 1
                if sure and now:
                    pairs["\x00both", g] += 1
                pairs[w, r] += 1
                last, sure = end, now

    def rows(self) -> Iterator[tuple[str, str, int, int]]:
        """(w, r, a, b): with \x02 as w, how often r certainly starts sentences and stands inside; else how often r follows
        w; under \x00, the lengths between places."""
        words: dict[str, list[int]] = {}
        for group, pre in enumerate(("", "\x03")):
            inside: Counter = Counter()
            for token, n in self.tokens[group].items():
                inside[word(token.lstrip(OPENING))] += n
            inside.subtract(self.after[group])
            for r, n in inside.items():
                words[pre + r] = [self.starts[group][r], max(n, 0)]
        yield from (("\x02", r, s, m) for r, (s, m) in words.items())
        yield from ((w, r, n, 0) for (w, r), n in self.pairs.items())


def counted(texts: DataFrame) -> DataFrame:
    """``Counts`` of all texts, made inside each task, so that only distinct keys leave it."""
    names = ["w", "r", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*counts.rows())) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.add(text)
                if len(counts) > FLUSH:
                    yield flush()
                    counts = Counts()
        yield flush()

    each = texts.mapInArrow(run, "w string, r string, a bigint, b bigint")
    return each.groupBy("w", "r").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a > 0 OR b > 0")


class Model:
    """Parameters that travel to the workers: steps of right words, log-odds of an event after a left word by the bucket
    of the right one, the same for the classes of left words, and weights of sentence lengths."""

    def __init__(self, steps: dict[str, int], by_kind: dict[str, int], index: dict[str, int], lefts: dict[str, int], odds: np.ndarray, by_left: dict[str, np.ndarray], length: list[float]):
        self.steps, self.by_kind, self.index, self.lefts, self.table, self.by_left, self.length = steps, by_kind, index, lefts, odds, by_left, length
        self.spaces = fit_spaces({})
        self.rest: tuple[DataFrame, DataFrame] | bool | None = None
        self.memo: dict[tuple[str, str], float] = {}

    def odds(self, w: str, r: str, step: int | None = None, own: np.ndarray | None = None) -> float:
        """Log-odds of an event between w and r; ``step`` and ``own`` are theirs if they aren't in this worker's tables."""
        if w[:-1] == SPACE:
            return self.spaces[w[-1] + r]
        k = kind(r)
        usual = self.by_kind.get(k, 0)
        at = self.index.get(f"{k}{self.steps.get(r, usual) if step is None else step}")
        if at is None:
            at = self.index.get(f"{k}{usual}")
        row = self.lefts.get(w)
        own = self.table[row] if row is not None else own if own is not None else self.by_left.get(left_kind(w))
        if at is None or own is None:
            # Nothing like it was in the corpus: the marks and the case decide.
            m = w.lstrip("\x03")[:1]
            return -3.0 if k[-1] == "l" else 3.0 if m in STRONG else float(self.by_left[""][at]) if at is not None else 0.5
        return float(own[at])

    def known(self, w: str, r: str) -> float:
        """``odds`` by this worker's tables alone, remembered."""
        old = self.memo.get((w, r))
        if old is None:
            if len(self.memo) >= FLUSH:
                self.memo.clear()
            old = self.memo[w, r] = self.odds(w, r)
        return old

    def unknown(self, w: str, r: str) -> bool:
        """Whether a table outside this worker may know more of a place."""
        return self.rest is not None and w[:-1] != SPACE and (w not in self.lefts or r not in self.steps)

    def boundaries(self, par: str, spots: list[tuple[int, str, str]] | None = None, odds: list[float] | None = None) -> list[int]:
        """Ends of the sentences of a paragraph, by forward-backward over its places and their log-odds."""
        spots = spots or all_places(par)
        if not spots:
            return []
        n = len(spots)
        odds = [exp(min(max(x, -30), 30)) for x in (odds or [self.odds(w, r) for _, w, r in spots])]
        # pair[i]: weight of an event at i if there was one at i - 1 (or the paragraph began there).
        ends = [0, *[e for e, _, _ in spots]]
        pair = [1.0 if w[:-1] == SPACE else self.length[length_class(b - a, w)] for a, b, (_, w, _) in zip(ends, ends[1:], spots)]
        forward = []
        no, yes = 0.0, 1.0
        for i in range(n):
            no, yes = no + yes, (no + yes * pair[i]) * odds[i]
            z = no + yes
            no, yes = no / z, yes / z
            forward.append((no, yes))
        out, bn, by = [], 1.0, 1.0
        for i in range(n - 1, -1, -1):
            fn, fy = forward[i]
            if fy * by > fn * bn:
                out.append(spots[i][0])
            if i:
                bn, by = bn + odds[i] * by, bn + pair[i] * odds[i] * by
                z = bn + by
                bn, by = bn / z, by / z
        return out[::-1]

    def asks(self, text: str | None) -> list[tuple[int, str, str]]:
        """(number, w, r) of the places, numbered through the text, of which tables outside this worker may know more."""
        spots = [s for a, b in paragraphs(text or "") for s in all_places(text[a:b])]
        return [(n, w, r) for n, (_, w, r) in enumerate(spots) if self.unknown(w, r)]

    def spans(self, text: str | None, told: dict[int, tuple[int | None, np.ndarray | None]] | None = None) -> list[tuple[int, int]]:
        """(start, end) of every sentence; ``told`` has the step and odds of places that this worker's tables lack."""
        out, seen = [], 0
        for a, b in paragraphs(text or ""):
            par, at = text[a:b], 0
            spots = all_places(par)
            odds = [self.odds(w, r, *told[seen + n]) if told and seen + n in told else self.known(w, r) for n, (_, w, r) in enumerate(spots)]
            seen += len(spots)
            for end in [*(self.boundaries(par, spots, odds) if spots else []), len(par)]:
                piece = par[at:end]
                if piece.strip():
                    out.append((a + at + len(piece) - len(piece.lstrip()), a + at + len(piece.rstrip())))
                at = end
        return out


def _step(s: float, m: float, total_s: float, total_m: float) -> int:
    ratio = log((s + 0.1) / (total_s + 1) / ((m + 0.1) / (total_m + 1)))
    return int(round(min(max(ratio / 1.5, -STEPS), STEPS)))


def fit_events(c: np.ndarray, start: np.ndarray, inside: np.ndarray, prior: np.ndarray, sure: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of events, log-odds of an event by bucket, expected counts without event) of left words with counts ``c``.
    ``sure`` says of which words and buckets events are certain.

    A word is followed by sentence starts, nearly as they are, or by a following of its own, or it mixes both (EM from the
    shared tables with and without the word's class). The marginal likelihoods, the word's own followings integrated
    out, decide; a mixture must be better by MIXED for each place, as most words do one or the other.
    """
    gamma = np.vectorize(lgamma, otypes=[float])
    sure = np.zeros(c.shape, bool) if sure is None else sure
    # All places count, but together as no more than ENOUGH: what is rare among very many doesn't outweigh the rest.
    c = c / np.maximum(c.sum(1, keepdims=True) / ENOUGH, 1)
    start = (1 - STRAY) * start + STRAY * inside
    base, top = SHRINK * inside, STARTS * start
    best = None
    for begin in (1e-3, 1 - 1e-3, None, np.where(start > inside, 0.98, 0.02)):
        if begin is None:
            e = prior[:, None] * start
            resp = e / (e + (1 - prior)[:, None] * inside)
        else:
            resp = np.broadcast_to(begin, c.shape)
        resp = np.where(sure, 1.0, resp)
        pure = isinstance(begin, float)
        for _ in range(1 if pure else INNER):
            e, o = c * resp, c * (1 - resp)
            p = np.clip((e.sum(1) + prior) / (c.sum(1) + 1), 1e-4, 1 - 1e-4)
            q = (o + base) / (o.sum(1) + SHRINK)[:, None]
            a = p[:, None] * (e + top) / (e.sum(1) + STARTS)[:, None]
            resp = resp if pure else np.where(sure, 1.0, a / (a + (1 - p)[:, None] * q))
        e, o = c * resp, c * (1 - resp)
        own = gamma(o + base).sum(1) - gamma(base).sum() + lgamma(SHRINK) - gamma(o.sum(1) + SHRINK)
        own += gamma(e + top).sum(1) - gamma(top).sum() + lgamma(STARTS) - gamma(e.sum(1) + STARTS)
        r = np.clip(resp, 1e-12, 1 - 1e-12)
        score = own + gamma(e.sum(1) + prior) + gamma(o.sum(1) + 1 - prior) - gamma(prior) - gamma(1 - prior) - (c * (r * np.log(r) + (1 - r) * np.log(1 - r))).sum(1)
        odds = np.log(a / ((1 - p)[:, None] * q))
        score -= 0.0 if pure else 3 + MIXED * c.sum(1)
        if best is None:
            best = score, p, odds, o
        else:
            better = score > best[0]
            best = tuple(np.where(better if x.ndim == 1 else better[:, None], x, y) for x, y in zip((score, p, odds, o), best))
    return best[1:]


def fit_spaces(counts: dict[tuple[str, str], int]) -> dict[str, float]:
    """Log-odds of an event at a space, in scripts that end sentences with spaces, by the classes of its two words.

    Sentences end and start as paragraphs do, which is counted; what stands around other spaces, and the share of events,
    come by EM. Every model is also taught SPACES places of each kind as the stated rule has them: a space ends a
    sentence unless it stands next to a figure. They decide where the corpus says little.
    """
    kinds = [a + b for a in "o#" for b in "o#"]
    n = np.array([counts.get(("\x00spaces", k), 0) for k in kinds], float)
    event = np.array([float(k == "oo") for k in kinds])
    share = lambda of: (lambda o, f: {"o": (o + SPACES) / (o + f + SPACES + 0.5), "#": (f + 0.5) / (o + f + SPACES + 0.5)})(*(counts.get((of, c), 0) for c in "o#"))
    end, start = share("\x00end"), share("\x00start")
    shown = np.array([end[a] * start[b] for a, b in kinds])
    resp = event
    for _ in range(INNER):
        p = (n @ resp + SPACES * event.sum() + 0.5) / (n.sum() + SPACES * len(kinds) + 1)
        q = n * (1 - resp) + SPACES * (1 - event) + 0.5
        odds = np.log(p * shown / ((1 - p) * q / q.sum()))
        resp = 1 / (1 + np.exp(-odds))
    return dict(zip(kinds, odds.tolist()))


def train(texts: DataFrame, column: str = "text") -> Model:
    """The model of all texts: one counting pass, then EM on the counts."""
    texts = texts.filter(F.col(column).isNotNull()).select(column)
    counts = cut(counted(texts))
    words = counts.filter(F.col("w") == "\x02").select("r", F.col("a").alias("s"), F.col("b").alias("m"))
    pairs = counts.filter(F.col("w") != "\x02").select("w", "r", F.col("a").alias("n"))

    @F.arrow_udf(T.StringType())
    def word_kind(r: pa.Array) -> pa.Array:
        return pa.array(list(map(kind, r.to_pylist())), pa.string())

    total = words.groupBy(word_kind("r").alias("k")).agg(F.sum("s").alias("s"), F.sum("m").alias("m")).toPandas()
    s_all, m_all = float(total["s"].sum()), float(total["m"].sum())
    by_kind = {k: _step(s, m, s_all, m_all) for k, s, m in zip(total["k"], total["s"], total["m"])}

    # A word's step is its own once it was seen often enough to differ from its class.
    @F.arrow_udf(T.StringType())
    def bucket(r: pa.Array, s: pa.Array, m: pa.Array) -> pa.Array:
        out = []
        for a, b, c in zip(r.to_pylist(), s.to_pylist(), m.to_pylist()):
            k = kind(a)
            own = b is not None and b + c >= 5
            out.append(f"{k}{_step(b, c, s_all, m_all) if own else by_kind.get(k, 0)}")
        return pa.array(out, pa.string())

    labelled = words.select("r", "s", "m", bucket("r", "s", "m").alias("bucket"))
    shared = labelled.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("m").alias("m")).toPandas()
    seen = pairs.filter(~F.col("w").startswith("\x00")).join(words, "r", "left").select("w", "n", bucket("r", "s", "m").alias("bucket"))
    names = sorted({*shared["bucket"], *(r[0] for r in seen.select("bucket").distinct().collect())})  # at most classes x steps
    index = {b: i for i, b in enumerate(names)}
    start, inside = np.full(len(names), 0.5), np.full(len(names), 0.5)
    for b, s, m in zip(shared["bucket"], shared["s"], shared["m"]):
        start[index[b]] += s
        inside[index[b]] += m
    groups = np.array([b[0] == "\x03" for b in names], bool)
    able = np.array([b.lstrip("\x03")[0] in ABLE for b in names], bool)

    def shared_out(v: np.ndarray) -> np.ndarray:
        """Caseless paragraphs and others have distributions of their own."""
        return v / np.where(groups, max(v[groups].sum(), 1e-9), max(v[~groups].sum(), 1e-9))

    start, inside = shared_out(start), shared_out(inside)
    by_bucket = F.array(*[F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)) for b in names])
    lefts = cut(seen.groupBy("w").agg(by_bucket.alias("c")))
    by_left: dict[str, float] = {"": 0.5}

    def expected(inside: np.ndarray, by_left: dict[str, float]) -> DataFrame:
        """Of each left word: its class, share of events, count, log-odds by bucket and expected counts without event."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = batch.column(0).to_pylist()
                if not w:
                    continue
                c = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(w), -1)
                kinds = [left_kind(x) for x in w]
                sure = np.array([ends_surely(x) for x in w])[:, None] & able
                p, odds, other = fit_events(c, start, inside, np.array([by_left.get(k, by_left[""]) for k in kinds]), sure)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(kinds), pa.array(p), pa.array(np.minimum(c.sum(1), ENOUGH)), pa.array(list(odds)), pa.array(list(other))], ["w", "k", "p", "n", "odds", "o"])

        return lefts.mapInArrow(run, "w string, k string, p double, n double, odds array<double>, o array<double>")

    rows = []
    for _ in range(ROUNDS):
        # A frequent word counts for its class as no more than 20 places, so that no single one speaks for it.
        each = expected(inside, by_left).withColumn("weight", F.expr("least(n, 20) / n"))
        sums = [F.sum(F.get("o", F.lit(i)) * F.col("weight")) for i in range(len(names))]
        rows = each.groupBy("k").agg(F.sum(F.expr("p * n * weight")).alias("p"), F.sum(F.expr("n * weight")).alias("n"), F.array(*sums).alias("o")).collect()  # one row for each class of left words
        inside = np.sum([r["o"] for r in rows], 0) + 0.05 if rows else inside
        inside = shared_out(inside)
        by_left = {r["k"]: (r["p"] + 0.5) / (r["n"] + 1) for r in rows}
        by_left[""] = (sum(r["p"] for r in rows) + 0.5) / (sum(r["n"] for r in rows) + 1)

    odds = F.transform("odds", lambda x: x.cast("float"))
    final = cut(expected(inside, by_left).select("w", "n", odds.alias("odds")))
    step = F.regexp_extract("bucket", r"-?\d+$", 0).cast("int")
    own = cut(labelled.filter("s + m >= 5").select("r", step.alias("step"), (F.col("s") + F.col("m")).alias("n")))

    def fitting(df: DataFrame) -> tuple[pa.Table, DataFrame]:
        """The most frequent rows, and the others."""
        least = 1
        while df.filter(F.col("n") >= least).count() > MODEL_ROWS:
            least *= 2
        return df.filter(F.col("n") >= least).toArrow(), df.filter(F.col("n") < least)

    ratio = np.log(start / inside)
    class_odds = {k: np.log(p / (1 - p)) + ratio for k, p in by_left.items()}
    known, more_steps = fitting(own)
    events, more_lefts = fitting(final)
    steps = dict(zip(known["r"].to_pylist(), known["step"].to_pylist()))
    table = np.array(events["odds"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(events), len(names))
    lengths = {(r["w"], r["r"]): r["n"] for r in pairs.filter(F.col("w").startswith("\x00")).collect()}
    n_all, n_both = (sum(n for (w, _), n in lengths.items() if w == x) for x in ("\x00all", "\x00both"))
    length = []
    for g in range(len(SHORT) + 1):
        both, every = lengths.get(("\x00both", str(g)), 0), lengths.get(("\x00all", str(g)), 0)
        length.append(min(1.0, (both + 0.5) / (n_both + 1) / ((every + 0.5) / (n_all + 1))))
    model = Model(steps, by_kind, index, {w: i for i, w in enumerate(events["w"].to_pylist())}, table, class_odds, length)
    model.spaces = fit_spaces(lengths)
    if more_steps.head(1) or more_lefts.head(1):
        model.rest = more_steps, more_lefts
    return model


_SPAN = T.StructType([T.StructField("sent_start", T.IntegerType()), T.StructField("sent_end", T.IntegerType())])
_ASK = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("w", T.StringType()), T.StructField("r", T.StringType())])


def sentences(documents: DataFrame, key: str = "doc_id", column: str = "text", model: Model | None = None) -> DataFrame:
    """(key, sent_start, sent_end): the sentences of every text with their places.

    Workers hold the most frequent words' parameters. If there are others, the places with words that a worker lacks are
    joined with the rest of the tables first (only rare words, so no key is hot) and come back to their texts.
    """
    model = model or train(documents, column)
    rest, small = model.rest, copy(model)
    small.rest, small.memo = True if rest else None, {}  # frames stay on the driver
    sent = documents.sparkSession.sparkContext.broadcast(small)
    texts = documents.select(key, column)

    @F.arrow_udf(T.ArrayType(_ASK))
    def asks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [[{"n": n, "w": w, "r": r} for n, w, r in sent.value.asks(t)] for t in batch.to_pylist()]
            yield pa.array(rows, pa.list_(pa.struct([("n", pa.int32()), ("w", pa.string()), ("r", pa.string())])))

    @F.arrow_udf(T.ArrayType(_SPAN))
    def split(text: pa.Array, told: pa.Array) -> pa.Array:
        starts, ends, offsets = [], [], [0]
        for t, more in zip(text.to_pylist(), told.to_pylist()):
            for a, b in sent.value.spans(t, {x["n"]: (x["step"], x["odds"]) for x in more or []}):
                starts.append(a)
                ends.append(b)
            offsets.append(len(starts))
        rows = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["sent_start", "sent_end"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    told = F.lit(None).cast("array<struct<n:int,step:int,odds:array<float>>>")
    if rest is not None:
        texts = cut(texts.withColumn("_row", F.monotonically_increasing_id()))
        asked = cut(texts.select("_row", F.inline(asks(column))))
        steps, lefts = rest
        asked = asked.join(steps.select("r", "step"), "r", "left").join(lefts.select("w", "odds"), "w", "left").filter("step IS NOT NULL OR odds IS NOT NULL")
        texts = texts.join(asked.groupBy("_row").agg(F.collect_list(F.struct("n", "step", "odds")).alias("_told")), "_row", "left")
        told = F.col("_told")
    return texts.select(key, F.inline(split(column, told)))
