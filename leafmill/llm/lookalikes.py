"""One form for texts that look the same.

``one_form`` gives each text the form in which visually identical texts are equal. Letters that several scripts share in
look are resolved for each token: every letter has the set of scripts it can be spelled in, the sets are intersected over
the token, and the token takes the script that remains. A token whose letters could all stand in several scripts (a
whole-script confusable) takes the item's main script; a truly mixed one that of most of its letters. Only letters with
one script vote, and look-alike substitutions never touch those, so all variants of a text resolve alike. Then invisible
characters go, spaces become one kind, wide, narrow and compatibility forms become plain ones, and accents compose.

Raised and lowered digits, letter case and line breaks are visible and stay. Defined cases: null stays null, the empty
text stays empty, a text of invisible characters becomes empty; very long texts are handled whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from leafmill.session import cut

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")
#: Letters of other scripts that look like the Latin letter under them.
CYRILLIC = "аеорсухіјѕһԁԛԝӏАВЕЅІЈКМНОРСТУХԚԜ"
CYRILLIC_AS = "aeopcyxijshdqwlABESIJKMHOPCTYXQW"
GREEK = "ονρϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "ovpjABEZHIKMNOPTYX"
ARMENIAN = "օսհոցզյՕՍԼՏ"
ARMENIAN_AS = "ouhngqjOULS"
CHEROKEE = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DRTiAJEWMHGZSVLCPKB"
#: Compatibility forms that differ from their plain form only in encoding, not in look.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
HYPHENS = "‐‑"
#: Scripts in which joiners change the shape of letters.
JOINING = r"[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}]"

SPELLINGS: dict[str, dict[str, str]] = {}
for _script, _letters, _as in (("Cyrillic", CYRILLIC, CYRILLIC_AS), ("Greek", GREEK, GREEK_AS), ("Armenian", ARMENIAN, ARMENIAN_AS), ("Cherokee", CHEROKEE, CHEROKEE_AS)):
    for _a, _b in zip(_letters, _as):
        SPELLINGS.setdefault(_b, {"Latin": _b})[_script] = _a
for _spelled in list(SPELLINGS.values()):
    for _letter in _spelled.values():
        SPELLINGS[_letter] = _spelled


@lru_cache(1)
def _patterns():
    import regex

    hidden = regex.compile(rf"(?<!{JOINING})[‌‍]|­(?!\n)|[\p{{Default_Ignorable_Code_Point}}--[­‌‍]]", regex.V1)
    scripts = [(s, regex.compile(rf"\p{{{s}}}")) for s in SCRIPTS]
    return scripts, hidden, regex.compile(r"\p{Default_Ignorable_Code_Point}")


@lru_cache(1 << 16)
def _spellings(letter: str) -> dict[str, str]:
    """By script, the letters that look like this one; a mark fits any script."""
    if letter in SPELLINGS:
        return SPELLINGS[letter]
    return {s: letter for s, p in _patterns()[0] if p.match(letter)}


def _plain(c: str) -> str:
    """The plain form of one character of a decomposed text."""
    if c in HYPHENS or c == "­":
        return "-"
    if c in "\n\r\t" or c < "\x7f":
        return c
    if unicodedata.category(c) == "Zs":
        return " "
    kind, *points = unicodedata.decomposition(c).split() or [""]
    if kind in SAME_LOOK and c != "ſ":
        return "".join(_plain(chr(int(p, 16))) for p in points)
    return c


@lru_cache(1)
def _votes():
    """By script: a pattern of its letters that no other script spells alike, one of tokens with a letter of another."""
    import regex

    shared = "".join(sorted(SPELLINGS))
    own = {s: regex.compile(rf"[\p{{{s}}}--[{shared}]]", regex.V1) for s in SCRIPTS}
    letter = "[" + "".join(rf"\p{{{s}}}" for s in SCRIPTS) + r"\p{M}]*"
    foreign = {s: regex.compile(letter + "[" + "".join(rf"\p{{{o}}}" for o in SCRIPTS if o != s) + "]" + letter) for s in SCRIPTS}
    return own, foreign


def resolve_scripts(text: str) -> str:
    """A decomposed text with each token in its consistent script spelling."""
    own, foreign = _votes()
    votes = {s: len(p.findall(text)) for s, p in own.items()}
    order = {s: (-votes[s], n) for n, s in enumerate(SCRIPTS)}

    def respell(match) -> str:
        token = match[0]
        sets = [_spellings(c) for c in token]
        common = set(SCRIPTS).intersection(*(s.keys() for s in sets if s))
        if common:
            script = min(common, key=order.get)
        else:
            alone = Counter(next(iter(s)) for s in sets if len(s) == 1)
            script = min(alone, key=lambda s: (-alone[s], SCRIPTS.index(s)))
        # A letter that the token's script can't spell takes the text's main one of its own.
        return "".join(s.get(script) or s[min(s, key=order.get)] if s else c for s, c in zip(sets, token))

    # A token wholly in the text's main script is consistent already.
    return foreign[min(SCRIPTS, key=order.get)].sub(respell, text)


class _Plain(dict):
    def __missing__(self, point: int) -> str:
        self[point] = out = _plain(chr(point))
        return out


_PLAIN = _Plain()


@lru_cache(1)
def _touched():
    """A pattern of the characters that can make a text differ from its one form: all but ASCII and those that are
    their own plain form. Scripts beside Latin always count, since they bear on how ambiguous letters are resolved."""
    import regex

    voters = regex.compile("[" + "".join(rf"\p{{{s}}}" for s in SCRIPTS[1:]) + r"\p{M}\p{Default_Ignorable_Code_Point}\p{Cn}\p{Co}]")
    own = lambda c: unicodedata.normalize("NFC", "".join(map(_plain, unicodedata.normalize("NFD", c)))) == c
    plain = [n for n in (*range(0x80, 0xD800), *range(0xE000, 0x10000)) if not voters.match(chr(n)) and own(chr(n))]
    runs, begin = [], None
    for a, b in zip(plain, [*plain[1:], None]):
        begin = a if begin is None else begin
        if b != a + 1:
            runs.append(f"{chr(begin)}-{chr(a)}")
            begin = None
    return regex.compile(rf"[^\x00-\x7F{''.join(runs)}]")


def canonical(text: str) -> str:
    """The one form of all texts that look like ``text``."""
    return resolve(text) if _touched().search(text) else text


def resolve(text: str) -> str:
    """``canonical`` without its shortcut."""
    hidden, some = _patterns()[1:]
    text = unicodedata.normalize("NFD", text)
    if some.search(text):
        text = hidden.sub("", text)
    text = text.translate(_PLAIN)
    return unicodedata.normalize("NFC", resolve_scripts(unicodedata.normalize("NFD", text)))


@F.arrow_udf(T.StringType())
def _canonical(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if x is None else canonical(x) for x in batch.to_pylist()], pa.string())


def one_form(text: Column) -> Column:
    """``text`` in its one form. ASCII texts are in it already and aren't sent to Python."""
    return F.coalesce(_canonical(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def items(records: DataFrame) -> DataFrame:
    """(record_id, paper_id, item, place, text): all blocks but tables and all filled cells. ``place`` is what items of
    two records must share to be compared."""
    blocks = records.select("record_id", "paper_id", F.inline("blocks"))
    blocks = blocks.filter(F.col("text").isNotNull() & ~F.coalesce(F.col("kind") == "table", F.lit(False)))
    name = lambda *parts: F.concat_ws("/", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    blocks = blocks.select("record_id", "paper_id", name(F.col("record_id"), "b", F.col("order")).alias("item"), name("b", F.col("page")).alias("place"), "text", F.col("page").isNotNull().alias("placed"))
    cells = records.select("record_id", "paper_id", F.posexplode("tables.cells").alias("i", "rows"))
    cells = cells.select("record_id", "paper_id", "i", F.posexplode("rows").alias("j", "row"))
    cells = cells.select("record_id", "paper_id", "i", "j", F.posexplode("row").alias("k", "text")).filter("text <> ''")
    place = name("t", F.col("i"), F.col("j"), F.col("k"))
    cells = cells.select("record_id", "paper_id", name(F.col("record_id"), place).alias("item"), place.alias("place"), "text", F.lit(True).alias("placed"))
    return blocks.unionByName(cells)


def identical_pairs(records: DataFrame) -> DataFrame:
    """(item_a, item_b): items of two records of a paper, in the same place, that look the same but differ as strings.

    Items travel as hashes. Groups of one look are first reduced, before the shuffle, to whether they hold different
    strings at all; only items of those that do are joined. A null paper or page is no place to share.
    """
    them = items(records).filter(F.col("paper_id").isNotNull() & F.col("placed"))
    them = them.withColumn("form", one_form(F.col("text")))
    them = them.select(
        F.xxhash64("paper_id", "place", "form").alias("look"),
        F.xxhash64("form", "place", F.lit(7), "paper_id").alias("look2"),
        F.xxhash64("text").alias("stored"),
        "record_id",
        "item",
    )
    them = cut(them)
    differ = them.groupBy("look", "look2").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).filter("a <> b").select("look", "look2")
    some = them.join(differ, ["look", "look2"], "left_semi").distinct()
    a, b = some.alias("a"), some.alias("b")
    on = (F.col("a.look") == F.col("b.look")) & (F.col("a.look2") == F.col("b.look2"))
    pairs = a.join(b, on & (F.col("a.record_id") != F.col("b.record_id")) & (F.col("a.stored") != F.col("b.stored")) & (F.col("a.item") < F.col("b.item")))
    return pairs.select(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"))
