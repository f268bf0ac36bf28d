"""One spelling for values that look the same: full-width forms, loose accents, unseen characters, look-alike letters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from arbora.storage import materialize

#: Distinct values that one trie holds.
SHARD_VALUES = 4_000
#: What the automaton charges for a symbol that is put in, left out or replaced; look-alikes, variants and ignorables cost nothing.
EDIT_COST = 1
#: Values that look the same are at cost 0; a larger bound would also find values that are only spelt alike.
MOST_COST = 0

# Letters of other scripts (or other Latin letters) that look like a Latin letter.
LOOK_ALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ",
    "K": "КΚ", "L": "Ꮮ", "M": "МΜϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ",
    "U": "Ս", "V": "ѴᏙ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ", "Đ": "ÐƉ",
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "f": "ſ", "g": "ɡց", "h": "һհ", "i": "іıɩι", "j": "јϳ",
    "k": "κк", "l": "ӏ", "m": "м", "n": "ոη", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "τт",
    "u": "υսʋ", "v": "νѵυ", "w": "ԝѡ", "x": "хχ", "y": "уγү", "z": "ᴢ", "đ": "ðɖ",
}
# Modifiers and tones that Vietnamese puts on its vowels.
_VOWELS, _HATS, _TONES = "aeiouyAEIOUY", ("", "̂", "̆", "̛"), ("", "̀", "́", "̃", "̉", "̣")
_ON = {"̂": "aeoAEO", "̆": "aA", "̛": "ouOU"}

VIETNAMESE = frozenset(
    unicodedata.normalize("NFC", v + hat + tone) for v in _VOWELS for hat in _HATS for tone in _TONES if not hat or v in _ON[hat]
) | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZđĐ")
#: Ordinary beside plain letters: raised digits after a unit.
_RAISED = frozenset("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺")
_UNSEEN = frozenset("͏ᅟᅠ឴឵ㅤﾠ")
#: Joiners, scripts in which they change nothing, and format characters that are seen.
_JOINERS = frozenset("\u200c\u200d")
_UNJOINED = ("LATIN", "CYRILLIC", "GREEK", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "ARMENIAN", "GEORGIAN", "HEBREW", "THAI", "LAO", "COMBINING")
_SIGNS = frozenset("\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd")
_ASCII_SPACE = frozenset(" \t\n\r\x0b\x0c")
#: For the JVM: values made of these alone need no look.
PLAIN_PATTERN = "^[ -~\\t\\n\\r\\x0b\\x0c" + "".join(sorted(c for c in VIETNAMESE if ord(c) > 126)) + r"]*\z"

_LATIN_OF: dict[str, list[str]] = {}
for _latin, _others in LOOK_ALIKES.items():
    for _c in _others:
        _LATIN_OF.setdefault(_c, []).append(_latin)


@lru_cache(maxsize=65536)
def _unseen(c: str) -> bool:
    return c in _UNSEEN or "︀" <= c <= "️" or unicodedata.category(c) == "Cf" or (unicodedata.category(c) == "Cc" and not c.isspace())


@lru_cache(maxsize=65536)
def _unfold(c: str) -> str:
    """White space to the blank, full-width and font variants to their letter, others decomposed."""
    if c in _ASCII_SPACE:
        return c
    if c.isspace():
        return " "
    tag, _, codes = unicodedata.decomposition(c).partition("> ")
    if codes and tag in ("<wide", "<narrow", "<font", "<compat"):
        plain = unicodedata.normalize("NFKD", c)
        if tag != "<compat" or plain.isalpha():
            return plain
    return unicodedata.normalize("NFD", c)


def symbols(value: str) -> str:
    """What meets the eye: unseen characters gone, variants unfolded, marks apart in canonical order."""
    return unicodedata.normalize("NFD", "".join(_unfold(c) for c in value if not _unseen(c)))


def _is_latin(c: str) -> bool:
    return c.isalpha() and (c.isascii() or unicodedata.name(c, "").startswith("LATIN"))


def _words(seen: str) -> Iterable[tuple[str, bool]]:
    """Words and the white space between them, each with whether look-alikes may stand in it:
    only where a Latin letter stands too, for words wholly in another script are ordinary."""
    start = 0
    for end in range(1, len(seen) + 1):
        if end == len(seen) or seen[end].isspace() != seen[start].isspace():
            word = seen[start:end]
            yield word, any(_is_latin(c) for c in word)
            start = end


def options(seen: str) -> list[tuple[str, ...]]:
    """For each symbol the symbols that look so, itself among them, at no cost."""
    return [(*_LATIN_OF.get(c, ()), c) if mixed else (c,) for word, mixed in _words(seen) for c in word]


def by_table(seen: str) -> str:
    """The first look-alike of each symbol, composed."""
    return unicodedata.normalize("NFC", "".join(o[0] for o in options(seen)))


def is_plain(value: str) -> bool:
    return all(c in VIETNAMESE or c in _ASCII_SPACE or c in _RAISED or (c.isascii() and c >= " ") or unicodedata.category(c)[0] == "P" for c in value)


def skeleton(value: str) -> str:
    """Equal for all values that can be read as each other: letters that share a look-alike fall together."""
    return "".join(_CLASS.get(o[0], o[0]) for o in options(symbols(value)))


_CLASS: dict[str, str] = {}
for _all in _LATIN_OF.values():
    _least = min(_CLASS.get(x, x) for x in _all)
    for _x in _all:
        _CLASS[_x] = _least


def clusters(value: str) -> Iterable[tuple[tuple[str, ...], str]]:
    """The value as the automaton reads it: for each seen character all that it may stand for at no cost, and the marks on it in canonical order.

    Ignorables are passed over, also between a letter and its marks. Look-alikes may stand for a
    Latin letter only in a word that holds a Latin letter, for words wholly in another script are ordinary.
    """
    raw = [(c, _unfold(c)) for c in value if not _unseen(c)]
    mixed: list[bool] = []
    for blank, run in groupby(raw, key=lambda x: x[1].isspace()):
        word = list(run)
        mixed += [not blank and any(_is_latin(u) for _, seen in word for u in seen)] * len(word)
    base, marks = None, ""
    for (_, seen), is_mixed in zip(raw, mixed):
        for u in seen:
            if base is not None and unicodedata.combining(u):
                marks += u
                continue
            if base is not None:
                yield base, unicodedata.normalize("NFD", "a" + marks)[1:]
            base, marks = ((u, *_LATIN_OF.get(u, ())) if is_mixed else (u,)), ""
    if base is not None:
        yield base, unicodedata.normalize("NFD", "a" + marks)[1:]


class Trie:
    """Vocabulary with its frequencies, traversed by a weighted edit automaton on the raw value."""

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.words: dict[int, tuple[int, str]] = {}

    def add(self, word: str, n: int) -> None:
        node = 0
        for c in unicodedata.normalize("NFD", word):
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
            node = self.children[node][c]
        if n > self.words.get(node, (0, ""))[0]:
            self.words[node] = (n, word)

    def _settle(self, states: dict[int, int], most: int) -> dict[int, int]:
        """With the states that symbols put in lead to."""
        waiting = list(states.items())
        for node, cost in waiting:
            if cost + EDIT_COST <= most:
                for child in self.children[node].values():
                    if states.get(child, most + 1) > cost + EDIT_COST:
                        states[child] = cost + EDIT_COST
                        waiting.append((child, cost + EDIT_COST))
        return states

    def _read(self, states: dict[int, int], symbol: str, most: int) -> dict[int, int]:
        reached: dict[int, int] = {}

        def reach(node: int, cost: int) -> None:
            if cost < reached.get(node, most + 1):
                reached[node] = cost

        for node, cost in states.items():
            child = self.children[node].get(symbol)
            if child is not None:
                reach(child, cost)
            if cost + EDIT_COST <= most:
                reach(node, cost + EDIT_COST)
                for other in self.children[node].values():
                    reach(other, cost + EDIT_COST)
        return self._settle(reached, most)

    def find(self, value: str, most: int = MOST_COST) -> str | None:
        """The word at the least cost up to ``most``; of several the most frequent, then the first by code points."""
        states = self._settle({0: 0}, most)
        for base, marks in clusters(value):
            met: dict[int, int] = {}
            for symbol in base:
                reached = states
                for c in symbol + marks:
                    reached = self._read(reached, c, most)
                for node, cost in reached.items():
                    if cost < met.get(node, most + 1):
                        met[node] = cost
            states = met
            if not states:
                return None
        ends = [(cost, -self.words[node][0], self.words[node][1]) for node, cost in states.items() if node in self.words]
        return min(ends)[2] if ends else None


@lru_cache(maxsize=65536)
def _joins(c: str) -> bool:
    """Whether a joiner beside the character changes its look: emoji and scripts whose letters join."""
    kind = unicodedata.category(c)
    return kind in ("So", "Sk") or "︀" <= c <= "️" or (kind[0] in "LM" and not unicodedata.name(c, "LATIN").startswith(_UNJOINED))


def shown(value: str) -> str:
    """``symbols``, but for joiners, variation selectors and signs that show beside emoji or letters of another script."""

    def shows(k: int, c: str) -> bool:
        before, after = value[k - 1 : k], value[k + 1 : k + 2]
        if c in _JOINERS:
            return bool(before and after) and _joins(before) and _joins(after)
        if "︀" <= c <= "️":
            return after == "⃣" or (before > "~" and (unicodedata.category(before)[0] in "SP" or unicodedata.category(before) == "Lo"))
        return "\U000e0020" <= c <= "\U000e007f" or c in _SIGNS

    return unicodedata.normalize("NFD", "".join(_unfold(c) for k, c in enumerate(value) if not _unseen(c) or shows(k, c)))


def _run(letters: str) -> str:
    """A run of letters read as Latin, if it holds a Latin letter and all others look like one."""
    spelling = by_table(letters)
    return spelling if all(_is_latin(c) for c in spelling if c.isalpha()) else letters


def _word(word: str) -> str:
    spelling = by_table(word)
    return spelling if is_plain(spelling) else "".join(_run("".join(run)) for _, run in groupby(word, lambda c: unicodedata.category(c)[0] in "LM"))


def canonical(value: str, vocabulary: Trie | None = None) -> str:
    """The one spelling of ``value``: that of the vocabulary, if it looks so, else by table. Where the whole does not look like plain spelling, characters are unfolded and
    composed and unseen ones go, but look-alikes are only read as Latin in words or runs of letters that are Latin then."""
    spelling = vocabulary.find(value) if vocabulary else None
    if spelling is None:
        spelling = by_table(symbols(value))
    return spelling if is_plain(spelling) else unicodedata.normalize("NFC", "".join(_word(word) for word, _ in _words(shown(value))))


@F.pandas_udf(StringType())
def _skeleton(values: pd.Series) -> pd.Series:
    return values.map(skeleton)


def _respell(odd: pd.DataFrame, plain: pd.DataFrame) -> pd.DataFrame:
    trie = Trie()
    for value, n in zip(plain["value"], plain["n"]):
        trie.add(value, n)
    spelled = [canonical(v, trie) for v in odd["value"]]
    return pd.DataFrame({"value": odd["value"], "canonical": spelled, "plain": [is_plain(c) for c in spelled], "n": odd["n"]})


def cells(records: DataFrame) -> DataFrame:
    """(record_id, idx, field_name, position, value) of every form, syllable and register that is not null.

    ``register`` has idx -1; ``position`` counts a token's syllables from 0. Null or empty
    token lists give only the register.
    """
    cell = lambda idx, field, position, value: F.struct(idx.alias("idx"), F.lit(field).alias("field_name"), position.alias("position"), value.alias("value"))
    of_token = F.transform(
        "tokens",
        lambda t: F.concat(
            F.array(cell(t["idx"], "form", F.lit(0), t["form"])),
            F.transform(F.coalesce(t["syllables"], F.array()), lambda s, i: cell(t["idx"], "syllables", i, s)),
        ),
    )
    register = F.array(cell(F.lit(-1), "register", F.lit(0), F.col("register")))
    every = records.select("record_id", F.explode(F.concat(register, F.flatten(F.coalesce(of_token, F.array())))).alias("c"))
    return every.select("record_id", "c.idx", "c.field_name", "c.position", "c.value").filter("value is not null")


def _texts(records: DataFrame):
    """All forms, syllables and the register of a record as one array."""
    none = F.array().cast("array<string>")
    syllables = F.flatten(F.filter(F.col("tokens.syllables"), lambda s: s.isNotNull()))
    return F.concat(F.coalesce(F.col("tokens.form"), none), F.coalesce(syllables, none), F.array("register"))


def spellings(records: DataFrame) -> DataFrame:
    """(value, canonical, plain, n) for every distinct value that is not made of plain characters alone.

    Plain values are the vocabulary. Values that may look the same fall into one shard, whose
    trie the odd values traverse; what matches nothing is normalised by the table alone.
    """
    found = records.select(F.explode(_texts(records)).alias("value")).filter("value is not null")
    values = materialize(found.groupBy("value").agg(F.count("*").alias("n")).withColumn("odd", ~F.col("value").rlike(PLAIN_PATTERN)), "values")
    shards = max(1, -(-values.count() // SHARD_VALUES))
    sharded = values.withColumn("shard", F.pmod(F.xxhash64(_skeleton("value")), F.lit(shards)))
    odd, plain = (sharded.filter(c).repartition(shards, "shard").groupBy("shard") for c in ("odd", "not odd"))
    return odd.cogroup(plain).applyInPandas(lambda a, b: _respell(a, b), "value string, canonical string, plain boolean, n bigint")


def respelled(records: DataFrame) -> DataFrame:
    """Every cell with its ``canonical`` value."""
    changed = materialize(spellings(records).filter("value <> canonical"), "spellings").select("value", "canonical")
    all_cells = cells(records)
    odd = F.coalesce(~F.col("value").rlike(PLAIN_PATTERN), F.lit(False))
    plain = all_cells.filter(~odd).withColumn("canonical", F.col("value"))
    rest = all_cells.filter(odd).join(changed, "value", "left").withColumn("canonical", F.coalesce("canonical", "value"))
    return plain.unionByName(rest)


def found_cells(records: DataFrame) -> DataFrame:
    """(record_id, idx, field_name) of every cell whose value changes to plain spelling, once for all syllables of a token."""
    changed = materialize(spellings(records).filter("plain and value <> canonical"), "spellings").select("value")
    with_odd = records.filter(~F.array_join(_texts(records), " ").rlike(PLAIN_PATTERN))
    odd = cells(with_odd).filter(~F.col("value").rlike(PLAIN_PATTERN))
    return odd.join(changed, "value", "left_semi").select("record_id", "idx", "field_name").distinct()
