"""Many patterns at once: strings that a match cannot lack, found by one automaton, choose the patterns worth trying.

A pattern gives a set of ASCII strings of which every text that it matches holds at least one, once both are folded. An
Aho-Corasick automaton over all sets reads a text once, whatever the number of patterns. What it names is a superset of
the matches; the exact test follows on those alone. Patterns that are a string, as it stands or as a whole word (``plain``),
need no test: the automaton sees what is beside a string, so that it decides them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 2
#: What the occurrence of a string says of its pattern: to be tried, met if the lower-case text holds it, met, met as a whole word.
TRY, LOWER, HELD, WORD = range(4)
#: Texts that are turned into Python strings at once.
ROWS = 256
WHOLE_WORD = re.compile(r"\(\^\|\[\^a-z\]\)([A-Za-z]+)\(\[\^a-z\]\|\$\)")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
#: Characters beyond ASCII that count as an ASCII letter where case is ignored.
FOLDED = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "K": "k"})


def fold(text: str) -> str:
    return text.translate(FOLDED).lower()


def plain_runs(text: str) -> str:
    """The longest ASCII run of a text."""
    return max("".join(c if c.isascii() else "\0" for c in text).split("\0"), key=len)


class Reader:
    """Reads a regular expression for what a match must hold. Whatever it does not understand ends in ``ValueError``."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def quantifier(self) -> str | None:
        """``some`` (once or more), ``none`` (may be absent) or None."""
        c = self.peek()
        if c and c in "*?+":
            self.i += 1
            out = "some" if c == "+" else "none"
        elif c == "{":
            end = self.p.index("}", self.i)
            low = self.p[self.i + 1 : end].split(",")[0]
            self.i = end + 1
            out = "some" if low.isdigit() and int(low) > 0 else "none"
        else:
            return None
        if self.peek() in ("?", "+"):
            self.i += 1
        return out

    def skip_class(self) -> None:
        self.i += self.peek() == "^"
        first = True
        while first or self.peek() != "]":
            c = self.take() if self.peek() else ""
            if c in ("", "[", "&"):  # nested and intersected classes
                raise ValueError(self.p)
            self.i += c == "\\"
            first = False
        self.i += 1

    def group(self) -> list[str] | None:
        """After ``(``: what the group must hold, None where that is unknown or the group does not match as it stands."""
        if self.peek() != "?":
            return self.alternatives(True)
        self.i += 1
        flags = ""
        while self.peek() and self.peek() in "imsuUdx-":
            flags += self.take()
        if "x" in flags:
            raise ValueError(self.p)
        if self.peek() == ")":
            self.i += 1
            return None
        if self.peek() == ":":
            self.i += 1
            return self.alternatives(True)
        if flags:
            raise ValueError(self.p)
        held = self.peek() == ">"  # an atomic group; others look around or are named
        named = self.peek() == "<" and self.p[self.i + 1 : self.i + 2] not in ("=", "!")
        self.i = self.p.index(">", self.i) + 1 if named else self.i + (2 if self.peek() == "<" else 1)
        found = self.alternatives(True)
        return found if held or named else None

    def alternatives(self, inner: bool) -> list[str] | None:
        """The strings of which one is in every match; None where an alternative needs none. Reads to the end of the group."""
        out: list[str] | None = []
        while True:
            one = self.sequence()
            out = None if one is None or out is None else out + one
            c = self.take() if self.peek() else ""
            if c == "|":
                continue
            if (c == ")") != inner:
                raise ValueError(self.p)
            return out

    def sequence(self) -> list[str] | None:
        found: list[list[str]] = []
        run, fresh = "", False

        def close() -> None:
            nonlocal run
            if run:
                found.append([run])
            run = ""

        while self.peek() and self.peek() not in "|)":
            c = self.take()
            held: list[str] | None = None
            literal = ""
            if c == "\\":
                e = self.take() if self.peek() else ""
                if e.isalnum() or not e:
                    if e not in tuple("dDwWsSbBAzZGhHvVRtnrfae"):
                        raise ValueError(self.p)
                else:
                    literal = e
            elif c == "[":
                self.skip_class()
            elif c == "(":
                held = self.group()
            elif c not in ".^$":
                literal = c
            many = self.quantifier()
            if literal and literal.isascii() and many != "none":
                run += literal
                if many:
                    close()
            else:
                close()
                if held and many != "none":
                    found.append(held)
        close()
        found = [x for x in found if min(map(len, x)) >= LEAST]
        return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def needles(pattern: str | None, match_type: str | None) -> list[str] | None:
    """Folded strings of which every text that the pattern matches holds one; none for a pattern that matches nothing, None
    where nothing is known."""
    if pattern is None:
        return []
    if match_type in ("exact", "contains"):
        run = plain_runs(pattern)
        return [fold(run)] if len(run) >= LEAST else None
    try:
        found = Reader(pattern).alternatives(False)
    except (ValueError, IndexError):
        return None
    return None if found is None else sorted({fold(x) for x in found})


def plain(pattern: str | None, match_type: str | None) -> tuple[str, int] | None:
    """(folded string, how) of a pattern without case that its string's occurrences decide; else None."""
    if not pattern or not pattern.isascii():
        return None
    if match_type == "contains":
        return (pattern.lower(), LOWER) if len(pattern) >= LEAST else None
    if match_type == "exact":
        return None
    word = WHOLE_WORD.fullmatch(pattern)
    text, how = (word[1], WORD) if word else (pattern, HELD)
    return (text.lower(), how) if len(text) >= LEAST and text.isalpha() else None


_automata: dict[str, list] = {}


def candidates(spark: SparkSession, wanted: dict[str, dict[str, list[tuple[int, int]]]], texts: Callable[[str], Column]) -> Column:
    """An array of (needle, seen): the keys whose strings occur, null to be tried, else with a bit for each of the texts, in the order
    of their names, that meet the pattern. ``wanted`` maps the name of a text to strings with their keys and what they say of
    them, ``texts`` a name to its column. The automata are built once a worker; null texts hold nothing."""
    import ahocorasick

    names = sorted(wanted)
    shared, tag = spark.sparkContext.broadcast([sorted(wanted[n].items()) for n in names]), uuid.uuid4().hex

    def built() -> list:
        if tag not in _automata:
            _automata.clear()
            made = []
            for entries in shared.value:
                a = ahocorasick.Automaton()
                for text, keys in entries:
                    a.add_word(text, (text, *([key for key, how in keys if how == x] for x in (TRY, LOWER, HELD, WORD))))
                a.make_automaton()
                made.append(a)
            _automata[tag] = made
        return _automata[tag]

    def search(automaton: ahocorasick.Automaton, text: str, bit: int, found: dict[int, int | None]) -> None:
        folded, low = fold(text), None
        for end, (string, tries, lower, held, words) in automaton.iter(folded):
            for key in tries:
                found[key] = None
            if lower:
                if low is None:
                    low = text.lower()
                if low == folded or string in low:
                    for key in lower:
                        found[key] = found.get(key, 0) | bit
            for key in held:
                found[key] = found.get(key, 0) | bit
            if words and folded[end + 1 : end + 2] not in LETTERS:
                start = end - len(string)
                if start < 0 or folded[start] not in LETTERS:
                    for key in words:
                        found[key] = found.get(key, 0) | bit

    def run(*columns: pa.Array) -> pa.Array:  # in the order of ``names``
        cuts, keys, seen = [0], [], []
        for at in range(0, len(columns[0]), ROWS):
            for row in zip(*(c.slice(at, ROWS).to_pylist() for c in columns), strict=True):
                found: dict[int, int | None] = {}
                for i, (automaton, text) in enumerate(zip(built(), row, strict=True)):
                    if text:
                        search(automaton, text, 1 << i, found)
                keys += found
                seen += found.values()
                cuts.append(len(keys))
        pairs = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(seen, pa.int64())], ["needle", "seen"])
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)

    kind = T.ArrayType(T.StructType([T.StructField("needle", T.LongType()), T.StructField("seen", T.LongType())]))
    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)(*(texts(n) for n in names))


def indexed(rows: Iterable[tuple[int, bool, list[tuple[str, str | None, str | None]] | None]]) -> tuple[dict[str, dict[str, list[tuple[int, int]]]], list[int]]:
    """(wanted, always): ``rows`` are keys, whether case counts, and what they read, (text name, pattern, match type) each; a key
    whose needs are unknown for one of its texts is always to be tried."""
    wanted: dict[str, dict[str, list[tuple[int, int]]]] = {}
    always = []
    for key, case, reads in rows:
        sets = None if reads is None else [(name, needles(pattern, kind)) for name, pattern, kind in reads]
        if sets is None or any(x is None for _, x in sets):
            always.append(key)
            continue
        forms = [None if case else plain(pattern, kind) for _, pattern, kind in reads]
        if None not in forms and len(reads) <= 62:
            for (name, _, _), (text, how) in zip(reads, forms, strict=True):
                wanted.setdefault(name, {}).setdefault(text, []).append((key, how))
            continue
        for name, strings in sets:
            for text in strings:
                wanted.setdefault(name, {}).setdefault(text, []).append((key, TRY))
    return wanted, always
