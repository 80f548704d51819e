"""Tokens of English text with character offsets, and entities as short rules over their attributes.

A text is cut at white space; marks at either end of what is left are tokens of their own, as
are %, currency signs and units next to digits, and marks between letters; abbreviations of
COMPANY_FORMS keep their dot. A rule is a row of steps, each a test of a token that may be
optional. All ways to match count, and of matches that overlap the longest stays, of equal
ones the first, of equal spans the earlier rule.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

# The words and places of the English rules.
COMPANY_FORMS = ("llc", "plc", "pjsc", "inc.", "inc")
PLACES = ("UAE", "Dubai", "Abu Dhabi", "KSA", "Saudi", "Qatar", "Bahrain", "Oman", "Kuwait")
# Words that are like numbers.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split()
)
ORDINAL_WORDS = frozenset(
    "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth hundredth thousandth millionth billionth trillionth".split()
)

# An abbreviation of a company with its dot; a signed number with marks inside; letters and digits with apostrophes, hyphens and dots inside; else one sign.
_TOKEN = re.compile(rf"(?i:{'|'.join(re.escape(f) for f in COMPANY_FORMS if f.endswith('.'))})(?![^\W_])|" r"[+\-±~]?\d+(?:[.,/]\d+)*(?i:st|nd|rd|th)?(?![^\W_])|[^\W_]+(?:['’\-.][^\W_]+)*|[^\s]")


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of each token, in order."""
    return [m.span() for m in _TOKEN.finditer(text)]


def is_title(t: str) -> bool:
    return t.istitle()


def like_number(t: str) -> bool:
    """Digits with a sign, dots and commas, a fraction, a number in words, or an ordinal."""
    bare = t[1:] if t[:1] in "+-±~" else t
    bare = bare.replace(",", "").replace(".", "").lower()
    top, _, below = bare.partition("/")
    return bare.isdigit() or (top.isdigit() and below.isdigit()) or bare in NUMBER_WORDS or bare in ORDINAL_WORDS or (bare[-2:] in ("st", "nd", "rd", "th") and bare[:-2].isdigit())


def is_currency(t: str) -> bool:
    return all(unicodedata.category(c) == "Sc" for c in t)


def shape(t: str) -> str:
    """X for capitals, x for other letters, d for digits, signs as they are; of a run four stay."""
    out = ""
    for c in t:
        k = "d" if c.isdigit() else ("X" if c.isupper() else "x") if c.isalpha() else c
        out += k if not out.endswith(k * 4) else ""
    return out


_PLACE = re.compile("|".join(PLACES))
Test = Callable[[str], bool]
#: Label and steps: a test, and whether the step is optional.
RULES: tuple[tuple[str, tuple[tuple[Test, bool], ...]], ...] = (
    ("ORG", ((is_title, False), (is_title, True), (lambda t: t.lower() in COMPANY_FORMS, True))),
    ("GPE", ((lambda t: _PLACE.search(t) is not None, False),)),
    ("PERCENT", ((like_number, False), (lambda t: t == "%", False))),
    ("MONEY", ((is_currency, False), (like_number, False))),
    ("DATE", ((lambda t: len(t) >= 4 and t.isdigit(), False),)),
)


def _ends(steps, words: list[str], at: int) -> set[int]:
    """Tokens at which a match from here can end."""
    now = {at}
    for test, optional in steps:
        now = {k + 1 for k in now if k < len(words) and test(words[k])} | (now if optional else set())
    return {k for k in now if k > at}


#: Characters of a word whose rules are remembered, and how many such words.
_KNOWN_LENGTH, _KNOWN_WORDS = 32, 1 << 16


@lru_cache
def _starts(rules) -> tuple[Callable[[str], tuple[int, ...]], Callable[[str], tuple[int, ...]]]:
    """Which rules can take a word first (a step up to the first that is not optional takes it), and the same with a memory."""
    firsts = []
    for k, (_, steps) in enumerate(rules):
        lead = next((n + 1 for n, (_, optional) in enumerate(steps) if not optional), len(steps))
        firsts += [(k, test) for test, _ in steps[:lead]]

    def starts(word: str) -> tuple[int, ...]:
        return tuple(dict.fromkeys([k for k, test in firsts if test(word)]))

    return starts, lru_cache(_KNOWN_WORDS)(starts)


def entities(text: str, rules=RULES) -> list[tuple[int, int, str]]:
    """(start, end, label) in code points. Most words begin no rule, and which ones a word begins is remembered."""
    hits = list(_TOKEN.finditer(text))
    words = [m.group() for m in hits]
    starts, known = _starts(rules)
    begun = [(at, ks) for at, w in enumerate(words) if (ks := known(w) if len(w) <= _KNOWN_LENGTH else starts(w))]
    found = [(at - end, at, k, end) for at, ks in begun for k in ks for end in _ends(rules[k][1], words, at)]
    taken, out = [False] * len(words), []
    for _, at, k, end in sorted(found):
        if not any(taken[at:end]):
            taken[at:end] = [True] * (end - at)
            out.append((hits[at].start(), hits[end - 1].end(), rules[k][0]))
    return sorted(out)


# Fixed value: where a sentence ends, abbreviations or not.
SENTENCE_END = re.compile(r"(?<=[\.\!\?؟۔])\s+(?=[A-Za-z0-9؀-ۿ])")


def sentence_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sentence) in the stripped text."""
    s = text.strip()
    cuts = [(m.start(), m.end()) for m in SENTENCE_END.finditer(s)]
    return [(a, b, s[a:b]) for a, b in zip([0, *(e for _, e in cuts)], [*(b for b, _ in cuts), len(s)]) if b > a]
