r"""Runs of name words, matched in time linear in the text and without nesting.

The patterns of ``wordlists`` repeat a group of words. Java's matcher goes one
level deeper for each repetition, so a long text without punctuation ends in a
stack overflow. Here what can't belong to a run is marked first, by patterns
that look at one token or comma; a run is then a stretch of one class of
characters, which the matcher walks without nesting. Word characters and white
space are those of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W

SPACE = r"\t\n\f\r "
#: Stands for what ends a run; in no class of a run.
MARK = "\x01"
_TOKEN = "[A-Za-z0-9_]+"
_OUTSIDE = "(?<![A-Za-z0-9_])"
_END = "(?![A-Za-z0-9_])"
WORDS = rf"([A-Za-z][A-Za-z{SPACE}]*[A-Za-z])"
PLACE_WORDS = rf"([A-Za-z][A-Za-z,{SPACE}]*[A-Za-z])"


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with word boundaries of ASCII words: Java's \b counts letters of all scripts."""
    return pattern.replace(r"\b", f"(?:{_OUTSIDE}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){_END})")


def whole_word(pattern: str, first: str, end: str = _END) -> str:
    r"""``ascii_bounds`` of a pattern that starts with \b and a character of the class ``first``: that character is looked for before what stands behind it. ``end``: what its last \b says; after a word character, that none follows."""
    flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    assert body.startswith(r"\b") and body.endswith(r"\b")
    return f"{flags}(?=[{first}]){_OUTSIDE}{body[2:-2]}{end}"


def _replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def _every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _whole_words(text: Column) -> Column:
    """Tokens that aren't words of two letters or more become an underscore, so that they still end a word."""
    return _replace(text, f"{_OUTSIDE}(?![A-Za-z]{{2,}}{_END}){_TOKEN}", "_")


def _no_loose_commas(text: Column) -> Column:
    """Commas that don't follow a word, or that no space follows, end a run."""
    return _replace(text, f"(?<![A-Za-z]),|,(?![{SPACE}])", MARK)


def capitalised(text: Column) -> Column:
    """All runs of words with a capital and lower-case letters after it."""
    kept = _replace(text, f"{_OUTSIDE}(?![A-Z][a-z]+{_END}){_TOKEN}", "_")
    return _every(kept, rf"([A-Z][A-Za-z{SPACE}]*[a-z])")


def places(text: Column) -> Column:
    """All runs of words, of any case, after in, at, from or to; commas may stand between words."""
    return _every(_no_loose_commas(_whole_words(text)), rf"(?i)(?<![A-Za-z])(?:in|at|from|to)[{SPACE}]+{PLACE_WORDS}")


def companies(text: Column) -> Column:
    """All runs of words, of any case, up to their last company word, that word included."""
    kept = _whole_words(text)
    run = rf"{WORDS}(?=(\.?[A-Za-z0-9_]?))"  # with what follows, as a dot may end the company word
    runs = F.zip_with(_every(kept, run, 1), _every(kept, run, 2), lambda a, b: F.concat(a, b))
    closed = rf"(?i)^({WORDS}[{SPACE}]+(?:Inc\.?|Corp\.?|LLC|Ltd\.?|Company|Co\.))\b"
    return F.filter(F.transform(runs, lambda r: F.regexp_extract(r, closed, 1)), lambda c: c != "")


def relations(text: Column) -> dict[str, tuple[Column, Column]]:
    """For each relation that ends in a run: all its sources and targets, in step."""
    single = _replace(text, "(?<![A-Za-z])([A-Za-z])(?![A-Za-z])", f"{MARK}$1")
    patterns = {
        "works_at": (single, rf"(?i){W.NAME2}[{SPACE}]+(?:works at|works for|is employed by|joined)[{SPACE}]+{WORDS}"),
        "lives_in": (_no_loose_commas(single), rf"(?i){W.NAME2}[{SPACE}]+(?:lives in|is from|moved to|resides in)[{SPACE}]+{PLACE_WORDS}"),
        "member_of": (single, rf"(?i){W.NAME2}[{SPACE}]+is[{SPACE}]+(?:{MARK}a[{SPACE}]+)?(?:member|part)[{SPACE}]+of[{SPACE}]+{WORDS}"),
    }
    return {kind: (_every(t, p, 1), _every(t, p, 2)) for kind, (t, p) in patterns.items()}
