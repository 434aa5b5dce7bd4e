"""Text helpers: folding, blanks, words, phrases. A missing value is the empty string."""

from __future__ import annotations

import re
from functools import lru_cache
from re import _parser as _regex  # the tree of a pattern; patterns here mean the same in Java

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fold(c: Column) -> Column:
    """Case folding: lower case, and the one letter that folds to two."""
    return F.replace(F.lower(text(c)), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column) -> Column:
    """Every run of blanks is one space, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    return fold(squeeze(c))


def found(c: Column, pattern: str) -> Column:
    """Whether a pattern matches somewhere, with Unicode classes."""
    return c.rlike("(?U)" + pattern)


@lru_cache(maxsize=None)
def needles(pattern: str) -> tuple[str, ...]:
    """Literals of which a text must hold one, or the pattern can't match; none where it has no such literals of two letters."""
    if "(?i" in pattern:
        return ()

    def of(items) -> tuple[str, ...]:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is _regex.LITERAL:
                run += chr(arg)
                continue
            found.append((run,))
            run = ""
            if op is _regex.SUBPATTERN:
                found.append(of(arg[-1]))
            elif op is _regex.BRANCH:
                parts = [of(x) for x in arg[1]]
                found.append(tuple(dict.fromkeys(w for part in parts for w in part)) if all(parts) else ())
            elif op is _regex.MAX_REPEAT and arg[0] > 0:
                found.append(of(arg[2]))
        best = max((f for f in found if f), key=lambda f: (min(len(min(f, key=len)), 4), -len(f)), default=())
        return best if best and len(min(best, key=len)) > 1 else ()

    return of(_regex.parse(pattern))


def holds(t: Column, pattern: str) -> Column:
    """found(), after a look for the pattern's literals, which costs next to nothing. t is named more than once: bind it with let()."""
    words = needles(pattern)
    return any_of(t, words) & found(t, pattern) if words else found(t, pattern)


def word_list(t: Column) -> Column:
    """The distinct words of a text: a word of letters and digits is among them if and only if it stands there alone."""
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?U)(\w+)"), F.lit(1)))


def quoted(word: str) -> str:
    """A literal inside a pattern, in text that both Java and RE2 read."""
    return re.sub(r"([^\w\s])", r"\\\1", word)


def any_of(c: Column, words) -> Column:
    """Whether folded text holds one of the words as a substring."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def phrase(word: str) -> str:
    return rf"\b{quoted(word)}\b"


def first_nonblank(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in cols], F.lit(""))


def joined(cols, sep: str = "; ") -> Column:
    return F.array_join(cols, sep)


def split_list(c: Column, sep: str = ";") -> Column:
    """Parts of a joined list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text(c), sep), lambda x: strip(x)), lambda x: x != "")


def let(value: Column, body) -> Column:
    """body(v) with v bound to value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
