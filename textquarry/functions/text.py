"""Text column functions with the white-space and word rules of the reference, in built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common English words that carry no content; a parameter of every function that uses them.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do "
    "does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more "
    "most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these "
    "they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()

_SPACE = r"(?U)\s+"
#: The characters that count as white space.
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def split_words(c: Column) -> Column:
    """Words between runs of white space; none for blank text."""
    return F.filter(F.split(c, _SPACE), lambda w: w != "")


def newlines(c: Column) -> Column:
    """All line ends as line feeds, as text is when loaded."""
    return F.regexp_replace(c, "\r\n?", "\n")


def content_words(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of two or more letters or digits, without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS if stop_words is None else list(stop_words)))


def glob_regex(glob: str) -> str:
    """The regular expression of a file glob in which ``*`` also crosses directory borders."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        end = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", ch)
        i += 1
    return "^" + out + "$"


def matches_any(c: Column, globs: list[str]) -> Column:
    """Whether the text matches one of the globs; false without globs or for null."""
    return F.coalesce(c.rlike("|".join(glob_regex(g) for g in globs)), F.lit(False)) if globs else F.lit(False)


def preview(c: Column, limit: int = 400) -> Column:
    """A short form of a text, cut behind a sentence in the last 30 %, else at a blank in the last 20 %, else hard."""
    def shown(clean: Column, head: Column) -> Column:
        last = lambda ch: F.when(F.contains(head, F.lit(ch)), F.lit(limit) - F.locate(ch, F.reverse(head))).otherwise(-1)
        sentence, blank = F.greatest(last("."), last("!"), last("?")), last(" ")
        return (
            F.when(F.length(clean) <= limit, clean)
            .when(sentence > limit * 0.7, F.concat(F.left(head, sentence + 1), F.lit("...")))
            .when(blank > limit * 0.8, F.concat(F.left(head, blank), F.lit("...")))
            .otherwise(F.concat(head, F.lit("...")))
        )

    clean = F.replace(F.replace(strip(c), F.lit("\n\n\n"), F.lit("\n\n")), F.lit("\t"), F.lit(" "))
    # Bound as the variable of a one-element array, so that the text is cleaned once.
    out = F.transform(F.array(clean), lambda t: F.transform(F.array(F.left(t, F.lit(limit))), lambda h: shown(t, h))[0])[0]
    return F.when(c.isNull() | (c == ""), "[No content available]").otherwise(out)
