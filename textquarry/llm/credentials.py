"""Secret values in code, configuration and guides: their exact positions, and the text without them.

A text is read lexically, into identifiers, literals with their escapes, and comments; literals and comments that speak of
credentials are read again inside. What is assigned or passed to an identifier that names a credential is a secret:
literals of every quoting, over several lines too, parts of a spread literal, bare values of configuration, tags and
attributes, block values; so are passwords of URLs and of command lines, authorisation schemes, private keys.
Placeholders, references and settings *about* secrets are left alone: empty, repeated or reserved words, names of
variables and credentials, sentences.

Values under names that say nothing are found by their format: the formats (a prefix such as ``abc_live_``) are
mined from the collection, as those that several different named secrets share and that much of what has the prefix has
such a name. The counts are exact and cover all rows.

Null texts give no row; overlapping findings are merged into the longest; rows are judged one by one, so repeated
texts give the same spans. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.runtime import cut

#: A format is mined if so many different named secrets have it, and they are this share of all different values that have it.
FORMAT_VALUES, FORMAT_SHARE = 3, 0.1
#: Up to so many formats are sent to all tasks; more are joined by shuffle.
SENT_FORMATS = 50_000

# Words that make an identifier the name of a secret when it ends with them.
_CREDENTIAL = (
    r"(?:passw(?:or)?d|passwd|passphrase|pass(?:word)?|pwd|secret|token|credentials?|"
    r"(?:api|access|signing|private|secret|encryption|account|auth|master|shared)[_-]?key)"
)
# Words that never are a secret.
_PLACEHOLDERS = frozenset(
    "changeme change_me replace_me replaceme todo fixme tbd none null nil true false undefined example example-only placeholder dummy redacted hidden "
    "secret password passwd token string str your_api_key_here your-token xxx test yes no on off required optional unset empty default".split()
)
_NAME = re.compile(_CREDENTIAL + r"(?![a-z0-9_-])", re.I)
#: Names whose values people make up, so that a plain word can be one.
_PASSWORD = re.compile(r"(?i)(?:pass|pwd|secret)\w*$")
#: The lexical elements: literals (a quote inside a word opens none), identifiers and, outside of them, comments up to the end of their line.
_INSIDE = (
    r"""(?P<literal>(?<!\w)[bruf]{0,2}(?:\"\"\".{0,20000}?\"\"\"|'''.{0,20000}?''')|"(?:\\.|[^"\\\n])*"|(?<!\w)'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\\n])*`)|"""
    r"""(?P<name>[A-Za-z_$][\w$]*(?:[.-]+[\w$]+)*)"""
)
_COMMENT = r"""|(?P<comment>(?<![:\w/])//[^\n]*|/\*[^\n]*?(?:\*/|$)|<!--[^\n]*?(?:-->|$)|(?<!\S)(?:\#|--[ \t])[^\n]*)"""
_TOKEN, _INNER = re.compile(_INSIDE + _COMMENT, re.S | re.M), re.compile(_INSIDE, re.S)
#: What opens a literal or a comment, however often.
_OPENS = re.compile(r"(?:[bruf]{0,2}[\"'`]+)?(?:\s*(?://+|/\*+|<!--|\#+|--))*")
_ABOUT = re.compile(r"(?i)^(?:label|max|min|num|no|has|is|show|use|enable|disable|require|hint|placeholder|title|public|pub|build|make|get|find|load|read|write|apply|check|render|resolve|update|collect|merge|route|split|trim)(?:[_.-]|(?=[A-Z]))")
#: The credential word must be a word of the identifier: ``token`` in ``authToken`` and ``auth_token``, not in ``betoken``.
_ENDS = re.compile(r"(?:^|[^A-Za-z])(?i:" + _CREDENTIAL + r")$|[a-z0-9](?-i:Passw(?:or)?d|Passphrase|Pass|Pwd|Secret|Token|Credentials?|Key|PASSWORD|SECRET|TOKEN|KEY)$|(?i:^|[^A-Za-z])(?i:api|access|auth|db|client|my|user|smtp|root|admin)(?i:" + _CREDENTIAL + r")$")
_SEPARATOR = re.compile(
    r"""(?:\\?["'`\])}]){0,3}(?:\s*:\s*&?(?:'static\s+)?(?:[A-Za-z_][\w<>.\[\]]*)(?=\s*=[^=]))?(?P<sep>\s*(?::=|=>|===?|=|:)\s*|\s*\(\s*|\s*,\s*|>\s*|\s+value\s*=\s*|[ \t]+is[ \t]+|[ \t]+)"""
)
_LITERAL = re.compile(
    r"""(?:[bru]{0,2}(?P<q>"(?!"")|'(?!'')|`)(?P<s>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q))""", re.S
)
_TRIPLE = re.compile(r'(?P<q>"""|\'\'\')(?P<s>.*?)(?P=q)', re.S)
#: A literal inside a literal: its quotes are escaped.
_ESCAPED = re.compile(r"""\\(?P<q>["'])(?P<s>[^"'\\\n]+)\\(?P=q)""")
_JOIN = re.compile(r"""[ \t]+(?=["'])|\s*(?:\+|\.\.?|&|\\)?\s*(?:\\\s*\n\s*|\n\s*)?(?=["'`])""")
_BLOCK = re.compile(r"[ \t]*(?:[|>][+-]?[ \t]*\r?\n[ \t]+|\r?\n[ \t]+(?=\S+[ \t]*(?:\r?\n|$)))")
_BLOCK_VALUE = re.compile(r"[^\s\"']+")
_LISTED = re.compile(r"""["']?[ \t]*\r?\n[ \t]+(?:value|default):[ \t]*""")
_BARE_TAG, _BARE_TEXT = re.compile(r"[^\s<]+"), re.compile(r"[^\s\"'`<>]+")
#: Where the next field of a list of assignments (a connection string, a query) begins.
_NEXT_FIELD = re.compile(r"[;&,](?=[A-Za-z][\w.-]*=)")
_CODE = re.compile(r"^[A-Za-z_][\w.]*[(\[]|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$|^[a-zA-Z_]+\d{0,2}$|^[A-Za-z_]\w*(?:->|::)")
_SCHEME = re.compile(r"(?:Bearer|Basic|Token|ApiKey)\s+", re.I)
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://(?P<user>[^\s/:@\"'`<>]*):(?P<pw>[^\s/\"'`<>@]+(?:@[^\s/\"'`<>@:]+(?=@))?)@(?=[\w$\[{-])", re.I)
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
_OPTION = re.compile(r"(?<![\w-])(?:-u|--user)[ =]+(?P<q>[\"']?)[\w.@-]+:(?P<pw>[^\s\"'`]+)(?P=q)|(?<![\w-])--(?:[\w-]*)" + _CREDENTIAL + r"[ =]+(?P<q2>[\"']?)(?P<pw2>[^\s\"'`]+)(?P=q2)", re.I)
_AUTH = re.compile(r"(?<![A-Za-z])(?:Bearer|Basic)\s+(?P<pw>[A-Za-z0-9][^\s\"'`<>\\]{9,})")
# Prose and statements that pass a value on: "log in as `x` with `value`", IDENTIFIED BY 'value'.
_PASSED = re.compile(r"(?i:\blog ?in (?:as|with) [\"'`]?[\w.@-]+[\"'`]? (?:with|and|using) |\bidentified by |\bwith password )(?P<q>[\"'`])(?P<pw>[^\s\"'`]+)(?P=q)")
#: A random literal spread over several: as such a sign of a secret, whatever its name.
_SPREAD = re.compile(r"""(?P<q>["'])(?P<a>[A-Za-z0-9+/=_.-]{8,})(?P=q)\s*\+\s*(?:\\?\n\s*)?(?P=q)(?P<b>[A-Za-z0-9+/=_.-]{6,})(?P=q)""")
# Published formats of tokens, and the general shape of a prefixed token.
_KNOWN = re.compile(r"(?<![\w./+-])(?:eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{16,}|AKIA[0-9A-Z]{16}|gh[pousr]_\w{30,}|glpat-[\w-]{20}|xox[abps]-[\w-]{20,}|[a-z]{2,6}_(?:sk|pk|pat|live|test|key|tok)_[A-Za-z0-9]{16,})(?![\w/+=-])")
_LONG = re.compile(r"[A-Za-z0-9]{16}")
_SHAPED = re.compile(r"(?<![\w./+-])(?P<p>[A-Za-z][A-Za-z0-9]{1,4}[.:_-](?:[a-z]{2,6}_)?|[A-Z]{3})[A-Za-z0-9]{16,64}(?![\w/+=-])")
_PREFIX = re.compile(r"[A-Za-z][A-Za-z0-9]{1,4}[.:_-](?:[a-z]{2,6}_)?|[A-Z]{3}(?=[A-Za-z0-9]{16,}$)")
_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "basic ")
_REFERENCE = re.compile(r"\$\{|\{\{|%\(|<[\w -]+>|\$\(|^\$\w|^%\w+%$|^@@|^\*+$|process\.env|os\.environ|getenv|vault[.:/]|^env[.:]|^arn:|^ref\+", re.I)
_WORDLIKE = re.compile(r"[a-z]+(?:[-_ ][a-z]+)*|[A-Z]+(?:[_-][A-Z]+)*|[A-Z][a-z]+")


def is_placeholder(value: str, quoted: bool, password: bool = False) -> bool:
    """Whether a value (bare, or the content of a literal) stands for a secret without being one; ``password``: of a name that means one."""
    v = value.strip()
    low = v.lower()
    if not v or low in _PLACEHOLDERS or _REFERENCE.search(v) or re.match(r"(?i)(?:your|my|the|insert|enter|put|some|any|example|replace|change|fake|sample)[-_ ]", v):
        return True
    if v.startswith(("-----BEGIN", "/srv/", "data:")) or re.search(r"(?i)://[^/]*@", v):
        return True
    if quoted and re.search(r"\s", v):
        # Words with blanks between are a sentence unless letters and other marks are mixed in one of them.
        lines = v.split("\n")
        spread = len(lines) > 1 and all(re.fullmatch(r"\S{6,}", l.strip()) for l in lines) and bool(re.search(r"\d", v))
        return not spread and not (password and len(v.split()) <= 4 and re.search(r"[A-Za-z][\d@#$%^&*+=~][^\s.,]", v))
    if re.search(r"\s", v) or len(set(low)) <= 2:
        return True
    if _WORDLIKE.fullmatch(v):
        # A word is a password only where the name says so, and names no credential or placeholder itself.
        parts = re.split(r"[-_ ]", low)
        return not (quoted and password and len(v) >= 4 and not _PLACEHOLDERS.intersection(parts) and not re.search(_CREDENTIAL, low) and v == low)
    if len(v) < (4 if quoted and password else 6):
        return True
    if re.fullmatch(r"[\d.,:eE+-]+|[/.~][\w./-]*|[a-z]+://\S*|\d+\w{0,2}", v) and len(v) < 24:
        return True
    return not quoted and not re.search(r"\d", v) and not re.search(r"[^\w.-]", v)


def credential_names(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the identifiers that name a credential, in code, comments and literals."""
    regions = [(0, len(text), _TOKEN)]
    while regions:
        start, end, token = regions.pop()
        for m in token.finditer(text, start, end):
            if m.lastgroup == "name":
                if _NAME.search(m.group()) and _ENDS.search(m.group()) and not _ABOUT.match(re.split(r"[.$]", m.group())[-1]):
                    yield m.span()
            elif _NAME.search(text, *m.span()):
                # No comment begins in a comment, and no literal in one of its own quotes: few levels, each read once.
                inner = m.start() + len(_OPENS.match(m.group()).group())
                regions.append((max(inner, m.start() + 1), m.end() - (m.lastgroup == "literal"), _INNER if m.lastgroup == "comment" or token is _INNER else _TOKEN))


def _literals(text: str, at: int) -> list[tuple[int, int]]:
    """The contents of the literal at this position and of those joined to it."""
    inside = _ESCAPED.match(text, at)
    if inside:
        return [inside.span("s")]
    m = _TRIPLE.match(text, at) or _LITERAL.match(text, at)
    out = []
    while m:
        out.append(m.span("s"))
        j = _JOIN.match(text, m.end())
        m = j and j.end() > m.end() and _LITERAL.match(text, j.end()) or None
    return out


def named_values(text: str) -> list[tuple[int, int]]:
    """Spans of the values assigned or passed to credential names."""
    found: list[tuple[int, int]] = []
    for start, stop in credential_names(text) if _NAME.search(text) else ():
        listed = _LISTED.match(text, stop)
        s = listed or _SEPARATOR.match(text, stop)
        if not s:
            continue
        password = bool(_PASSWORD.search(text[start:stop]))
        before = text[start - 1 : start] if start else ""
        sep, at = "=" if listed else s["sep"], s.end()
        mark = sep.strip()
        lead = text[text.rfind("\n", 0, start) + 1 : start]
        comment = bool(re.match(r"\s*(?:#|//|--|;|\*|/\*|<!--)", lead))
        if mark == "" and sep:
            # A name and a value with only a blank between: in comments and options.
            if not (comment or re.match(r"[\"'`]", text[at : at + 1]) or re.search(r"#define\s+$", lead)):
                continue
        # Block and list forms of YAML.
        block = _BLOCK.match(text, text.index(":", stop) + 1) if mark == ":" else None
        if block:
            b = _BLOCK_VALUE.match(text, block.end())
            if b and not re.search(r"[:{}]$", b.group()) and not is_placeholder(b.group(), True) and re.search(r"\d", b.group()):
                found.append(b.span())
            continue
        if "\n" in sep and mark != "(":
            continue
        spans = _literals(text, at)
        if spans:
            joined = "".join(text[a:b] for a, b in spans)
            sch = _SCHEME.match(text, spans[0][0])
            if sch and sch.end() < spans[0][1]:
                spans[0] = (sch.end(), spans[0][1])
                joined = "".join(text[a:b] for a, b in spans)
            if mark == "," and before not in "\"'`":
                continue
            if not is_placeholder(joined, True, password):
                found += [x for x in spans if x[1] > x[0]]
            continue
        if mark in ("(", ","):
            continue
        sch = _SCHEME.match(text, at)
        at = sch.end() if sch else at
        b = (_BARE_TAG if mark.endswith(">") else _BARE_TEXT).match(text, at)
        if not b:
            continue
        a, e = b.span()
        rest = text[e : e + 1]
        v = _NEXT_FIELD.split(text[a:e], maxsplit=1)[0]
        v = v.rstrip(",;") if not comment else v.rstrip(",;.)")
        e = a + len(v)
        if re.search(r"[(\[{]", v) and not re.search(r"\d", v) or rest in ("(",) or is_placeholder(v, False):
            continue
        if _CODE.search(v):
            continue
        if mark in ("", "is") and (len(v) < 12 or not re.search(r"\d", v) or not re.search(r"[A-Za-z]", v)):
            continue
        found.append((a, e))
    return found


def scan(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, prefix) of the secrets of a text and of those candidates that only a mined format proves."""
    found: list[tuple[int, int, str, str]] = []
    keys = []
    if "PRIVATE KEY" in text:
        for m in _KEY_BLOCK.finditer(text):
            end = m.end()
            if not m.group().endswith("-----") or m.group().count("-----") < 4:
                body = re.compile(r"-----BEGIN [A-Z0-9 ]+-----(?:(?:\\r|\\n|\s)+[A-Za-z0-9+/=]{16,})*").match(text, m.start())
                end = body.end() if body else m.end()
            found.append((m.start(), end, "key", ""))
            keys.append((m.start(), end))
    low = text.lower()
    if "://" in low or "-u" in low or "log in" in low or "login" in low or "identified by" in low or any(w in low for w in _HINTS):
        for m in _URL.finditer(text):
            if not is_placeholder(m["pw"], True) or re.search(r"\d", m["pw"]) and not _REFERENCE.search(m["pw"]):
                found.append((*m.span("pw"), "url", ""))
        for m in _OPTION.finditer(text):
            g = "pw" if m["pw"] else "pw2"
            if not is_placeholder(m[g], True) and re.search(r"\d", m[g]):
                found.append((*m.span(g), "named", ""))
        for m in _AUTH.finditer(text):
            if re.search(r"\d", m["pw"]) and not is_placeholder(m["pw"], True):
                found.append((*m.span("pw"), "named", ""))
        for m in _PASSED.finditer(text):
            if not is_placeholder(m["pw"], True) and re.search(r"\d", m["pw"]):
                found.append((*m.span("pw"), "named", ""))
        for a, b in named_values(text):
            found.append((a, b, "named", ""))
    for m in _SPREAD.finditer(text) if "+" in text else ():
        whole = m["a"] + m["b"]
        if re.search(r"\d", whole) and re.search(r"[a-z]", whole) and re.search(r"[A-Z]", whole) and not re.search(r"[a-z]{6}|[A-Z]{6}", whole):
            found += [(*m.span("a"), "spread", ""), (*m.span("b"), "spread", "")]
    for m in _KNOWN.finditer(text) if _LONG.search(text) else ():
        found.append((*m.span(), "known", ""))
    for m in _SHAPED.finditer(text) if _LONG.search(text) else ():
        if re.search(r"\d", m.group()) and re.search(r"[a-zA-Z]", m.group()[len(m["p"]) :]):
            found.append((*m.span(), "shaped", m["p"]))
    if not found:
        return found
    out: list[tuple[int, int, str, str]] = []
    rank = {"key": 0, "url": 1, "named": 2, "known": 3, "spread": 4, "shaped": 5}
    for a, b, kind, p in sorted(found, key=lambda x: (rank[x[2]], x[0] - x[1], x[0])):
        if all(b <= x or a >= y for x, y, _, _ in out):
            if kind in ("named", "known"):
                p = (_PREFIX.match(text[a:b]) or [""])[0]
            out.append((a, b, kind, p))
    return sorted(out)


_SPANS = "vec_id long, start_pos int, end_pos int, kind string, prefix string, shaped boolean, value_hash long"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(v, a, b, kind, p, bool(_SHAPED.fullmatch(t, a, b)), xxhash.xxh64_intdigest(t[a:b].encode("utf-8", "surrogatepass")) >> 1) for v, t in zip(pdf["vec_id"], pdf["chunk_text"]) for a, b, kind, p in scan(t)]
        yield pd.DataFrame(rows, columns=["vec_id", "start_pos", "end_pos", "kind", "prefix", "shaped", "value_hash"])


def _candidates(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("chunk_text").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "chunk_text").mapInPandas(_scan, _SPANS)


def mined_formats(candidates: DataFrame) -> DataFrame:
    """``prefix``: what several different named secrets start with, and not many more other values."""
    values = candidates.where("prefix != '' and (kind = 'shaped' or kind = 'named' and shaped)").groupBy("prefix", "value_hash").agg(F.max(F.col("kind") == "named").alias("named"))
    per_prefix = values.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.count_if("named").alias("named"))
    return per_prefix.where((F.col("named") >= FORMAT_VALUES) & (F.col("named") >= FORMAT_SHARE * F.col("n"))).select("prefix")


def find_secrets(chunks: DataFrame) -> DataFrame:
    """``vec_id, start_pos, end_pos, kind``: every secret value of ``chunk_text``."""
    spans = cut(_candidates(chunks))
    formats = cut(mined_formats(spans))
    formats = F.broadcast(formats) if formats.count() <= SENT_FORMATS else formats
    proven = spans.where("kind != 'shaped'").select("vec_id", "start_pos", "end_pos", "kind")
    shaped = spans.where("kind = 'shaped'").join(formats, "prefix", "left_semi").select("vec_id", "start_pos", "end_pos", "kind")
    return proven.unionByName(shaped)


def redact(chunks: DataFrame, mask: str = "REDACTED") -> DataFrame:
    """``vec_id, n_secrets, redacted_text``: the texts with only the secret values replaced; delimiters stay."""
    spans = find_secrets(chunks).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("spans"))
    joined = chunks.where(F.col("chunk_text").isNotNull()).select("vec_id", "chunk_text").join(spans, "vec_id")
    # Text between the secrets, then the mask between its parts: built-in functions on code points.
    n = F.size("spans")
    starts = F.transform("spans", lambda s: s["start_pos"])
    ends = F.transform("spans", lambda s: s["end_pos"])
    begin = F.concat(F.array(F.lit(0)), ends)
    stop = F.concat(starts, F.array(F.length("chunk_text")))
    kept = F.transform(F.arrays_zip(begin.alias("a"), stop.alias("b")), lambda p: F.substring("chunk_text", p["a"] + 1, p["b"] - p["a"]))
    return joined.select("vec_id", n.cast("long").alias("n_secrets"), F.array_join(kept, mask).alias("redacted_text"))
