"""Lightweight relationships of a chunk: references, code symbols and tags, as insertion-ordered sets.

Every extractor is a column expression over the text: all matches of its patterns, in the order of the patterns, each
value once. Null texts give empty arrays. A struct ``refs, symbols, tags`` is what each family returns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.arrays import empty, ordered_set
from textquarry.functions.text import strip

# The patterns below must find what the documented behaviour finds.
NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"
DOTTED = r"[a-zA-Z_][a-zA-Z0-9_.]*"
JS_NAME = r"[a-zA-Z_$][a-zA-Z0-9_$]*"


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of every match, in order; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), empty())


def _tag_if(found: Column, tag: str) -> Column:
    return F.when(F.size(found) > 0, F.array(F.lit(tag))).otherwise(empty())


def _family(refs: Column, symbols: Column | None = None, tags: Column | None = None) -> Column:
    none = empty()
    return F.struct(ordered_set(refs).alias("refs"), ordered_set(none if symbols is None else symbols).alias("symbols"), ordered_set(none if tags is None else tags).alias("tags"))


def capitalized(text: Column, most: int = 10) -> Column:
    """Capitalised words: of the first ``most``, those of more than two letters."""
    return F.filter(F.slice(find_all(text, r"(?U)\b([A-Z][a-zA-Z]+)\b"), 1, most), lambda w: F.length(w) > 2)


def code(text: Column) -> Column:
    """Functions, classes, imports and the first five variables of code of any language."""
    functions = find_all(text, rf"(?:def|function)(?U:\s)+({NAME})(?U:\s)*\(")
    classes = find_all(text, rf"class(?U:\s)+({NAME})")
    imports = imports_of(text)
    variables = F.slice(find_all(text, rf"(?m)^(?:var|let|const)(?U:\s)+({NAME})"), 1, 5)
    return _family(F.concat(functions, classes, imports), F.concat(functions, classes, variables), _tag_if(imports, "import"))


def imports_of(text: Column) -> Column:
    """Imported modules by the four general forms."""
    forms = [rf"import\s+({DOTTED})", rf"from\s+({DOTTED})\s+import", r'#include\s*[<"]([^>"]+)[">]', r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"]
    return ordered_set(*[find_all(text, p) for p in forms])


def python(text: Column) -> Column:
    functions = find_all(text, rf"(?:async\s+def|def)\s+({NAME})\s*\(")
    classes = find_all(text, rf"class\s+({NAME})")
    imports = F.concat(find_all(text, rf"import\s+({DOTTED})"), find_all(text, rf"from\s+({DOTTED})\s+import"))
    decorators = find_all(text, rf"@({DOTTED})")
    return _family(F.concat(functions, classes, imports, decorators), F.concat(functions, classes), F.concat(_tag_if(imports, "import"), _tag_if(decorators, "decorator")))


def java(text: Column) -> Column:
    # A called or defined name is what stands before a bracket; that needs no nested repetition.
    methods = F.filter(find_all(text, rf"({NAME})\s*\("), lambda m: ~m.isin("if", "for", "while", "switch", "catch"))
    classes, interfaces = find_all(text, rf"class\s+({NAME})"), find_all(text, rf"interface\s+({NAME})")
    imports = find_all(text, rf"import\s+(?:static\s+)?({DOTTED})")
    annotations = find_all(text, rf"@({DOTTED})")
    tags = F.concat(_tag_if(classes, "class"), _tag_if(interfaces, "interface"), _tag_if(imports, "import"), _tag_if(annotations, "annotation"))
    return _family(F.concat(methods, classes, interfaces, imports, annotations), F.concat(methods, classes, interfaces), tags)


def javascript(text: Column, typed: bool = False) -> Column:
    forms = [
        rf"(?:async\s+)?function\s+({JS_NAME})\s*\(",
        rf"(?:const|let|var)\s+({JS_NAME})\s*=\s*(?:async\s+)?(?:function|\()",
        rf"({JS_NAME})\s*:\s*(?:async\s+)?(?:function|\()",
        rf"({JS_NAME})\s*\(.*?\)\s*=>",
    ]
    functions = F.concat(*[find_all(text, p) for p in forms])
    classes = find_all(text, rf"class\s+({JS_NAME})")
    imports = F.concat(*[find_all(text, p) for p in (r"import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")])
    refs, symbols, tags = [functions, classes, imports], [functions, classes], [_tag_if(imports, "import")]
    if typed:
        interfaces, types = find_all(text, rf"interface\s+({JS_NAME})"), find_all(text, rf"type\s+({JS_NAME})\s*=")
        refs, symbols = [*refs, interfaces, types], [*symbols, interfaces, types]
        tags = [*tags, _tag_if(interfaces, "interface"), _tag_if(types, "type")]
    return _family(F.concat(*refs), F.concat(*symbols), F.concat(*tags))


def generic(text: Column) -> Column:
    functions = F.concat(*[find_all(text, rf"{w}\s+({NAME})") for w in ("def", "function", "fn")])
    classes = F.concat(*[find_all(text, rf"{w}\s+({NAME})") for w in ("class", "struct")])
    return _family(F.concat(functions, classes), F.concat(functions, classes))


def links(text: Column) -> Column:
    """Link texts, each followed by its target unless that is on the web."""
    form = r"\[([^\]]+)\]\(([^)]+)\)"
    pairs = F.arrays_zip(find_all(text, form, 1).alias("t"), find_all(text, form, 2).alias("u"))
    return F.flatten(F.transform(pairs, lambda p: F.when(p["u"].rlike("^https?://"), F.array(p["t"])).otherwise(F.array(p["t"], p["u"]))))


def citations(text: Column) -> Column:
    """[1], (Name 2020) and @name."""
    return F.concat(*[find_all(text, p) for p in (r"\[(\d+)\]", r"\(([A-Za-z]+\s+\d{4})\)", r"@([a-zA-Z][a-zA-Z0-9_]*)")])


def emphasis(text: Column) -> Column:
    """Bold, italic and code terms of 3 to 49 characters."""
    terms = F.transform(F.concat(*[find_all(text, p) for p in (r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`")]), strip)
    return F.filter(terms, lambda t: (F.length(t) > 2) & (F.length(t) < 50))


def document(text: Column, section: Column, most: int = 10) -> Column:
    """Links, citations, emphasised and capitalised words; the section and ``citation`` as tags."""
    cited = citations(text)
    tags = F.concat(_tag_if(cited, "citation"), F.when(F.coalesce(section, F.lit("")) != "", F.array(F.lower(section))).otherwise(empty()))
    return _family(F.concat(links(text), cited, emphasis(text), capitalized(text, most)), None, tags)


def relationships(text: Column, chunker: Column, extension: Column, section: Column, most: int = 10) -> Column:
    """The family that a chunk's chunker and language ask for."""
    e = F.lower(F.coalesce(extension, F.lit("")))
    language = F.when(e.isin("py", "python"), python(text)).when(e == "java", java(text)).when(e.isin("ts", "tsx"), javascript(text, True)).when(e.isin("js", "jsx"), javascript(text)).otherwise(generic(text))
    return F.when(chunker == "language", language).when(chunker == "code", code(text)).otherwise(document(text, section, most))
