"""Queries that cut texts into chunks and read relationships out of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions.arrays import as_text
from textquarry.functions.text import newlines
from textquarry.operators import chunking
from textquarry.operators import relationships as rel
from textquarry.operators.recursive_split import recursive_split
from textquarry.plans import sql as q
from textquarry.runtime import table
from textquarry.sources.files import coerce_source_type


def _documents(s, d):
    return table(s, d, "documents").select("doc_id", newlines(F.col("text")).alias("text"))


def _code(s, d):
    return table(s, d, "chunks").where("source_type = 'code'").select("vec_id", newlines(F.col("chunk_text")).alias("text"))


def _chunks(s, d):
    return table(s, d, "chunks").where("chunk_text is not null").withColumn("ext", F.lower(F.regexp_replace("file_extension", r"^\.", "")))


def _found(s, d, name, column):
    return _chunks(s, d).select("vec_id", as_text(column).alias(name)).where(F.col(name) != "")


def _family(s, d, family, where):
    return _chunks(s, d).where(where).select("vec_id", family(F.col("chunk_text")).alias("r")).select("vec_id", as_text(F.col("r.refs")).alias("refs"), as_text(F.col("r.symbols")).alias("symbols"), as_text(F.col("r.tags")).alias("tags"))


def _ordered(c):
    return F.array_distinct(c)


def _all_relationships(s, d):
    c = _chunks(s, d)
    kind = coerce_source_type(F.col("source_type"))
    r = rel.relationships(F.col("chunk_text"), chunking.chunker_of(kind, F.col("ext")), F.col("ext"), F.col("parent_section"))
    sizes = c.withColumn("r", r).select(kind.alias("source_type"), F.size("r.refs").alias("refs"), F.size("r.symbols").alias("symbols"), F.size("r.tags").alias("tags"))
    return sizes.groupBy("source_type").agg(F.sum("refs").alias("refs"), F.sum("symbols").alias("symbols"), F.sum("tags").alias("tags"))


def _section_chunks(s, d):
    out = chunking.header_sections(_documents(s, d), "text", ["doc_id"])
    return out.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk_text").alias("text_md5"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), "parent_section")


def _windows(s, d):
    out = chunking.token_windows(_documents(s, d), "text", ["doc_id"], 128, 32)
    return out.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk_text").alias("text_md5"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


def _parts(s, d):
    out = chunking.code_parts(_code(s, d), "text", ["vec_id"])
    return out.select("vec_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk_text").alias("text_md5"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


def _code_chunks(s, d):
    out = chunking.code_chunks(_code(s, d), "text", ["vec_id"], 128, 32)
    return out.select("vec_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk_text").alias("text_md5"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


def _script(c):
    return F.when(F.col("ext").isin("ts", "tsx"), rel.javascript(c, True)).otherwise(rel.javascript(c))


PYTHON, JAVA, SCRIPT = "ext = 'py'", "ext = 'java'", "ext in ('ts', 'tsx', 'js', 'jsx')"
GENERIC = "ext in ('cpp', 'c', 'cs', 'go', 'rs', 'swift', 'kt', 'scala', 'rb', 'php')"

QUERIES = {
    "token_window_chunks": _windows,
    "header_sections": _section_chunks,
    "code_boundary_chunks": _parts,
    "code_chunks": _code_chunks,
    "recursive_split": lambda s, d: recursive_split(_documents(s, d), "text", "doc_id", 256, 50),
    "recursive_split_code": lambda s, d: recursive_split(_chunks(s, d).where("source_type = 'code'"), "chunk_text", "vec_id", 64, 10, "ext"),
    "chunker_dispatch": lambda s, d: _chunks(s, d).groupBy(chunking.chunker_of(coerce_source_type(F.col("source_type")), F.col("ext")).alias("chunker")).agg(F.count(F.lit(1)).alias("chunks")),
    "capitalized_refs": lambda s, d: _found(s, d, "refs", _ordered(rel.capitalized(F.col("chunk_text")))),
    "import_refs": lambda s, d: _found(s, d, "refs", rel.imports_of(F.col("chunk_text"))),
    "code_symbols": lambda s, d: _family(s, d, rel.code, "source_type = 'code'"),
    "python_relationships": lambda s, d: _family(s, d, rel.python, PYTHON),
    "java_relationships": lambda s, d: _family(s, d, rel.java, JAVA),
    "script_relationships": lambda s, d: _family(s, d, _script, SCRIPT),
    "generic_relationships": lambda s, d: _family(s, d, rel.generic, GENERIC),
    "md_links": lambda s, d: _found(s, d, "refs", _ordered(rel.links(F.col("chunk_text")))),
    "citations": lambda s, d: _found(s, d, "refs", _ordered(rel.citations(F.col("chunk_text")))),
    "emphasis_terms": lambda s, d: _found(s, d, "refs", _ordered(rel.emphasis(F.col("chunk_text")))),
    "section_tags": lambda s, d: _chunks(s, d).where(F.coalesce("parent_section", F.lit("")) != "").select("vec_id", F.lower("parent_section").alias("tag")),
    "relationship_counts": _all_relationships,
}

_C = "SELECT *, lower(regexp_replace(file_extension, '^\\.', '')) AS ext FROM chunks WHERE chunk_text IS NOT NULL"
N, D, J = rel.NAME, rel.DOTTED, rel.JS_NAME


def _sql_found(expression: str, name: str = "refs") -> str:
    return f"WITH c AS (SELECT vec_id, {expression} AS a FROM ({_C})) SELECT vec_id, {q.as_text(q.ordered_set('a'))} AS {name} FROM c WHERE len(a) > 0 AND {q.as_text('a')} <> ''"


def _sql_concat(*lists: str) -> str:
    return lists[0] if len(lists) == 1 else f"list_concat({lists[0]}, {_sql_concat(*lists[1:])})"


def _sql_family(where: str, refs: str, symbols: str, tags: list[tuple[str, str]]) -> str:
    t = _sql_concat(*[f"CASE WHEN len({c}) > 0 THEN ['{n}'] ELSE []::VARCHAR[] END" for c, n in tags]) if tags else "[]::VARCHAR[]"
    return f"WITH c AS (SELECT vec_id, {refs} AS r, {symbols} AS s, {t} AS t FROM ({_C}) WHERE {where}) SELECT vec_id, {q.as_text(q.ordered_set('r'))} AS refs, {q.as_text(q.ordered_set('s'))} AS symbols, {q.as_text('t')} AS tags FROM c"


def _all(pattern: str, group: int = 1) -> str:
    return q.find_all("chunk_text", pattern, group)


_S = q.WS
_IMPORTS = _sql_concat(*[_all(p) for p in (rf"import\s+({D})", rf"from\s+({D})\s+import", r'#include\s*[<"]([^>"]+)[">]', r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")])
_CAPITAL = "list_filter(list_slice(list_filter(regexp_split_to_array(chunk_text, '[^\\p{L}\\p{N}\\p{M}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z]+')), 1, 10), lambda x: length(x) > 2)"

_F, _K = _all(rf"(?:def|function){_S}+({N}){_S}*\("), _all(rf"class{_S}+({N})")
_VAR = f"list_slice({_all(rf'(?m)^(?:var|let|const){_S}+({N})')}, 1, 5)"
_PF, _PC, _PI, _PD = _all(rf"(?:async\s+def|def)\s+({N})\s*\("), _all(rf"class\s+({N})"), _sql_concat(_all(rf"import\s+({D})"), _all(rf"from\s+({D})\s+import")), _all(rf"@({D})")
_JM = f"list_filter({_all(rf'({N})\s*\(')}, lambda x: x NOT IN ('if', 'for', 'while', 'switch', 'catch'))"
_JI, _JN, _JA = _all(rf"interface\s+({N})"), _all(rf"import\s+(?:static\s+)?({D})"), _all(rf"@({D})")
_TF = _sql_concat(*[_all(p) for p in (rf"(?:async\s+)?function\s+({J})\s*\(", rf"(?:const|let|var)\s+({J})\s*=\s*(?:async\s+)?(?:function|\()", rf"({J})\s*:\s*(?:async\s+)?(?:function|\()", rf"({J})\s*\(.*?\)\s*=>")])
_TC, _TI, _TT = _all(rf"class\s+({J})"), *(f"CASE WHEN ext IN ('ts', 'tsx') THEN {_all(p)} ELSE []::VARCHAR[] END" for p in (rf"interface\s+({J})", rf"type\s+({J})\s*="))
_TN = _sql_concat(*[_all(p) for p in (r"import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")])
_GF, _GC = _sql_concat(*[_all(rf"{w}\s+({N})") for w in ("def", "function", "fn")]), _sql_concat(*[_all(rf"{w}\s+({N})") for w in ("class", "struct")])
_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
_EMPHASIS = _sql_concat(*[_all(p) for p in (r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`")])
_KIND = "CASE WHEN source_type IN ('code', 'document') THEN source_type ELSE 'document' END"
_PARTS = f"""a AS (SELECT vec_id, string_split({q.newlines("chunk_text")}, chr(10)) AS ls FROM chunks WHERE source_type = 'code' AND chunk_text IS NOT NULL AND {q.strip("chunk_text")} <> ''),
        b AS (SELECT vec_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM a),
        l AS (SELECT *, regexp_matches({q.strip("line")}, '^(?:def|class|function|const|var|let) ') OR (regexp_matches({q.strip("line")}, '^(?:public|private|protected) ') AND regexp_matches(line, 'function|class|def')) AS cut FROM b),
        f AS (SELECT vec_id, 1::BIGINT AS n, 1 AS have, 0 AS part FROM l WHERE n = 1
              UNION ALL SELECT l.vec_id, l.n, CASE WHEN l.cut AND f.have > 5 THEN 1 ELSE f.have + 1 END, CASE WHEN l.cut AND f.have > 5 THEN f.part + 1 ELSE f.part END FROM f JOIN l ON l.vec_id = f.vec_id AND l.n = f.n + 1),
        p AS (SELECT f.vec_id, f.part, string_agg(l.line, chr(10) ORDER BY l.n) AS t FROM f JOIN l USING (vec_id, n) GROUP BY 1, 2),
        o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY vec_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM p)"""


def _sizes(where: str, refs: str, symbols: str = "[]::VARCHAR[]", tags: str = "0") -> str:
    distinct = "len(list_distinct({}))"
    return f"SELECT {_KIND} AS source_type, {distinct.format(refs)} AS r, {distinct.format(symbols)} AS s, {tags} AS t FROM ({_C}) WHERE {where}"


def _tags(*lists: str) -> str:
    return " + ".join(f"(len({c}) > 0)::INT" for c in lists)


_LANGUAGE = f"{_KIND} = 'code' AND "
_LINKED = f"flatten(list_transform(list_zip({_all(_LINK, 1)}, {_all(_LINK, 2)}), lambda p: CASE WHEN regexp_matches(p[2], '^https?://') THEN [p[1]] ELSE [p[1], p[2]] END))"
_CITED = _sql_concat(*[_all(p) for p in (r"\[(\d+)\]", r"\(([A-Za-z]+\s+\d{4})\)", r"@([a-zA-Z][a-zA-Z0-9_]*)")])
_TERMS = f"list_filter(list_transform({_EMPHASIS}, lambda x: {q.strip('x')}), lambda x: length(x) > 2 AND length(x) < 50)"
_KNOWN = "ext IN ('py','js','ts','jsx','tsx','java','cpp','c','cs','go','rs','swift','kt','scala','rb','php')"
_COUNTED = " UNION ALL ".join(
    [
        _sizes(_LANGUAGE + PYTHON, _sql_concat(_PF, _PC, _PI, _PD), _sql_concat(_PF, _PC), _tags(_PI, _PD)),
        _sizes(_LANGUAGE + JAVA, _sql_concat(_JM, _PC, _JI, _JN, _JA), _sql_concat(_JM, _PC, _JI), _tags(_PC, _JI, _JN, _JA)),
        _sizes(_LANGUAGE + SCRIPT, _sql_concat(_TF, _TC, _TN, _TI, _TT), _sql_concat(_TF, _TC, _TI, _TT), _tags(_TN, _TI, _TT)),
        _sizes(_LANGUAGE + GENERIC, _sql_concat(_GF, _GC), _sql_concat(_GF, _GC)),
        _sizes(_LANGUAGE + f"NOT coalesce({_KNOWN}, false)", _sql_concat(_F, _K, _IMPORTS), _sql_concat(_F, _K, _VAR), _tags(_IMPORTS)),
        _sizes(f"{_KIND} = 'document'", _sql_concat(_LINKED, _CITED, _TERMS, _CAPITAL), "[]::VARCHAR[]", _tags(_CITED) + " + (coalesce(parent_section, '') <> '' AND NOT (lower(parent_section) = 'citation' AND len(" + _CITED + ") > 0))::INT"),
    ]
)

SQL = {
    "relationship_counts": f"SELECT source_type, sum(r)::BIGINT AS refs, sum(s)::BIGINT AS symbols, sum(t)::BIGINT AS tags FROM ({_COUNTED}) GROUP BY 1",
    # 128 tokens are 98 words, 32 are 24: windows begin every 74 words.
    "token_window_chunks": f"""WITH w AS (SELECT doc_id, {q.words(q.newlines("text"))} AS w FROM documents WHERE text IS NOT NULL),
        k AS (SELECT doc_id, w, unnest(range(0, (greatest(ceil((len(w) - 98) / 74.0), 0) + 1)::BIGINT)) AS k FROM w WHERE len(w) > 0),
        p AS (SELECT doc_id, k AS chunk_no, array_to_string(w[k * 74 + 1 : k * 74 + 98], ' ') AS t, CASE WHEN k = 0 THEN 0 ELSE length(array_to_string(w[1 : k * 74], ' ')) + 1 END AS start_char FROM k)
        SELECT doc_id, chunk_no, md5(t) AS text_md5, start_char::BIGINT AS start_char, (start_char + length(t))::BIGINT AS end_char FROM p""",
    "header_sections": f"""WITH d AS (SELECT doc_id, {q.newlines("text")} AS text FROM documents WHERE text IS NOT NULL AND {q.strip("text")} <> ''),
        a AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM d),
        l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM a),
        h AS (SELECT *, {q.strip(f"regexp_extract({q.strip('line')}, '^#{{1,6}}{_S}+(.+)', 1)")} AS head FROM l),
        s AS (SELECT *, sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM h),
        g AS (SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY n) AS t, string_agg(line, ' ' ORDER BY n) AS j, min(place) AS start_char, arg_min(head, n) AS head FROM s GROUP BY doc_id, sec),
        f AS (SELECT *, sec = max(sec) OVER (PARTITION BY doc_id) AS lst FROM g),
        r AS (SELECT *, lst OR length({q.strip("j")}) > 50 AS keep FROM f),
        c AS (SELECT *, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS kept FROM r),
        o AS (SELECT doc_id, sec, t, start_char, start_char + length(t) AS end_char, nullif(head, '') AS parent_section FROM c WHERE keep AND kept > 1
              UNION ALL SELECT doc_id, 0, text, 0, length(text), NULL FROM d WHERE doc_id IN (SELECT doc_id FROM c WHERE kept <= 1))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS chunk_no, md5(t) AS text_md5, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char, parent_section FROM o""",
    "code_boundary_chunks": f"""WITH RECURSIVE {_PARTS} SELECT vec_id, part::BIGINT AS chunk_no, md5(t) AS text_md5, start_char::BIGINT AS start_char, (start_char + length(t))::BIGINT AS end_char FROM o""",
    # Parts of at most 128 tokens stay; others, and texts of one part, come in windows.
    "code_chunks": f"""WITH RECURSIVE {_PARTS}, w AS (SELECT *, {q.words("t")} AS w, count(*) OVER (PARTITION BY vec_id) AS parts FROM o),
        k AS (SELECT *, unnest(range(0, (greatest(ceil((len(w) - 98) / 74.0), 0) + 1)::BIGINT)) AS k FROM w WHERE len(w) > 0 AND (parts = 1 OR len(w) * 1.3 > 128)),
        c AS (SELECT vec_id, part, k, array_to_string(w[k * 74 + 1 : k * 74 + 98], ' ') AS t, start_char + CASE WHEN k = 0 THEN 0 ELSE length(array_to_string(w[1 : k * 74], ' ')) + 1 END AS start_char FROM k
              UNION ALL SELECT vec_id, part, 0, t, start_char FROM w WHERE NOT (parts = 1 OR len(w) * 1.3 > 128))
        SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY part, k) - 1 AS chunk_no, md5(t) AS text_md5, start_char::BIGINT AS start_char, (start_char + length(t))::BIGINT AS end_char FROM c""",
    "chunker_dispatch": f"SELECT CASE WHEN {_KIND} = 'code' AND ext IN ('py','js','ts','jsx','tsx','java','cpp','c','cs','go','rs','swift','kt','scala','rb','php') THEN 'language' WHEN {_KIND} = 'code' THEN 'code' ELSE 'document' END AS chunker, count(*) AS chunks FROM ({_C}) GROUP BY 1",
    "capitalized_refs": _sql_found(_CAPITAL),
    "import_refs": _sql_found(_IMPORTS),
    "code_symbols": _sql_family("source_type = 'code'", _sql_concat(_F, _K, _IMPORTS), _sql_concat(_F, _K, _VAR), [(_IMPORTS, "import")]),
    "python_relationships": _sql_family(PYTHON, _sql_concat(_PF, _PC, _PI, _PD), _sql_concat(_PF, _PC), [(_PI, "import"), (_PD, "decorator")]),
    "java_relationships": _sql_family(JAVA, _sql_concat(_JM, _PC, _JI, _JN, _JA), _sql_concat(_JM, _PC, _JI), [(_PC, "class"), (_JI, "interface"), (_JN, "import"), (_JA, "annotation")]),
    "script_relationships": _sql_family(SCRIPT, _sql_concat(_TF, _TC, _TN, _TI, _TT), _sql_concat(_TF, _TC, _TI, _TT), [(_TN, "import"), (_TI, "interface"), (_TT, "type")]),
    "generic_relationships": _sql_family(GENERIC, _sql_concat(_GF, _GC), _sql_concat(_GF, _GC), []),
    "md_links": _sql_found(_LINKED),
    "citations": _sql_found(_CITED),
    "emphasis_terms": _sql_found(_TERMS),
    "section_tags": "SELECT vec_id, lower(parent_section) AS tag FROM chunks WHERE chunk_text IS NOT NULL AND coalesce(parent_section, '') <> ''",
}
