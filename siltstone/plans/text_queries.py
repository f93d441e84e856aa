"""Queries over texts, paths, blocks and snippets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import stats
from ..operators import text as X
from . import views as V
from .common import Registry, d6, r6, scratch

R = Registry()

_LINES = "ln AS (SELECT doc_id, path, lang, source, unnest(range(1, len(a)+1)) AS n, unnest(a) AS line FROM (SELECT *, string_split(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS a FROM doc))"


#: Columns that are INT here and BIGINT in DuckDB.
_WHOLE = {
    "txt_lines": ("n",),
    "txt_grep_ci": ("n",),
    "txt_grep_pattern": ("n", "start", '"end"'),
    "txt_grep_multi": ("start", '"end"'),
    "txt_code_anchor": ("anchor",),
    "txt_imports": ("n",),
    "flt_forbidden_line": ("n",),
    "flt_comment_line": ("n",),
    "flt_code_line": ("n",),
    "ctx_sanitize": ("start", '"end"'),
}


def _lines(s, d):
    return X.lines(V.doc(s, d), ["doc_id", "path", "lang", "source"])


def _doc(name: str, sql: str, doubles: list[str], make):
    text = V.with_views(sql, "doc")
    R.add(name, d6(text, *doubles) if doubles else text)(lambda s, d: r6(make(V.doc(s, d))))


def _line(name: str, sql: str, doubles: list[str], make):
    text = V.with_views(f"WITH {_LINES} {sql}", "doc")
    whole = [c for c in ("n", "start", '"end"', "anchor") if c in _WHOLE.get(name, ())]
    if whole:
        text = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INT) AS {c}' for c in whole)}) FROM ({text})"
    R.add(name, d6(text, *doubles) if doubles else text)(lambda s, d: r6(make(_lines(s, d))))


_line("txt_lines", "SELECT doc_id, n, length(line) AS chars FROM ln", [], lambda x: x.select("doc_id", "n", F.char_length("line").cast("long").alias("chars")))
_doc("txt_newlines", "SELECT doc_id, replace(replace(concat(text, chr(13), chr(10), 'x', chr(13), 'y'), chr(13)||chr(10), chr(10)), chr(13), chr(10)) AS t FROM doc", [], lambda x: x.select("doc_id", X.newlines(F.concat("text", F.lit("\r\nx\ry"))).alias("t")))
_doc(
    "txt_head_tail",
    "SELECT doc_id, array_to_string(a[1:3], chr(10)) AS head, array_to_string(a[greatest(1, len(a)-1):], chr(10)) AS tail FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM doc)",
    [],
    lambda x: x.select("doc_id", X.head_lines(F.col("text"), 3).alias("head"), X.tail_lines(F.col("text"), 2).alias("tail")),
)
_doc("txt_window", "SELECT doc_id, array_to_string(a[2:5], chr(10)) AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM doc)", [], lambda x: x.select("doc_id", X.line_window(F.col("text"), F.lit(2), F.lit(9), 4).alias("w")))
_line("txt_grep_ci", "SELECT path, n, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM ln WHERE contains(lower(line), 'stupid')", [], lambda x: X.grep(x, "Stupid").select("path", "n", "line"))
_GREP = "SELECT path, n, greatest(1, n-2) AS start, least(total, n+2) AS \"end\", substring(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 160) AS preview FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS total FROM ln) WHERE regexp_matches(line, '[0-9]{3}-[0-9]{4}')"


def _grep_pattern(x):
    from pyspark.sql import Window

    rows = x.withColumn("total", F.max("n").over(Window.partitionBy("doc_id")))
    return X.grep_pattern(rows, "[0-9]{3}-[0-9]{4}", F.col("total")).select("path", "n", "start", "end", "preview")


_line("txt_grep_pattern", _GREP, [], _grep_pattern)
_MANY = """, p AS (SELECT unnest(['license', 'idiot', '@mail']) AS pattern) SELECT path, greatest(1, n-2) AS start, n+2 AS "end", array_to_string(list_sort(list(DISTINCT pattern)), '|') AS patterns
 FROM (SELECT path, n, pattern, row_number() OVER (PARTITION BY pattern ORDER BY path, n) AS k FROM ln JOIN p ON contains(lower(line), pattern)) WHERE k <= 40 GROUP BY path, greatest(1, n-2), n+2"""
_line("txt_grep_multi", _MANY, [], lambda x: X.grep_many(x, ["license", "idiot", " @mail", "idiot"], ["path"], 40).withColumn("patterns", F.array_join("patterns", "|")))
_line("txt_code_anchor", "SELECT path, coalesce(arg_min(n, abs(n-3)*100000+n) FILTER (regexp_matches(line, '^\\s*(this|This)\\s+[A-Za-z_]\\w*')), least(max(n), 3)) AS anchor FROM ln GROUP BY path", [], lambda x: X.code_anchor(x.withColumn("line", F.regexp_replace("line", r"^(\s*)(?:this|This)\s", "$1def ")), ["path"], F.lit(3)))
_line(
    "txt_imports",
    "SELECT doc_id, module, min(n) AS n FROM (SELECT doc_id, n, regexp_extract(replace(line, 'licensed under', 'import gpl'), '^.*import\\s+([\\w.]+)', 1) AS module FROM ln WHERE contains(line, 'licensed under')) WHERE module <> '' GROUP BY ALL",
    [],
    lambda x: X.imported_modules(x.where(F.col("line").contains("licensed under")).withColumn("line", F.regexp_replace(F.replace("line", F.lit("licensed under"), F.lit("import gpl")), r"^.*import", "import")), ["doc_id"]),
)
_doc("txt_import_paths", "SELECT doc_id, unnest([concat(replace(concat(lang,'.',source),'.','/'),'.py'), concat(replace(concat(lang,'.',source),'.','/'),'/__init__.py')]) AS path FROM doc", [], lambda x: x.select("doc_id", F.explode(X.module_paths(F.concat_ws(".", "lang", "source"))).alias("path")))

# paths: documents as files, some of them with telling names
_PATHS = "pp AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat(source, '/license-', doc_id, '.txt') WHEN 1 THEN 'setup.py' WHEN 2 THEN concat('tests/', source, '/test_', doc_id, '.py') WHEN 3 THEN concat(lang, '/readme.md') WHEN 4 THEN concat('pkg/', lang, '/a/', doc_id, '.py') WHEN 5 THEN concat('docs/notice/', doc_id, '.rst') WHEN 6 THEN 'pyproject.toml' ELSE concat(lang, '/', source, '/x.bin') END AS path, concat('pkg/', lang, '/a/main.py') AS target FROM doc)"


def _paths(x):
    i, p = F.col("doc_id") % 8, lambda *a: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in a))
    c, s, g = F.col("doc_id").cast("string"), F.col("source"), F.col("lang")
    path = F.when(i == 0, p(s, "/license-", c, ".txt")).when(i == 1, "setup.py").when(i == 2, p("tests/", s, "/test_", c, ".py")).when(i == 3, p(g, "/readme.md")).when(i == 4, p("pkg/", g, "/a/", c, ".py"))
    path = path.when(i == 5, p("docs/notice/", c, ".rst")).when(i == 6, "pyproject.toml").otherwise(p(g, "/", s, "/x.bin"))
    return x.select("doc_id", path.alias("path"), p("pkg/", g, "/a/main.py").alias("target"))


def _path(name: str, sql: str, make):
    R.add(name, V.with_views(f"WITH {_PATHS} {sql}", "doc"))(lambda s, d: make(_paths(V.doc(s, d))))


_TOK = "license|licenses|licence|licences|copying|notice|copyright|readme|changelog|changes"
_NAME = "string_split(path, '/')[-1]"
_STEM = f"regexp_replace({_NAME}, '\\.[^.]*$', '')"
_PARENTS = "list_filter(string_split(path, '/')[:-2], lambda p: p <> '')"
_META = f"({_NAME} IN ('setup.py','setup.cfg','pyproject.toml','tox.ini') OR regexp_full_match({_STEM}, '{_TOK}') OR len(list_filter({_PARENTS}, lambda p: regexp_full_match(p, '{_TOK}'))) > 0)"
_TEST = f"(len(list_filter(string_split(path, '/'), lambda p: p IN ('test','tests','testing'))) > 0 OR starts_with({_NAME}, 'test_'))"
_path("flt_noise_path", f"SELECT doc_id FROM pp WHERE path <> target AND (regexp_matches(string_split({_NAME}, '.')[1], '^({_TOK})([-_].*)?$') OR len(list_filter({_PARENTS}, lambda p: regexp_full_match(p, '{_TOK}'))) > 0)", lambda x: x.where(X.is_noise_path(F.col("path"), F.col("target"))).select("doc_id"))
_path("flt_metadata_path", f"SELECT doc_id FROM pp WHERE {_META}", lambda x: x.where(X.is_metadata_path(F.col("path"))).select("doc_id"))
_path("flt_test_path", f"SELECT doc_id FROM pp WHERE {_TEST}", lambda x: x.where(X.is_test_path(F.col("path"))).select("doc_id"))
_SHARED = "CASE WHEN starts_with(path, string_split(target,'/')[1] || '/') THEN CASE WHEN starts_with(path, array_to_string(string_split(target,'/')[1:2],'/') || '/') THEN CASE WHEN starts_with(path, array_to_string(string_split(target,'/')[1:3],'/') || '/') THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END"
_path("flt_broad_test", f"SELECT doc_id FROM pp WHERE {_TEST} AND {_SHARED} < 2", lambda x: x.where(X.is_broad_test(F.col("path"), F.col("target"))).select("doc_id"))
_path("txt_shared_depth", f"SELECT doc_id, CAST({_SHARED} AS INT) AS depth FROM pp", lambda x: x.select("doc_id", X.shared_depth(F.col("path"), F.col("target")).alias("depth")))
_path(
    "flt_suspicious",
    f"SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN path = 'setup.py' THEN 'setup:' || path END, CASE WHEN {_NAME} IN ('pyproject.toml','setup.cfg','tox.ini') THEN 'project_meta:' || path END, CASE WHEN regexp_full_match({_STEM}, '{_TOK}') THEN 'noise_path:' || path END, CASE WHEN {_TEST} THEN 'broad_test:' || path END], lambda t: t IS NOT NULL)), '|') AS tags FROM pp",
    lambda x: x.select("doc_id", F.array_join(X.suspicious_tags(F.col("path"), F.col("target")), "|").alias("tags")),
)
_PRIO = f"CASE WHEN path = target THEN 0 ELSE (CASE WHEN doc_id % 10 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN CASE WHEN starts_with(path, regexp_replace(target, '/[^/]*$', '/')) THEN 2 ELSE 3 END WHEN starts_with(path, regexp_replace(target, '/[^/]*$', '/')) THEN 2 ELSE 4 END) + CASE WHEN {_META} THEN 4 ELSE 0 END + CASE WHEN {_TEST} AND {_SHARED} < 2 THEN 3 ELSE 0 END END"
_prio = lambda: X.path_priority(F.col("path"), F.col("target"), F.col("doc_id") % 10 == 0, F.col("doc_id") % 5 == 0, F.lit(False))
_path("txt_priority", f"SELECT doc_id, CAST({_PRIO} AS INT) AS priority FROM pp", lambda x: x.select("doc_id", _prio().alias("priority")))
_path("sort_path_prio", f"SELECT doc_id, path, CAST({_PRIO} AS INT) AS priority FROM pp ORDER BY path <> target, priority, -({_SHARED}), NOT ends_with(path, '.py'), path, doc_id LIMIT 50", lambda x: x.select("doc_id", "path", "target", _prio().alias("priority")).orderBy(F.col("path") != F.col("target"), "priority", -X.shared_depth(F.col("path"), F.col("target")), ~F.col("path").endswith(".py"), "path", "doc_id").limit(50).select("doc_id", "path", "priority"))
_STRONG = f"CASE WHEN path = target THEN 1000 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 350 ELSE 0 END + CASE WHEN starts_with(path, regexp_replace(target, '/[^/]*$', '/')) THEN 220 ELSE 0 END + 20*greatest(0, 10 - {_PRIO}) + 0.4::DOUBLE*least(doc_id, 220) - CASE WHEN {_META} THEN 320 ELSE 0 END - CASE WHEN {_TEST} AND {_SHARED} < 2 THEN 220 ELSE 0 END"


def _strength(x):
    near = F.col("path").startswith(F.regexp_replace("target", "/[^/]*$", "/"))
    return x.select("doc_id", C.strength(F.col("path"), F.col("target"), F.col("doc_id") % 5 == 0, near, _prio(), F.col("doc_id")).alias("score"))


R.add("sort_strength", d6(V.with_views(f"WITH {_PATHS} SELECT doc_id, {_STRONG} AS score FROM pp ORDER BY score DESC, doc_id", "doc"), "score"))(lambda s, d: r6(_strength(_paths(V.doc(s, d))).orderBy(F.desc("score"), "doc_id")))
_path("src_text", "SELECT doc_id FROM pp WHERE regexp_extract(lower(path), '(\\.[^./]+)$', 1) IN ('.py','.kt','.java','.kts','.md','.txt','.rst','.json','.toml','.yaml','.yml','.ini','.cfg','.gradle','.properties','.xml','.sh','.bat')", lambda x: x.where(X.is_text_file(F.col("path"))).select("doc_id"))
_path("flt_ext", "SELECT doc_id FROM pp WHERE ends_with(lower(path), '.py')", lambda x: x.where(F.lower("path").endswith(".py")).select("doc_id"))
_doc("flt_size", "SELECT doc_id FROM doc WHERE octet_length(encode(text)) <= 4096", [], lambda x: x.where(F.octet_length("text") <= 4096).select("doc_id"))
_path("txt_list", "SELECT string_split(path, '/')[1] AS entry, bool_or(contains(path, '/')) AS is_dir, count(*) AS files FROM pp GROUP BY 1 ORDER BY entry LIMIT 60", lambda x: x.groupBy(F.substring_index("path", "/", 1).alias("entry")).agg(F.bool_or(F.contains("path", F.lit("/"))).alias("is_dir"), F.count("*").alias("files")).orderBy("entry").limit(60))
_path("topk_staged", f", g AS (SELECT *, CASE WHEN doc_id % 97 = 96 THEN 0 WHEN {_TEST} THEN 1 ELSE 2 END AS stage FROM pp WHERE contains(path, 'py')), r AS (SELECT *, row_number() OVER (ORDER BY path, doc_id) AS k FROM g WHERE stage = (SELECT min(stage) FROM g)) SELECT doc_id, path, stage FROM r WHERE k <= 8", lambda x: _staged(x))


def _staged(x):
    hit = x.where(F.col("path").contains("py")).withColumn("stage", F.when(F.col("doc_id") % 97 == 96, 0).when(X.is_test_path(F.col("path")), 1).otherwise(2))
    least = hit.agg(F.min("stage").alias("least"))
    return hit.join(F.broadcast(least), F.col("stage") == F.col("least")).orderBy("path", "doc_id").limit(8).select("doc_id", "path", "stage")


# forbidden, comment and code lines; documents have no code, so some of their signs are made brackets and comments
_CODED = ", cl AS (SELECT doc_id, path, n, CASE WHEN n % 5 = 2 THEN concat('# ', line) WHEN n % 3 = 0 THEN concat('x = f(', line, ')') ELSE line END AS line FROM ln)"
_MARK = "started by|maintained by|currently maintained by|maintained for|copyright|licensed under|free software foundation|gnu general public license|documentation:|github:|pypi:|homepage:|read the docs|python markdown|all rights reserved|license :: osi approved|license agreement"
_FORB = f"(regexp_matches(line, '\\S') AND (regexp_matches(lower(line), 'https?://') OR regexp_matches(line, '(?i)^\\s*[''\"]?(license|classifiers?|author(_email)?|maintainer(_email)?|description|long_description|project_urls?|url)[''\"]?\\s*[:=]') OR ((contains(line, '::') OR regexp_matches(line, '^\\s*(#|//|/\\*|\\*)')) AND regexp_matches(line, '(?i)\\b(license|licensed under|copyright|all rights reserved|free software foundation)\\b')) OR regexp_matches(lower(line), '{_MARK}')))"
_COMM = "regexp_matches(line, '^\\s*(#|//|/\\*|\\*)')"
_CODE = f"(regexp_matches(line, '\\S') AND NOT {_FORB} AND NOT {_COMM} AND (contains(line, '=') OR regexp_matches(line, '[()\\[\\]{{}}]') OR regexp_matches(line, ':\\s*$')))".replace("{{}}", "{}")


def _coded(x):
    n, line = F.col("n"), F.col("line")
    return x.select("doc_id", "path", "n", F.when(n % 5 == 2, F.concat(F.lit("# "), line)).when(n % 3 == 0, F.concat(F.lit("x = f("), line, F.lit(")"))).otherwise(line).alias("line"))


_line("flt_forbidden_line", f"{_CODED} SELECT doc_id, n FROM cl WHERE {_FORB}", [], lambda x: _coded(x).where(X.is_forbidden_line(F.col("line"))).select("doc_id", "n"))
_line("flt_comment_line", f"{_CODED} SELECT doc_id, n FROM cl WHERE {_COMM}", [], lambda x: _coded(x).where(X.is_comment_line(F.col("line"))).select("doc_id", "n"))
_line("flt_code_line", f"{_CODED} SELECT doc_id, n FROM cl WHERE {_CODE}", [], lambda x: _coded(x).where(X.is_code_line(F.col("line"))).select("doc_id", "n"))
_SAN = f"""{_CODED}, f AS (SELECT *, {_FORB} AS f FROM cl), g AS (SELECT *, sum(CAST(f AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM f),
 r AS (SELECT doc_id, g, min(n) FILTER (regexp_matches(line, '\\S')) AS start, max(n) FILTER (regexp_matches(line, '\\S')) AS "end", count(*) FILTER ({_CODE}) AS code, count(*) FILTER ({_COMM}) AS comments FROM g WHERE NOT f GROUP BY ALL),
 z AS (SELECT *, round(2.2::DOUBLE*code - 0.2::DOUBLE*comments + 0.01::DOUBLE*least("end"-start+1, 80), 9) AS score FROM r WHERE start IS NOT NULL AND "end"-start+1 >= 6 AND code >= 3),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) AS k FROM z) SELECT doc_id, start, "end", code, score FROM k WHERE k = 1"""
_line("ctx_sanitize", _SAN, ["score"], lambda x: C.sanitised(_coded(x), ["doc_id"]))

# contexts: one per source and run of fifty ids, its documents as blocks
_CTX = "cx AS (SELECT source || ':' || (doc_id // 50) AS source, string_agg('<|file_sep|>' || path || chr(10) || text, chr(10) ORDER BY doc_id) AS context FROM doc GROUP BY 1), bl AS (SELECT source, p[1] AS path, p[2] AS content, k FROM (SELECT source, unnest(range(1, len(a)+1)) - 1 AS k, unnest(a) AS raw FROM (SELECT source, string_split(context, '<|file_sep|>') AS a FROM cx)), LATERAL (SELECT [string_split(ltrim(raw, chr(10)), chr(10))[1], substring(ltrim(raw, chr(10)), instr(ltrim(raw, chr(10)), chr(10))+1)] AS p) WHERE regexp_matches(raw, '\\S'))"


def _contexts(x):
    return C.rendered(x.select(F.concat("source", F.lit(":"), F.expr("CAST(doc_id div 50 AS STRING)")).alias("source"), F.col("doc_id").alias("selection"), "path", F.col("text").alias("content")), ["source"])


_doc("txt_blocks", f"WITH {_CTX} SELECT source, CAST(k AS INT) AS k, path, content FROM bl", [], lambda x: X.blocks(_contexts(x), ["source"]))
_doc(
    "txt_exactness",
    f"WITH {_CTX}, co AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) ELSE 'other' END AS t FROM doc WHERE doc_id % 5 <> 0) SELECT bl.path, CASE WHEN bl.path = '' THEN 'non_exact' WHEN t IS NULL THEN 'missing' WHEN contains(t, content) THEN 'exact' ELSE 'non_exact' END AS state FROM bl LEFT JOIN co ON bl.path = co.path",
    [],
    lambda x: X.exactness(X.blocks(_contexts(x), ["source"]), x.where("doc_id % 5 != 0").select("path", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n"))).otherwise("other").alias("text"))).select("path", "state"),
)
_doc(
    "txt_noise_hits",
    f"WITH {_CTX}, nl AS (SELECT source, k, path, unnest(range(1, len(a)+1)) AS n, lower(unnest(a)) AS l FROM (SELECT *, string_split(content, chr(10)) AS a FROM bl)), h AS (SELECT source, k, path, arg_min(CASE WHEN regexp_matches(l, 'https?://') THEN 'url' ELSE 'noise_line' END, n) AS kind FROM nl WHERE regexp_matches(l, 'https?://|{_MARK}') GROUP BY ALL) SELECT s.source, coalesce(array_to_string(list_sort(list(DISTINCT kind || ':' || path)), '|'), '') AS hits FROM (SELECT DISTINCT source FROM bl) s LEFT JOIN h ON s.source = h.source GROUP BY 1",
    [],
    lambda x: X.noise_hits(X.blocks(_contexts(x), ["source"]).withColumn("target", F.lit("-")), ["source"], "target").withColumn("hits", F.array_join("hits", "|")),
)
_doc(
    "txt_row_metrics",
    f"WITH {_CTX}, t AS (SELECT source, min(path) AS target FROM bl GROUP BY 1), r AS (SELECT bl.*, target, row_number() OVER (PARTITION BY bl.source ORDER BY k) AS i FROM bl JOIN t ON bl.source = t.source) SELECT source, count(*) AS block_count, count(DISTINCT path) AS unique_paths, min(i) FILTER (path = target) - 1 AS target_index, bool_or(path = target AND i = 1) AS target_first, bool_or(path = target AND i <= 2) AS target_in_first_2, count(*) FILTER (NOT regexp_matches(content, '\\S')) AS empty_blocks FROM r GROUP BY 1",
    [],
    lambda x: _row_metrics(x),
)


def _row_metrics(x):
    from pyspark.sql import Window

    b = X.blocks(_contexts(x), ["source"]).withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("k"))).withColumn("target", F.min("path").over(Window.partitionBy("source")))
    hit = F.col("path") == F.col("target")
    return b.groupBy("source").agg(F.count("*").alias("block_count"), F.countDistinct("path").alias("unique_paths"), (F.min(F.when(hit, F.col("i"))) - 1).cast("long").alias("target_index"), F.bool_or(hit & (F.col("i") == 1)).alias("target_first"), F.bool_or(hit & (F.col("i") <= 2)).alias("target_in_first_2"), F.count_if(~F.col("content").rlike(r"\S")).alias("empty_blocks"))


_doc("txt_recover", "SELECT doc_id, CASE WHEN instr(text, ' the ') > 0 THEN CASE WHEN instr(substring(text, instr(text, ' the ')+5), '.') > 0 THEN substring(text, instr(text, ' the ')+5, instr(substring(text, instr(text, ' the ')+5), '.')-1) END END AS ref FROM doc", [], lambda x: x.select("doc_id", X.between(F.col("text"), F.lit(" the "), F.lit(".")).alias("ref")))
_doc("txt_exact", "SELECT doc_id, text = concat(text, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END) AS same FROM doc", [], lambda x: x.select("doc_id", X.exact_match(F.col("text"), F.concat("text", F.when(F.col("doc_id") % 2 == 0, "").otherwise("x"))).alias("same")))
_CH = """WITH p AS (SELECT item_id, b.text AS a, d.text AS r FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3),
 g AS (SELECT item_id, o, substring(x, i, o) AS g, s FROM (SELECT item_id, o, x, s, unnest(range(1, length(x)-o+2)) AS i FROM (SELECT item_id, a AS x, 0 AS s FROM p UNION ALL SELECT item_id, r, 1 FROM p), range(1,7) t(o))),
 c AS (SELECT item_id, o, g, count(*) FILTER (s=0) AS x, count(*) FILTER (s=1) AS y FROM g GROUP BY ALL), q AS (SELECT item_id, o, sum(least(x,y)) AS m, sum(x) AS x, sum(y) AS y FROM c GROUP BY ALL),
 z AS (SELECT item_id, sum(coalesce(m/nullif(x,0),0))/6 AS p, sum(coalesce(m/nullif(y,0),0))/6 AS r FROM q GROUP BY 1) SELECT item_id, coalesce(5*p*r/nullif(4*p+r,0), 0) AS chrf FROM z"""


def _pairs(s, d):
    b = V.table(s, d, "benchmark").select("item_id", F.col("text").alias("a"))
    return b.join(V.table(s, d, "documents").select((F.col("doc_id") / 3).cast("long").alias("item_id"), "doc_id", F.col("text").alias("r")).where("doc_id % 3 = 0"), "item_id")


@R.add("txt_chrf", d6(_CH, "chrf"))
def txt_chrf(s, d):
    return r6(X.chrf(_pairs(s, d), ["item_id"], "a", "r"))


@R.add("set_multiset_intersect", _CH.rpartition(",\n z AS")[0] + " SELECT item_id, CAST(o AS INT) AS o, CAST(m AS BIGINT) AS m FROM q WHERE o = 2")
def set_multiset_intersect(s, d):
    p = _pairs(s, d)
    grams = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.char_length(c) - 1), lambda i: F.substr(F.col(c), i, F.lit(2)))).alias("g")
    count = lambda c, n: p.where(F.char_length(c) > 1).select("item_id", grams(c)).groupBy("item_id", "g").agg(F.count("*").alias(n))
    return count("a", "x").join(count("r", "y"), ["item_id", "g"], "left").groupBy("item_id").agg(F.lit(2).alias("o"), F.sum(F.least("x", F.coalesce("y", F.lit(0)))).alias("m"))


@R.add("txt_align", "SELECT o_orderkey AS k, greatest(1, p+1) AS gap_start, CASE WHEN t <= 0 THEN greatest(0, t-s) ELSE t-s END AS gap_end, CASE WHEN t <= 0 THEN 'target_missing_or_empty' WHEN m = '' THEN 'aligned' ELSE m END AS status, t <= 0 OR m = '' AS consistent, CASE WHEN t <= 0 THEN greatest(1, p+1) WHEN m = '' THEN least(t, least(greatest(1,p+1), greatest(1, t-s))) ELSE greatest(1, least(greatest(1,p+1), t)) END AS anchor FROM (SELECT *, concat_ws('|', CASE WHEN p > t+6 THEN 'prefix_out_of_range' END, CASE WHEN s > t+6 THEN 'suffix_out_of_range' END, CASE WHEN t-s < greatest(1,p+1)-1 THEN 'estimated_gap_inverted' END) AS m FROM (SELECT o_orderkey, o_orderkey % 40 AS t, o_custkey % 60 AS p, o_orderkey % 23 AS s FROM orders))")
def txt_align(s, d):
    o = V.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), *X.alignment(F.col("o_orderkey") % 40, F.col("o_custkey") % 60, F.col("o_orderkey") % 23))


@R.add("txt_find_seq")
def txt_find_seq(s, d):
    """Where the first five lines of the longest document of the first source stand in all documents."""
    rows = _lines(s, d)
    first = V.doc(s, d).select(F.max_by("text", F.struct(F.size(F.split("text", "\n")), "doc_id")).alias("t")).first()["t"].split("\n")[:5]
    return X.find_sequence(rows, first, ["doc_id"], F.lit(1))


@R.add("txt_answer_rank", "SELECT source, max(doc_id) FILTER (k = 1) AS doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 2 END, length(text) DESC, doc_id DESC) AS k FROM documents) GROUP BY 1")
def txt_answer_rank(s, d):
    doc = V.table(s, d, "documents")
    notes = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("search_stall at 3"))).when(F.col("doc_id") % 2 == 1, F.array(F.lit("uncertain"))).otherwise(F.array().cast("array<string>"))
    return doc.groupBy("source").agg(F.max_by("doc_id", F.struct(X.answer_rank(notes, F.col("text")).alias("r"), "doc_id")).alias("doc_id"))


@R.add("txt_unresolved", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'max_agent_steps' WHEN doc_id % 2 = 0 THEN 'needs x' ELSE 'needs x|Anchor ' || doc_id END AS notes FROM documents")
def txt_unresolved(s, d):
    doc = V.table(s, d, "documents").select("doc_id")
    note = F.concat(F.lit("Anchor "), F.col("doc_id").cast("string"))
    notes = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(" max_agent_steps "), F.lit("needs x"), note)).otherwise(F.array(F.lit("needs x"), F.lit("NEEDS X "), note, F.lit("")))
    return doc.select("doc_id", F.array_join(X.cleaned_notes(notes, F.col("doc_id") % 2 == 0), "|").alias("notes"))


@R.add("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_fields(s, d):
    return V.table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# snippets as intervals

_SN = lambda sql: V.with_views(sql, "snip")


@R.add("ctx_merge", _SN("""WITH m AS (SELECT *, max("end") OVER (PARTITION BY path ORDER BY start, "end", selection ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM snip), g AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY start, "end", selection) AS g FROM m)
 SELECT path, min(start) AS start, max("end") AS "end", CAST(floor(avg(anchor)) AS BIGINT) AS anchor, min(selection) AS selection, count(*) AS parts FROM g GROUP BY path, g"""))
def ctx_merge(s, d):
    return C.merged(V.snip(s, d))


R.add("join_overlap", R.sql["ctx_merge"])(ctx_merge)


@R.add("ctx_dedupe", _SN("""WITH m AS (SELECT *, max("end") OVER (PARTITION BY path ORDER BY start, "end" DESC, selection ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM snip) SELECT path, start, "end", selection FROM m WHERE b IS NULL OR "end" > b"""))
def ctx_dedupe(s, d):
    return C.contained(V.snip(s, d)).select("path", "start", "end", "selection")


_CP = """WITH z AS (SELECT *, greatest(12, least(24, size_lines)) AS want FROM snip), y AS (SELECT *, greatest(0, least(greatest(0, least(size_lines-1, greatest(0, anchor-start)) - want//2), size_lines-want)) AS f FROM z)
 SELECT selection, CASE WHEN size_lines <= 24 THEN start ELSE start+f END AS new_start, CASE WHEN size_lines <= 24 THEN start+size_lines-1 ELSE start+f+want-1 END AS new_end, CASE WHEN size_lines <= 24 THEN anchor ELSE least(greatest(anchor, start+f), start+f+want-1) END AS new_anchor FROM y"""


@R.add("ctx_compress", _SN(_CP))
def ctx_compress(s, d):
    return V.snip(s, d).select("selection", *C.compressed(F.col("start"), F.col("size_lines"), F.col("anchor"), 24))


_FIVE = """f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY selection) AS k FROM snip)"""
_STEPS = (96, 80, 64, 48, 32, 24, 16, 12)


@R.add("ctx_fit", _SN(f"""WITH {_FIVE}, z AS (SELECT path, CAST(sum(CAST(k > 5 AS INT)) AS BIGINT) AS dropped, sum(size_chars) FILTER (k <= 5) AS a, {", ".join(f"sum(ceil(size_chars*least(1.0::DOUBLE, {n}.0::DOUBLE/size_lines))) FILTER (k <= 5) AS s{n}" for n in _STEPS)} FROM f GROUP BY path)
 SELECT path, CAST(CASE WHEN a <= 1500 THEN 0 {" ".join(f"WHEN s{n} <= 1500 THEN {n}" for n in _STEPS)} END AS INT) AS lines, dropped FROM z"""))
def ctx_fit(s, d):
    return C.fitted(V.snip(s, d), ["path"], 1500)


@R.add("ctx_pack", _SN("SELECT path, selection FROM (SELECT *, sum(size_chars+1) OVER (PARTITION BY path ORDER BY size_lines DESC, selection ROWS UNBOUNDED PRECEDING) AS r FROM snip) WHERE r <= 4000"))
def ctx_pack(s, d):
    return C.packed(V.snip(s, d), ["path"], "size_lines", 4000).select("path", "selection")


@R.add("ctx_pack_final")
def ctx_pack_final(s, d):
    """Finished contexts of a source's documents by runs of a hundred ids: the first path is the target; tested on hand-written snippets."""
    x = V.doc(s, d).select(F.concat("source", F.lit(":"), F.expr("CAST(doc_id div 100 AS STRING)")).alias("record"), "doc_id", "path", "text")
    target = x.groupBy("record").agg(F.min("path").alias("target"), F.min_by(F.char_length("text") <= 2200, "path").alias("small"))
    near = F.col("path").startswith(F.regexp_extract("target", "^(.*/)[^/]+$", 1))
    base = C.strength(F.col("path"), F.col("target"), F.col("doc_id") % 5 == 0, near, None, F.lit(0))
    snippets = x.join(target, "record").select("record", F.col("doc_id").alias("selection"), "path", F.lit(1).alias("start"), F.col("text").alias("content"), F.lit(None).cast("int").alias("anchor"), base.alias("base"), (F.col("path") == F.col("target")).alias("own"), "small")
    return C.final_pack(snippets, "record").select("record", "place", "path", "start", F.char_length("content").alias("chars"))


@R.add("ctx_reason", _SN("WITH z AS (SELECT path, sum(size_chars) AS u, max(size_lines) AS w, count(*) AS n FROM snip GROUP BY 1) SELECT path, CASE WHEN n <= 1 THEN NULL WHEN u >= 22500 THEN 'near_char_budget' WHEN w > 80 THEN 'wide_snippets' WHEN n >= 4 THEN 'many_snippets' WHEN greatest(0, 30000-u) <= 4000 THEN 'low_remaining_chars' END AS reason FROM z"))
def ctx_reason(s, d):
    z = V.snip(s, d).groupBy("path").agg(F.sum("size_chars").alias("u"), F.max("size_lines").alias("w"), F.count("*").alias("n"))
    return z.select("path", C.reason(F.col("u"), F.col("w"), F.col("n"), 30000, 5).alias("reason"))


@R.add("ctx_small_target", _SN("SELECT selection, size_lines <= 64 OR size_chars <= 2200 AS small FROM (SELECT selection, size_lines*3 AS size_lines, size_chars*4 AS size_chars FROM snip)"))
def ctx_small_target(s, d):
    return V.snip(s, d).select("selection", C.small_target(F.col("size_lines") * 3, F.col("size_chars") * 4).alias("small"))


@R.add("topk_support", _SN("SELECT path, selection FROM (SELECT *, row_number() OVER (PARTITION BY path, anchor % 10 = 0 ORDER BY size_lines DESC, selection) AS k FROM snip) WHERE anchor % 10 = 0 OR k <= 3"))
def topk_support(s, d):
    return C.top_support(V.snip(s, d), ["path"], F.col("anchor") % 10 == 0, [F.desc("size_lines"), F.col("selection")], 3).select("path", "selection")


@R.add("txt_reorder")
def txt_reorder(s, d):
    """Turns of each conversation as blocks of the speaker's file: without contained ones, the user's first, within a budget."""
    turns = V.table(s, d, "conversations").select("conv_id", F.col("turn").alias("k"), F.concat(F.lit("talk/"), F.coalesce("role", F.lit("")), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return C.reordered(turns, ["conv_id"], F.lit("talk/user.txt"), F.col("path") == "talk/assistant.txt", 4000, 12).select("conv_id", "place", "k", "path")


@R.add("txt_dedupe_blocks")
def txt_dedupe_blocks(s, d):
    """Turns of each conversation as blocks in order, by content; their order matters, so it is tested against brute force."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("content")))), lambda x: F.struct(x["turn"].alias("turn"), x["content"].alias("content")))
    kept = V.table(s, d, "conversations").groupBy("conv_id").agg(blocks.alias("b")).select("conv_id", F.explode(C.without_contained(F.col("b"))).alias("k"))
    return kept.select("conv_id", "k.turn")


@R.add("join_contain", _SN("""SELECT DISTINCT a.selection FROM snip a JOIN snip b ON a.path = b.path AND a.selection <> b.selection AND b.start <= a.start AND b."end" >= a."end" AND (b.start < a.start OR b."end" > a."end" OR b.selection < a.selection)"""))
def join_contain(s, d):
    """Snippets within another of their path: what the containment window leaves out."""
    a = V.snip(s, d)
    return a.select("selection").subtract(C.contained(a).select("selection"))


@R.add("ctx_quota", "SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) > 2 THEN 'blocked' ELSE 'ok' END AS status FROM conversations")
def ctx_quota(s, d):
    return C.over_quota(V.table(s, d, "conversations"), ["conv_id"], ["turn", "text"], "role", {}, 2).select("conv_id", "turn", "status")


# every branch has rows: steps 0 to 9 of 8, no to two snippets, few and many characters, searches and blocked calls
@R.add("ctx_autofinal", """WITH z AS (SELECT event_id, event_id % 10 AS step, event_id // 10 % 3 AS snippets, event_id // 30 % 2 * 900 AS chars, event_id // 60 % 8 AS searches, event_id // 480 % 4 AS blocked FROM events)
 SELECT event_id, CASE WHEN snippets > 0 AND step >= 7 THEN CASE WHEN step < 8 AND chars < 600 THEN NULL ELSE 'step_budget_near_limit_with_context' END
  WHEN snippets = 0 AND step >= 6 AND searches >= 6 THEN 'search_stall_without_snippets' WHEN snippets = 0 AND blocked >= 2 THEN 'blocked_tool_stall_without_snippets' END AS stop FROM z""")
def ctx_autofinal(s, d):
    part = lambda size, many: F.expr(f"CAST(event_id div {size} % {many} AS INT)")
    stop = C.stop_rule(part(1, 10), F.lit(8), part(10, 3), part(30, 2) * 900, part(60, 8), part(480, 4))
    return V.table(s, d, "events").select("event_id", stop.alias("stop"))


# report aggregates


@R.add("agg_topk_count", "SELECT p_brand, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 ORDER BY n DESC, first LIMIT 5")
def agg_topk_count(s, d):
    return stats.most_common(V.table(s, d, "part"), "p_brand", "p_partkey", 5)


@R.add("agg_num_summary", d6("SELECT lang, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 1) AS mean, median(n_chars) AS median FROM documents GROUP BY 1", "mean", "median"))
def agg_num_summary(s, d):
    return r6(stats.number_summary(V.table(s, d, "documents"), "n_chars", ["lang"]))


@R.add("agg_rate", d6("SELECT source, count(*) FILTER (n_chars > 2000) AS hits, coalesce(CAST(count(*) FILTER (n_chars > 2000) AS DOUBLE)/nullif(count(*) FILTER (n_chars > 500),0),0) AS rate FROM documents GROUP BY 1", "rate"))
def agg_rate(s, d):
    return r6(V.table(s, d, "documents").groupBy("source").agg(*stats.hit_rate(F.col("n_chars") > 2000, F.col("n_chars") > 500)))


@R.add("agg_collect_ids", "SELECT source, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents WHERE n_chars > 5000 GROUP BY 1")
def agg_collect_ids(s, d):
    return stats.ids_where(V.table(s, d, "documents"), F.col("n_chars") > 5000, "doc_id", ["source"]).select("source", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@R.add("agg_tokens", "SELECT conv_id, CAST(sum(coalesce(CASE WHEN role = 'user' THEN length(text) END, 0)) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def agg_tokens(s, d):
    log = F.to_json(F.struct(F.struct(F.when(F.col("role") == "user", F.char_length("text")).alias("input_tokens")).alias("usage")))
    rows = V.table(s, d, "conversations").select("conv_id", log.alias("row"))
    return rows.groupBy("conv_id").agg(F.sum(F.coalesce(F.from_json("row", "usage struct<input_tokens: long>")["usage"]["input_tokens"], F.lit(0).cast("long"))).alias("tokens"))


@R.add("win_first_occ", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def win_first_occ(s, d):
    return stats.first_occurrences(V.table(s, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], ["doc_id"])


@R.add("join_position", "SELECT a.k, a.doc_id, b.item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents) a JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS k FROM benchmark) b ON a.k = b.k")
def join_position(s, d):
    """Rows paired by their place in order; places come from a range sort, not from one task."""
    from pyspark.sql import Window

    def placed(df, key):
        # the numbers are written down: a range sort that is run again may part the rows elsewhere
        path = scratch(s, "places")
        df.select(key).repartitionByRange(8, key).sortWithinPartitions(key).withColumn("m", F.monotonically_increasing_id()).write.parquet(path)
        sorted_ = s.read.parquet(path)
        per = sorted_.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count("*").alias("n"), F.min("m").alias("first"))
        shift = per.withColumn("s", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        local = F.col("m") - F.col("first")
        return sorted_.withColumn("p", F.shiftright("m", 33)).join(F.broadcast(shift), "p").select((local + F.col("s") + 1).alias("k"), key)

    return placed(V.table(s, d, "documents"), "doc_id").join(placed(V.table(s, d, "benchmark"), "item_id"), "k")


_AFTER = "substring(text, instr(text, ' the ') + 5)"


# a source's longest document is its target, every fifth one is changed, the latest first
@R.add("join_ref_match", V.with_views(f"""WITH t AS (SELECT source, arg_max(doc_id, (length(text), doc_id)) AS t FROM doc GROUP BY 1),
 c AS (SELECT source, doc_id, CASE WHEN doc_id = t THEN -1 ELSE 1000000000 - doc_id END AS rank, CASE WHEN instr(text, ' the ') > 0 AND instr({_AFTER}, '.') > 0 THEN substring({_AFTER}, 1, instr({_AFTER}, '.') - 1) END AS ref FROM doc JOIN t USING (source) WHERE doc_id = t OR doc_id % 5 = 0)
 SELECT source, doc_id, ref FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS k FROM c WHERE ref IS NOT NULL) WHERE k = 1""", "doc"))
def join_ref_match(s, d):
    """Of each source's candidates, the target and then the changed ones in order, the first whose text has the sought sentence."""
    x = V.doc(s, d).select("source", "doc_id", "text")
    target = x.groupBy("source").agg(F.max_by("doc_id", F.struct(F.char_length("text"), "doc_id")).alias("t"))
    ranked = x.join(target, "source").where("doc_id = t or doc_id % 5 = 0").withColumn("rank", F.when(F.col("doc_id") == F.col("t"), -1).otherwise(1_000_000_000 - F.col("doc_id"))).drop("t")
    return X.first_reference(ranked, ["source"], "rank", F.lit(" the "), F.lit(".")).select("source", "doc_id", "ref")


@R.add("txt_suggest")
def txt_suggest(s, d):
    """Per source: the target's window, its tail, heads of modified documents, then siblings; distinct, at most six."""
    from pyspark.sql import Window

    x = V.doc(s, d).select("source", "doc_id", "path", F.size(F.split("text", "\n")).alias("total"))
    target = x.groupBy("source").agg(F.min("doc_id").alias("t"))
    j = x.join(target, "source")
    own = j.where("doc_id = t")
    parts = [own.select("source", "path", F.lit(1).alias("start"), F.least("total", F.lit(320)).alias("end"), F.lit(0).alias("o")), own.select("source", "path", F.greatest(F.lit(1), F.col("total") - 95).alias("start"), F.col("total").alias("end"), F.lit(1).alias("o"))]
    others = j.where("doc_id <> t")
    parts += [others.where("doc_id % 5 = 0").select("source", "path", F.lit(1).alias("start"), F.least("total", F.lit(96)).alias("end"), F.lit(2).alias("o")), others.where("doc_id % 5 <> 0").select("source", "path", F.lit(1).alias("start"), F.least("total", F.lit(48)).alias("end"), F.lit(3).alias("o"))]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    once = stats.first_occurrences(every, ["source", "path", "start", "end"], ["o"])
    return once.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("o", "path", "start", "end"))).where("k <= 6")


# rows for every rule but the last, which consistent counts never reach: targets of 0 to 599 lines, prefix and suffix each found or not, also in the wrong order
_TW = "z AS (SELECT o_orderkey AS k, o_orderkey * 7 % 600 AS t, o_custkey * 11 % 400 AS p, o_orderkey * 13 % 300 AS s, o_orderkey % 5 < 3 AS fp, o_custkey % 4 < 2 AS fs, o_custkey * 17 % 500 + 1 AS ps, o_orderkey * 19 % 500 + 1 AS ss FROM orders)"


@R.add("txt_target_window", f"""WITH {_TW}, y AS (SELECT *, p > t + 6 OR s > t + 6 OR t - s < p AS bad, least(t, p + 1) AS g, greatest(1, least(t, t - s + 1)) AS r FROM z WHERE t > 0),
 x AS (SELECT k, t, CASE WHEN bad THEN 'mismatch' WHEN fp AND fs AND ps + 11 < ss THEN 'both' WHEN fp THEN 'prefix' WHEN fs THEN 'suffix' WHEN r >= g THEN 'estimate' ELSE 'focus' END AS rule, g, r, ps, ss FROM y),
 w AS (SELECT k, rule, greatest(1, CASE rule WHEN 'both' THEN ps - 48 WHEN 'prefix' THEN ps - 48 WHEN 'suffix' THEN ss - 180 ELSE g - 64 END) AS start,
  least(t, CASE rule WHEN 'mismatch' THEN g + 220 WHEN 'both' THEN ss + 11 + 48 WHEN 'prefix' THEN ps + 11 + 180 WHEN 'suffix' THEN ss + 11 + 48 WHEN 'estimate' THEN r + 48 ELSE g + 220 END) AS e FROM x)
 SELECT z.k, start, least(e, start + 320) AS "end", rule FROM z LEFT JOIN w ON z.k = w.k""")
def txt_target_window(s, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    total, prefix, suffix = key * 7 % 600, cust * 11 % 400, key * 13 % 300
    at = lambda found, line: F.when(found, F.struct(line.alias("start"), (line + 11).alias("end")))
    window = X.target_window(total, prefix, suffix, at(key % 5 < 3, cust * 17 % 500 + 1), at(cust % 4 < 2, key * 19 % 500 + 1), F.least(total, prefix + 1))
    return V.table(s, d, "orders").select(key.alias("k"), *window)
