"""Text operators: lines, search, filters, ranking of files, blocks, recovery and scores."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio

# Word lists, limits and patterns of the filters below.
TEXT_EXTENSIONS = (".py", ".kt", ".java", ".kts", ".md", ".txt", ".rst", ".json", ".toml", ".yaml", ".yml", ".ini", ".cfg", ".gradle", ".properties", ".xml", ".sh", ".bat")
NOISE_PATH_TOKENS = ("license", "licenses", "licence", "licences", "copying", "notice", "copyright", "readme", "changelog", "changes")
METADATA_FILENAMES = ("setup.py", "setup.cfg", "pyproject.toml", "tox.ini")
FORBIDDEN_LINE_MARKERS = (
    "started by",
    "maintained by",
    "currently maintained by",
    "maintained for",
    "copyright",
    "licensed under",
    "free software foundation",
    "gnu general public license",
    "documentation:",
    "github:",
    "pypi:",
    "homepage:",
    "read the docs",
    "python markdown",
    "all rights reserved",
    "license :: osi approved",
    "license agreement",
)
METADATA_ASSIGNMENT = r"(?i)^\s*['\"]?(license|classifiers?|author(_email)?|maintainer(_email)?|description|long_description|project_urls?|url)['\"]?\s*[:=]"
LICENSE_LITERAL = r"(?i)\b(license|licensed under|copyright|all rights reserved|free software foundation)\b"
SEVERE_MARKERS = ("model_request_failed", "search_stall", "max_agent_steps", "input_token_budget", "tool_failure_budget", "consecutive_tool_failures", "response_without_finish_tool")
BENIGN_MARKERS = ("prefix/suffix", "prefix_suffix", "anchor", "exact missing", "gap location", "uncertain", "not present in repository", "inconsistent")
MAX_FILE_BYTES, PREVIEW_CHARS, ALIGN_TOLERANCE = 512_000, 160, 6
SEPARATOR = "<|file_sep|>"


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether a text has any of the literal words: one pass."""
    return text.rlike("|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, n, line): 1-based, blank and trailing empty lines kept."""
    return df.select(*keys, F.posexplode(F.split(newlines(F.col(text)), "\n")).alias("_n", "line")).select(*keys, (F.col("_n") + 1).alias("n"), "line")


def head_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def tail_lines(text: Column, n: int) -> Column:
    parts = F.split(text, "\n")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), "\n")


def probe_lines(text: Column, n: int = 12, tail: bool = False) -> Column:
    """The first or last n lines that aren't blank, as an array."""
    full = F.filter(F.split(newlines(text), "\n"), lambda x: x.rlike(r"\S"))
    return F.slice(full, F.greatest(F.lit(1), F.size(full) - n + 1), n) if tail else F.slice(full, 1, n)


def line_window(text: Column, start: Column, end: Column, most: int, numbered: bool = False) -> Column:
    """Lines start to end (1-based, at most ``most``), with ``n: `` before each if asked for."""
    parts = F.split(newlines(text), "\n")
    first = F.greatest(F.lit(1), start)
    count = F.greatest(F.lit(0), F.least(end - first + 1, F.lit(most)))
    part = F.slice(parts, first, count)
    if numbered:
        part = F.transform(part, lambda x, i: F.concat((first + i).cast("string"), F.lit(": "), x))
    return F.array_join(part, "\n")


# paths


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column, last: bool = False) -> Column:
    """Name without what follows its first dot, or without its last suffix."""
    name = file_name(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "") if last else F.substring_index(name, ".", 1)


def is_text_file(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*TEXT_EXTENSIONS)


def _parents(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def is_noise_path(path: Column, target: Column | None = None) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    stem = file_stem(p)
    begins = stem.rlike("^(" + "|".join(NOISE_PATH_TOKENS) + ")([-_].*)?$")
    noisy = begins | F.arrays_overlap(_parents(p), F.array(*map(F.lit, NOISE_PATH_TOKENS)))
    return noisy if target is None else noisy & (path != target)


def is_metadata_path(path: Column) -> Column:
    p = F.lower(path)
    return file_name(p).isin(*METADATA_FILENAMES) | file_stem(p, last=True).isin(*NOISE_PATH_TOKENS) | F.arrays_overlap(_parents(p), F.array(*map(F.lit, NOISE_PATH_TOKENS)))


def is_test_path(path: Column) -> Column:
    p = F.lower(path)
    return F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, ("test", "tests", "testing")))) | file_name(p).startswith("test_")


def shared_depth(a: Column, b: Column) -> Column:
    """Leading directories that two paths share."""
    same = F.zip_with(_parents(a), _parents(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(same, start, lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])


def is_broad_test(path: Column, target: Column) -> Column:
    return ~is_test_path(target) & is_test_path(path) & (shared_depth(path, target) < 2)


def suspicious_tags(path: Column, target: Column) -> Column:
    p = F.lower(path)
    tag = lambda name, condition: F.when(condition, F.concat(F.lit(f"{name}:"), path))
    tags = F.array(
        tag("setup", p == "setup.py"),
        tag("project_meta", file_name(p).isin("pyproject.toml", "setup.cfg", "tox.ini")),
        tag("noise_path", file_stem(p, last=True).isin(*NOISE_PATH_TOKENS)),
        tag("broad_test", ~is_test_path(target) & is_test_path(path)),
    )
    return F.array_sort(F.array_distinct(F.filter(tags, lambda x: x.isNotNull())))


def path_priority(path: Column, target: Column, hinted: Column, modified: Column, hinted_dir: Column) -> Column:
    """0 target, 1 import hint, 2 or 3 modified, 2 same or hinted directory, else 4; metadata +4, broad tests +3."""
    parent = F.regexp_replace(target, r"/?[^/]*$", "")
    near = (parent != "") & path.startswith(F.concat(parent, F.lit("/")))
    base = F.when(hinted, 1).when(modified, F.when(near, 2).otherwise(3)).when(near | hinted_dir, 2).otherwise(4)
    penalty = F.when(is_metadata_path(path), 4).otherwise(0) + F.when(is_broad_test(path, target), 3).otherwise(0)
    return F.when(path == target, 0).otherwise(base + penalty)


# lines


def is_comment_line(line: Column) -> Column:
    return line.rlike(r"^\s*(#|//|/\*|\*)")


def is_forbidden_line(line: Column) -> Column:
    low = F.lower(line)
    literal = line.rlike(LICENSE_LITERAL)
    bad = any_of(low, ("http://", "https://")) | line.rlike(METADATA_ASSIGNMENT) | (line.contains("::") & literal) | (is_comment_line(line) & literal) | any_of(low, FORBIDDEN_LINE_MARKERS)
    return line.rlike(r"\S") & bad


def is_code_line(line: Column) -> Column:
    """Not blank, forbidden or a comment, and with an assignment, a bracket or a colon at its end."""
    shape = line.contains("=") | line.rlike(r"[()\[\]{}]") | line.rlike(r":\s*$")
    return line.rlike(r"\S") & ~is_forbidden_line(line) & ~is_comment_line(line) & shape


def grep(rows: DataFrame, query: str, limit: int | None = None, order: Sequence[str] = ("path", "n")) -> DataFrame:
    """Lines with a literal in any case: the columns of ``rows`` with the line stripped."""
    hit = rows.where(F.contains(F.lower("line"), F.lit(query.lower()))).withColumn("line", stripped(F.col("line")))
    return hit if limit is None else hit.orderBy(*order).limit(limit)


def grep_pattern(rows: DataFrame, pattern: str, totals: Column, around: int = 2, literal: bool = False, ignore_case: bool = True) -> DataFrame:
    """Matching lines with the window around them (within 1 and ``totals``) and a preview."""
    p = (r"\Q" + pattern + r"\E") if literal else pattern
    hit = rows.where(F.col("line").rlike(("(?i)" if ignore_case else "") + p))
    return hit.select("*", F.greatest(F.lit(1), F.col("n") - around).alias("start"), F.least(totals, F.col("n") + around).alias("end"), F.substring(stripped(F.col("line")), 1, PREVIEW_CHARS).alias("preview"))


def grep_many(rows: DataFrame, patterns: Sequence[str], keys: Sequence[str], per_pattern: int | None = None, around: int = 2) -> DataFrame:
    """Windows (keys, start, end) with the sorted patterns that match in them; each pattern gives at most ``per_pattern`` lines in order of keys and line.

    At most six patterns count. They are a literal list, and each line is matched against all in one pass."""
    wanted = list(dict.fromkeys(p.strip() for p in patterns if p.strip()))[:6]
    found = F.array_compact(F.array(*(F.when(F.contains(F.lower("line"), F.lit(p.lower())), F.lit(p)) for p in wanted)))
    hit = rows.select(*keys, "n", F.explode(found).alias("pattern"))
    if per_pattern is not None:
        hit = hit.withColumn("_k", F.row_number().over(Window.partitionBy("pattern").orderBy(*keys, "n"))).where(F.col("_k") <= per_pattern)
    return hit.groupBy(*keys, F.greatest(F.lit(1), F.col("n") - around).alias("start"), (F.col("n") + around).alias("end")).agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))


def imported_modules(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, module, n): modules of ``import x`` and ``from x import`` lines by first occurrence."""
    module = F.regexp_extract("line", r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))", 0)
    name = F.regexp_extract(module, r"(?:from|import)\s+([\w.]+)", 1)
    return rows.select(*keys, "n", name.alias("module")).where("module != ''").groupBy(*keys, "module").agg(F.min("n").alias("n"))


def module_paths(module: Column) -> Column:
    base = F.replace(module, F.lit("."), F.lit("/"))
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))


def code_anchor(rows: DataFrame, keys: Sequence[str], preferred: Column) -> DataFrame:
    """(keys, anchor): the definition line nearest to ``preferred``, the earlier of equals; ``preferred`` if there is none."""
    hit = F.col("line").rlike(r"^\s*(def|class)\s+[A-Za-z_]\w*")
    best = F.min(F.when(hit, F.struct(F.abs(F.col("n") - preferred).alias("d"), F.col("n").alias("n"))))
    return rows.groupBy(*keys).agg(F.coalesce(best["n"], F.greatest(F.lit(1), F.least(F.max("n"), F.max(preferred)))).alias("anchor"))


def find_sequence(rows: DataFrame, probe: Sequence[str], keys: Sequence[str], preferred: Column, fuzzy: bool = False) -> DataFrame:
    """(keys, n, size): where the longest tail of a probe (down to 3 lines) stands, nearest to ``preferred``.

    One window over the lines of a file gives all line k-grams; sizes are tried in one pass."""
    shape = (lambda c: stripped(F.regexp_replace(c, r"\s+", " "))) if fuzzy else (lambda c: c)
    most = min(12, len(probe))
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(0, most - 1)
    grams = rows.withColumn("_g", F.collect_list(shape(F.col("line"))).over(w))
    tries = F.array_compact(F.array(*(F.when(F.slice("_g", 1, k) == F.array(*(shape(F.lit(x)) for x in probe[-k:])), F.lit(k)) for k in range(most, 2, -1))))
    hits = grams.select(*keys, "n", tries.alias("_t")).where(F.size("_t") > 0).withColumn("size", F.array_max("_t"))
    return hits.groupBy(*keys).agg(F.min(F.struct((-F.col("size")).alias("s"), F.abs(F.col("n") - preferred).alias("d"), F.col("n").alias("n"), F.col("size").alias("size"))).alias("b")).select(*keys, F.col("b.n").alias("n"), F.col("b.size").alias("size"))


def alignment(total: Column, prefix: Column, suffix: Column) -> list[Column]:
    """Gap estimate from line counts: gap_start, gap_end, status, consistent, anchor."""
    start, end = F.greatest(F.lit(1), prefix + 1), total - suffix
    checks = [("prefix_out_of_range", prefix > total + ALIGN_TOLERANCE), ("suffix_out_of_range", suffix > total + ALIGN_TOLERANCE), ("estimated_gap_inverted", end < start - 1)]
    said = F.concat_ws("|", *(F.when(c, F.lit(n)) for n, c in checks))
    fine = said == ""
    anchor = F.when(fine, F.least(total, F.least(start, F.greatest(F.lit(1), end)))).otherwise(F.greatest(F.lit(1), F.least(start, total)))
    empty = total <= 0
    return [
        start.alias("gap_start"),
        F.when(empty, F.greatest(F.lit(0), end)).otherwise(end).alias("gap_end"),
        F.when(empty, "target_missing_or_empty").when(fine, "aligned").otherwise(said).alias("status"),
        (empty | fine).alias("consistent"),
        F.when(empty, start).otherwise(anchor).alias("anchor"),
    ]


# Lines before, after and around what is found of a target, the same around an estimate, and the longest window.
WINDOW_BEFORE, WINDOW_AFTER, ESTIMATE_BEFORE, ESTIMATE_AFTER, LONGEST_WINDOW = 48, 180, 64, 220, 320


def target_window(total: Column, prefix: Column, suffix: Column, prefix_at: Column, suffix_at: Column, anchor: Column) -> list[Column]:
    """start, end, rule of the window around a gap; all NULL for an empty target.

    total, prefix and suffix are line counts; prefix_at and suffix_at say on which lines the two were found (start, end; NULL
    where they weren't); anchor is the definition line nearest to the estimate, taken where the counts contradict each other."""
    consistent = alignment(total, prefix, suffix)[3]
    inside = lambda line: F.greatest(F.lit(1), F.least(total, line))
    gap, rest = inside(prefix + 1), inside(total - suffix + 1)
    rules = [
        ("mismatch", ~consistent, anchor - ESTIMATE_BEFORE, anchor + ESTIMATE_AFTER),
        ("both", prefix_at["end"] < suffix_at["start"], prefix_at["start"] - WINDOW_BEFORE, suffix_at["end"] + WINDOW_BEFORE),
        ("prefix", prefix_at.isNotNull(), prefix_at["start"] - WINDOW_BEFORE, prefix_at["end"] + WINDOW_AFTER),
        ("suffix", suffix_at.isNotNull(), suffix_at["start"] - WINDOW_AFTER, suffix_at["end"] + WINDOW_BEFORE),
        ("estimate", rest >= gap, gap - ESTIMATE_BEFORE, rest + WINDOW_BEFORE),
        ("focus", F.lit(True), gap - ESTIMATE_BEFORE, gap + ESTIMATE_AFTER),
    ]
    first = F.coalesce(*(F.when(holds, F.struct(F.greatest(F.lit(1), low).cast("long").alias("start"), F.least(total, high).cast("long").alias("end"), F.lit(name).alias("rule"))) for name, holds, low, high in rules))
    some = F.when(total > 0, first)
    return [some["start"].alias("start"), F.least(some["end"], some["start"] + LONGEST_WINDOW).alias("end"), some["rule"].alias("rule")]


# blocks of a context


def blocks(df: DataFrame, keys: Sequence[str], text: str = "context") -> DataFrame:
    """(keys, k, path, content): blocks by their separator; without one, a single block without a path; empty ones are skipped."""
    parts = F.posexplode(F.split(F.col(text), re.escape(SEPARATOR)))
    rows = df.select(*keys, F.contains(F.col(text), F.lit(SEPARATOR)).alias("_has"), parts.alias("k", "_raw"))
    raw = F.regexp_replace("_raw", "^\n+", "")
    named = F.when(F.col("_has"), F.substring_index(raw, "\n", 1)).otherwise("")
    body = F.when(~F.col("_has"), F.col("_raw")).when(F.locate("\n", raw) > 0, F.substr(raw, F.locate("\n", raw) + 1)).otherwise("")
    return rows.where(F.col("_raw").rlike(r"\S")).select(*keys, "k", stripped(named).alias("path"), body.alias("content"))


def exactness(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Blocks with ``state``: exact, missing (no such file) or non_exact. corpus: path, text."""
    joined = found.join(corpus.select("path", F.col("text").alias("_t")), "path", "left")
    state = F.when(F.col("path") == "", "non_exact").when(F.col("_t").isNull(), "missing").when(F.contains("_t", "content"), "exact").otherwise("non_exact")
    return joined.withColumn("state", state).drop("_t")


def noise_hits(found: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """(keys, hits): for each block at most its first URL or marker line, and a noisy path; distinct and sorted. ``found`` has ``target``."""
    low = F.lower(stripped(F.col("line")))
    kind = F.when(any_of(low, ("http://", "https://")), "url").when(any_of(low, FORBIDDEN_LINE_MARKERS), "noise_line")
    first = lines(found, [*keys, "k", "path", target], "content").withColumn("kind", kind).groupBy(*keys, "k", "path", target).agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("n"))).alias("kind"))
    tags = F.array_compact(F.array(F.when(F.col("kind").isNotNull(), F.concat_ws(":", "kind", "path")), F.when((F.col("path") != F.col(target)) & file_stem(F.lower("path"), last=True).isin(*NOISE_PATH_TOKENS), F.concat(F.lit("path:"), F.col("path")))))
    return first.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tags)))).alias("hits"))


def between(text: Column, prefix: Column, suffix: Column) -> Column:
    """The text between a prefix and a suffix (literal); to the end for an empty suffix; NULL where either is missing."""
    at = F.instr(text, prefix)
    rest = F.substr(text, at + F.char_length(prefix))
    stop = F.instr(rest, suffix)
    return F.when(at > 0, F.when(F.char_length(suffix) == 0, rest).when(stop > 0, F.substr(rest, F.lit(1), stop - 1)))


def first_reference(candidates: DataFrame, keys: Sequence[str], rank: str, prefix: Column, suffix: Column, text: str = "text") -> DataFrame:
    """The candidate of each record that comes first by ``rank`` (the target before the changed files, in their order) among those
    that hold the text between prefix and suffix, with that text as ``ref``; records without one are left out.

    One aggregate with map-side combination: only one candidate of a record is kept a task."""
    found = candidates.withColumn("ref", between(newlines(F.col(text)), newlines(prefix), newlines(suffix))).drop(text).where("ref is not null")
    rest = [c for c in found.columns if c not in keys]
    best = found.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


def chrf(pairs: DataFrame, keys: Sequence[str], a: str, b: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """(keys, chrf): F score of character n-grams of 1 to ``order``, averaged over the orders. Both empty gives 1, one empty 0.

    N-grams are exploded and counted with map-side combination; the two sides meet as one aggregate, without a join."""
    def of_order(text: str, side: int, n: int) -> Column:
        gram = lambda i: F.struct(F.lit(n).alias("o"), F.substr(F.col(text), i, F.lit(n)).alias("g"), F.lit(side).alias("s"))
        return F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), gram))

    def grams(text: str, side: int) -> Column:
        return F.flatten(F.array_compact(F.array(*(of_order(text, side, n) for n in range(1, order + 1)))))

    exploded = pairs.select(*keys, F.inline(F.concat(grams(a, 0), grams(b, 1))))
    counts = exploded.groupBy(*keys, "o", "g").agg(F.count_if(F.col("s") == 0).alias("x"), F.count_if(F.col("s") == 1).alias("y"))
    per = counts.groupBy(*keys, "o").agg(F.sum(F.least("x", "y")).alias("m"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    part = lambda n: F.coalesce(ratio(F.col("m").cast("double"), F.col(n)), F.lit(0.0))
    mean = per.groupBy(*keys).agg((F.sum(part("x")) / order).alias("p"), (F.sum(part("y")) / order).alias("r"))
    score = F.coalesce(ratio((1 + beta * beta) * F.col("p") * F.col("r"), beta * beta * F.col("p") + F.col("r")), F.lit(0.0))
    base = pairs.select(*keys, (F.char_length(a) == 0).alias("_a"), (F.char_length(b) == 0).alias("_b")).join(mean, list(keys), "left")
    return base.select(*keys, F.when(F.col("_a") & F.col("_b"), 1.0).when(F.col("_a") | F.col("_b"), 0.0).otherwise(F.coalesce(score, F.lit(0.0))).alias("chrf"))


def exact_match(a: Column, b: Column) -> Column:
    return newlines(a) == newlines(b)


def answer_rank(unresolved: Column, context: Column) -> Column:
    """What the better of two answers has more of: fewer severe notes, fewer notes, more paths, more text."""
    severe = F.size(F.filter(unresolved, lambda x: any_of(F.lower(x), SEVERE_MARKERS)))
    paths = F.size(F.split(context, re.escape(SEPARATOR))) - 1
    return F.struct((-severe).alias("severe"), (-F.size(unresolved)).alias("notes"), paths.alias("paths"), F.char_length(context).alias("chars"))


def cleaned_notes(notes: Column, reasonable: Column) -> Column:
    """Notes stripped and distinct in any case; only severe ones if there are any, else none that are benign for a reasonable context."""
    trimmed = F.filter(F.transform(notes, stripped), lambda x: x != "")
    low = F.transform(trimmed, F.lower)
    once = F.filter(trimmed, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    severe = F.filter(once, lambda x: any_of(F.lower(x), SEVERE_MARKERS))
    return F.when(F.size(severe) > 0, severe).when(reasonable, F.filter(once, lambda x: ~any_of(F.lower(x), BENIGN_MARKERS))).otherwise(once)
