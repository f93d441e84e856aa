"""Context packing: sanitised runs of lines, interval merging, compression, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import SEPARATOR, is_broad_test, is_code_line, is_comment_line, is_forbidden_line, is_metadata_path

#: Fixed values.
MIN_LINES, MIN_CODE, CODE_SCORE, COMMENT_SCORE, LINE_SCORE, MOST_SCORED = 6, 3, 2.2, 0.2, 0.01, 80
LEAST_COMPRESSED = 12
QUOTAS = {"read_file": 10, "search_files": 4, "search_pattern": 10, "search_patterns": 6}


def sanitised(rows: DataFrame, keys: Sequence[str], least_lines: int = MIN_LINES, least_code: int = MIN_CODE, bonus: float = 0.0) -> DataFrame:
    """(keys, start, end, code, score): the best run of lines between forbidden ones, without blank edges; the first of equals. rows: keys, n, line."""
    w = Window.partitionBy(*keys).orderBy("n")
    marked = rows.withColumn("_f", is_forbidden_line(F.col("line")))
    runs = marked.withColumn("_g", F.sum(F.col("_f").cast("int")).over(w)).where("not _f")
    full = F.col("line").rlike(r"\S")
    found = runs.groupBy(*keys, "_g").agg(
        F.min(F.when(full, F.col("n"))).alias("start"), F.max(F.when(full, F.col("n"))).alias("end"), F.count_if(is_code_line(F.col("line"))).alias("code"), F.count_if(is_comment_line(F.col("line"))).alias("comments")
    )
    size = F.col("end") - F.col("start") + 1
    score = CODE_SCORE * F.col("code") - COMMENT_SCORE * F.col("comments") + LINE_SCORE * F.least(size, F.lit(MOST_SCORED)) + bonus
    fit = found.where("start is not null").where((size >= least_lines) & (F.col("code") >= least_code)).withColumn("score", F.round(score, 9))
    best = fit.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), "start", "end", "code")).alias("b"))
    return best.select(*keys, F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.col("b.code").alias("code"), (-F.col("b.s")).alias("score"))


def merged(snippets: DataFrame, by: str = "path") -> DataFrame:
    """Overlapping intervals (start <= running end) as one: start, end, anchor (mean), selection (first), parts. Intervals that only touch stay apart."""
    w = Window.partitionBy(by).orderBy("start", "end", "selection")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = snippets.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w))
    return islands.groupBy(by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.floor(F.avg("anchor")).cast("long").alias("anchor"), F.min("selection").alias("selection"), F.count("*").alias("parts")).drop("_g")


def contained(snippets: DataFrame, by: str = "path") -> DataFrame:
    """Snippets that don't lie wholly within another of their path (of equal ones the first selected stays).

    One window: sorted by start and falling end, one that ends by the running maximum is contained."""
    w = Window.partitionBy(by).orderBy("start", F.desc("end"), "selection")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return snippets.withColumn("_b", before).where("_b is null or end > _b").drop("_b")


def compressed(start: Column, n_lines: Column, anchor: Column, target: int) -> list[Column]:
    """new_start, new_end, new_anchor of a snippet shrunk to ``target`` lines (at least 12) around its anchor."""
    want = F.greatest(F.lit(LEAST_COMPRESSED), F.least(F.lit(target), n_lines))
    at = F.coalesce(anchor, start + F.floor(n_lines / 2))
    index = F.least(n_lines - 1, F.greatest(F.lit(0), at - start))
    first = F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), index - F.floor(want / 2)), n_lines - want))
    keep = (n_lines <= target) | (want >= n_lines)
    low, high = start + first, start + first + want - 1
    return [
        F.when(keep, start).otherwise(low).cast("long").alias("new_start"),
        F.when(keep, start + n_lines - 1).otherwise(high).cast("long").alias("new_end"),
        F.when(keep, anchor).otherwise(F.least(F.greatest(at, low), high)).cast("long").alias("new_anchor"),
    ]


def reason(used: Column, widest: Column, count: Column, budget: int, most: int) -> Column:
    """Why a context should be compressed, else NULL."""
    return (
        F.when(count <= 1, F.lit(None))
        .when(used >= int(budget * 0.75), "near_char_budget")
        .when(widest > 80, "wide_snippets")
        .when(count >= min(most, 4), "many_snippets")
        .when(F.greatest(F.lit(0), budget - used) <= 4000, "low_remaining_chars")
    )


def strength(path: Column, target: Column, modified: Column, same_dir: Column, priority: Column | None, n_lines: Column) -> Column:
    """Rank of a snippet: 1000 target, 350 modified, 220 same directory, priority and length, less metadata and broad tests."""
    score = F.when(path == target, 1000.0).otherwise(0.0) + F.when(modified, 350.0).otherwise(0.0) + F.when(same_dir, 220.0).otherwise(0.0)
    if priority is not None:
        score = score + 20.0 * F.greatest(F.lit(0), 10 - priority)
    return score + 0.4 * F.least(n_lines, F.lit(220)) - F.when((path != target) & is_metadata_path(path), 320.0).otherwise(0.0) - F.when(is_broad_test(path, target), 220.0).otherwise(0.0)


def top_support(snippets: DataFrame, by: Sequence[str], is_target: Column, order: Sequence[Column], most: int) -> DataFrame:
    """Target snippets and the ``most`` best others of each group."""
    w = Window.partitionBy(*by, is_target).orderBy(*order)
    return snippets.withColumn("_k", F.row_number().over(w)).where(is_target | (F.col("_k") <= most)).drop("_k")


def greedy_fit(items: Column, budget: int) -> Column:
    """Of ordered (k, size) structs those that fit: each is taken if it still fits (others are skipped); a first one that is too large is kept alone."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ks"))

    def step(s: Column, e: Column) -> Column:
        fits = s["used"] + e["size"] <= budget
        alone = (F.size(s["ks"]) == 0) & (e["size"] > budget) & (s["used"] == 0)
        took = F.struct(F.when(alone, F.lit(budget).cast("long")).otherwise(s["used"] + e["size"]).alias("used"), F.array_append(s["ks"], e["k"].cast("long")).alias("ks"))
        return F.when(fits | alone, took).otherwise(s)

    return F.aggregate(items, start, step, lambda s: s["ks"])


def fitted(snippets: DataFrame, by: Sequence[str], budget: int, steps: Sequence[int] = (96, 80, 64, 48, 32, 24, 16, 12), most: int = 5) -> DataFrame:
    """(by, lines, dropped): the line limit per snippet that makes a context fit, after all but the ``most`` best have gone; NULL limit if none does.

    snippets: by, selection, size_lines, size_chars. Characters shrink in proportion to lines."""
    w = Window.partitionBy(*by).orderBy("selection")
    kept = snippets.withColumn("_k", F.row_number().over(w)).withColumn("_d", (F.col("_k") > most).cast("int"))
    size = lambda n: F.sum(F.when(F.col("_d") == 0, F.ceil(F.col("size_chars") * F.least(F.lit(1.0), F.lit(float(n)) / F.col("size_lines")))))
    sums = kept.groupBy(*by).agg(F.sum("_d").alias("dropped"), size(10**9).alias("_all"), *(size(n).alias(f"_{n}") for n in steps))
    limit = F.when(F.col("_all") <= budget, F.lit(0))
    for n in steps:
        limit = limit.when(F.col(f"_{n}") <= budget, F.lit(n))
    return sums.select(*by, limit.alias("lines"), "dropped")


def packed(snippets: DataFrame, by: Sequence[str], score: str, budget: int) -> DataFrame:
    """Snippets by falling score as long as the running size (one separator each) stays within the budget."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), "selection")
    running = F.sum(F.col("size_chars") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return snippets.withColumn("running", running).where(F.col("running") <= budget)


def rendered(snippets: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, context): the snippets (selection, path, content) in order, each after the separator and its path."""
    block = F.concat(F.lit(SEPARATOR), F.col("path"), F.lit("\n"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("selection", block.alias("b"))))
    return snippets.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n").alias("context"))


def small_target(n_lines: Column, chars: Column, most_lines: int = 64, most_chars: int = 2200) -> Column:
    return (n_lines <= most_lines) | (chars <= most_chars)


def over_quota(calls: DataFrame, by: Sequence[str], order: Sequence[str], tool: str = "tool", quotas: dict[str, int] = QUOTAS, default: int = 10**6) -> DataFrame:
    """Calls with ``status``: blocked beyond the limit of their tool, in order."""
    w = Window.partitionBy(*by, tool).orderBy(*order)
    limit = F.lit(default)
    for k, v in quotas.items():
        limit = F.when(F.col(tool) == k, v).otherwise(limit)
    return calls.withColumn("nth", F.row_number().over(w)).withColumn("status", F.when(F.col("nth") > limit, "blocked").otherwise("ok"))


#: Steps and searches after which a run without a snippet has stalled, blocked calls that do it at any step, characters that are least.
STALL_STEP, STALL_SEARCHES, STALL_BLOCKED, LEAST_CHARS = 6, 6, 2, 600


def stop_rule(step: Column, most_steps: Column, snippets: Column, chars: Column, searches: Column, blocked: Column, least_chars: int = LEAST_CHARS) -> Column:
    """Why a run should end, NULL if it goes on: its steps are nearly used up and it has a context (at the last but one step, one of the
    least size), or it has no snippet after many searches or blocked calls."""
    budget = (snippets > 0) & (step >= most_steps - 1)
    early = (step < most_steps) & (chars < max(LEAST_CHARS, least_chars))
    stalled = F.when((step >= STALL_STEP) & (searches >= STALL_SEARCHES), "search_stall_without_snippets").when(blocked >= STALL_BLOCKED, "blocked_tool_stall_without_snippets")
    return F.when(budget, F.when(~early, "step_budget_near_limit_with_context")).when(snippets == 0, stalled)


def without_contained(items: Column, by: str | None = None) -> Column:
    """Of an ordered array of structs with ``content`` those whose content no other has: one that lies in a kept one goes, one that
    holds a kept one takes its place. Empty contents lie in none. With ``by``, only structs that agree in that field are compared."""

    def step(kept: Column, item: Column) -> Column:
        alike = lambda a, b: F.lit(True) if by is None else a[by] == b[by]
        inside = lambda a, b: alike(a, b) & (a["content"] != "") & b["content"].contains(a["content"])
        hit = F.get(F.filter(F.transform(kept, lambda k, i: F.when(inside(item, k), -1 - i).when(inside(k, item), i)), lambda h: h.isNotNull()), F.lit(0))
        return F.when(hit.isNull(), F.array_append(kept, item)).when(hit >= 0, F.transform(kept, lambda k, i: F.when(i == hit, item).otherwise(k))).otherwise(kept)

    return F.aggregate(items, F.slice(items, 1, 0), step)


def reordered(found: DataFrame, by: Sequence[str], target: Column, modified: Column, budget: int | None = None, most: int | None = None) -> DataFrame:
    """(by, place, k, path, content): the blocks of each context without redundant ones, the strongest first, ties as they stood; the
    first ``most``, and of these what fits ``budget`` as rendered blocks.

    found: by, k, path, content. target is a context's own path, modified whether a block's path was changed. One array a context."""
    folder = F.regexp_extract(target, "^(.*/)[^/]+$", 1)
    near = (folder != "") & F.col("path").startswith(folder)
    n_lines = F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", "\n")))
    score = F.round(strength(F.col("path"), target, modified, near, None, n_lines), 9)
    item = F.struct("k", "path", "content", (-score).alias("s"))
    kept = without_contained(F.array_sort(F.collect_list(item)), "path")
    ordered = F.array_sort(F.transform(kept, lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["path"].alias("path"), b["content"].alias("content"))))
    lists = found.groupBy(*by).agg(ordered.alias("_o"))
    if most:
        lists = lists.withColumn("_o", F.slice("_o", 1, most))
    if budget:
        # every block but the first has a line break before it
        size = lambda b: F.char_length(b["path"]) + F.char_length(b["content"]) + (len(SEPARATOR) + 2)
        fits = greedy_fit(F.transform("_o", lambda b, i: F.struct(i.cast("long").alias("k"), size(b).cast("long").alias("size"))), budget + 1)
        lists = lists.withColumn("_f", fits).withColumn("_o", F.transform("_f", lambda i: F.get("_o", i.cast("int"))))
    return lists.select(*by, F.posexplode("_o").alias("place", "_b")).select(*by, "place", "_b.k", "_b.path", "_b.content")


def locate(rows: DataFrame, content: Sequence[str], keys: Sequence[str], preferred: Column) -> DataFrame:
    """(keys, start, end): the lines of each file that a content's first lines (at most twelve) stand on, nearest to ``preferred``."""
    from .text import find_sequence

    probe = list(content[:12])
    hit = find_sequence(rows, probe, keys, preferred)
    # a shorter tail of the probe was found further down: the content began that much before
    start = F.greatest(F.lit(1), F.col("n") - (len(probe) - F.col("size")))
    return hit.select(*keys, start.alias("start"), (start + len(content) - 1).alias("end"))


def expanded(rows: DataFrame, keys: Sequence[str], anchor: Column, floor: int, steps: Sequence[int] = (160, 240, 320, 400, 480)) -> DataFrame:
    """(keys, step, chars): the narrowest window of lines around an anchor with at least ``floor`` characters, else the widest. rows: keys, n, line."""
    chars = F.char_length("line") + 1
    inside = lambda s: F.coalesce(F.sum(F.when(F.abs(F.col("n") - anchor) <= s // 2, chars)), F.lit(0))
    sums = rows.groupBy(*keys).agg(*(inside(s).alias(f"_{s}") for s in steps))
    step, size = F.lit(steps[-1]), F.col(f"_{steps[-1]}")
    for s in reversed(steps[:-1]):
        enough = F.col(f"_{s}") >= floor
        step, size = F.when(enough, s).otherwise(step), F.when(enough, F.col(f"_{s}")).otherwise(size)
    return sums.select(*keys, step.alias("step"), size.cast("long").alias("chars"))


def shrunk(start: int, lines: list[str], anchor: int | None, target: int) -> tuple[int, list[str], int | None]:
    """A snippet of at most ``target`` lines (at least 12) around its anchor; as it is if it has no more."""
    want = max(LEAST_COMPRESSED, min(target, len(lines)))
    if want >= len(lines):
        return start, lines, anchor
    at = anchor if anchor is not None else start + len(lines) // 2
    index = min(len(lines) - 1, max(0, at - start))
    first = max(0, min(max(0, index - want // 2), len(lines) - want))
    start, lines = start + first, lines[first : first + want]
    return start, lines, min(max(at, start), start + want - 1)


class ContextBuffer:
    """A context that is built call by call: add, compress, preview, reset. Snippets are (path, start, content, anchor)."""

    def __init__(self, budget: int = 12_000, most: int = 5) -> None:
        self.budget, self.most = budget, most
        self.snippets: list[tuple[str, int, list[str], int | None]] = []

    def reset(self) -> None:
        self.snippets = []

    def preview(self) -> str:
        return "\n".join(f"{SEPARATOR}{path}\n" + "\n".join(lines) for path, _, lines, _ in self.snippets)

    def compress(self, target: int) -> None:
        """Shrink every snippet to ``target`` lines (at least 12) around its anchor."""
        self.snippets = [(path, *shrunk(start, lines, anchor, target)) for path, start, lines, anchor in self.snippets]

    def add(self, path: str, start: int, content: str, anchor: int | None = None) -> bool:
        """Add a snippet; the oldest go beyond ``most``, all shrink until the budget holds; False if the new one doesn't fit even then."""
        before = list(self.snippets)
        self.snippets = [*self.snippets, (path, start, content.split("\n"), anchor)][-self.most :]
        for target in (10**9, 96, 80, 64, 48, 32, 24, 16, 12):
            self.compress(target)
            if len(self.preview()) <= self.budget:
                return True
        self.snippets = before
        return False


def replayed(calls: DataFrame, by: str, budget: int, most: int = 5) -> DataFrame:
    """(by, context): buffers after all ``add`` calls of a record in order; calls: by, n, path, start, content. A record's calls are one task."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        buffer = ContextBuffer(budget, most)
        for r in frame.sort_values("n").itertuples():
            buffer.add(r.path, int(r.start), r.content)
        return pd.DataFrame({by: [frame[by].iloc[0]], "context": [buffer.preview()]})

    return calls.groupBy(by).applyInPandas(run, f"{by} {dict(calls.dtypes)[by]}, context string")


# Fixed values, for a large and a small target: characters and lines that supports shrink to; supports kept, and those kept of a small target that isn't chosen.
FINAL_CHARS, FINAL_LINES = (10_800, 11_800), ((56, 40, 32, 24), (72, 56, 40, 32))
FINAL_SUPPORTS, FINAL_SUPPORTS_ALONE = 2, 3


def final_pack(snippets: DataFrame, by: str, budget: int = 12_000) -> DataFrame:
    """(by, place, path, start, content): the finished context of each record, the strongest snippet first.

    snippets: by, selection, path, start, content, anchor, base (its strength without lines), own (of the target), small (the target
    is). Of the supports only the best stay, the later of equal ones; while the context is over its budget they shrink, the weakest
    first, by one step of lines after the other, and then the weakest go. The target's snippets stay as they are, even over the budget.
    Nulls: a null content is empty, a null base 0, a null own or small false. A record's chosen snippets are one task."""
    import pandas as pd

    def strength_of(s: dict) -> float:
        return round(s["base"] + 0.4 * min(len(s["lines"]), 220), 9)

    def chars(kept: list[dict]) -> int:
        return sum(len(SEPARATOR) + len(s["path"]) + 1 + sum(map(len, s["lines"])) + len(s["lines"]) for s in kept) - 1

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for r in frame.itertuples():
            content = r.content if isinstance(r.content, str) else ""
            base = 0.0 if pd.isna(r.base) else float(r.base)
            kept.append({"path": r.path or "", "start": int(r.start), "lines": content.split("\n"), "anchor": None if pd.isna(r.anchor) else int(r.anchor), "selection": int(r.selection), "base": base, "own": r.own is not None and not pd.isna(r.own) and bool(r.own)})
        small = bool(frame["small"].fillna(False).any())
        most = FINAL_SUPPORTS_ALONE if small and not any(s["own"] for s in kept) else FINAL_SUPPORTS
        room = min(budget, FINAL_CHARS[small])
        kept.sort(key=lambda s: (-strength_of(s), s["selection"]))
        supports = sorted((s for s in kept if not s["own"]), key=lambda s: (strength_of(s), s["selection"]))
        supports = supports[max(0, len(supports) - most) :]
        kept = [s for s in kept if s["own"] or any(s is x for x in supports)]
        for s, target in ((s, target) for target in FINAL_LINES[small] for s in supports):
            if chars(kept) <= room:
                break
            s["start"], s["lines"], s["anchor"] = shrunk(s["start"], s["lines"], s["anchor"], target)
        while supports and chars(kept) > room:
            weakest = min(supports, key=lambda s: (strength_of(s), -s["selection"]))
            supports = [s for s in supports if s is not weakest]
            kept = [s for s in kept if s is not weakest]
        key = frame[by].iloc[0]
        return pd.DataFrame([(key, i, s["path"], s["start"], "\n".join(s["lines"])) for i, s in enumerate(kept)], columns=[by, "place", "path", "start", "content"])

    columns = [by, "selection", "path", "start", "content", "anchor", "base", "own", "small"]
    return snippets.select(*columns).groupBy(by).applyInPandas(run, f"{by} {dict(snippets.dtypes)[by]}, place int, path string, start long, content string")
