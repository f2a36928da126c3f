"""Memory snapshots: normalisation, lookup, retry history and carry-over text."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.functions import variants as V
from trailmark.plans.keyed import first_by
from trailmark.plans.staging import staged

# ---- fixed values -------------------------------------------------------------------------
STATUSES = ("verified", "conflicting", "partial")
FACT_FIELDS = ("fact", "summary", "value")
SOURCE_FIELDS = ("source_url", "source", "url")
TARGET_FIELDS = ("target", "url", "path")
REASON_FIELDS = ("reason", "why")
# -------------------------------------------------------------------------------------------

#: Wording of the carry-over text: this project's own, nothing reads it back.
CARRY_TITLES = {
    "memory_id": "Snapshot: ",
    "task_progress": "Done so far: ",
    "next_step_plan": "Planned next: ",
    "facts": "What is known:\n",
    "visited": "Places seen: ",
    "frontier": "Still open:\n",
    "dead_ends": "Without result, leave out:\n",
    "meta_learnings": "Lessons:\n",
}
CARRY_TAIL = {"en": "Use what is written here first. Answer in English if nothing else was asked for.", "zh": "请先使用以上内容。如无其他要求，请用中文回答。"}

FACT = "array<struct<fact:string,source_url:string,status:string>>"
FRONTIER = "array<struct<target:string,reason:string>>"


def _pick(v: Column, names: tuple[str, ...]) -> Column:
    return S.first_nonempty(*[V.text_at(v, f"$.{n}") for n in names])


def normal_facts(v: Column) -> Column:
    """Knowledge graph entries with their aliases resolved; a bare value becomes a partial fact."""
    def entry(e: Column) -> Column:
        return S.let(F.struct(e.alias("e"), V.is_object(e).alias("obj"), V.text_at(e, "$.status").alias("status")), fields)

    def fields(p: Column) -> Column:
        e, obj, status = p["e"], p["obj"], p["status"]
        return F.struct(
            F.when(obj, _pick(e, FACT_FIELDS)).otherwise(e.try_cast("string")).alias("fact"),
            F.when(obj, _pick(e, SOURCE_FIELDS)).otherwise(F.lit("")).alias("source_url"),
            F.when(obj & status.isin(*STATUSES), status).otherwise(F.lit("partial")).alias("status"),
        )

    return F.coalesce(F.transform(v.try_cast("array<variant>"), entry), F.array().cast(FACT)).cast(FACT)


def normal_navigation(v: Column) -> Column:
    """Navigation state with resolved aliases: visited summary, frontier targets and reasons, dead ends as text."""
    def lead(e: Column) -> Column:
        obj = V.is_object(e)
        return F.struct(
            F.when(obj, _pick(e, TARGET_FIELDS)).otherwise(e.try_cast("string")).alias("target"),
            F.when(obj, _pick(e, REASON_FIELDS)).otherwise(F.lit("")).alias("reason"),
        )

    queue = F.transform(V.at(v, "$.frontier_queue").try_cast("array<variant>"), lead)
    ends = F.transform(V.at(v, "$.dead_ends").try_cast("array<variant>"), lambda e: e.try_cast("string"))
    return F.struct(
        _pick(v, ("visited_summary", "visited")).alias("visited_summary"),
        F.coalesce(queue, F.array().cast(FRONTIER)).cast(FRONTIER).alias("frontier_queue"),
        F.coalesce(ends, F.array().cast("array<string>")).alias("dead_ends"),
    )


def normalized(snapshots: DataFrame) -> DataFrame:
    """Replace the JSON texts knowledge_graph and navigation_state by typed values."""
    return snapshots.withColumns(
        {
            "knowledge_graph": normal_facts(F.try_parse_json("knowledge_graph")),
            "navigation_state": normal_navigation(F.try_parse_json("navigation_state")),
        }
    )


def build_snapshots(seals: DataFrame) -> DataFrame:
    """Snapshot rows from seal calls: fresh id and time, missing parts filled with empties."""
    df = normalized(seals)
    empty = F.array().cast("array<string>")
    keep = lambda c, default: F.coalesce(F.col(c), default) if c in seals.columns else default
    return df.withColumns(
        {
            "memory_id": F.uuid(),
            "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00Z'"),
            "tags": keep("tags", empty),
            "meta_learnings": keep("meta_learnings", empty),
            "next_step_plan": F.coalesce("next_step_plan", F.lit("")),
            "task_progress": F.coalesce("task_progress", F.lit("")),
        }
    )


def read_projection(snapshots: DataFrame, include_structured: bool = False, structured_max_chars: int = 6000) -> DataFrame:
    """What a reader of a snapshot sees; the structured summary only on request and cut to its budget."""
    cols = ["memory_id", "knowledge_graph", "navigation_state", "next_step_plan", "task_progress"]
    out = snapshots.select("question_id", *cols, *(["structured_summary"] if include_structured else []))
    if include_structured:
        out = out.withColumn("structured_summary", F.substring(F.coalesce("structured_summary", F.lit("")), 1, structured_max_chars))
    return out


def carry_over(snapshots: DataFrame, language: str = "en", seal_count: str | None = None, max_seals: int = 0) -> DataFrame:
    """Text that carries a snapshot into the next context; absent sections are left out.

    Input: normalised snapshots with memory_id, task_progress, next_step_plan, optional meta_learnings.
    """
    listed = lambda arr: F.array_join(arr, "\n")
    titled = lambda title, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(title), text))
    facts = F.transform(
        F.filter("knowledge_graph", lambda f: f["fact"] != ""),
        lambda f: F.concat(F.lit("- "), f["fact"], F.when(f["status"] != "", F.concat(F.lit(" ["), f["status"], F.lit("]"))).otherwise(F.lit(""))),
    )
    leads = F.transform(
        "navigation_state.frontier_queue",
        lambda e: F.concat(
            F.lit("- "), F.coalesce(F.nullif(e["target"], F.lit("")), F.lit("(no target)")),
            F.when(e["reason"] != "", F.concat(F.lit(" ("), e["reason"], F.lit(")"))).otherwise(F.lit("")),
        ),
    )
    dashed = lambda arr: F.transform(arr, lambda e: F.concat(F.lit("- "), e))
    parts = [
        titled(CARRY_TITLES["memory_id"], F.col("memory_id")),
        titled(CARRY_TITLES["task_progress"], F.col("task_progress")),
        titled(CARRY_TITLES["next_step_plan"], F.col("next_step_plan")),
        titled(CARRY_TITLES["facts"], listed(facts)),
        titled(CARRY_TITLES["visited"], F.col("navigation_state.visited_summary")),
        titled(CARRY_TITLES["frontier"], listed(leads)),
        titled(CARRY_TITLES["dead_ends"], listed(dashed("navigation_state.dead_ends"))),
    ]
    if "meta_learnings" in snapshots.columns:
        parts.append(titled(CARRY_TITLES["meta_learnings"], listed(dashed("meta_learnings"))))
    parts.append(F.lit(CARRY_TAIL["zh" if language == "zh" else "en"]))
    if seal_count is not None and max_seals > 0:
        used = F.col(seal_count).cast("string")
        left = (F.lit(max_seals) - F.col(seal_count)).cast("string")
        parts.append(F.concat(F.lit("Snapshots used: "), used, F.lit(f" of {max_seals}, left: "), left))
    return snapshots.withColumn("carryover_text", F.concat_ws("\n", *parts))


def natural_key(name: Column) -> Column:
    """Sort key that compares digit runs as numbers."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.coalesce(r.try_cast("bigint"), F.lit(-1)).alias("n"), F.when(r.rlike(r"^\d"), F.lit("")).otherwise(r).alias("t")))


def _folder_rank(folder: Column) -> Column:
    """Current snapshots first, then retry attempts in natural order."""
    return F.when(folder == "memory", F.array().cast("array<struct<n:bigint,t:string>>")).otherwise(natural_key(folder))


#: Folder names up to which their ranks are sent to all executors.
FEW_NAMES = 100_000

#: Runs of letters and digits, and of anything else: a name found inside another starts and ends within such runs.
_RUN = string.ascii_letters + string.digits


def _classes(text: Column) -> Column:
    """The text with every letter or digit as ``a`` and everything else as ``-``."""
    return F.regexp_replace(F.translate(text, _RUN, "a" * len(_RUN)), "[^a]", "-")


def _shape(text: Column) -> Column:
    """How a wanted text begins: its length, the class of its first run, that run's length, and whether it is the only one."""
    kinds = _classes(text)
    first = F.length(F.regexp_extract(kinds, "^(a+|-+)", 1))
    return F.struct(F.length(text).alias("n"), F.substring(kinds, 1, 1).alias("kind"), first.alias("head"), (first == F.length(text)).alias("only"))


def _runs(kinds: Column) -> Column:
    """The runs of a text's classes as (kind, start, end), found once per name and not for each shape."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def add(seen: Column, run: Column) -> Column:
        end = seen["end"] + F.length(run)
        own = F.struct(F.substring(run, 1, 1).alias("kind"), (seen["end"] + 1).alias("start"), end.alias("end"))
        return F.struct(end.alias("end"), F.concat(seen["runs"], F.array(own)).alias("runs"))

    return F.aggregate(F.regexp_extract_all(kinds, F.lit("a+|-+"), F.lit(0)), F.struct(F.lit(0).alias("end"), none.alias("runs")), add, lambda seen: seen["runs"])


def _places(stem: Column, runs: Column, shapes: Column) -> Column:
    """Parts of a name that could be wanted, as (text, end): where a run ends as the shape's first run does.

    A wanted text of several runs can only start so many characters before the end of a run as its first run is long; one of a
    single run must lie within a run. A part at the end of the name is always offered.
    """
    size = F.length(stem)
    part = lambda i, n: F.struct(F.substr(stem, i, n).alias("text"), (i + n - 1 == size).alias("end"))

    def offered(s: Column) -> Column:
        own = lambda fits: F.filter(runs, lambda r: (r["kind"] == s["kind"]) & fits(r))
        inside = F.flatten(F.transform(own(lambda r: r["end"] - r["start"] + 1 >= s["n"]), lambda r: F.sequence(r["start"], r["end"] - s["n"] + 1)))
        first = lambda r: r["end"] - s["head"] + 1
        ended = F.transform(own(lambda r: (first(r) >= 1) & (first(r) + s["n"] - 1 <= size)), first)
        return F.transform(F.array_union(F.when(s["only"], inside).otherwise(ended), F.array(size - s["n"] + 1)), lambda i: part(i, s["n"]))

    return F.flatten(F.transform(F.filter(shapes, lambda s: (s["n"] > 0) & (s["n"] <= size)), offered))


def _ranked(snapshots: DataFrame) -> DataFrame:
    """Add ``_rank``, found once per folder name where these have been counted to be few, and per row otherwise."""
    rank = _folder_rank(F.col("folder"))
    names = staged(snapshots.select("folder").distinct(), "folders")
    if names.count() > FEW_NAMES:
        return snapshots.withColumn("_rank", rank)
    ranks = names.select(F.col("folder").alias("_folder"), rank.alias("_rank"))
    return snapshots.join(F.broadcast(ranks), F.col("folder") == F.col("_folder"), "left").drop("_folder")


def lookup(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Best snapshot for each requested (question_id, wanted): one row per request that matches.

    File names decide first (same end, then the id without dashes at the end, then anywhere in the name),
    the inner id last; earlier folders win over later ones. Matching is by equality: each file offers the
    parts of its name that have the shape of a requested id (`_places`), reduced to the best file per text before the
    join, so a question with many snapshots is never paired with all its requests.
    """
    plain = requests.select("question_id", "wanted", F.col("wanted").alias("text"), F.lit(True).alias("plain"))
    compact = requests.select("question_id", "wanted", F.replace("wanted", F.lit("-"), F.lit("")).alias("text"), F.lit(False).alias("plain"))
    asked = plain.unionByName(compact)
    # the distinct shapes asked for by a question: a few as a rule, names being short a few thousand at most
    shapes = asked.groupBy("question_id").agg(F.collect_set(_shape(F.col("text"))).alias("_shapes"))
    ranked = _ranked(snapshots)
    files = ranked.withColumn("_runs", _runs(_classes(F.col("stem")))).join(shapes, "question_id")
    cols = ["folder", "stem", "memory_id"]
    offered = files.select("question_id", "_rank", *cols, F.explode(_places(F.col("stem"), F.col("_runs"), F.col("_shapes"))).alias("p")).select(
        "question_id", F.col("p.text").alias("text"), F.col("p.end").alias("end"), "_rank", *cols
    )
    by_name = asked.join(first_by(offered, ["question_id", "text", "end"], ["_rank", "stem"]), ["question_id", "text"])
    how = F.when(F.col("plain") & F.col("end"), 1).when(~F.col("plain") & F.col("end"), 2).when(F.col("plain"), 3)
    named = by_name.withColumn("match", how).filter("match IS NOT NULL").select("question_id", "wanted", "_rank", "match", *cols)
    inner = ranked.select("question_id", F.col("memory_id").alias("wanted"), "_rank", F.lit(3).alias("match"), *cols)
    by_id = first_by(inner, ["question_id", "wanted"], ["_rank", "stem"]).join(requests.select("question_id", "wanted"), ["question_id", "wanted"], "left_semi")
    return first_by(named.unionByName(by_id), ["question_id", "wanted"], ["_rank", "match", "stem"]).drop("_rank")


def next_attempt(folders: DataFrame, index_rows: DataFrame) -> DataFrame:
    """Next retry attempt per question from folder names and index rows; questions with neither are absent (0)."""
    named = folders.select("question_id", F.regexp_extract("folder", r"attempt_(\d+)(?:_|/|$)", 1).try_cast("bigint").alias("attempt"))
    both = named.filter("attempt IS NOT NULL").unionByName(index_rows.select("question_id", F.col("retry_attempt").cast("bigint").alias("attempt")))
    return both.groupBy("question_id").agg((F.max("attempt") + 1).alias("next_attempt"))


def ordered_memories(index_rows: DataFrame) -> DataFrame:
    """Retry memories in (attempt, order, id) order per question; rows without an id are dropped."""
    rows = index_rows.filter(F.coalesce(F.col("memory_id") != "", F.lit(False)))
    return rows.orderBy("question_id", "retry_attempt", "memory_order", "memory_id")


def retry_context(index_rows: DataFrame) -> DataFrame:
    """Lines of the retry section: (question_id, retry_attempt, memory_order, line), in rows.

    Attempts of any length stay distributed; a caller joins the lines of the question it prompts.
    """
    rows = index_rows.filter(F.coalesce(F.col("memory_id") != "", F.lit(False)))
    line = F.concat(F.lit("- memory "), F.col("memory_order").cast("string"), F.lit(": "), F.col("memory_id"))
    heads = rows.select("question_id", "retry_attempt").distinct().select(
        "question_id", "retry_attempt", F.lit(None).cast("bigint").alias("memory_order"),
        F.concat(F.lit("Attempt "), (F.col("retry_attempt") + 1).cast("string"), F.lit(":")).alias("line"),
    )
    return heads.unionByName(rows.select("question_id", "retry_attempt", F.col("memory_order").cast("bigint").alias("memory_order"), line.alias("line")))
