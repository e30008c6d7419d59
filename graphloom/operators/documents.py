"""Decisions as numbered markdown documents, and documents by others as decisions.

decisions: (repo, id, title, status, decided_at, context, decision, consequences, alternatives, superseded_by,
anchors array<struct<path, node_id, kind>>, paths array<string>, supersedes array<string>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decision_id

#: What a status may be, and the sections of prose, in order.
STATUSES = ("proposed", "accepted", "rejected", "deprecated", "superseded")
PROSE = ("context", "decision", "consequences", "alternatives")
NEEDED = ("context", "decision")
#: What ends a document of ours; files with it are replaced by the next export, others are left alone.
MARK = "<!-- graphloom export: "


def _section(name: str, body: Column) -> Column:
    """Null if the body is."""
    return F.concat(F.lit(f"## {name.capitalize()}\n\n"), body, F.lit("\n\n"))


def _listed(items: Column) -> Column:
    """A line for each, null without any."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def exported(decisions: DataFrame) -> DataFrame:
    """(repo, number, file, text) of decisions, numbered by id within their repository, so equal input gives equal files.

    Decisions of one id follow in order of their other columns; equal ones are numbered together, and then dealt out.
    Lines of prose that would read as headings are escaped.
    """
    order = ["id", *sorted(c for c in decisions.columns if c not in ("repo", "id"))]
    kinds = decisions.groupBy("repo", *order).agg(F.count(F.lit(1)).alias("_n"))
    kinds = kinds.withColumn("_last", F.sum("_n").over(Window.partitionBy("repo").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = kinds.withColumn("number", F.explode(F.sequence((F.col("_last") - F.col("_n") + 1).cast("int"), F.col("_last").cast("int"))))
    status = F.concat("status", F.coalesce(F.concat(F.lit(" (superseded by "), "superseded_by", F.lit(")")), F.lit("")))
    plain = {c: F.regexp_replace(c, r"(?m)^(\s*)#", r"$1\\#") for c in PROSE}
    prose = [_section(c, F.coalesce(plain[c], F.lit("")) if c in NEEDED else F.nullif(plain[c], F.lit(""))) for c in PROSE]
    anchors = F.transform(F.coalesce("anchors", F.array()), lambda a: F.concat(F.coalesce(F.nullif(a["path"], F.lit("")), a["node_id"]), F.lit(" ("), F.coalesce(a["kind"], F.lit("node")), F.lit(")")))
    governs = F.concat(anchors, F.coalesce("paths", F.array().cast("array<string>")))
    text = F.concat(
        F.format_string("# %d. %s\n\nDate: %s\n\n", "number", "title", F.col("decided_at").cast("string")),
        _section("status", status),
        *(F.coalesce(p, F.lit("")) for p in (*prose, _section("governs", _listed(governs)), _section("supersedes", _listed(F.coalesce("supersedes", F.array().cast("array<string>")))))),
        F.lit(MARK),
        "id",
        F.lit(" -->\n"),
    )
    file = F.format_string("%04d-%s.md", "number", F.regexp_replace("id", "^adr:", ""))
    return rows.select("repo", "number", file.alias("file"), text.alias("text"))


def parsed(docs: DataFrame) -> DataFrame:
    """docs (file, text, ..) with title, status, decided_at and the prose of each; ok: title, status and decision are there.

    The first heading of a name counts; a section's lines are joined by spaces; the date stands before the first section.
    """
    lines = docs.withColumn("_lines", F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")))
    lines = lines.withColumn("_heads", F.transform("_lines", lambda x: F.lower(F.trim(F.regexp_extract(x, r"^##\s+(.+)$", 1)))))
    title = F.try_element_at(F.filter("_lines", lambda x: x.rlike(r"^#\s+.")), F.lit(1))
    none = F.size("_heads") + 1

    def next_head(start: Column) -> Column:
        """Where the first heading from start on stands."""
        found = F.array_position(F.transform(F.slice("_heads", start, F.size("_heads")), lambda h: h != ""), True)
        return F.when(found > 0, start + found - 1).otherwise(none)

    def section(name: str) -> Column:
        at = F.array_position("_heads", name)
        begin = (at + 1).cast("int")
        body = F.slice("_lines", begin, (next_head(begin) - begin).cast("int"))
        kept = F.filter(F.transform(body, lambda x: F.regexp_replace(x, r"^\s+", "")), lambda x: (x != "") & ~x.startswith("<!--"))
        return F.when(at > 0, F.nullif(F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"^\\#", "#")), " "), F.lit("")))

    head = F.slice("_lines", F.lit(1), (next_head(F.lit(1)) - 1).cast("int"))
    day = F.try_element_at(F.filter(head, lambda x: x.rlike(r"^Date:\s*\d{4}-\d{2}-\d{2}\s*$")), F.lit(-1))
    word = F.lower(F.regexp_extract(section("status"), r"^[^\s(]*", 0))
    out = lines.select(
        *docs.columns,
        F.nullif(F.trim(F.regexp_replace(title, r"^#\s+(\d+\.\s+)?", "")), F.lit("")).alias("title"),
        F.when(word.isin(*STATUSES), word).alias("status"),
        F.nullif(F.regexp_extract(day, r"\d{4}-\d{2}-\d{2}", 0), F.lit("")).alias("decided_at"),
        *(section(c).alias(c) for c in PROSE),
    )
    return out.withColumn("ok", F.col("title").isNotNull() & F.col("status").isNotNull() & F.col("decision").isNotNull())


def imported(docs: DataFrame, taken: DataFrame, fallback: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New decisions, files that are none, and files whose id is taken (id) or an earlier file's, so importing twice adds nothing.

    A document without a date gets fallback.
    """
    rows = parsed(docs)
    good = rows.where("ok").withColumn("decided_at", F.coalesce("decided_at", F.lit(fallback)))
    good = good.withColumn("id", decision_id(F.col("decided_at"), F.col("title"))).join(taken.select("id", F.lit(True).alias("_taken")).distinct(), "id", "left")
    good = good.withColumn("_new", F.col("_taken").isNull() & (F.expr("row_number() over (partition by id order by file)") == 1))
    new = good.where("_new").select("id", "title", "status", F.coalesce("context", F.lit("")).alias("context"), "decision", "consequences", "alternatives", "decided_at", F.lit("human").alias("decided_by"), "file")
    return new, rows.where("not ok").select("file"), good.where("not _new").select("file", "id")
