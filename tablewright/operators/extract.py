"""Use cases out of free-text responses: ``(title, description, impact, effort)`` rows.

Every response is taken apart inside its own row with array functions, so the
text is never shuffled; only the explode at the end makes more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.sources.text import BLANKS

CASE = "struct<title:string,description:string,impact:string,effort:string>"
_LINES = "array<struct<line:string,title:boolean,label:string,level:string>>"
# What a case gets for a part that its text does not give.
NO_TITLE = "Untitled Use Case"
NO_DESCRIPTION = "No description provided"
NO_LEVEL = "Medium"
# The case reported for a text without any.
DEFAULT_CASE = {
    "title": "Data-Driven Decision Making",
    "description": "Implement a framework for making decisions based on data insights.",
    "impact": "High",
    "effort": "Medium",
}


def json_cases(text: Column) -> Column:
    """Array of cases between the first ``[`` and the last ``]``; null when that is not a JSON list of objects."""
    listed = F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))
    # Wrapped in an object, anything behind the end of the list is a syntax error.
    wrapped = F.concat(F.lit('{"cases":'), listed, F.lit("}"))
    return F.from_json(wrapped, f"struct<cases:array<{CASE}>>", {"allowSingleQuotes": "false"})["cases"]


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _after_colon(line: Column) -> Column:
    return F.when(line.contains(":"), _strip(F.regexp_replace(line, r"(?s)^[^:]*:", ""))).otherwise(line)


def _level(low: Column) -> Column:
    return F.when(low.contains("high"), "High").when(low.contains("medium"), "Medium").when(low.contains("low"), "Low")


def _is_title(line: Column) -> Column:
    return line.rlike(r"^[0-9]") & F.substring(line, 1, 3).contains(".")


def _last(lines: Column) -> Column:
    return F.get(lines, F.size(lines) - 1)


def _marked(line: Column, low: Column) -> Column:
    """A line with what it is: title, description (d), impact (i), effort (e) or neither, and its level."""
    level = _level(low)
    label = F.when(level.isNull(), "").when(low.contains("impact"), "i").when(low.contains("effort"), "e").otherwise("")
    # An impact line without a level word is no effort line either.
    label = F.when(low.contains("description"), "d").when(low.contains("impact") & level.isNull(), "").otherwise(label)
    return F.struct(line.alias("line"), _is_title(line).alias("title"), label.alias("label"), level.alias("level"))


def _case(lines: Column, title_at: Column) -> Column:
    """One case from its marked lines; ``title_at`` is the 1-based place of the title among them.

    Only the first case has lines before its title.
    """
    before = F.slice(lines, F.lit(1), title_at - 1)
    after = F.slice(lines, title_at + 1, F.size(lines))
    title = _strip(F.regexp_replace(F.get(lines, title_at - 1)["line"], r"(?s)^[^.]*\.", ""))

    def labelled(part: Column, label: str) -> Column:
        return F.filter(part, lambda x: x["label"] == label)

    described_before = F.exists(before, lambda x: x["label"] == "d")
    described = F.concat(labelled(before, "d"), labelled(after, "d"))
    description = _after_colon(F.coalesce(_last(described), F.get(after, F.lit(0)))["line"])
    # The first line below the title is the description unless one came earlier.
    rest = F.when(described_before, after).otherwise(F.slice(after, F.lit(2), F.size(after)))
    free = F.concat(before, rest)
    return F.struct(
        title.alias("title"),
        F.coalesce(description, F.lit(NO_DESCRIPTION)).alias("description"),
        F.coalesce(_last(labelled(free, "i"))["level"], F.lit(NO_LEVEL)).alias("impact"),
        F.coalesce(_last(labelled(free, "e"))["level"], F.lit(NO_LEVEL)).alias("effort"),
    )


def _add_lines(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_lines`` (trimmed, not empty, marked) and ``_starts`` (1-based places of titles)."""
    lines = F.filter(F.transform(F.split(text, "\n"), _strip), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    marked = F.transform(pairs, lambda p: _marked(p["line"], p["low"]))
    places = F.filter(F.transform("_lines", lambda x, i: F.when(x["title"], i + 1)), lambda p: p.isNotNull())
    return df.withColumn("_lines", F.coalesce(marked, F.array().cast(_LINES))).withColumn("_starts", places)


def line_cases(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_cases``: cases of numbered lists with labelled lines, missing parts filled.

    A line that starts with a digit and has a dot among its first three
    characters opens a case.  The last line naming a description gives the
    description, else the first line below the title.  The last other line
    naming impact (or else effort) with a level word gives that level.
    """
    work = _add_lines(df, col(text))

    def build(start: Column, i: Column) -> Column:
        first = F.when(i == 0, F.lit(1)).otherwise(start)
        end = F.coalesce(F.get("_starts", i + 1), F.size("_lines") + 1)
        return F.struct(
            F.slice("_lines", first, end - first).alias("lines"), (start - first + 1).alias("title_at")
        )

    blocks = F.transform("_starts", build)
    cases = F.transform("_blocks", lambda b: _case(b["lines"], b["title_at"]))
    return (
        work.withColumn("_blocks", blocks).withColumn("_cases", cases).drop("_lines", "_starts", "_blocks")
    )


def extract_cases(df: DataFrame, text: str = "text", keep: list[str] | None = None, fill_json: bool = False) -> DataFrame:
    """Cases of every response: ``(keep…, case_no, title, description, impact, effort, source)``.

    A JSON list is taken as it is (``fill_json`` fills its gaps); otherwise the
    lines are read; a text without any case gives one default case.
    ``source`` is ``json``, ``lines`` or ``default``.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    # Only a text that is no JSON list is read line by line.
    tried = df.withColumn("_json", json_cases(col(text)))
    parsed = line_cases(tried.withColumn(text, F.when(F.col("_json").isNull(), col(text))), text)
    default = F.array(F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_CASE.items()]))
    use_json = F.col("_json").isNotNull()
    use_lines = F.size("_cases") > 0
    cases = F.when(use_json, F.col("_json")).when(use_lines, F.col("_cases")).otherwise(default)
    source = F.when(use_json, "json").when(use_lines, "lines").otherwise("default")
    rows = parsed.select(*[col(k) for k in keep], source.alias("source"), F.posexplode(cases).alias("pos", "case"))
    parts = {p: F.col(f"case.{p}") for p in ("title", "description", "impact", "effort")}
    if fill_json:
        parts["title"] = F.coalesce(parts["title"], F.lit(NO_TITLE))
        parts["description"] = F.coalesce(parts["description"], F.lit(NO_DESCRIPTION))
        parts["impact"] = F.coalesce(parts["impact"], F.lit(NO_LEVEL))
        parts["effort"] = F.coalesce(parts["effort"], F.lit(NO_LEVEL))
    return rows.select(
        *[col(k) for k in keep], (F.col("pos") + 1).alias("case_no"), *[c.alias(p) for p, c in parts.items()], "source"
    )


def join_texts(texts: Column) -> Column:
    """All texts of an array or map column joined with a blank line, within the row."""
    return F.array_join(texts, "\n\n")


def tag_counts(cases: DataFrame) -> DataFrame:
    """Cases per impact and effort."""
    return cases.groupBy("impact", "effort").agg(F.count("*").alias("count"))
