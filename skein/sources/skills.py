"""Skills: Markdown documents with a front matter, and the references beside them.

A document needs a front matter between lines of dashes and a name in it; what lacks either gives a row with a problem
instead of failing the whole scan. References are read in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import is_blank, trimmed

#: Form of a document and of a reference's name (fixed values).
FRONT_MATTER = r"^---\s*\n([\s\S]*?)\n---\s*\n([\s\S]*)$"
REFERENCE_NAME = r"^[a-zA-Z0-9._-]+$"
#: Headings of a prompt (fixed values).
SKILL_HEADING, GUIDE_HEADING, REFERENCES_HEADING, REFERENCE_HEADING = "# 技能: ", "## 技能指南", "## 参考文档", "### "


def _unquoted(value: Column) -> Column:
    quoted = (value.startswith('"') & value.endswith('"') | value.startswith("'") & value.endswith("'")) & (F.length(value) >= 2)
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def front_matter(text: Column) -> Column:
    """Keys and values of the front matter as a map, the last value of a key winning; null if there is none.

    Blank lines and comments are skipped, a key ends at the first colon, and matching quotes around a value go.
    """
    block = F.regexp_extract(text, FRONT_MATTER, 1)
    lines = F.filter(F.transform(F.split(block, r"\r\n|\r|\n"), trimmed), lambda x: (x != "") & ~x.startswith("#") & (F.locate(":", x) > 1))
    pairs = F.transform(lines, lambda x: F.struct(trimmed(F.substring_index(x, ":", 1)).alias("key"), _unquoted(trimmed(F.substring(x, F.locate(":", x) + 1, F.length(x)))).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.when(text.rlike(FRONT_MATTER), F.map_from_entries(last))


def parsed(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` with ``name, description, content, problem``."""
    found = documents.withColumn("__front", front_matter(F.col(text)))
    name = F.element_at("__front", F.lit("name"))
    problem = F.when(F.col("__front").isNull(), "no front matter").when(is_blank(name), "no name")
    good = problem.isNull()
    return found.select(*documents.columns, F.when(good, name).alias("name"), F.when(good, F.coalesce(F.element_at("__front", F.lit("description")), F.lit(""))).alias("description"), F.when(good, trimmed(F.regexp_extract(text, FRONT_MATTER, 2))).alias("content"), problem.alias("problem"))


def read_skills(spark: SparkSession, *folders: str) -> DataFrame:
    """All skills below the first folder that has any: ``name, description, content, problem, path``."""
    for folder in folders:
        try:
            rows = spark.read.text(f"{folder}/*/SKILL.md", wholetext=True).withColumn("path", F.input_file_name())
        except Exception:  # the path does not exist: try the next one
            continue
        return parsed(rows, "value").drop("value")
    raise FileNotFoundError("no skill in " + ", ".join(folders))


def read_references(spark: SparkSession, folder: str) -> DataFrame:
    """All references of all skills of a folder: ``skill, ref, content``; names outside the permitted form are left out."""
    rows = spark.read.text(f"{folder}/*/reference/*.md", wholetext=True).withColumn("path", F.input_file_name())
    named = rows.select(F.regexp_extract("path", r"([^/]+)/reference/[^/]+$", 1).alias("skill"), F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("ref"), F.col("value").alias("content"))
    return named.where(F.col("ref").rlike(REFERENCE_NAME))


def listed(skills: DataFrame) -> DataFrame:
    return skills.where("problem is null").select("name", "description").orderBy("name")


def reference(references: DataFrame, skill: str, name: str) -> DataFrame:
    """One reference; a name that is blank or outside the permitted form finds nothing."""
    return references.where((F.col("skill") == skill) & (F.col("ref") == name) & F.lit(name).rlike(REFERENCE_NAME))


def prompts(skills: DataFrame, references: DataFrame) -> DataFrame:
    """``name, prompt``: title, description, guide and all references in the order of their names."""
    gathered = references.groupBy("skill").agg(F.array_sort(F.collect_list(F.struct("ref", "content"))).alias("refs"))
    joined = skills.where("problem is null").join(gathered, F.col("name") == F.col("skill"), "left")
    part = F.array_join(F.transform("refs", lambda x: F.concat(F.lit(REFERENCE_HEADING), x["ref"], F.lit("\n\n"), x["content"], F.lit("\n\n"))), "")
    head = F.concat(F.lit(SKILL_HEADING), "name", F.lit("\n\n"), "description", F.lit(f"\n\n---\n\n{GUIDE_HEADING}\n\n"), "content", F.lit("\n\n"))
    return joined.select("name", F.concat(head, F.when(F.size("refs") > 0, F.concat(F.lit(f"{REFERENCES_HEADING}\n\n"), part)).otherwise("")).alias("prompt"))


def tool_arguments(text: Column) -> Column:
    """What a tool call names, as a struct ``skill, reference``: from JSON, from ``skill:reference``, or a bare skill; null for blank text."""
    plain = trimmed(text)
    colon = F.locate(":", plain)
    json = F.struct(F.get_json_object(plain, "$.skill_name").alias("skill"), F.get_json_object(plain, "$.reference_name").alias("reference"))
    pair = F.struct(trimmed(F.substring_index(plain, ":", 1)).alias("skill"), trimmed(F.substring(plain, colon + 1, F.length(plain))).alias("reference"))
    bare = F.struct(plain.alias("skill"), F.lit(None).cast("string").alias("reference"))
    return F.when(~is_blank(text), F.when(plain.startswith("{"), json).when(colon > 0, pair).otherwise(bare))
