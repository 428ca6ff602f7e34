"""Templates: variables, conditional questions and instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tomeflow import fixed_values as V
from tomeflow.functions import text as X
from tomeflow.operators.sizes import small

PLACEHOLDER = r"(?<!\\)\{(?![:.#])([^{}]*\S[^{}]*)\}"
VARIABLES = "array<struct<key:string,type:string,label:string,value:string>>"


def extract_variables(subsections: DataFrame) -> DataFrame:
    """One row per placeholder in reading order; a repeated label gets key, key_2, key_3.

    The numbering window groups the placeholders of one body only, so a group is bounded by a single text value.
    """
    found = F.regexp_extract_all("body", F.lit(PLACEHOLDER), F.lit(1))
    rows = subsections.filter(F.col("body").contains("{")).select("id", F.posexplode(found).alias("position", "raw"))
    raw = F.trim("raw")
    listed = F.lower(F.trim(F.split_part(raw, F.lit(":"), F.lit(1)))).eqNullSafe("list") & raw.contains(":")
    rows = rows.withColumn("type", F.when(listed, "list").otherwise("string"))
    rows = rows.withColumn("label", F.when(listed, F.trim(F.regexp_replace(raw, "^[^:]*:", ""))).otherwise(raw))
    rows = rows.withColumn("base", F.coalesce(F.nullif(X.slug(F.col("label"), "_"), F.lit("")), F.lit("var")))
    n = F.row_number().over(W.partitionBy("id", "base").orderBy("position"))
    key = F.when(n == 1, F.col("base")).otherwise(F.concat_ws("_", "base", n.cast("string")))
    return rows.select("id", "position", key.alias("key"), "type", "label")


def variables_of(subsections: DataFrame) -> DataFrame:
    """Variables of each subsection as one ordered array."""
    rows = extract_variables(subsections)
    item = F.struct("position", F.struct("key", "type", "label", F.lit(None).cast("string").alias("value")).alias("v"))
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("variables"))


def substitute(body: Column, variables: Column) -> Column:
    """Put values in place of placeholders of the same label; empty values leave the placeholder."""
    tokens = F.regexp_extract_all(body, F.lit(r"\{[^{}]*\}|[^{]+|\{"), F.lit(0))

    def one(t: Column) -> Column:
        label = F.trim(F.regexp_replace(t, "^\\{|\\}$", ""))
        value = F.get(F.filter(variables, lambda v: v["label"] == label), F.lit(0))["value"]
        return F.when(t.rlike(r"^\{[^{}]+\}$") & (F.coalesce(value, F.lit("")) != ""), value).otherwise(t)

    return F.array_join(F.transform(tokens, one), "")


def unescape(body: Column) -> Column:
    return F.replace(F.replace(body, F.lit("\\{"), F.lit("{")), F.lit("\\}"), F.lit("}"))


def set_values(variables_json: Column, values: Column) -> Column:
    """Merge a key → value map into the stored variable JSON; unknown keys are ignored, order stays."""
    current = F.from_json(variables_json, VARIABLES)
    return F.to_json(
        F.transform(
            current,
            lambda v: F.struct(v["key"].alias("key"), v["type"].alias("type"), v["label"].alias("label"),
                               F.when(F.map_contains_key(values, v["key"]), F.try_element_at(values, v["key"])).otherwise(v["value"]).alias("value")),
        )
    )


def prefill(label: Column, value: Column, labels: dict[str, str] | None = None) -> Column:
    """Value of the last instance field whose display label occurs in the variable label; else the given value. ``labels`` (field
    to display label, in order; without: ``fixed_values.INSTANCE_LABELS``) names the fields, which have to be columns."""
    out = value
    for field, name in (V.INSTANCE_LABELS if labels is None else labels).items():
        out = F.when(F.lower(label).contains(name.lower()) & (F.coalesce(F.col(field), F.lit("")) != ""), F.col(field)).otherwise(out)
    return out


def conditional_answer(instructions: Column) -> Column:
    """True for (YES), false for (NO), null without a token; case matters."""
    token = F.regexp_extract(instructions, r"\((YES|NO)\)", 1)
    return F.when(token == "YES", True).when(token == "NO", False)


def question_names(questions: DataFrame) -> DataFrame:
    """Normalised subsection name → first question that governs it."""
    names = questions.select("position", "key", "label", "page", F.explode("subsections").alias("n"))
    first = names.groupBy(F.lower(F.trim("n")).alias("norm_name")).agg(F.min(F.struct("position", "key", "label", "page")).alias("q"))
    return first.select("norm_name", "q.key", "q.label", "q.page")


def question_matches(subsections: DataFrame, questions: DataFrame) -> DataFrame:
    """Subsections with the question that governs them. The question list is configuration and counted before it is broadcast."""
    names = small(question_names(questions).withColumnRenamed("label", "question_label").withColumnRenamed("key", "question_key"))
    return subsections.withColumn("norm_name", F.lower(F.trim("name"))).join(names, "norm_name").drop("norm_name")


def template_notes(subsections: DataFrame, questions: DataFrame) -> DataFrame:
    """Sentence naming the question and required answer, and the comma list of variable labels."""
    asked = subsections.withColumn("answer", conditional_answer(F.col("instructions")))
    q = question_matches(asked.filter(F.col("answer").isNotNull()), questions).select(
        "id",
        F.concat(
            F.lit("Note: Writers will be asked “"), "question_label", F.lit("”, and will see this section if they answer: "),
            F.when(F.col("answer"), "Yes").otherwise("No"), F.lit("."),
        ).alias("note"),
    )
    v = extract_variables(subsections).groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]), ", ").alias("labels")
    )
    return subsections.select("id").join(q, "id", "left").join(v, "id", "left").select(
        "id", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("labels", F.lit("")).alias("labels")
    )


def merge_answers(current: Column, page_keys: Column, given: Column) -> Column:
    """Answers after saving one page: its keys come from ``given`` (unanswered ones drop), other keys stay."""
    others = F.map_filter(current, lambda k, v: ~F.array_contains(page_keys, k))
    mine = F.map_filter(given, lambda k, v: F.array_contains(page_keys, k) & v.isNotNull())
    return F.map_concat(others, mine)


def yes_no(value: Column) -> Column:
    return F.when(value, "Yes").when(~value, "No").otherwise("Not answered")


def instantiate(instances: DataFrame, tree: DataFrame, questions: DataFrame) -> DataFrame:
    """Template rows copied into each instance (``id``, ``parent``, ``answers`` map).

    Rows with a (YES)/(NO) token come along only when the instance's answer equals it; rows with a token but no
    question are left out.
    """
    rows = tree.withColumn("token", conditional_answer(F.col("instructions"))).withColumn("norm_name", F.lower(F.trim("name")))
    names = small(question_names(questions).select("norm_name", F.col("key").alias("question_key")))
    rows = rows.join(names, "norm_name", "left").filter(F.col("token").isNull() | F.col("question_key").isNotNull()).drop("norm_name")
    inst = instances.select(F.col("id").alias("instance_id"), F.col("parent").alias("document_id"), "answers")
    both = rows.join(inst, "document_id")
    agrees = F.try_element_at("answers", F.col("question_key")) == F.col("token")
    return both.filter(F.col("token").isNull() | F.coalesce(agrees, F.lit(False))).drop("answers", "token", "question_key")
