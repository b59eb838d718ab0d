"""Rule scores of candidates: features of the question and the statement, and a table of rules over them.

Every rule is a condition and an amount. They are evaluated as plain columns, so a score costs one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import field_list, group_fields, has_spaced_literal, normal_sql, word_count
from .pool import with_support

# What a question (lower case) and a statement (lower case, one blank) are searched for.
QUESTION = {
    "count_word": r"\bhow many\b|\bcount\b", "number": r"\bnumber\b", "number_of_time": r"\bnumber\s+of\s+(years?|times?)\b",
    "average": r"\b(average|avg|mean)\b", "maximum": r"\b(maximum|max|highest|oldest|most|greatest|largest)\b",
    "minimum": r"\b(minimum|min|lowest|youngest)\b", "oldest": r"\boldest\b", "youngest": r"\byoungest\b",
    "superlative": r"\b(most|greatest|largest)\b", "not_used": r"\bnot\s+used\b", "us_territory": "us territory", "enrollment_id": r"\benrollment\s+id\b",
    "entity_count": r"\bwho\s+participated\b|\bnumber\s+of\b.*\b(winners?|players?|students?|people|owners?)\b.*\bwho\b",
    "entity_filter": r"\b(who|that|which)\s+have\b|\bgone\s+through\b|\bany\s+(friends?|treatments?)\b",
    "speaks": r"\b(use|uses|speak|speaks|spoken)\b", "official": "official", "each": r"\b(each|per)\b", "by": r"\bby\b",
    "done_by": r"\b(not\s+used|used|written|composed|sung|performed|owned|created)\s+by\b", "order": r"\b(order|ordered|sort|sorted)\b",
    "asks_number": r"\b(and|with)\s+(the\s+)?(number|count|total)\b",
}
STATEMENT = {
    "count": r"\bcount\s*\(", "count_star": r"\bcount\s*\(\s*\*\s*\)", "count_distinct": r"\bcount\s*\(\s*distinct\b", "avg": r"\bavg\s*\(",
    "max": r"\bmax\s*\(", "min": r"\bmin\s*\(", "sum": r"\bsum\s*\(", "group": r"\bgroup\s+by\b", "order": r"\border\s+by\b", "join": r"\bjoin\b",
    "left_join": r"\bleft\s+(outer\s+)?join\b", "limit": r"\blimit\b", "desc": r"\bdesc\b", "asc": r"\basc\b", "dated": "(date|year|birth|born)",
    "anti": r"\bnot\s+in\s*\(|\bnot\s+exists\b", "is_null": r"\bis\s+null\b", "member": r"\bin\s*\(|\bexists\b|\bdistinct\b",
    "isofficial": "isofficial", "governmentform": "governmentform", "enrollment": "enrollment", "where": r"\bwhere\b", "distinct": r"\bdistinct\b",
}
# How far each source is relied on, and names of columns that hold text.
RELIABILITY = {"embedrag": 5.0, "bm25rag": 4.0, "lora_rag": 3.0, "promptonly": 1.0, "loraonly_ep3": 0.5}
_TEXT_LIKE = r"\b(name|text|title|first_name|last_name|fname|lname)\b"


@dataclass(frozen=True)
class Rule:
    name: str
    applies: Column
    amount: Column


def question_features(q: Column) -> dict[str, Column]:
    """Features of a question in lower case."""
    f = {f"q_{k}": q.rlike(p) for k, p in QUESTION.items()}
    f["q_words"] = word_count(q)
    return f


def statement_features(s: Column, sql: Column, chosen: Column, grouped: Column) -> dict[str, Column]:
    """Features of a statement in normal form, as written, and of its field and group lists."""
    f = {f"s_{k}": s.rlike(p) for k, p in STATEMENT.items()}
    return f | {
        "s_words": word_count(s), "s_select_count": chosen.rlike(STATEMENT["count"]), "s_select_comma": chosen.contains(","), "s_select_text": chosen.rlike(_TEXT_LIKE),
        "s_select_items": F.when(chosen != "", F.size(F.split(chosen, ","))).otherwise(0), "s_joins": F.regexp_count(s, F.lit(STATEMENT["join"])),
        "s_group_id": grouped.rlike(r"\b\w*id\b"), "s_group_name": grouped.rlike(r"\bname\b"),
        "s_spaced": F.coalesce(has_spaced_literal(sql), F.lit(False)),
    }


def rules() -> list[Rule]:
    c, n = F.col, F.lit
    desc = c("s_order") & c("s_desc") & c("s_limit")
    asc = c("s_order") & c("s_asc") & c("s_limit")
    count = c("q_count_word") | (c("q_number") & ~c("q_number_of_time"))
    grouping = c("q_each") | (c("q_by") & ~c("q_done_by"))
    strength = F.when(c("q_each"), 1.5).otherwise(0.75)
    found_max = c("s_max") | desc | (c("q_oldest") & asc & c("s_dated"))
    found_min = c("s_min") | asc | (c("q_youngest") & desc & c("s_dated"))
    signed = lambda good, plus, minus: F.when(good, n(plus)).otherwise(n(minus))
    reliability = n(0.0)
    for name, value in RELIABILITY.items():
        reliability = F.when(c("source") == name, value).otherwise(reliability)
    per_count = count & c("q_each") & c("s_count")
    ranked = c("q_superlative") & c("s_count") & c("s_group") & desc
    repaired, ok = c("repaired") == 1, c("ok")
    short = c("q_words") <= 8
    return [
        Rule("execution", n(True), signed(ok, 10.0, -10.0)),
        Rule("source_reliability", n(True), reliability),
        Rule("repair_variant", repaired, F.when(~ok, -2.0).when(~c("original_ok"), 1.0).otherwise(0.25)),
        Rule("repair_spaced_literal", repaired & c("s_spaced"), n(-2.0)),
        Rule("repair_guard", ~repaired & ok & c("repair_available") & c("repair_ok"), n(0.25)),
        Rule("keyword_count", count, signed(c("s_count"), 2.0, -3.0)),
        Rule("keyword_average", c("q_average"), signed(c("s_avg"), 2.0, -2.5)),
        Rule("keyword_maximum", c("q_maximum"), signed(found_max, 2.0, -2.5)),
        Rule("keyword_minimum", c("q_minimum"), signed(found_min, 2.0, -2.5)),
        Rule("keyword_group", grouping, F.when(c("s_group"), strength).otherwise(-strength)),
        Rule("count_each_left_join", per_count & c("s_left_join"), n(0.75)),
        Rule("count_each_inner_join", per_count & ~c("s_left_join") & c("s_join") & c("s_group"), n(-0.5)),
        Rule("keyword_order", c("q_order"), signed(c("s_order"), 1.5, -1.5)),
        Rule("mismatch_ranking_outputs_count", c("q_superlative") & c("s_select_count") & c("s_select_comma") & ~c("q_asks_number"), n(-2.0)),
        Rule("ranking_group_by_id", ranked & c("s_group_id"), n(0.75)),
        Rule("ranking_group_by_name", ranked & ~c("s_group_id") & c("s_group_name"), n(-0.75)),
        Rule("not_used_antijoin", c("q_not_used") & c("s_anti"), n(1.0)),
        Rule("not_used_left_join_null", c("q_not_used") & ~c("s_anti") & c("s_left_join") & c("s_is_null"), n(-0.5)),
        Rule("mismatch_us_territory_column", c("q_us_territory") & ~c("s_governmentform"), n(-2.0)),
        Rule("mismatch_enrollment_id_column", c("q_enrollment_id") & ~c("s_enrollment"), n(-2.0)),
        Rule("mismatch_entity_count_distinct", c("q_entity_count") & c("s_count_star") & ~c("s_count_distinct"), n(-1.25)),
        Rule("mismatch_avg_join_duplicates", c("q_entity_filter") & c("s_avg") & c("s_join") & ~c("s_member"), n(-2.0)),
        Rule("mismatch_unasked_official_filter", c("q_speaks") & ~c("q_official") & c("s_isofficial"), n(-2.0)),
        Rule("mismatch_count_select_text", count & ~c("s_count") & c("s_select_text"), n(-2.0)),
        Rule("mismatch_simple_count_complex_sql", count & ~grouping & (c("q_words") <= 12) & c("s_join") & c("s_group") & c("s_order") & c("s_limit"), n(-2.0)),
        Rule("mismatch_long_sql_short_question", short & (c("s_words") >= 50), F.when(c("s_words") >= 80, -1.0).otherwise(-0.5)),
        Rule("empty_result", ok & c("empty"), n(-0.5)),
        Rule("result_consistency", ok & (c("support") > 1), F.least(n(2.0), 0.5 * (c("support") - 1))),
    ]


def featured(pool: DataFrame, items: DataFrame) -> DataFrame:
    """Pool rows with their support, question and features."""
    asked = items.filter("idx IS NOT NULL").select("idx", "question").dropDuplicates(["idx"])
    # normal forms first, as columns of their own, so that they are made once for all features
    asked = asked.select("idx", "question", F.lower("question").alias("q")).withColumns(question_features(F.col("q"))).drop("q")
    flags = [c for c in asked.columns if c.startswith("q_")]
    joined = normal_forms(with_support(pool)).join(asked, "idx", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0) if c == "q_words" else F.lit(False)) for c in flags})
    return joined.withColumns(statement_features(*_forms())).drop("s", "chosen", "grouped")


def _forms() -> tuple[Column, ...]:
    return F.col("s"), F.col("sql"), F.col("chosen"), F.col("grouped")


def normal_forms(df: DataFrame) -> DataFrame:
    normal = df.withColumn("s", normal_sql(F.col("sql")))
    return normal.withColumns({"chosen": field_list(F.col("s")), "grouped": group_fields(F.col("s"))})


def scored(pool: DataFrame, items: DataFrame) -> DataFrame:
    """Pool rows with ``rule_score`` and the ``breakdown`` that makes it up."""
    table = rules()
    each = F.array(*[F.when(r.applies, F.struct(F.lit(r.name).alias("rule"), r.amount.cast("double").alias("delta"))) for r in table])
    total = sum((F.when(r.applies, r.amount).otherwise(0.0) for r in table), F.lit(0.0))
    return featured(pool, items).withColumns({"rule_score": F.round(total, 4), "breakdown": F.filter(each, lambda x: x.isNotNull())})


def structures(df: DataFrame) -> DataFrame:
    """Statements with their structure as text in ``structure``."""
    f = statement_features(*_forms())
    shown = {"select_items": "s_select_items", "joins": "s_joins", "where": "s_where", "group_by": "s_group", "order_by": "s_order", "limit": "s_limit",
             "distinct": "s_distinct", "count": "s_count", "avg": "s_avg", "sum": "s_sum", "max": "s_max", "min": "s_min", "not_in_or_exists": "s_anti"}
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), f[v].cast("string")) for k, v in shown.items()])
    return normal_forms(df).withColumn("structure", text).drop("s", "chosen", "grouped")


# Kinds of wrong candidates, hardest first.
KINDS = ("hard_supported_executable_wrong", "hard_same_shape_executable_wrong", "hard_non_empty_executable_wrong", "hard_empty_executable_wrong",
         "hard_executable_wrong", "other_semantic_wrong", "easy_execution_error")


def candidate_kinds(pool: DataFrame) -> DataFrame:
    """Every candidate with its support, the shape of its result and its kind."""
    rows = F.from_json("result", "array<array<string>>")
    shape = F.when(rows.isNotNull(), F.concat_ws("x", F.size(rows), F.when(F.size(rows) > 0, F.size(F.get(rows, 0))).otherwise(0))).otherwise("none")
    typed = with_support(pool).withColumn("shape", shape)
    right = typed.filter("labeled AND correct").select("idx", "shape").distinct().withColumn("right_shape", F.lit(True))
    joined = typed.join(right, ["idx", "shape"], "left")
    wrong = F.col("labeled") & F.col("ok") & ~F.col("correct")
    kind = (
        F.when(wrong & (F.col("support") >= 2), KINDS[0]).when(wrong & F.coalesce("right_shape", F.lit(False)), KINDS[1])
        .when(wrong & ~F.col("empty"), KINDS[2]).when(wrong, KINDS[3]).when(F.col("labeled") & F.col("ok") & F.col("correct"), "positive_execution_correct")
        .when(F.col("ok") & ~F.col("labeled"), KINDS[4]).when(~F.col("ok"), KINDS[6]).otherwise(KINDS[5]))
    return joined.withColumn("kind", kind).drop("right_shape")


def kind_priority(kind: Column) -> Column:
    out = F.lit(999)
    for place, name in enumerate(KINDS):
        out = F.when(kind == name, place).otherwise(out)
    return out




def type_profile(result: Column, rows: int = 5) -> Column:
    """Types of the cells of the first rows, counted: "types=int:2,text:3"."""
    cells = F.flatten(F.slice(F.try_variant_get(F.try_parse_json(result), "$", "array<array<variant>>"), 1, rows))
    raw = F.transform(cells, F.schema_of_variant)
    name = lambda t: (F.when(t == "VOID", "null").when(t == "BOOLEAN", "bool").when(t.isin("BIGINT", "INT"), "int")
                      .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "float").when(t == "STRING", "text").otherwise("other"))
    names = F.transform(raw, name)
    kinds = ("bool", "float", "int", "null", "other", "text")
    part = lambda k: F.when(F.exists(names, lambda x: x == k), F.concat(F.lit(f"{k}:"), F.size(F.filter(names, lambda x: x == k)).cast("string")))
    parts = F.array(*[part(k) for k in kinds])
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull()), ",")
    return F.when(cells.isNull() | (F.size(cells) == 0), "types=unknown").otherwise(F.concat(F.lit("types="), text))


def result_summary(result: Column, rows: int = 3, chars: int = 500) -> Column:
    """A result as one line: shape and a sample of its first rows."""
    from ..functions.equality import rows_of, shape
    from ..functions.text import shorten

    s = shape(result)
    sample = shorten(F.to_json(F.slice(rows_of(result), 1, rows)), chars)
    full = F.concat(F.lit("result=non_empty; rows="), s["rows"].cast("string"), F.lit("; cols="), s["cols"].cast("string"), F.lit("; scalar="), s["scalar"].cast("string"),
                    F.lit("; "), type_profile(result), F.lit("; sample="), sample)
    return F.when(result.isNull(), "result=NULL").when(s["empty"], "result=empty; rows=0; cols=0").otherwise(full)


def repair_trace() -> Column:
    """What is known of a candidate's repair, as a line of its text."""
    told = {"repair_variant": F.col("repaired") == 1, "original_exec_ok": F.when(F.col("repaired") == 1, F.col("original_ok")), "repair_exec_ok": F.col("repair_ok"), "repair_available": F.col("repair_available")}
    return F.concat(F.lit("Repair trace: "), F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in told.items()]))


def candidate_text(pool: DataFrame, items: DataFrame, schemas: DataFrame, schema_chars: int = 4500) -> DataFrame:
    """(pool_id, text): what a ranker reads of a candidate: question, schema, statement and evidence; labels stay out."""
    from ..functions.text import shorten

    totals = pool.groupBy("idx").agg(F.count_if("ok").alias("n_ok"))
    asked = items.filter("idx IS NOT NULL").select("idx", "question", F.lower(F.trim("db_id")).alias("db")).dropDuplicates(["idx"])
    described = schemas.select(F.lower(F.trim("db_id")).alias("db"), shorten(F.col("text"), schema_chars).alias("schema"))
    full = structures(with_support(pool)).join(totals, "idx").join(asked, "idx", "left").join(described, "db", "left")
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Question: "), squeeze(F.col("question"))), F.concat(F.lit("Database id: "), F.coalesce("db", F.lit(""))), F.lit("Schema:"), F.coalesce("schema", F.lit("")),
        F.concat(F.lit("Candidate metadata: source="), "source", F.lit("; variant="), "variant", F.lit("; candidate_index="), F.coalesce(F.col("candidate_index").cast("string"), F.lit("none"))),
        F.lit("SQL:"), normal_sql(F.col("sql"), lower=False),
        F.concat(F.lit("Execution evidence: exec_ok="), F.col("ok").cast("string"), F.lit("; non_empty_result="), (~F.col("empty")).cast("string"), F.lit("; result_support="), F.col("support").cast("string"), F.lit("/"), F.col("n_ok").cast("string")),
        F.concat(F.lit("Result evidence: "), result_summary(F.col("result"))), F.concat(F.lit("SQL structure: "), F.col("structure")), repair_trace())
    return full.select("pool_id", text.alias("text"))


def training_counts(pool: DataFrame) -> DataFrame:
    """Questions by what they offer for training."""
    per = pool.groupBy("idx").agg(
        F.max("labeled").alias("labeled"), F.max(F.col("labeled") & F.col("ok") & F.col("correct")).alias("right"),
        F.max(F.col("labeled") & F.col("ok") & ~F.col("correct")).alias("hard"), F.max(~F.col("ok")).alias("failed"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("questions"), F.sum("n").alias("candidates"), F.count_if("labeled").alias("labeled"), F.count_if("right").alias("with_right"),
                   F.count_if("hard").alias("with_hard_wrong"), F.count_if(F.col("right") & F.col("hard")).alias("with_both"), F.count_if("failed").alias("with_failed"))
