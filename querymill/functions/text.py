"""Text functions as Columns: tokens, stems, normal forms, literals, clauses, cleaning of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that the retrieval tokens leave out.
STOP_WORDS = (
    "select", "from", "where", "join", "on", "and", "or", "group", "by", "order", "limit", "distinct",
    "count", "sum", "avg", "min", "max", "as", "in", "like", "between", "is", "null",
    "database", "table", "columns", "column", "type", "foreignkey", "joinhint",
)
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def stem(word: Column) -> Column:
    """Plural forms cut: -ies to -y beyond four letters, -es and -s beyond three."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.left(word, n - 3), F.lit("y")))
        .when(word.endswith("es") & (n > 3), F.left(word, n - 2))
        .when(word.endswith("s") & (n > 3), F.left(word, n - 1))
        .otherwise(word)
    )


def retrieval_tokens(text: Column) -> Column:
    """Lower-case words and numbers of two characters or more, without stop words, stemmed; in their order, repeats kept."""
    words = _all(F.lower(F.coalesce(text, F.lit(""))), TOKEN)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.transform(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w)), stem)


def plural_forms(words: Column) -> Column:
    """The words and the singulars that they may be plurals of."""
    n = F.length
    add = F.flatten(F.transform(words, lambda w: F.when(w.endswith("ies") & (n(w) > 4), F.array(F.concat(F.left(w, n(w) - 3), F.lit("y"))))
                                .when(w.endswith("es") & (n(w) > 4), F.array(F.left(w, n(w) - 2)))
                                .when(w.endswith("s") & (n(w) > 3), F.array(F.left(w, n(w) - 1)))
                                .otherwise(F.array().cast("array<string>"))))
    return F.array_union(words, add)


def normal_question(text: Column) -> Column:
    """Lower case, straight quotes, everything but letters, digits, _ and ' as one blank."""
    straight = F.regexp_replace(F.lower(text), "[‘’]", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(straight, r"[^a-z0-9_']+", " "), " +", " "))


def word_count(text: Column) -> Column:
    return F.size(_all(F.lower(F.coalesce(text, F.lit(""))), r"[a-z0-9_']+"))


def normal_sql(text: Column, lower: bool = True) -> Column:
    """Comments dropped, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    out = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.lower(out) if lower else out


def sql_key(text: Column) -> Column:
    """Lower case, white space squeezed, trailing semicolons gone; literals are lowered too."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"[; ]+$", ""))


def field_list(normal: Column) -> Column:
    """The selected fields of a statement in normal form: of the first SELECT with a FROM behind it, wherever it stands."""
    return F.trim(F.regexp_extract(normal, r"(?s)\bselect\b\s+(.*?)\s+\bfrom\b", 1))


def group_fields(normal: Column) -> Column:
    """The GROUP BY fields of a statement in normal form."""
    return F.trim(F.regexp_extract(normal, r"(?s)\bgroup\s+by\b\s+(.*?)(?:\border\s+by\b|\bhaving\b|\blimit\b|;|$)", 1))


def string_literals(sql: Column) -> Column:
    """Every '…' literal, then every "…" one, trimmed, each once, blank ones left out."""
    both = F.concat(_all(sql, r"'([^']*)'", 1), _all(sql, r'"([^"]*)"', 1))
    return F.array_distinct(F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x != ""))


def has_spaced_literal(sql: Column) -> Column:
    """Whether a '…' literal begins or ends with a blank."""
    return F.exists(_all(sql, r"'([^']*)'", 1), lambda x: x != F.trim(x))


def identifier_words(name: Column) -> Column:
    """Words of an identifier: split at case changes and other characters, two letters or more, lower case."""
    split = F.split(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+")
    return F.filter(F.transform(split, F.lower), lambda w: F.length(w) >= 2)


def shorten(text: Column, n: int) -> Column:
    """At most n characters; a cut text ends in ' ...'."""
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.left(text, F.lit(n))), F.lit(" ..."))).otherwise(text)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_")


def stable_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def clean_answer(text: Column) -> Column:
    """The first statement of a model's answer: out of its JSON or fence, from SELECT or WITH up to the first semicolon."""
    unfenced = F.regexp_replace(F.coalesce(text, F.lit("")), r"```[a-zA-Z]*", "")
    listed = F.get_json_object(F.trim(unfenced), "$.sqls[0]")
    single = F.get_json_object(F.trim(unfenced), "$.sql")
    raw = F.coalesce(listed, single, unfenced)
    found = F.regexp_extract(raw, r"(?is)\b((?:select|with)\b[^;]*)", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def answer_statements(text: Column) -> Column:
    """The candidates of a JSON answer, its list ``sqls`` before its single ``sql``, each once; empty where there is none."""
    outer = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(outer, "struct<sqls:array<string>,sql:string>")
    listed = F.concat(F.coalesce(parsed["sqls"], F.array().cast("array<string>")), F.array(parsed["sql"]))
    return F.array_distinct(F.filter(F.transform(listed, lambda s: F.trim(s)), lambda s: s != ""))


def file_name(model: Column) -> Column:
    """A model's name as part of a file name."""
    return F.translate(model, "/: ", "___")


def with_semicolon(sql: Column) -> Column:
    """A target statement trimmed and closed by a semicolon; nothing stays nothing."""
    bare = F.trim(F.coalesce(sql, F.lit("")))
    return F.when((bare != "") & ~bare.endswith(";"), F.concat(bare, F.lit(";"))).otherwise(bare)


# Words that are no value behind a keyword.
_AGES = ("old", "young", "oldest", "youngest")


def value_after(question: Column, keyword: str) -> Column:
    """The word behind a keyword, in any case; null where there is none or it only tells an age."""
    found = F.nullif(F.regexp_extract(question, rf"(?i){keyword}\s+([A-Za-z][A-Za-z-]*)", 1), F.lit(""))
    return F.when(~F.lower(found).isin(*_AGES), found)


def compared(question: Column) -> Column:
    """(op, value) of the first comparison with a number in words; null where there is none."""
    low = F.lower(question)
    more = F.regexp_extract(low, r"(heavier|greater|more)\s+than\s+(\d+)", 2)
    less = F.regexp_extract(low, r"(less|lighter|under)\s+than\s+(\d+)", 2)
    pair = lambda op, v: F.struct(F.lit(op).alias("op"), v.try_cast("bigint").alias("value"))
    return F.when(more != "", pair(">", more)).when(less != "", pair("<", less))


def judgment(response: Column) -> Column:
    """(winner, confidence, scores) of a judge's answer: the outermost braces as JSON; A without confidence where it can't be read."""
    outer = F.regexp_extract(F.regexp_replace(F.coalesce(response, F.lit("")), r"```[a-zA-Z]*", ""), r"(?s)(\{.*\})", 1)
    read = F.from_json(outer, "winner string, confidence double, scores map<string,struct<A:double,B:double>>")
    return F.struct(F.when(F.upper(F.trim(read["winner"])) == "B", "B").otherwise("A").alias("winner"),
                    F.coalesce(read["confidence"], F.lit(0.0)).alias("confidence"), read["scores"].alias("scores"))
