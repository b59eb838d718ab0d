import pytest

from querymill.llm import pair_defects as op
from querymill.llm.statements import plain_statement

FAILING = "SELECT name, height FROM dome WHERE summit = 'High Bank' AND width > 18 ORDER BY height DESC LIMIT 10"
QUESTION = "Show the name and height of each dome whose summit is High Bank and width above 18."
FIXED = FAILING.replace("width > 18", "CAST(width AS SIGNED) > 18")
ENDS = {}
for s in (FAILING, "SELECT a FROM b WHERE c = 1", "SELECT COUNT(*) FROM b GROUP BY a", "SELECT a FROM b WHERE c = 'x'"):
    for ctx, end in op.contexts(s):
        e, n = ENDS.get(ctx, (0, 0))
        ENDS[ctx] = (e + 10 * end, n + 10)


def kind(text):
    return op.classify(text, [plain_statement(FAILING)], " ".join(op._WORDS.findall(QUESTION.lower())), ["dome db", "1054 unknown column width"], ENDS)


CASES = {
    None: [FIXED, f'{{"sqls": ["{FIXED}"]}}', f"Sorry about that. Fixed:\n```sql\n{FIXED};\n```", "Unable to run as written, so a cast is added:\n" + f'{{"sqls": ["{FIXED}"]}}',
           f'{{"sqls": ["{FAILING}"]}}\n\n{{"sqls": ["{FIXED}"]}}', FAILING.replace("10", "11") + "\n", f'{{"sqls": ["{FIXED}"]}}\nNo other change',
           "Renamed the column to match the catalog; rerun the statement.", f"Original SQL: {FAILING}\nCorrected as asked: the column is cast now, see the next message for the reasons."],
    "empty": [None, "", " \n", "{}", '""', "null", ";", "-", "```sql\n```", '{"sqls": []}', '{"sqls": [""]}', '{"sqls": null}', '{"sqls": [";"]}', f'{{"sqls": ["{FIXED}"]}}\n\n{{"sqls": []}}'],
    "truncated": [FIXED[:40], f'{{"sqls": ["{FIXED[:30]}', f'{{"sqls": ["{FIXED}", "SELECT na', "```sql\nSELECT name, hei…", FAILING[:60] + "...", FAILING.split(" ORDER")[0]],
    "refusal": ["I am sorry, but I cannot help with that.", "There is no fix that could be given here.", "That is something I couldn’t write.", "-- No repair can be offered by me.", '{"error": "I must decline to answer."}', '{"sqls": "I can\'t rewrite this statement."}'],
    "copy": [f"Statement:\n{FAILING}\nError:\n1054 unknown column width", FAILING.lower(), f'{{"sqls": ["{FAILING};"]}}', f"Here it is:\n```sql\n{FAILING}\n```", QUESTION.upper(), f"Q: {QUESTION}",
             f"Database id:\ndome db\nOriginal SQL:\n{FAILING}\nMySQL execution error:\n1054 unknown column width"],
    "language": ["Die Abfrage schlägt fehl, weil die Spalte nicht in der Tabelle ist.", "查询失败,请改为小写后重新执行。", f"Voici la requête corrigée, la table est en minuscules :\n{FIXED}",
                 '{"sqls": [], "hinweis": "Die Spalte gibt es nicht, deshalb ist keine Korrektur möglich"}', "SELECCIONAR nombre DE tabla DONDE nombre NO ES NULO ORDENAR POR nombre;"],
}


@pytest.mark.parametrize("expected,text", [(k, t) for k, v in CASES.items() for t in v])
def test_kinds(expected, text):
    assert kind(text) == expected


def test_table(spark):
    schema = ("rid string, kind string, repair_id bigint, db_id string, question string, selected_sql string, mysql_sql string, mysql_exec_error string, "
              "mysql_dialect_repair_stage string, mysql_dialect_repair_raw_response string")
    rows = [("a", "b", 1, None, None, None, None, None, "llm", None), ("a", "b", 2, "d", QUESTION, FAILING, None, "e", "llm", FAILING),
            ("a", "b", 3, "d", QUESTION, FAILING, FAILING, "e", "none", None), ("a", "b", 4, "d", QUESTION, FAILING, FAILING, "e", None, None),
            ("a", "b", 5, "d", QUESTION, FAILING, FAILING, "e", "llm", FIXED), ("a", "b", 6, None, None, None, None, None, "llm", "x" * 300_000),
            ("a", "b", 7, None, None, None, None, None, "llm", "I must decline. " * 20_000),
            ("a", "b", 2, "d", QUESTION, FAILING, None, "e", "llm", FAILING)]
    got = sorted(tuple(r) for r in op.defects(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "empty"), (2, "copy"), (2, "copy"), (7, "refusal")]
    assert op.defects(spark.createDataFrame([], schema)).count() == 0
