"""Problem 5: answers that are no usable repair, each with its kind of defect.

Of a response of several rounds the last round counts. It is taken apart into candidate statements (JSON list,
code fence or bare text) and prose. Then, in this order:

* ``empty``: neither statement nor prose.
* ``language``: the prose, or what stands in for a statement, is in another script or holds more words of
  another language's dictionary than of the English one.
* ``copy``: the response, compressed with its prompt (failing statement, question, error, database) as a
  zstandard dictionary, shrinks below a share of its length, and an exact check on the forms without formatting
  finds the failing statement, the question or the prompt in it with nothing changed but lead-in words.
* ``truncated``: the JSON or a literal is left open inside a statement, the statement is a proper prefix of the
  failing one, or the terminal context (last three token classes) hardly ever ends a whole statement. The
  contexts are counted over all failing statements of the table, which are whole.
* ``refusal``: no statement, and a phrase of the refusal dictionary or a word of declining. English prose without
  a statement that declines nothing is none of the five kinds and is not flagged.

Defined results: a null or blank response of the stage is empty; null statements, questions and errors are
blank prompts that nothing copies; rows of other stages are no cases; repeated rows are each judged; whole
responses are read, however long.

Failing statements and their words are made once for each distinct text of a task's batches.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statements import plain_statement, sql_tokens

# Phrases by which an answer declines, and common words by language.
REFUSALS = (
    "not able to", "unable to help", "unable to assist", "unable to provide", "cannot help", "can't help", "cannot assist",
    "can't assist", "cannot provide", "can't provide", "cannot rewrite", "can't rewrite", "cannot comply", "can't comply",
    "cannot answer", "can't answer", "cannot produce", "can't produce", "cannot fulfil", "can't fulfil", "will not generate",
    "will not provide", "won't generate", "won't provide", "must decline", "have to decline", "decline to", "must pass",
    "have to pass", "must refuse", "rather not", "not possible for me", "outside what i", "no repair can be offered",
    "not allowed to", "not permitted to", "against my", "beyond what i", "refuse to",
)
LANGUAGES: dict[str, str] = {
    "en": "the a an of to is are was and in for on with not this that it be by as at from or have has can you your i "
          "should must which when where each every so because no",
    "de": "der die das den dem des ein eine einen einer eines und ist sind nicht mit für von zu im auf weil wird werden "
          "bitte hier sich auch als nach aus bei wurde muss kann keine ohne wähle wobei leer sortiert spalte tabelle abfrage",
    "fr": "le la les des du un une et est sont pas avec pour dans sur que qui car cette ce il elle doit être ne au aux "
          "voici où par choisir depuis requête colonne table échoue puis manque nul trié sélectionner",
    "es": "el la los las de del un una y es son no con para en que por se está esta esto hay como pero donde porque "
          "seleccionar ordenar consulta columna tabla falla aquí debe nulo versión corregida",
    "it": "il lo la gli le di del della dei un una e è sono non con per in che da al alla si ecco va come perché deve "
          "seleziona dove ordina nullo colonna tabella versione corretta interrogazione",
    "pt": "o a os as de do da dos das um uma e é são não com para em que por se ao à na no porque basta esse esta "
          "selecionar onde ordenar nulo consulta coluna tabela falha nome",
    "nl": "de het een en is zijn niet met voor van te in op dat die omdat wordt staat naar bij deze opnieuw probeer "
          "kies uit waar leeg gesorteerd kolom tabel query mislukt",
    "pl": "nie jest i w z na do się ponieważ ma oraz przez dla jako ale inną nazwę należy wybierz gdzie kolumna tabeli zapytanie",
    "sv": "och är inte med för av till i på att som en ett den det eftersom kolumnen tabellen frågan välj från där",
    "tr": "ve bir bu için ile değil olarak sütun tablo sorgu çünkü lütfen seç nerede",
}
#: A copy must shrink to this share of its length when its prompt is the dictionary.
COPY_SHARE = 0.6
#: Most lead-in words before a copy.
LEAD_IN = 12
#: A context that ends fewer than this share of its occurrences in whole statements is a cut.
END_SHARE = 0.002

#: Characters of failing statements whose forms a task keeps from one batch to the next.
KEPT_CHARS = 16_000_000

# Words that decline, for refusals that no phrase of the dictionary covers.
_DECLINES = re.compile(
    r"\b(?:can(?:no|')t|can not|could(?:n't| not)|won't|will not|unable|not able|decline[sd]?|declining|refuse[sd]?|refusing|refrain|"
    r"not (?:allowed|permitted|authori[sz]ed|possible)|no (?:repair|fix|statement|query|answer))\b"
)
_SETS = {k: frozenset(v.split()) for k, v in LANGUAGES.items()}
_ENGLISH_ONLY = _SETS["en"]
_STRUCTURE = frozenset(
    "select from where group by having order limit offset and or not in is null as join on left right inner outer cross "
    "between like exists distinct asc desc case when then else end union all cast count sum avg min max with".split()
)
_START = re.compile(r"\b(?:select|with)\b", re.I)
_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_WORDS = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
_NOTHING = frozenset(("null", "none", "sql", "json", "n"))
#: A label in front of a part of the prompt.
_LABEL = re.compile(r"(?m)^[^\S\n]*[^\W\d_](?:[^\W\d_]|[ \t])*:[^\S\n]*")
_ROUND = re.compile(r"\}\s*(?:```)?[ \t]*\n[ \t]*\n+")
_FENCE = re.compile(r"```[a-zA-Z]*")
_COMMENT = re.compile(r"(?m)^\s*(?:--|#)\s?")
_JSON = re.compile(r'\{\s*"')
_BARE = re.compile(r"(?is)(select\b.*|with\s+\S+\s+as\b.*)")
_MARK = re.compile(r'["{}\[\]]')
_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_LITERAL = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`")


def last_round(text: str) -> str:
    """The answer of the last round: what follows the last complete JSON answer and a blank line."""
    cut = 0
    for m in _ROUND.finditer(text):
        if text[m.end():].strip():
            cut = m.end()
    return text[cut:]


def _unescaped(raw: str) -> str:
    if "\\" not in raw:
        return raw
    try:
        return json.loads(f'"{raw}"', strict=False)
    except ValueError:
        return raw.replace('\\"', '"').replace("\\n", "\n")


def take_apart(answer: str) -> tuple[list[str], str, bool]:
    """Statements, prose, and whether the last statement is left open by its wrapping."""
    text = _COMMENT.sub("", _FENCE.sub("\n", answer))
    statements: list[str] = []
    prose: list[str] = []
    open_end = False
    found = _JSON.search(text)
    if found is None:
        bare = text.strip()
        if (m := _START.search(bare)) and _BARE.match(bare, m.start()):
            lead = bare[:m.start()]
            # "with" or "select" inside a sentence is prose, unless it opens a line
            if not lead.strip() or lead.rstrip(" \t").endswith(("\n", ":")):
                return [bare[m.start():]], lead, False
        return [], bare, False
    prose.append(text[:found.start()])
    at, depth = found.start(), 0
    while mark := _MARK.search(text, at):
        c, at = mark.group(), mark.end()
        if c == '"':
            string = _STRING.match(text, at)
            value = _unescaped(text[at: string.end() - 1 if string else len(text)])
            if not (string and depth == 1 and text[string.end():].lstrip()[:1] == ":"):
                if _START.match(value.strip()):
                    statements.append(value)
                else:
                    prose.append(value)
            if string is None:
                open_end = True
                break
            at = string.end()
            continue
        depth += (c in "{[") - (c in "}]")
        if depth == 0:
            prose.append(text[at:])
            break
    else:
        open_end = depth > 0
    return statements, "\n".join(prose), open_end


def _class(tok: str) -> str:
    if tok[0] == "\x01":
        return "name"
    if tok in ("group", "order"):
        return "sorted"  # either is followed by names and may end with them
    if tok in _STRUCTURE or not (tok[0].isalnum() or tok[0] == "_"):
        return tok
    return "number" if tok[0].isdigit() else "name"


def contexts(statement: str) -> Iterator[tuple[str, bool]]:
    """Every run of three token classes, and whether the statement ends with it."""
    cls = ["", "", *map(_class, sql_tokens(statement))]
    for i in range(2, len(cls)):
        yield " ".join(cls[i - 2: i + 1]), i == len(cls) - 1


def _open_literal(statement: str) -> bool:
    low = _LITERAL.sub("", statement) if "'" in statement or '"' in statement or "`" in statement else statement
    return any(q in low for q in "'\"`") or low.count("(") > low.count(")") or low.count("[") > low.count("]")


def is_cut(statement: str, failing: list[str], ends: Mapping[str, tuple[int, int]], tokens: list[str] | None = None) -> bool:
    """``tokens`` are those of the statement, if they are known."""
    body = statement.rstrip(" \t\r\n…�")
    if body.endswith("..."):
        body = body[:-3].rstrip()
    if body.endswith(";"):
        return False
    if tokens is None or len(body) != len(statement):
        tokens = sql_tokens(body)
    plain = _plain(tokens)
    if not plain:
        return False
    if _open_literal(body):
        return True
    for whole in failing:
        if len(whole) > len(plain) and whole.startswith(plain):
            return True
    n_end, n = ends.get(" ".join(["", "", *map(_class, tokens[-3:])][-3:]), (0, 0))
    if n and n_end < END_SHARE * n:
        return True
    if n == 0 and "from" not in plain.split():
        return True
    # a name that stops short of one in the failing statement
    tail = plain.rpartition(" ")[2]
    if not failing or not tail[0].isalpha() or tail in _STRUCTURE:
        return False
    known = {w for f in failing for w in f.split()}
    return tail not in known and any(k.startswith(tail) for k in known)


def _plain(tokens: list[str]) -> str:
    return " ".join(tokens).replace("\x01", "")


def foreign(prose: str) -> bool:
    if not prose.strip():
        return False
    words = [w.lower() for w in _LETTERS.findall(prose)]
    letters = "".join(words)
    if not letters:
        return False
    if sum(ord(c) > 0x2FF for c in letters) * 5 > len(letters):
        return True
    counts = {k: sum(w in s for w in words) for k, s in _SETS.items()}
    english = counts.pop("en")
    best = max(counts.values())
    accents = sum(0xBF < ord(c) < 0x250 for c in letters)
    return best >= 2 and best > english or (accents > 0 and best >= 1 and best >= english)


def _shrinks(answer: str, prompt: str) -> bool:
    """Whether the answer, compressed with its prompt as the dictionary, shrinks to COPY_SHARE of its length."""
    raw = answer.encode()
    book = prompt.encode()
    if not raw or len(book) < 8:
        return False
    packed = zstandard.ZstdCompressor(
        compression_params=zstandard.ZstdCompressionParameters(
            window_log=max(10, (len(raw) + len(book)).bit_length()), hash_log=max(10, min(20, len(book).bit_length())), chain_log=10,
            search_log=1, min_match=5, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False),
        dict_data=zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
    ).compress(raw)
    return len(packed) - 9 <= COPY_SHARE * len(raw)


def _words(text: str) -> str:
    return " ".join(_WORDS.findall(text.lower()))


def _last_word(text: str) -> str:
    found = _WORDS.findall(text[-80:].lower())
    return found[-1] if found else ""


def _is_copy(plain: list[str], answer: str, statements: list[str], prose: str, failing: list[str], question: str, prompt: list[str]) -> bool:
    if not _shrinks(" ".join([*plain, prose.lower()]), " \n ".join([*failing, question.lower(), *(p.lower() for p in prompt)])):
        return False
    if plain and all(p in failing for p in plain):
        return True
    told = [*statements, prose]
    if question and (last := _last_word(question)) and any(_last_word(t) == last for t in told):
        asked = _words(question).split()
        words = _words(" ".join([prose, *statements])).split()
        if words[-len(asked):] == asked and len(words) - len(asked) <= LEAD_IN:
            return True
    # the prompt: without labels the failing statement and at least one more part, and hardly a word besides
    low = answer.lower()
    if not any((first := _WORDS.search(p.lower())) and first.group() in low for p in (question, *prompt)):
        return False
    bare = ""
    for f in failing:
        own = _words(f)
        bare = bare or _words(_LABEL.sub(" ", answer))
        if not own or own not in bare:
            continue
        left = bare.replace(own, " ", 1)
        parts = [p for p in map(_words, (question, *prompt)) if p and p in left]
        for p in parts:
            left = left.replace(p, " ", 1)
        if parts and len(left.split()) <= 2:
            return True
    return False


def classify(response: str | None, failing: list[str], question: str, prompt: list[str],
             ends: Mapping[str, tuple[int, int]]) -> str | None:
    """The defect of one answer, or None. ``failing`` comes without formatting."""
    answer = last_round(response or "")
    statements, prose, open_end = take_apart(answer)
    statements = [s for s in statements if _WORDS.search(s)]
    if not statements and not any(w.lower() not in _NOTHING for w in _LETTERS.findall(prose)):
        return "truncated" if open_end and _WORDS.search(prose) else "empty"
    if foreign(prose):
        return "language"
    tokens = [sql_tokens(s) for s in statements]
    if _is_copy([_plain(t) for t in tokens], answer, statements, prose, failing, question, prompt):
        return "copy"
    if statements:
        return "truncated" if open_end or is_cut(statements[-1], failing, ends, tokens[-1]) else None
    low = prose.lower().replace("’", "'")
    declines = any(p in low for p in REFUSALS) or _DECLINES.search(low) is not None
    return "refusal" if declines else "truncated" if open_end else None


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            for ctx, end in contexts(text):
                seen[ctx] += 1
                ends[ctx] += end
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([ends[c] for c in seen], pa.int64()),
             pa.array(list(seen.values()), pa.int64())], names=["ctx", "ends", "seen"])


def terminal_contexts(df: DataFrame, statement: str) -> dict[str, tuple[int, int]]:
    """How often each context ends a whole statement, over all rows.

    Its size is bounded by the token classes (some sixty, cubed), not by the data.
    """
    counted = (
        df.select(F.col(statement).alias("s")).filter("s IS NOT NULL")
        .mapInArrow(_count_contexts, "ctx string, ends bigint, seen bigint")
        .groupBy("ctx").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen"))
    )
    return {r.ctx: (r.ends, r.seen) for r in counted.collect()}


def defects(df: DataFrame, record: str = "repair_id", stage: str = "mysql_dialect_repair_stage", judged: str = "llm",
            response: str = "mysql_dialect_repair_raw_response", failing: tuple[str, ...] = ("mysql_sql", "selected_sql"),
            question: str = "question", prompt: tuple[str, ...] = ("db_id", "mysql_exec_error")) -> DataFrame:
    """(record, defect_type): the judged rows that have a defect."""
    ends = df.sparkSession.sparkContext.broadcast(terminal_contexts(df, failing[-1]))
    texts = [response, *failing, question, *prompt]
    src = df.filter(F.col(stage) == judged).select(
        F.col(record).cast("bigint").alias("rid"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(texts)])
    n = len(failing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ends.value
        plain: dict[str, str] = {}
        held = 0

        def form(text: str) -> str:
            nonlocal held
            known = plain.get(text)
            if known is None:
                if held > KEPT_CHARS:
                    plain.clear()
                    held = 0
                held += 2 * len(text)
                known = plain[text] = plain_statement(text)
            return known

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            rids, kinds = [], []
            for rid, answer, *rest in zip(*cols):
                whole = list(dict.fromkeys(p for s in rest[:n] if s and (p := form(s))))
                kind = classify(answer, whole, rest[n] or "", [p for p in rest[n + 1:] if p], model)
                if kind:
                    rids.append(rid)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(kinds, pa.string())], names=["rid", "kind"])

    return src.mapInArrow(run, "rid bigint, kind string").select(F.col("rid").alias(record), F.col("kind").alias("defect_type"))
