"""Problem 8: texts that were cut off, and how often each source cuts.

Two signs, each measured over all texts and reported by itself:

* Field limits, by length spikes. Per source the lengths in characters and bytes, with and without what was put
  behind a cut, are counted over distinct texts. A length is a field limit if it occurs SPIKE times as often as those
  around it, if far fewer of its texts end in terminal punctuation than elsewhere in the source (half of what is
  expected there, and at least EXPECTED texts short of it), and if no single ending makes up half of them, as it
  does where a template gives equal lengths. The source's greatest length is mostly such a spike; a limit that was
  raised leaves another one below. A text of that length without terminal punctuation is cut.
* Cuts in mid-transfer, by terminal contexts. All runs of three tokens (words, with numbers, names and identifiers
  as classes) are counted with how often a sentence or line ends behind them. A text whose last run hardly ever ends
  one is cut, as is one whose last word begins a word that occurs FRAGMENT times as often inside texts, or any word
  if nothing else has it behind the two tokens before it. A run that ends several texts and never goes on is a
  sign-off. Texts that end with a run speak for it as a regular ending only as distinct texts, away from field
  limits, and beyond what chance may bring; so copies of a cut text prove nothing. JSON left open is cut; statements
  have their own contexts.

Runs are counted and shuffled as 64-bit hashes of their classes, pre-aggregated; every distinct ending is looked up
once. Only the endings found open are joined back to the texts, salted, so that an ending shared by a third of all
texts is no hot key. Lookups are joins, no model is collected; the driver sees the distinct lengths of last words.

Defined results: null and blank texts are no cases; a null source is a source of its own, letter case of the
source doesn't count; texts are read whole, however long (of the last 400 characters the last three tokens are taken,
of the whole text where they hold fewer); rows sent twice under one identifier give one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pair_defects import _open_literal, contexts
from .runtime import cut

#: A spike occurs this many times as often as the lengths around it, and at least LEAST times.
SPIKE, LEAST, AROUND, CLOSE = 10, 5, 25, 4
#: Share of the texts expected to end in terminal punctuation that a limit leaves at most, and texts that must be short of it;
#: the most that a single ending may have of a limit's texts; texts away from spikes from which a source speaks for itself.
LIMIT_SHARE, EXPECTED, ONE_ENDING, OWN = 0.5, 2, 0.5, 20
#: A run that ends a sentence or line less often than this share doesn't end one.
END_SHARE = 0.05
#: Occurrences from which a run is trusted; fewer fall back to the shorter run.
SEEN = 4
#: How much more often a longer word must occur for the last word to be a piece of it.
FRAGMENT = 50
#: How often the two tokens before the last must occur for a piece of a word behind them to show.
LEFT = 25
#: Distinct texts that must end with a run that never goes on, for it to be a sign-off.
SIGN_OFF = 3
#: Standard errors of a count of closing texts that are left to chance.
ERRORS = 2
#: Characters whose runs are counted at once, and distinct tokens that a task keeps classes of.
HELD_CHARS, HELD = 8_000_000, 200_000
#: Salts of the join that brings open endings back to the texts.
SALTS = 16

# What may stand behind a cut, besides blanks.
_BLANKS = " \t\r\n\x0b\x0c\x85\xa0\u2028\u2029\u200b…�"
_BRACKETED = re.compile(r"(?:\[\s*(?:\.\.\.|…|truncated|cut|snip|more)\s*\]|\(\s*(?:\.\.\.|…|truncated|cut|more)\s*\)|<\s*(?:\.\.\.|…|truncated|cut|more)\s*>)\Z", re.I)
TOKEN = re.compile(r"\w++(?:[.'’-]\w++)*+|\S|\n+")
WORD = re.compile(r"[^\W\d]\w*")
STATEMENT = re.compile(r"(?im)^[ \t>]*(select\b)")
CLAUSE = re.compile(r"(?i)[\s>]*(?:from|where|group|order|limit|having|join|left|inner|on|and|or|union|offset|$)")
_FINAL = ".!?;"
_OPENERS = frozenset(",:(-/=<&+|[{")
_BEFORE_FIRST = frozenset("*-#>.!?\n")
WHOLE, CUT, PROSE, SQL = 0, 1, 2, 3
MEASURES = ("chars", "bytes", "body_chars", "body_bytes")
_FEATURES = ("doc bigint, src string, chars int, bytes int, body_chars int, body_bytes int, body bigint, final boolean, verdict int, "
             "k3 bigint, k2 bigint, k1 bigint, before bigint, small boolean, all_small boolean, word string")
_ENDING = ["verdict", "k3", "word"]


def without_mark(text: str) -> str:
    """The text without blanks and cut marks at its end."""
    while True:
        text = text.rstrip(_BLANKS)
        if text.endswith("..."):
            text = text[:-3]
        elif text[-1:] in "])>" and (m := _BRACKETED.search(text[-24:])):
            text = text[: len(text) - (m.end() - m.start())]
        else:
            return text


def _class(tok: str) -> str:
    """A token's class inside a sentence."""
    head = tok[0]
    if head == "\n":
        return "\n"
    if not (head.isalnum() or head == "_"):
        return tok
    if head.isdigit():
        return "0"
    if "_" in tok or "." in tok:
        return "@"
    return "^" if head.isupper() else tok.lower()


def unwrapped(raw: list[str]) -> list[str]:
    """The tokens without the line breaks, and the quote marks after them, that a small letter follows: wrapped lines go on."""
    out: list[str] = []
    start = at = 0
    try:
        while True:
            at = raw.index("\n", at)
            after = at + 1
            while after < len(raw) and raw[after] == ">":
                after += 1
            if after < len(raw) and raw[after][0].islower():
                out += raw[start:at]
                start = after
            at = after
    except ValueError:
        return out + raw[start:] if start else raw


def classes_of(raw: list[str]) -> list[str]:
    """Tokens as classes; the first word of a sentence, line or list item counts as if it were written small."""
    out = [_class(t) for t in raw]
    at = -1
    try:
        while True:
            at = out.index("^", at + 1)
            if at == 0 or out[at - 1] in _BEFORE_FIRST:
                out[at] = raw[at].lower()
    except ValueError:
        return out


_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_ALL = (1 << 64) - 1


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def run_key(*hashes: int) -> int:
    """The key of a run of hashed classes, the last one first in weight; as a signed number."""
    n = len(hashes)
    mixed = sum(h * f for h, f in zip(reversed(hashes), _FACTORS)) + n * 0x27D4EB2F165667C5 & _ALL
    return mixed - (1 << 64) if mixed >> 63 else mixed


def _run_keys(*hashes: np.ndarray) -> np.ndarray:
    """As above, for columns of hashes."""
    total = np.full(len(hashes[0]), len(hashes) * 0x27D4EB2F165667C5 & _ALL, np.uint64)
    for h, f in zip(reversed(hashes), _FACTORS):
        total += h * np.uint64(f)
    return total.view(np.int64)


_JSON_MARK = re.compile(r'\\.|["{}\[\]]', re.S)
_VISIBLE = re.compile(r"\S")


def json_open(text: str) -> bool | None:
    """Whether the last JSON value that opens a line is left open; None if there is none up to the end."""
    starts = [m.start() for m in re.finditer(r"(?m)^[ \t]*[{\[](?=\s*[\"{\[\]}])", text)]
    if not starts:
        return None
    done = 0
    for start in starts:
        if start < done:
            continue
        depth, inside, end = 0, False, -1
        for m in _JSON_MARK.finditer(text, start):
            c = m.group()
            if c == '"':
                inside = not inside
            elif not inside and c in "{[":
                depth += 1
            elif not inside and c in "}]":
                depth -= 1
                if depth == 0:
                    end = m.end()
                    break
        if end < 0:
            return True
        if _VISIBLE.search(text, end) is None:
            return False
        done = end
    return None


def whole_statements(body: str) -> Iterator[str]:
    """The statements that open a line and end in a semicolon."""
    *parts, _ = body.split(";")
    for part in parts:
        start = -1
        for m in STATEMENT.finditer(part):
            start = m.start(1)
        if start >= 0:
            yield part[start:]


def last_word(body: str) -> str:
    """The word that the text ends with, or nothing."""
    at = len(body)
    while at and (body[at - 1].isalnum() or body[at - 1] == "_"):
        at -= 1
    m = WORD.search(body, at)
    return m.group().lower() if m else ""


def _last_statement(body: str) -> str:
    """The statement without semicolon that ends the text, or nothing."""
    start = -1
    for m in STATEMENT.finditer(body, body.rfind(";") + 1):
        start = m.start(1)
    if start < 0:
        return ""
    statement = body[start:]
    outside = re.sub(r"'[^'\n]*'|\"[^\"\n]*\"|`[^`\n]*`", "", statement)
    if ";" in outside or "\n\n" in outside or re.search(r"[.!?](?:\s|$)", outside):
        return ""
    lines = outside.split("\n")
    return statement if all(CLAUSE.match(line) for line in lines[1:]) else ""


def look(text: str) -> tuple[str, int, tuple[str, ...], str]:
    """The text without its cut mark, a verdict, and for PROSE and SQL the last run and word."""
    body = without_mark(text)
    if not body:
        return body, WHOLE, (), ""
    state = json_open(body)
    if state is not None:
        return body, CUT if state else WHOLE, (), ""
    last = body[-1]
    if statement := _last_statement(body):
        if _open_literal(statement):
            return body, CUT, (), ""
        run = ""
        for run, _ in contexts(statement):
            pass
        return body, SQL, (run,), last_word(body)
    if last in _FINAL:
        return body, WHOLE, (), ""
    if last in _OPENERS:
        return body, CUT, (), ""
    if not (last.isalnum() or last == "_"):
        return body, WHOLE, (), ""
    raw = unwrapped(TOKEN.findall(body[-400:]))
    if len(raw) < 5:  # the text is short, or its last tokens are long
        raw = unwrapped(TOKEN.findall(body))
    # the token before the last three says whether they begin a sentence
    ending = classes_of(raw[-4:])[-3:]
    return body, PROSE, tuple((["\n", "\n"] + ending)[-3:]), last_word(body)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    types = [{"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]] for f in _FEATURES.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for doc, src, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            body, verdict, run, word = look(text)
            keys: tuple = (None, None, None, None)
            small = all_small = False
            if verdict == SQL:
                keys = (run_key(_hash("S" + run[0])), None, None, None)
            elif verdict == PROSE:
                a, b, c = map(_hash, run)
                keys = (run_key(a, b, c), run_key(b, c), run_key(c), run_key(a, b))
                small, all_small = run[2][:1].islower(), run[2].isalpha() and run[2].islower()
            out.append((doc, src, len(text), len(text.encode()), len(body), len(body.encode()), _hash(body) - (1 << 63),
                        body[-1:] in _FINAL and verdict == WHOLE or not body, verdict, *keys, small, all_small, word))
        cols = list(zip(*out)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and for every value the place of its own."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


class _Known(dict):
    """Tokens by number, with their hashed classes; number 0 is the break before a text."""

    def __init__(self) -> None:
        super().__init__()
        self.tokens = [""]
        self.classes = [_hash("\n")]

    def __missing__(self, tok: str) -> int:
        known = self[tok] = len(self.tokens)
        self.tokens.append(tok)
        self.classes.append(_hash(_class(tok)))
        return known


class _Counts:
    """Runs and words of some millions of characters."""

    def __init__(self) -> None:
        self.known = _Known()
        self.special = {c: _hash(c) for c in ("^", "\n", ".", "!", "?", *_BEFORE_FIRST)}
        self.clear()

    def clear(self) -> None:
        if len(self.known) > HELD:
            self.known = _Known()
        self.flat: list[int] = []
        self.last: list[int] = []
        self.sql: Counter[tuple[str, bool]] = Counter()
        self.chars = 0

    def add(self, body: str) -> None:
        self.chars += len(body)
        raw = unwrapped(TOKEN.findall(body))
        if not raw:
            return
        self.flat += (0, 0)
        self.flat += map(self.known.__getitem__, raw)
        self.last.append(self.flat[-1])
        if "elect" in body or "ELECT" in body:
            for statement in whole_statements(body):
                self.sql.update(contexts(statement))

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.flat:
            tokens = self.known.tokens
            flat = np.array(self.flat, np.int64)
            h = np.array(self.known.classes, np.uint64)[flat]
            firsts = np.zeros(len(h), bool)
            for c in _BEFORE_FIRST:
                firsts[1:] |= h[:-1] == self.special[c]
            for p in np.flatnonzero(firsts & (h == self.special["^"])).tolist():
                h[p] = _hash(tokens[flat[p]].lower())
            ends = np.zeros(len(h) - 3, bool)
            for c in (".", "!", "?", "\n"):
                ends |= h[3:] == self.special[c]
            # runs that nothing of their text follows stay out, as do those that reach into the next text
            inside = flat[3:] != 0
            ends = ends[inside]
            a, b, c = h[:-3][inside], h[1:-2][inside], h[2:-1][inside]
            threes, back = _distinct(_run_keys(a, b, c))
            where = np.zeros(len(threes), np.int64)
            where[back] = np.arange(len(back))
            total = np.bincount(back, minlength=len(threes))
            ended = np.bincount(back, weights=ends, minlength=len(threes)).astype(np.int64)
            b, c = b[where], c[where]
            keys, sums, finals = [threes], [total], [ended]
            for shorter in (_run_keys(b, c), _run_keys(c)):
                own, back = _distinct(shorter)
                keys.append(own)
                sums.append(np.bincount(back, weights=total, minlength=len(own)).astype(np.int64))
                finals.append(np.bincount(back, weights=ended, minlength=len(own)).astype(np.int64))
            yield _counted(np.concatenate(keys), None, np.concatenate(finals), np.concatenate(sums))
            times = np.bincount(flat, minlength=len(tokens)) - np.bincount(self.last, minlength=len(tokens))  # a last word may be a piece
            words: Counter[str] = Counter()
            for k in np.flatnonzero(times).tolist():
                for w in WORD.findall(tokens[k].lower()):
                    words[w] += int(times[k])
            yield _counted(None, list(words), np.zeros(len(words), np.int64), np.array(list(words.values()), np.int64))
        if self.sql:
            runs = list(dict.fromkeys(run for run, _ in self.sql))
            yield _counted(np.array([run_key(_hash("S" + r)) for r in runs], np.int64), None, np.array([self.sql[r, True] for r in runs], np.int64),
                           np.array([self.sql[r, True] + self.sql[r, False] for r in runs], np.int64))
        self.clear()


def _counted(keys: np.ndarray | None, words: list[str] | None, ends: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    n = len(total)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys) if keys is not None else pa.nulls(n, pa.int64()), pa.array(words, pa.string()) if words is not None else pa.nulls(n, pa.string()),
         pa.array(ends), pa.array(total)], names=["key", "word", "ends", "total"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if body := without_mark(text):
                counts.add(body)
                if counts.chars > HELD_CHARS:
                    yield from counts.take()
    yield from counts.take()


def _lengths(texts: DataFrame, *kept: str) -> DataFrame:
    return texts.select("src", *kept, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES])).alias("x")).select("src", *kept, "x.*")


def limits(features: DataFrame) -> DataFrame:
    """(src, measure, length): the field limits, by source and measure."""
    # copies of one text are not a limit
    texts = features.groupBy("src", "body", *MEASURES).agg(F.max("final").alias("final"), F.first("k3").alias("k3"))
    counted = _lengths(texts, "final").groupBy("src", "measure", "length").agg(F.count("*").alias("n"), F.count_if("final").alias("finals"))
    # a window over distinct lengths of one source and measure, not over texts
    by = Window.partitionBy("src", "measure").orderBy("length")
    wide = F.coalesce(F.sum("n").over(by.rangeBetween(-AROUND, AROUND)), F.lit(0))
    close = F.coalesce(F.sum("n").over(by.rangeBetween(-CLOSE, CLOSE)), F.lit(0))
    around = (wide - close) / (2 * (AROUND - CLOSE))
    marked = cut(counted.withColumn("spike", (F.col("n") >= LEAST) & (F.col("n") >= SPIKE * around)))
    # what is left of a source away from its spikes says how its texts end; all sources where that is little
    away = lambda what: F.sum(F.when(~F.col("spike"), F.col(what)).otherwise(0))
    own = Window.partitionBy("src", "measure")
    every = marked.agg(F.coalesce(F.try_divide(away("finals"), away("n")), F.lit(0.0)).alias("share")).first().share
    share = F.when(away("n").over(own) >= OWN, away("finals").over(own) / away("n").over(own))
    high = marked.withColumn("own_share", share).filter("spike")
    expected = F.col("n") * F.coalesce("own_share", F.lit(every))
    high = high.filter((F.col("finals") <= LIMIT_SHARE * expected) & (expected - F.col("finals") >= EXPECTED)).select("src", "measure", "length")
    there = _lengths(texts.filter(~F.col("final")), "k3").join(high, ["src", "measure", "length"])
    ends = there.groupBy("src", "measure", "length", "k3").agg(F.count("*").alias("n")).groupBy("src", "measure", "length").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("k3").isNotNull(), F.col("n"))).alias("most"))
    return ends.filter(F.coalesce("most", F.lit(0)) <= ONE_ENDING * F.col("n")).select("src", "measure", "length")


def _at(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """The features with ``at``, whether one of their lengths is among the source's ``lengths``."""
    of = lengths.groupBy("src").agg(*[
        F.collect_set(F.when(F.col("measure") == m, F.col("length"))).alias(f"{m}_limits") for m in MEASURES])
    at = F.lit(False)
    for m in MEASURES:
        at = at | F.coalesce(F.array_contains(f"{m}_limits", F.col(m)), F.lit(False))
    return features.join(of, "src", "left").withColumn("at", at).drop(*[f"{m}_limits" for m in MEASURES])


def _open_endings(asking: DataFrame, texts: DataFrame) -> DataFrame:
    """(verdict, k3, word): the endings that the contexts find open. ``asking`` has ``at``."""
    counts = cut(texts.mapInArrow(_count, "key bigint, word string, ends bigint, total bigint").groupBy("key", "word").agg(
        F.sum("ends").alias("ends"), F.sum("total").alias("total")))
    runs, words = counts.filter("key IS NOT NULL").drop("word"), counts.filter("word IS NOT NULL").select("word", "total")
    shown = ["k2", "k1", "before", "small", "all_small"]
    asked = cut(asking.groupBy(*_ENDING).agg(*[F.first(c).alias(c) for c in shown]))
    prose = F.col("verdict") == PROSE
    slots = {"r3": "k3", "r2": "k2", "r1": "k1", "lf": "before"}
    asks = asked.select(*_ENDING, F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(k).alias("key")) for s, k in slots.items()])).alias("x")).select(
        *_ENDING, "x.*").filter("key IS NOT NULL")
    met = asks.join(runs, "key").groupBy(*_ENDING).agg(
        *[F.max(F.when(F.col("slot") == s, F.col(v))).alias(f"{s}_{v}") for s in slots for v in ("ends", "total")])
    # distinct texts that end with a run, away from field limits
    closing = asking.filter(prose & ~F.col("at")).select("k3", "body").distinct().groupBy("k3").agg(F.count("*").alias("cl_total"))
    # the most frequent word that a last word begins: longer words cut at the lengths that last words have
    lasts = asked.filter("word <> ''").select("word").distinct()
    there = sorted(r.n for r in lasts.select(F.length("word").alias("n")).distinct().collect())  # one row for each length
    cuts = F.filter(F.array(*[F.lit(n) for n in there]).cast("array<int>"), lambda n: n < F.length("longer"))
    begins = words.select(F.col("word").alias("longer"), "total").select("total", F.explode(F.transform(cuts, lambda n: F.left("longer", n))).alias("word")).join(
        lasts, "word", "left_semi").groupBy("word").agg(F.max("total").alias("longer_total"))
    known = lasts.join(words, "word", "left").join(begins, "word", "left").select("word", F.coalesce("total", F.lit(0)).alias("wd_total"), "longer_total")
    full = asked.join(met, _ENDING, "left").join(closing, "k3", "left").join(known, "word", "left")
    full = full.na.fill(0, [f"{s}_{v}" for s in slots for v in ("ends", "total")] + ["cl_total", "wd_total"])
    # distinct texts that end with the run count as ends, but for what chance may bring
    more = F.greatest(F.col("cl_total") - ERRORS * F.sqrt("cl_total"), F.lit(0))
    share = (
        F.when(F.col("r3_total") + more >= SEEN, (F.col("r3_ends") + more) / (F.col("r3_total") + more))
        .when(F.col("r2_total") >= SEEN, F.col("r2_ends") / F.col("r2_total"))
        .when(F.col("r1_total") >= SEEN, F.col("r1_ends") / F.col("r1_total"))
        .when((F.col("r1_total") == 0) & F.col("small"), 0.0).otherwise(1.0)
    )  # a lower-case word that is nowhere else a word is a piece of one
    sign_off = (F.col("r3_total") == 0) & (F.col("cl_total") >= SIGN_OFF)
    sql_cut = (F.col("r3_total") >= SEEN) & (F.col("r3_ends") < END_SHARE * F.col("r3_total"))
    # a word that nothing else has in this place, and that begins another
    strange = prose & (F.col("lf_total") >= LEFT) & (F.col("r3_total") + more < SEEN) & F.col("all_small")
    fragment = F.coalesce((F.col("longer_total") > FRAGMENT * F.col("wd_total")) | (strange & F.col("longer_total").isNotNull()), F.lit(False))
    decided = F.when(fragment, True).when(~prose, sql_cut).when(sign_off, False).otherwise(share < END_SHARE)
    return full.filter(decided).select(*_ENDING)


def judged(df: DataFrame, record: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc, src, at_limit, in_transfer): both signs for every text that is not null or blank."""
    src = df.select(F.col(record).cast("bigint").alias("doc"), F.coalesce(F.lower(F.trim(F.col(source))), F.lit("(none)")).alias("src"),
                    F.col(text).alias("text")).filter("doc IS NOT NULL AND text rlike '\\\\S'")
    features = cut(src.mapInArrow(_features, _FEATURES))
    placed = _at(features, cut(limits(features)))
    asking = placed.filter(F.col("verdict").isin(PROSE, SQL))
    opened = _open_endings(asking, src.select("text")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("open", F.lit(True))
    met = asking.withColumn("salt", F.pmod("doc", F.lit(SALTS)).cast("int")).join(opened, [*_ENDING, "salt"], "left").select(
        "doc", "src", "at", "final", F.coalesce("open", F.lit(False)).alias("open"))
    rest = placed.filter(~F.col("verdict").isin(PROSE, SQL)).select("doc", "src", "at", "final", (F.col("verdict") == CUT).alias("open"))
    return met.unionByName(rest).select("doc", "src", (F.col("at") & ~F.col("final")).alias("at_limit"), F.col("open").alias("in_transfer"))


def cut_texts(df: DataFrame, record: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(record): the texts that were cut off."""
    return judged(df, record, text, source).filter("at_limit OR in_transfer").select(F.col("doc").alias(record)).distinct()


def cut_shares(df: DataFrame, record: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, texts, cut_texts, cut_share, at_limit, in_transfer): how often each source cuts, and by which sign that shows."""
    either = F.col("at_limit") | F.col("in_transfer")
    return judged(df, record, text, source).groupBy(F.col("src").alias(source)).agg(
        F.count("*").alias("texts"), F.count_if(either).alias("cut_texts"), F.round(F.avg(either.cast("int")), 6).alias("cut_share"),
        F.count_if("at_limit").alias("at_limit"), F.count_if("in_transfer").alias("in_transfer"))
