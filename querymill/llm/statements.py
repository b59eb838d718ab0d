"""Canonical forms of SQL statements and JSON result sets, for use inside Arrow batches.

Formatting is whitespace, letter case, quotes or brackets around names and values, semicolons and the
spacing of operators. Operators, digits and decimal points are content.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

TOKEN = re.compile(
    r"""[^\W\d]\w*|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\]|<>|<=|>=|!=|==|\|\||\d+(?:\.\d+)*|[^\s;]"""
)
CLAUSES = frozenset(
    ("select", "from", "where", "group", "having", "order", "limit", "offset", "union", "intersect", "except")
)
SET_OPERATIONS = frozenset(("union", "intersect", "except"))
JOINS = frozenset(("join", "left", "right", "inner", "full", "cross", "natural", ","))
CELL = re.compile(
    r""""((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([\[\]])|([^\s,\[\]"']+(?:\s+[^\s,\[\]"']+)*)"""
)
MISSING_RESULT = "null_result"

# A quoted token carries this mark while clauses are told apart, so that a value 'and' is no keyword.
_QUOTED = "\x01"
_QUOTES = frozenset("'\"`[")


def _unquoted(tok: str) -> str:
    inner = tok[1:-1]
    if tok[0] in inner:
        inner = inner.replace(tok[0] * 2, tok[0])
    return _QUOTED + " ".join(inner.split())


def sql_tokens(text: str) -> list[str]:
    """Lower-case tokens; quoted names and values lose their quotes and keep a leading mark."""
    return [_unquoted(tok) if tok[0] in _QUOTES and len(tok) > 1 else tok for tok in TOKEN.findall(text.lower())]


def plain_statement(text: str) -> str:
    """The statement without its formatting, everything in its order."""
    return " ".join(sql_tokens(text)).replace(_QUOTED, "")


def _shown(tokens: Sequence[str]) -> str:
    return " ".join(tokens).replace(_QUOTED, "")


def _split(tokens: Sequence[str], word: str) -> list[list[str]]:
    """The parts between a word; the AND of BETWEEN and what stands between CASE and END is inside a part."""
    if word not in tokens:
        return [list(tokens)]
    parts: list[list[str]] = [[]]
    cases, between = 0, False
    for tok in tokens:
        if tok == "case":
            cases += 1
        elif tok == "end":
            cases -= 1
        elif tok == "between" and not cases:
            between = True
        elif tok == word and not cases:
            if not (between and word == "and"):
                parts.append([])
                continue
            between = False
        parts[-1].append(tok)
    return parts


def _conditions(tokens: Sequence[str]) -> str:
    """Conditions joined by AND sorted; those joined by OR keep their order."""
    return "\x1foror\x1f".join("\x1f".join(sorted(_shown(c) for c in _split(part, "and"))) for part in _split(tokens, "or"))


def _group(tokens: list[str], before: str) -> str:
    """What stands in parentheses: a statement, conditions, or a list that keeps its order."""
    if tokens[:1] == ["select"]:
        return f"({_statement(tokens, before != 'in')[0]})"
    if ("and" in tokens or "or" in tokens) and "," not in tokens:
        return f"({_conditions(tokens)})"
    return f"({_shown(tokens)})"


def _from(tokens: list[str]) -> str:
    """Joined tables in their order, the conditions of every ON sorted."""
    if "on" not in tokens:
        return _shown(tokens)
    out: list[str] = []
    on: list[str] | None = None
    for tok in [*tokens, ""]:
        if on is not None and (tok in JOINS or tok == ""):
            out.append(_conditions(on))
            on = None
        if tok == "on":
            out.append(tok)
            on = []
        elif on is not None:
            on.append(tok)
        elif tok:
            out.append(tok)
    return _shown(out)


def _by_position(tokens: list[str], fields: list[str]) -> str:
    """A list behind BY, with the positions of fields as the fields."""
    out = []
    for item in _split(tokens, ","):
        at = next((k for k, t in enumerate(item) if t != "by"), 0)
        if item and item[at].isdigit() and 0 < int(item[at]) <= len(fields):
            item = [*item[:at], fields[int(item[at]) - 1], *item[at + 1:]]
        out.append(_shown(item))
    return "\x1f".join(out)


def _statement(tokens: list[str], sort_fields: bool = True) -> tuple[str, tuple[int, ...]]:
    """A statement whose groups in parentheses are single tokens by now.

    The fields of statements joined by set operations belong together by position, and are sorted together.
    """
    clauses: list[tuple[str, list[str]]] = [("", [])]
    for tok in tokens:
        if tok in CLAUSES:
            clauses.append((tok, []))
        else:
            clauses[-1][1].append(tok)
    leads: list[list[str]] = []
    lists: list[list[str]] = []
    for name, own in clauses:
        if name == "select":
            lead = own[:1] if own[:1] in (["distinct"], ["all"]) else []
            leads.append(lead)
            lists.append([_shown(f) for f in _split(own[len(lead):], ",")])
    order: tuple[int, ...] = ()
    if lists and sort_fields and len({len(x) for x in lists}) == 1:
        order = tuple(sorted(range(len(lists[0])), key=lambda i: [x[i] for x in lists]))
    out, at = [], -1
    for name, own in clauses:
        if name == "select":
            at += 1
            fields = lists[at]
            out.append("\x1f".join([name, *leads[at], *(fields[i] for i in order or range(len(fields)))]))
        elif name in ("where", "having"):
            out.append(f"{name}\x1f{_conditions(own)}")
        elif name == "from":
            out.append(f"{name} {_from(own)}")
        elif name in ("group", "order"):
            out.append(f"{name} {_by_position(own, lists[at] if at >= 0 else [])}")
        elif name or own:
            out.append(f"{name} {_shown(own)}")
    return "\x1e".join(out), order


def canonical_statement(text: str) -> tuple[str, tuple[int, ...]]:
    """The statement with selected fields and AND-ed conditions sorted, and the order the outermost fields took.

    So it is in WHERE, HAVING and ON, in parentheses and in statements inside the statement. What is joined by OR
    keeps its order, and so do the fields of a statement behind IN, which may answer a list before it.
    """
    levels: list[tuple[list[str], str]] = [([], "")]
    for tok in sql_tokens(text):
        if tok == "(":
            own = levels[-1][0]
            levels.append(([], own[-1] if own else ""))
        elif tok == ")" and len(levels) > 1:
            own, before = levels.pop()
            levels[-1][0].append(_group(own, before))
        else:
            levels[-1][0].append(tok)
    while len(levels) > 1:  # parentheses left open
        own, _ = levels.pop()
        levels[-1][0].append("(" + _shown(own))
    return _statement(levels[0][0])


def canonical_result(text: str, order: tuple[int, ...]) -> str:
    """Result rows in one order, each row's cells in the order of the sorted selected fields.

    So a cell stays with its field. Rows of another width than the field list keep the order of their cells.
    """
    low = text.lower()
    if low.strip() == MISSING_RESULT:
        return "\x00"
    rows: list[list[str]] = []
    cur: list[str] | None = None
    depth = 0
    for double, single, bracket, bare in CELL.findall(low):
        if bracket == "[":
            depth += 1
            if depth > 1:
                cur = []
        elif bracket:
            if cur is not None:
                rows.append(cur)
            cur, depth = None, depth - 1
        else:
            cell = " ".join((double or single or bare).split())
            if cur is None:
                rows.append([cell])
            else:
                cur.append(cell)
    width = len(order)
    return "\x1e".join(
        sorted("\x1f".join([r[i] for i in order] if len(r) == width else r) for r in rows)
    )
