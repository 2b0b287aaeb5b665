"""Chat formatting: a sandboxed template language compiled to Python closures.

The language has text, `{{ expression }}` and the tags `for x in y`, `if`,
`elif`, `else`, `set`, `generation` with their `end...`.  Expressions know
literals, names, `a.b` and `a['b']` on mappings, `==`, `!=`, `in`, `and`, `or`,
`not`, `+`, `if`-`else` and filters (`x | f`).  There are no calls, no Python
attributes and no names but those given, so a template reaches nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- language

_LEX = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.+()\[\]]))")
_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}


#: Brackets and blocks that may stand in each other; characters that one rendering may give.
MOST_NESTED, MOST_CHARS = 40, 1 << 32


class TemplateError(ValueError):
    """All that a template can do wrong, when it is compiled or rendered."""


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
        at = m.end()
        kind = m.lastgroup
        out.append(("word" if kind == "name" and m[kind] in _WORDS else kind, m[kind]))
    return out


class _Expression:
    """Recursive descent over one expression; nodes are tuples whose first item names them."""

    def __init__(self, source: str):
        self.tokens, self.at, self.depth = _lex(source), 0, 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "word") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def whole(self) -> tuple:
        node = self.choice()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> tuple:
        self.depth += 1
        if self.depth > MOST_NESTED:
            raise TemplateError("too deeply nested")
        node = self._choice()
        self.depth -= 1
        return node

    def _choice(self) -> tuple:
        then = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return ("choice", test, then, self.choice())
        return then

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        for op in ("==", "!=", "in"):
            if self.take(op):
                return (op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.reached()
        while self.take("|"):
            node = ("filter", self.name(), node)
        return node

    def reached(self) -> tuple:
        node = self.atom()
        while self.peek(".", "["):
            if self.take("."):
                node = ("get", node, ("value", self.name()))
            else:
                self.need("[")
                node = ("get", node, self.choice())
                self.need("]")
        return node

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name expected")

    def atom(self) -> tuple:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("value", text[1:-1])
        if kind == "num":
            return ("value", int(text))
        if kind == "name":
            return ("name", text)
        if text in ("true", "false", "none"):
            return ("value", {"true": True, "false": False, "none": None}[text])
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template: a list of nodes."""
    root: list[tuple] = []
    stack: list[tuple[str, list, Any]] = [("", root, None)]
    at = 0

    def close(kind: str) -> Any:
        if stack[-1][0] != kind:
            raise TemplateError(f"end{kind} has no beginning")
        return stack.pop()[2]

    for m in [*_PART.finditer(source), None]:
        if len(stack) > MOST_NESTED:
            raise TemplateError("too deeply nested")
        if text := source[at : m.start() if m else len(source)]:
            stack[-1][1].append(("text", text))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("out", _Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            target = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not target:
                raise TemplateError("for x in y expected")
            body: list[tuple] = []
            stack[-1][1].append(("for", target[1], _Expression(target[2]).whole(), body))
            stack.append(("for", body, None))
        elif word == "if":
            arms = [(_Expression(rest).whole(), [])]
            stack[-1][1].append(("if", arms))
            stack.append(("if", arms[0][1], arms))
        elif word in ("elif", "else"):
            arms = close("if")
            arms.append((_Expression(rest).whole() if word == "elif" else ("value", True), []))
            stack.append(("if", arms[-1][1], arms))
        elif word == "generation":
            body = []
            stack[-1][1].append(("generation", body))
            stack.append(("generation", body, None))
        elif word == "set":
            target = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
            if not target:
                raise TemplateError("set x = y expected")
            stack[-1][1].append(("set", target[1], _Expression(target[2]).whole()))
        elif word in ("endfor", "endif", "endgeneration"):
            close(word[3:])
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} has no end")
    return root


def _fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """Replaces what doesn't depend on the conversation by its value."""
    kind = node[0]
    if kind in ("value", "name"):
        return node
    if kind == "filter":
        inner = _fold(node[2], filters)
        return ("value", filters[node[1]](inner[1])) if inner[0] == "value" and node[1] in filters else ("filter", node[1], inner)
    inner = tuple(_fold(x, filters) for x in node[1:])
    if kind == "choice" and inner[0][0] == "value":
        return inner[1] if inner[0][1] else inner[2]
    if kind in ("and", "or") and inner[0][0] == "value":
        return inner[1] if bool(inner[0][1]) == (kind == "and") else inner[0]
    if kind != "get" and all(x[0] == "value" for x in inner):
        return ("value", _evaluate((kind, *inner), filters)({}))
    return (kind, *inner)


def fold(nodes: list[tuple], filters: dict[str, Callable]) -> list[tuple]:
    """The tree with constants folded, dead branches gone and neighbouring texts joined."""
    out: list[tuple] = []

    def put(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node[0] != "text" or node[1]:
            out.append(node)

    for node in nodes:
        if node[0] == "out":
            value = _fold(node[1], filters)
            put(("text", _shown(value[1])) if value[0] == "value" else ("out", value))
        elif node[0] == "for":
            put(("for", node[1], _fold(node[2], filters), fold(node[3], filters)))
        elif node[0] == "generation":
            put(("generation", fold(node[1], filters)))
        elif node[0] == "set":
            put(("set", node[1], _fold(node[2], filters)))
        elif node[0] == "if":
            arms = []
            for test, body in ((_fold(t, filters), fold(b, filters)) for t, b in node[1]):
                if test[0] == "value" and not test[1]:
                    continue
                arms.append((test, body))
                if test[0] == "value":
                    break
            if arms and arms[0][0][0] == "value":
                for x in arms[0][1]:
                    put(x)
            elif arms:
                put(("if", arms))
        else:
            put(node)
    return out


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


def _added(a: Any, b: Any) -> Any:
    """Numbers add up; all else is joined as text."""
    return a + b if type(a) is type(b) is int else _shown(a) + _shown(b)


def _within(a: Any, b: Any) -> bool:
    """A text in a text, or a value in a list or among the names of a mapping; nothing is in anything else."""
    if isinstance(b, str):
        return isinstance(a, str) and a in b
    return any(type(x) is type(a) and x == a for x in b) if isinstance(b, list | tuple | dict) else False


def _evaluated(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    """The closure of a whole expression; whatever goes wrong in it is the template's fault."""
    inner = _evaluate(node, filters)

    def run(scope: dict) -> Any:
        try:
            return inner(scope)
        except TemplateError:
            raise
        except (TypeError, ValueError, AttributeError, LookupError, RecursionError) as e:
            raise TemplateError(f"an expression fails: {e}") from e

    return run


def _evaluate(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "value":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        f, inner = filters[node[1]], _evaluate(node[2], filters)
        return lambda scope: f(inner(scope))
    parts = [_evaluate(x, filters) for x in node[1:]]
    if kind == "not":
        return lambda scope: not parts[0](scope)
    if kind == "choice":
        return lambda scope: parts[1](scope) if parts[0](scope) else parts[2](scope)
    a, b = parts
    if kind == "get":

        def get(scope: dict) -> Any:
            holder, key = a(scope), b(scope)
            if isinstance(holder, list | tuple) and type(key) is int:
                return holder[key] if 0 <= key < len(holder) else None
            return holder.get(key) if isinstance(holder, dict) and isinstance(key, str | int) else None

        return get
    return {
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
        "in": lambda scope: _within(a(scope), b(scope)),
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
        "+": lambda scope: _added(a(scope), b(scope)),
    }[kind]


Fragments = Iterator[tuple[str, bool]]
Render = Callable[[dict, bool], Fragments]


def _block(nodes: list[tuple], filters: dict[str, Callable]) -> Render:
    steps: list[Render] = []
    for node in nodes:
        kind = node[0]
        if kind == "text":
            steps.append(lambda scope, mask, text=node[1]: iter(((text, mask),)))
        elif kind == "out":
            steps.append(lambda scope, mask, f=_evaluated(node[1], filters): iter(((_shown(f(scope)), mask),)))
        elif kind == "generation":
            steps.append(lambda scope, mask, body=_block(node[1], filters): body(scope, True))
        elif kind == "set":

            def put(scope: dict, mask: bool, name: str = node[1], f=_evaluated(node[2], filters)) -> Fragments:
                scope[name] = f(scope)
                return iter(())

            steps.append(put)
        elif kind == "if":
            arms = [(_evaluated(t, filters), _block(b, filters)) for t, b in node[1]]

            def branch(scope: dict, mask: bool, arms=arms) -> Fragments:
                for test, body in arms:
                    if test(scope):
                        return body(scope, mask)
                return iter(())

            steps.append(branch)
        else:

            def loop(scope: dict, mask: bool, name: str = node[1], items=_evaluated(node[2], filters), body=_block(node[3], filters)) -> Fragments:
                each = items(scope)
                if each is not None and not isinstance(each, Iterable):
                    raise TemplateError(f"{name} can't go through {_shown(each)[:20]!r}")
                for i, item in enumerate(() if each is None else each):
                    yield from body(scope | {name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0}}, mask)

            steps.append(loop)

    def run(scope: dict, mask: bool) -> Fragments:
        for step in steps:
            yield from step(scope, mask)

    return run


def compile_template(source: str, filters: dict[str, Callable[[Any], Any]]) -> Callable[..., Fragments]:
    """A function that renders given names as fragments (text, is it under the loss mask), lazily.

    A template sees the given names and filters alone.  What it does wrong is a
    TemplateError: when it is compiled, if that shows then, else when it is
    rendered; so is nesting beyond MOST_NESTED and output beyond MOST_CHARS.
    """
    try:
        body = _block(fold(parse(source), filters), filters)
    except TemplateError:
        raise
    except (TypeError, ValueError, AttributeError, LookupError, RecursionError) as e:
        raise TemplateError(f"the template can't be compiled: {e}") from e

    def render(**names: Any) -> Fragments:
        left = MOST_CHARS
        for text, mask in body(dict(names), False):
            left -= len(text)
            if left < 0:
                raise TemplateError("the output is too long")
            yield text, mask

    return render


# ------------------------------------------------- escaping and reading back


class ControlStrings:
    """Escapes a template's control strings inside texts, reversibly.

    After the first character of a control string in a text a backslash is
    put, one more than the text itself has there; so no control string is left
    and unescaping takes exactly one away.
    """

    def __init__(self, strings: tuple[str, ...]):
        heads = "|".join(rf"{re.escape(s[0])}\\*(?={re.escape(s[1:])})" for s in strings)
        self._find = re.compile(heads)
        self.tokens = re.compile("|".join(map(re.escape, sorted(strings, key=len, reverse=True))))

    def escape(self, text: str | None) -> str:
        return self._find.sub(lambda m: m[0] + "\\", text or "")

    def unescape(self, text: str) -> str:
        return self._find.sub(lambda m: m[0][:-1] if m[0].endswith("\\") else m[0], text)


#: The default template: user and assistant turns have marks of their own, any other role is written out.
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | guard }} [/INST]"
    "{% elif m.role == 'assistant' %}[ANSWER] {% generation %}{{ m.text | guard }}{% endgeneration %}</s>"
    "{% else %}[ROLE] {{ m.role | guard }}[TEXT] {{ m.text | guard }}[/TEXT]{% endif %}"
    "{% endfor %}"
)
CONTROL = ("[INST]", "[/INST]", "[ANSWER]", "</s>", "[ROLE]", "[TEXT]", "[/TEXT]")


@lru_cache(maxsize=8)
def _compiled(template: str, control: tuple[str, ...]) -> tuple[Callable[..., Fragments], ControlStrings]:
    guard = ControlStrings(control)
    return compile_template(template, {"guard": guard.escape}), guard


#: Characters of a conversation that are held at once.
CHUNK = 1 << 20


def _format(template: str, control: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render, _ = _compiled(template, control)
        rows = ((c, {"role": r or "", "text": t or ""}) for pdf in batches for c, r, t in zip(pdf["conv"].astype(object).where(pdf["conv"].notna(), None), pdf["role"], pdf["text"], strict=True))
        held: list[tuple] = []
        for conv, messages in _runs(rows):
            parts, spans, size, chunk, turns = [], [], 0, 0, 0

            def counted(messages=messages) -> Iterator[dict]:
                nonlocal turns
                for m in messages:
                    turns += 1
                    yield m

            for text, mask in render(messages=counted()):
                if mask:
                    spans.append({"start": size, "stop": size + len(text)})
                parts.append(text)
                size += len(text)
                if size >= CHUNK:
                    held.append((conv, chunk, "".join(parts), spans))
                    parts, spans, size, chunk = [], [], 0, chunk + 1
                    yield _frame(held)
                    held = []
            held.append((conv, chunk, "".join(parts), spans))
            if sum(len(x[2]) for x in held) >= CHUNK:
                yield _frame(held)
                held = []
        yield _frame(held)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["conv", "chunk", "formatted", "loss_spans"])
    return pdf.astype({"conv": "Int64", "chunk": "int64"})


def _runs(rows: Iterator[tuple[Any, dict]]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Neighbouring rows of one key, one run after the other; a run is read before the next."""
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def run(key=key) -> Iterator[Any]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                now, ahead = ahead, next(rows, None)
                yield now[1]

        yield key, (own := run())
        for _ in own:
            pass


def format_conversations(
    turns: DataFrame, template: str = TEMPLATE, control: tuple[str, ...] = CONTROL, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Renders each conversation by the template, in the order of its turns.

    Returns conv_id, chunk, formatted, loss_spans (array<struct<start,stop>>,
    character places in the chunk under `generation`).  Rows of a conversation
    stream through one task in sorted order and leave it in chunks of about
    CHUNK characters, so that a conversation of any length needs little
    memory; a text is never cut by a chunk's end in a way that the following
    chunk doesn't continue.  Equal turns go by role and text; a null turn is
    first; a null role or text is empty; rows with a null conv_id are one
    conversation.  Extra columns are ignored; an empty table gives no rows.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    schema = "conv long, chunk long, formatted string, loss_spans array<struct<start:long,stop:long>>"
    return dealt.mapInPandas(_format(template, control), schema).withColumnRenamed("conv", conv_col)


def read_turns(formatted: Iterator[str], control: tuple[str, ...] = CONTROL) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, from the chunks of one conversation made by TEMPLATE."""
    _, guard = _compiled(TEMPLATE, control)
    longest = max(map(len, control))
    held, mark, role, at = "", "", "", 0
    for text in formatted:
        held += text
        while m := guard.tokens.search(held, at):
            before = held[: m.start()]
            held, at = held[m.end() :], 0
            if m[0] == "[TEXT]":
                role = guard.unescape(before[1:])
            elif m[0] == "[/INST]":
                yield "user", guard.unescape(before[1:-1])
            elif m[0] == "</s>":
                yield "assistant", guard.unescape(before[1:])
            elif m[0] == "[/TEXT]":
                yield role, guard.unescape(before[1:])
            mark = m[0]
        at = max(0, len(held) - longest)
    if held.strip():
        raise ValueError(f"text after the last turn ({mark})")
