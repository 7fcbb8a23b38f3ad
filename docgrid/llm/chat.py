r"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded, and Python closures are generated that render a
conversation as a stream of pieces, each with a flag that tells whether a ``generation`` block made it.  The language
is sandboxed: it knows names, literals, dictionary fields, comparisons, ``and or not in + ~``, the filters of
``FILTERS`` and the statements ``for if set generation``; it reaches no attribute, method or function of Python.

Texts are escaped so that no control string (``<|`` or ``|>``) of the template can stand in them: a backslash goes
before every backslash and between the two characters of either string.  ``unescape`` takes exactly those away.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"
)
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"
PART = 1 << 16

CONTROL = re.compile(r"\\|(?<=<)\||(?<=\|)>")
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class TemplateError(ValueError):
    """The template isn't in the language, or asks for what the sandbox doesn't give."""


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": len,
    "default": lambda v, other="": other if v is None else v,
    "replace": lambda v, old, new: _text(v).replace(old, new),
}
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b}
LEXER = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].,|%]))")
STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# Expressions are tuples: ("const", v) ("name", n) ("get", e, e) ("call", f, [e]) ("and"|"or", e, e) ("not", e).
class _Expression:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = LEXER.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        if self.peek()[0] != "str" and self.peek()[1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected, {self.peek()[1]!r} found")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"a name expected, {value!r} found")
        self.at += 1
        return value

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"{self.peek()[1]!r} isn't expected")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        while True:
            if op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                tree = ("call", COMPARE[op], [tree, self.joined()])
            elif self.peek() == ("name", "not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                tree = ("call", COMPARE["not in"], [tree, self.joined()])
            else:
                return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while op := self.take("+", "-", "~", "%"):
            apply = {"+": operator.add, "-": operator.sub, "~": lambda a, b: _text(a) + _text(b), "%": _modulo}[op]
            tree = ("call", apply, [tree, self.filtered()])
        return tree

    def filtered(self) -> tuple:
        tree = self.postfix()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            args = [tree]
            if self.take("("):
                while not self.take(")"):
                    args.append(self.either())
                    self.take(",")
            tree = ("call", FILTERS[name], args)
        return tree

    def postfix(self) -> tuple:
        tree = self.atom()
        while True:
            if self.take("."):
                tree = ("get", tree, ("const", self.name()))
            elif self.take("["):
                tree = ("get", tree, self.either())
                self.need("]")
            else:
                return tree

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        kind, value = self.peek()
        self.at += 1
        if kind == "num":
            return ("const", int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: STRING_ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else ("name", value)
        raise TemplateError(f"a value expected, {value!r} found")


def _modulo(a: Any, b: Any) -> int:
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("% is for whole numbers")
    return a % b


def _get(box: Any, key: Any) -> Any:
    """Field of a dictionary or item of a list; nothing else has fields here."""
    if isinstance(box, dict):
        return box.get(key)
    if isinstance(box, (list, tuple, str)) and isinstance(key, int):
        return box[key] if -len(box) <= key < len(box) else None
    return None


# Statements: ("text", s) ("out", e) ("for", name, e, body) ("if", [(e, body)]) ("set", name, e) ("generation", body).
def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    tokens = [t for t in TAGS.split(source) if t]
    body, at, _ = _body(tokens, 0, ())
    if at != len(tokens):
        raise TemplateError(f"{tokens[at]!r} has no beginning")
    return body


def _body(tokens: list[str], at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int, str]:
    out: list[tuple] = []
    while at < len(tokens):
        t = tokens[at]
        at += 1
        if t.startswith("{#"):
            continue
        if t.startswith("{{"):
            out.append(("out", _Expression(t[2:-2]).whole()))
        elif t.startswith("{%"):
            word, _, rest = t[2:-2].strip().partition(" ")
            if word in ends:
                return out, at, f"{word} {rest}".strip()
            if word == "for":
                name, mid, what = rest.strip().partition(" in ")
                if not mid or not name.strip().isidentifier():
                    raise TemplateError(f"can't read {t!r}")
                inner, at, _ = _body(tokens, at, ("endfor",))
                out.append(("for", name.strip(), _Expression(what).whole(), inner))
            elif word == "if":
                arms, said = [], rest
                while True:
                    inner, at, end = _body(tokens, at, ("elif", "else", "endif"))
                    arms.append((_Expression(said).whole(), inner))
                    if end == "else":
                        inner, at, _ = _body(tokens, at, ("endif",))
                        arms.append((("const", True), inner))
                        break
                    if end == "endif":
                        break
                    said = end.partition(" ")[2]
                out.append(("if", arms))
            elif word == "set":
                name, mid, what = rest.partition("=")
                if not mid or not name.strip().isidentifier():
                    raise TemplateError(f"can't read {t!r}")
                out.append(("set", name.strip(), _Expression(what).whole()))
            elif word == "generation":
                inner, at, _ = _body(tokens, at, ("endgeneration",))
                out.append(("generation", inner))
            else:
                raise TemplateError(f"{word!r} isn't expected")
        else:
            out.append(("text", t))
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return out, at, ""


def fold(tree: tuple) -> tuple:
    """An expression with its constant parts computed."""
    kind = tree[0]
    if kind == "call":
        args = [fold(a) for a in tree[2]]
        return ("const", tree[1](*(a[1] for a in args))) if all(a[0] == "const" for a in args) else ("call", tree[1], args)
    if kind == "get":
        box, key = fold(tree[1]), fold(tree[2])
        return ("const", _get(box[1], key[1])) if box[0] == key[0] == "const" else ("get", box, key)
    if kind == "not":
        a = fold(tree[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind in ("and", "or"):
        a, b = fold(tree[1]), fold(tree[2])
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    return tree


def fold_body(body: list[tuple]) -> list[tuple]:
    """Statements with constants folded, dead branches gone and neighbouring texts joined."""
    out: list[tuple] = []
    for s in body:
        kind = s[0]
        if kind == "out":
            e = fold(s[1])
            s = ("text", _text(e[1])) if e[0] == "const" else ("out", e)
        elif kind == "for":
            s = ("for", s[1], fold(s[2]), fold_body(s[3]))
        elif kind == "set":
            s = ("set", s[1], fold(s[2]))
        elif kind == "generation":
            s = ("generation", fold_body(s[1]))
        elif kind == "if":
            arms = []
            for test, inner in s[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_body(inner)))
                if test[0] == "const":
                    break
            if not arms:
                continue
            if arms[0][0][0] == "const":
                body_of_arm = arms[0][1]
                if body_of_arm and body_of_arm[0][0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + body_of_arm[0][1])
                    body_of_arm = body_of_arm[1:]
                out.extend(body_of_arm)
                continue
            s = ("if", arms)
        if s[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + s[1])
        elif s != ("text", ""):
            out.append(s)
    return out


def _value(tree: tuple) -> Callable[[dict], Any]:
    """A closure for an expression."""
    kind = tree[0]
    if kind == "const":
        constant = tree[1]
        return lambda env: constant
    if kind == "name":
        name = tree[1]
        return lambda env: env.get(name)
    if kind == "get":
        box, key = _value(tree[1]), _value(tree[2])
        return lambda env: _get(box(env), key(env))
    if kind == "not":
        inner = _value(tree[1])
        return lambda env: not inner(env)
    if kind == "and":
        left, right = _value(tree[1]), _value(tree[2])
        return lambda env: left(env) and right(env)
    if kind == "or":
        left, right = _value(tree[1]), _value(tree[2])
        return lambda env: left(env) or right(env)
    apply, args = tree[1], [_value(a) for a in tree[2]]
    if len(args) == 1:
        only = args[0]
        return lambda env: apply(only(env))
    return lambda env: apply(*(a(env) for a in args))


Piece = tuple[str, bool]


def _statement(s: tuple, masked: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = s[0]
    if kind == "text":
        whole = ((s[1], masked),)
        return lambda env: whole
    if kind == "out":
        value = _value(s[1])
        return lambda env: ((_text(value(env)), masked),)
    if kind == "generation":
        return _sequence(s[1], True)
    if kind == "set":
        name, value = s[1], _value(s[2])

        def assign(env):
            env[name] = value(env)
            return ()

        return assign
    if kind == "if":
        arms = [(_value(test), _sequence(inner, masked)) for test, inner in s[1]]

        def choose(env):
            for test, inner in arms:
                if test(env):
                    return inner(env)
            return ()

        return choose
    name, items, inner = s[1], _value(s[2]), _sequence(s[3], masked)

    def repeat(env):
        rest = iter(items(env) or ())
        now, missing = next(rest, END), END
        index = 0
        while now is not missing:
            later = next(rest, END)
            yield from inner(env | {name: now, "loop": {"index": index + 1, "index0": index, "first": index == 0, "last": later is missing}})
            now, index = later, index + 1

    return repeat


END = type("End", (), {})()


def _sequence(body: list[tuple], masked: bool) -> Callable[[dict], Iterator[Piece]]:
    parts = [_statement(s, masked) for s in body]

    def run(env):
        for part in parts:
            yield from part(env)

    return run


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A function from the variables to the pieces (text, made by a generation block) of the output.

    ``messages`` may be any iterable: it is walked once, so a conversation of any length is rendered as it comes.
    """
    return _sequence(fold_body(parse(source)), False)


ORDER = ("conv_id", "turn", "role", "text")
PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))])


def _parts(pieces: Iterable[Piece]) -> Iterator[tuple[str, list[int], list[int]]]:
    """Rendered text in parts of about ``PART`` characters, cut between pieces, with the spans under the loss mask."""
    texts, size, start, end = [], 0, [], []
    for text, masked in pieces:
        if masked and text:
            if end and end[-1] == size:
                end[-1] += len(text)
            else:
                start.append(size)
                end.append(size + len(text))
        texts.append(text)
        size += len(text)
        if size >= PART:
            yield "".join(texts), start, end
            texts, size, start, end = [], 0, [], []
    yield "".join(texts), start, end


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formatted conversations: conv_id, part (from 0), formatted, loss_start, loss_end.

    A conversation is its parts' texts in order; short ones have one part, none has a limit.  The spans are code point
    offsets within the part.  Turns go by turn (null first), then role and text, so repeated rows and ties have one
    order.  Null roles and texts are empty; rows with a null conv_id are one conversation; other columns are ignored;
    an empty table gives an empty result.  The rows of a conversation stay together and in order within a partition;
    they are streamed, never held.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(*ORDER)

    def run(batches):
        render = compile_template(template)

        def turns():
            for b in batches:
                yield from zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)

        held, size = [], 0
        for conv, group in itertools.groupby(turns(), key=operator.itemgetter(0)):
            messages = ({"role": role, "text": text} for _, role, text in group)
            for k, (text, start, end) in enumerate(_parts(render({"messages": messages}))):
                held.append((conv, k, text, start, end))
                size += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), PARTS, strict=True)], schema=PARTS)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), PARTS, strict=True)], schema=PARTS)

    return rows.mapInArrow(run, "conv_id long, part long, formatted string, loss_start array<int>, loss_end array<int>")


class Reader:
    """Reads one formatted conversation back, part by part."""

    def __init__(self):
        self.turns, self.chars, self.loss = 0, 0, 0
        self.sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self.rest = ""

    def feed(self, text: str, start: list[int], end: list[int]) -> None:
        self.chars += len(text)
        for a, b in zip(start, end, strict=True):
            said = unescape(text[a:b])
            self.loss += len(said)
            self.loss_sha.update(said.encode())
        *whole, self.rest = (self.rest + text).split(CLOSE)
        for turn in whole:
            role, mid, said = turn.removeprefix(OPEN).partition(MIDDLE)
            if not mid or not turn.startswith(OPEN):
                raise ValueError("a turn lacks its marks")
            self.turns += 1
            self.sha.update(f"{unescape(role)}\n{unescape(said)}\n".encode())

    def row(self) -> dict:
        if self.rest:
            raise ValueError("the last turn has no end")
        return {"n_turns": self.turns, "turns_sha256": self.sha.hexdigest(), "loss_chars": self.loss, "loss_sha256": self.loss_sha.hexdigest(), "formatted_chars": self.chars}


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text holds, read from the text and its spans alone.

    ``formatted`` must be the result of ``format_conversations`` with the default template, as it comes.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        def parts():
            for b in batches:
                yield from zip(*(b.column(n).to_pylist() for n in PARTS.names), strict=True)

        out = {n: [] for n in names}
        for conv, group in itertools.groupby(parts(), key=operator.itemgetter(0)):
            reader = Reader()
            for _, _, text, start, end in group:
                reader.feed(text, start, end)
            for n, v in ({"conv_id": conv} | reader.row()).items():
                out[n].append(v)
            if len(out["conv_id"]) >= 5000:
                yield pa.RecordBatch.from_pydict(out)
                out = {n: [] for n in names}
        if out["conv_id"]:
            yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.string() if n.endswith("sha256") else pa.int64()) for n in names], names)

    return formatted.mapInArrow(run, schema)
