"""Operator 2: a template compiler for chat formatting.

A small sandboxed template language is parsed into a syntax tree, its constant
parts are folded, and the tree is turned into Python closures that append text
and generation marks. Templates reach nothing but the names they are given:
there are no calls, no attributes of Python objects, and loops only over lists.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

DEFAULT_TEMPLATE = """{%- for m in messages -%}
{%- if m.role == 'assistant' -%}
{{ '### ' ~ 'Assistant: ' }}{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- elif m.role == 'user' -%}
{{ '### ' ~ 'User: ' }}{{ m.text | escape }}
{%- elif m.role == 'system' -%}
{{ '### ' ~ 'System: ' }}{{ m.text | escape }}
{%- else -%}
{{ '### =' }}{{ m.role | escape_name }}: {{ m.text | escape }}
{%- endif -%}
{{ '</turn>\\n' }}
{%- endfor -%}"""


class TemplateError(ValueError):
    """The template does not parse, or uses what the sandbox does not offer."""


def escape(s: str) -> str:
    """Backslash before every character that could begin a control string."""
    return re.sub(r"[\\#<]", r"\\\g<0>", s)


def escape_name(s: str) -> str:
    """As ``escape``, and for the colon that ends a role."""
    return re.sub(r"[\\#<:]", r"\\\g<0>", s)


def unescape(s: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", s)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_name": escape_name, "trim": str.strip, "upper": str.upper,
    "lower": str.lower, "capitalize": str.capitalize,
}

# ---------------------------------------------------------------- parsing
_TAG = re.compile(r"(?s)\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}")
_TOKEN = re.compile(
    r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.~\[\]()]))", re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "true", "false", "none"}


def _tokens(src: str) -> list[tuple[str, str]]:
    out, at, src = [], 0, src.strip()
    while at < len(src):
        m = _TOKEN.match(src, at)
        if not m:
            raise TemplateError(f"unexpected text in expression: {src[at:at + 20]!r}")
        kind = m.lastgroup or ""
        if kind == "name" and m[kind] in _WORDS:
            kind = "word"
        out.append((kind, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Expr:
    """Recursive descent over one expression; yields tuples (kind, ...)."""

    def __init__(self, src: str) -> None:
        self.toks, self.at = _tokens(src), 0

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.toks[self.at - 1]

    def take(self, *values: str) -> str | None:
        kind, v = self.toks[self.at]
        if kind in ("op", "word") and v in values:
            self.at += 1
            return v
        return None

    def whole(self):
        e = self.either()
        if self.toks[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.toks[self.at][1]!r}")
        return e

    def either(self):
        e = self.both()
        while self.take("or"):
            e = ("or", e, self.both())
        return e

    def both(self):
        e = self.negated()
        while self.take("and"):
            e = ("and", e, self.negated())
        return e

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        e = self.joined()
        op = self.take("==", "!=")
        return (op, e, self.joined()) if op else e

    def joined(self):
        e = self.filtered()
        while self.take("~"):
            e = ("~", e, self.filtered())
        return e

    def filtered(self):
        e = self.reached()
        while self.take("|"):
            kind, name = self.next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            e = ("filter", name, e)
        return e

    def reached(self):
        e = self.atom()
        while True:
            if self.take("."):
                kind, name = self.next()
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no attribute {name!r}")
                e = ("item", e, ("const", name))
            elif self.take("["):
                e = ("item", e, self.either())
                if not self.take("]"):
                    raise TemplateError("missing ]")
            else:
                return e

    def atom(self):
        kind, v = self.next()
        if kind == "str":
            return ("const", re.sub(r"(?s)\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), v[1:-1]))
        if kind == "int":
            return ("const", int(v))
        if kind == "word" and v in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[v])
        if kind == "name":
            if v.startswith("_"):
                raise TemplateError(f"no name {v!r}")
            return ("name", v)
        if (kind, v) == ("op", "("):
            e = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return e
        raise TemplateError(f"unexpected {v or 'end'!r}")


def parse(source: str) -> list[tuple]:
    """Template text -> list of nodes: text, out, if, for, generation."""
    pieces, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        left, right = m[1] or m[4], m[3] or m[6]
        if strip:
            text = text.lstrip()
        if left:
            text = text.rstrip()
        if text:
            pieces.append(("text", text))
        if m[2] is not None:
            pieces.append(("out", m[2]))
        elif m[5] is not None:
            pieces.append(("tag", m[5].strip()))
        at, strip = m.end(), bool(right)
    tail = source[at:].lstrip() if strip else source[at:]
    if tail:
        pieces.append(("text", tail))
    pos = 0

    def block(ends: tuple[str, ...]) -> tuple[list, str]:
        nonlocal pos
        nodes: list[tuple] = []
        while pos < len(pieces):
            kind, body = pieces[pos]
            pos += 1
            if kind == "text":
                nodes.append(("text", body))
            elif kind == "out":
                nodes.append(("out", _Expr(body).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return nodes, body
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            body, _ = block(("endfor",))
            return ("for", m[1], _Expr(m[2]).whole(), body)
        if word == "generation":
            body, _ = block(("endgeneration",))
            return ("generation", body)
        if word == "if":
            arms, other, cond = [], [], _Expr(rest).whole()
            while True:
                body, end = block(("elif", "else", "endif"))
                if cond is None:
                    other = body
                else:
                    arms.append((cond, body))
                if end.startswith("elif"):
                    cond = _Expr(end[4:]).whole()
                elif end == "else":
                    cond = None
                else:
                    return ("if", arms, other)
        raise TemplateError(f"unknown tag {word!r}")

    return block(())[0]


# ---------------------------------------------------------------- folding
def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


def fold_expr(e: tuple) -> tuple:
    """Evaluate what does not depend on names."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "filter":
        sub = fold_expr(e[2])
        return ("const", FILTERS[e[1]](_text(sub[1]))) if sub[0] == "const" else ("filter", e[1], sub)
    args = [fold_expr(x) for x in e[1:]]
    if kind in ("and", "or") and args[0][0] == "const":
        return args[1] if bool(args[0][1]) == (kind == "and") else args[0]
    if all(a[0] == "const" for a in args) and kind != "item":
        return ("const", _closure((kind, *args))({}))
    return (kind, *args)


def fold(nodes: list[tuple]) -> list[tuple]:
    """Fold constants, drop dead branches, join neighbouring text."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "out":
            e = fold_expr(node[1])
            new = [("text", _text(e[1]))] if e[0] == "const" else [("out", e)]
        elif kind == "for":
            new = [("for", node[1], fold_expr(node[2]), fold(node[3]))]
        elif kind == "generation":
            new = [("generation", fold(node[1]))]
        elif kind == "if":
            arms, other = [], fold(node[2])
            for cond, body in node[1]:
                c = fold_expr(cond)
                if c[0] == "const" and not c[1]:
                    continue
                if c[0] == "const":
                    other = fold(body)
                    break
                arms.append((c, fold(body)))
            new = [("if", arms, other)] if arms else other
        else:
            new = [node]
        for n in new:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)
    return out


# ---------------------------------------------------------------- closures
def _closure(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        v = e[1]
        return lambda env: v
    if kind == "name":
        name = e[1]
        return lambda env: env.get(name)
    if kind == "filter":
        f, a = FILTERS[e[1]], _closure(e[2])
        return lambda env: f(_text(a(env)))
    if kind == "not":
        a = _closure(e[1])
        return lambda env: not a(env)
    a, b = _closure(e[1]), _closure(e[2])
    if kind == "item":

        def item(env):
            v, k = a(env), b(env)
            if isinstance(v, dict):
                return v.get(k)
            if isinstance(v, list) and isinstance(k, int) and 0 <= k < len(v):
                return v[k]
            return None

        return item
    if kind == "~":
        return lambda env: _text(a(env)) + _text(b(env))
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "==":
        return lambda env: a(env) == b(env)
    return lambda env: a(env) != b(env)


class Sink:
    """Rendered text with the spans (code points) under generation marks."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[list[int]] = []

    def add(self, s: str) -> None:
        self.parts.append(s)
        self.length += len(s)

    def text(self) -> str:
        return "".join(self.parts)


def _render(nodes: list[tuple]) -> Callable[[dict, Sink], None]:
    steps = [_step(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, sink: Sink) -> None:
        for s in steps:
            s(env, sink)

    return run


def _step(node: tuple) -> Callable[[dict, Sink], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, sink: sink.add(text)
    if kind == "out":
        value = _closure(node[1])
        return lambda env, sink: sink.add(_text(value(env)))
    if kind == "generation":
        inner = _render(node[1])

        def mark(env: dict, sink: Sink) -> None:
            start = sink.length
            inner(env, sink)
            sink.spans.append([start, sink.length])

        return mark
    if kind == "if":
        arms = [(_closure(c), _render(b)) for c, b in node[1]]
        other = _render(node[2])

        def choose(env: dict, sink: Sink) -> None:
            for cond, body in arms:
                if cond(env):
                    return body(env, sink)
            return other(env, sink)

        return choose
    var, items, body = node[1], _closure(node[2]), _render(node[3])

    def loop(env: dict, sink: Sink) -> None:
        seq = items(env)
        if not isinstance(seq, list):
            raise TemplateError(f"{var}: not a list")
        for i, x in enumerate(seq):
            body({**env, var: x, "loop": {"index": i + 1, "first": i == 0}}, sink)

    return loop


class Template:
    """A compiled template; ``render`` gives text and generation spans.

    If its one top-level loop over ``messages`` is the only use of that name, it
    can also be run turn by turn (``streams``): a head, a body per message with
    ``loop.index`` and ``loop.first``, and a tail.
    """

    def __init__(self, source: str = DEFAULT_TEMPLATE) -> None:
        self.source = source
        self.tree = fold(parse(source))
        self.run = _render(self.tree)
        loops = [i for i, n in enumerate(self.tree) if n[0] == "for" and n[2] == ("name", "messages")]
        uses = str(self.tree).count("('name', 'messages')")
        self.streams = len(loops) == 1 and uses == 1
        if self.streams:
            i = loops[0]
            self.var = self.tree[i][1]
            self.head, self.body, self.tail = (
                _render(x) for x in (self.tree[:i], self.tree[i][3], self.tree[i + 1 :])
            )

    def __reduce__(self):
        return Template, (self.source,)

    def render(self, messages: list[dict]) -> tuple[str, list[list[int]]]:
        sink = Sink()
        self.run({"messages": messages}, sink)
        return sink.text(), sink.spans

    def fragment(self, message: dict, index: int, last: bool) -> tuple[str, list[list[int]]]:
        """One turn's share of the output: head before the first, tail after the last."""
        sink = Sink()
        if index == 0:
            self.head({}, sink)
        self.body({self.var: message, "loop": {"index": index + 1, "first": index == 0}}, sink)
        if last:
            self.tail({}, sink)
        return sink.text(), sink.spans


# ---------------------------------------------------------------- Spark
_FRAGMENTS = "conv_id {t}, turn_no bigint, fragment string, loss array<array<bigint>>, last boolean"


def _ordered(conv: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    conv = conv.select(
        F.col(conv_col).alias("c"), F.col(turn_col).alias("t"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return conv.repartition(F.col("c")).sortWithinPartitions("c", "t", "role", "text")


def format_conversations(
    conv: DataFrame,
    template: Template | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn, in order: ``conv_id, turn_no, fragment, loss, last``.

    A conversation's formatted text is its fragments joined in order of
    ``turn_no``; ``loss`` lists the generation spans inside the fragment. Turns
    are ordered by turn (null first), ties by role and text; null role and text
    count as empty; rows with a null conversation id form one conversation;
    repeated rows are turns of their own. Other columns are not read. No rows
    in, no rows out.

    The rows of a partition stream by, one turn held at a time, so a
    conversation of any length needs the memory of one batch. Its turns stay in
    one task, as their order is part of the result. A template that cannot be
    run turn by turn has each conversation gathered first; prefer one that can.
    """
    t = template or Template()
    kind = conv.schema[conv_col].dataType.simpleString()
    ids = to_arrow_type(conv.schema[conv_col].dataType)
    rows = _ordered(conv, conv_col, turn_col, role_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _batched(_fragments(t, _turns(batches))):
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], ids), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                    pa.array(cols[3], pa.list_(pa.list_(pa.int64()))), pa.array(cols[4], pa.bool_()),
                ],
                ["conv_id", "turn_no", "fragment", "loss", "last"],
            )

    out = rows.mapInArrow(run, _FRAGMENTS.format(t=kind))
    return out.withColumnRenamed("conv_id", conv_col)


def _turns(batches):
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in (0, 2, 3)))


def _batched(rows, size: int = 1000, chars: int = 4_000_000):
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r[2]) if isinstance(r[2], str) else 0
        if len(out) >= size or held >= chars:
            yield out
            out, held = [], 0
    if out:
        yield out


def _fragments(t: Template, turns):
    """(conv, number, fragment, spans, last) with one turn of look-ahead."""
    before, no, whole = None, 0, []
    for row in _with_end(turns):
        if before is not None:
            last = row is None or row[0] != before[0]
            message = {"role": before[1], "text": before[2]}
            if t.streams:
                text, spans = t.fragment(message, no, last)
                yield before[0], no, text, spans, last
            else:
                whole.append(message)
                if last:
                    text, spans = t.render(whole)
                    yield before[0], 0, text, spans, True
                    whole = []
            no = 0 if last else no + 1
        before = row


def _with_end(turns):
    yield from turns
    yield None


# A turn in the default format: mark, escaped text, end. Escapes are never split.
_TURN = re.compile(
    r"### (?:(System|User|Assistant)|=((?:[^\\:]|\\.)*+)): ((?:[^\\<]|\\.)*+)</turn>\n", re.S
)


class _Reader:
    """Reads one conversation back from consecutive pieces of formatted text."""

    def __init__(self) -> None:
        self.rest, self.n, self.chars, self.loss_chars = "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, spans: list[list[int]]) -> None:
        self.chars += len(piece)
        for a, b in spans:
            said = unescape(piece[a:b])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.rest += piece
        at = 0
        while m := _TURN.match(self.rest, at):
            role = m[1].lower() if m[1] else unescape(m[2])
            self.turns.update(f"{role}\n{unescape(m[3])}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
            at = m.end()
        self.rest = self.rest[at:]

    def result(self) -> tuple:
        if self.rest:
            raise ValueError(f"formatted text does not read back: {self.rest[:60]!r}")
        return (self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, what the default format's text says: ``n_turns``,
    ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    Takes ``format_conversations`` output as it comes, still in order within its
    tasks, so nothing is shuffled again. A digest over a conversation is
    sequential; hashes and one unread rest are all that is held.
    """
    kind = formatted.schema[conv_col].dataType.simpleString()
    ids = to_arrow_type(formatted.schema[conv_col].dataType)

    def run(batches):
        def digests():
            reader = _Reader()
            for b in batches:
                for c, piece, spans, last in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                    reader.feed(piece, spans)
                    if last:
                        yield (c, *reader.result())
                        reader = _Reader()

        for out in _batched(digests()):
            cols = list(zip(*out))
            types = (ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint"
    )
    return formatted.mapInArrow(run, schema).withColumnRenamed("conv_id", conv_col)
