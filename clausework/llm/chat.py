"""Chat formatting by a template compiler.

A small sandboxed template language is parsed to a syntax tree, constants are folded, and the tree becomes Python closures
that render a conversation turn by turn with the spans of generated text. The language has text, {{ expression }},
{% for x in name %}, {% if %} / {% elif %} / {% else %}, and {% generation %}. Expressions have strings, names, fields of
names (no other attributes, no calls), ==, !=, +, and, or, not, parentheses, and the filters `escape` and `upper`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The strings that steer a reader of the format, and the names of their first letters after the escape sign.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|", "|>")
FIRST = {"<": "l", "[": "b", "|": "p", ">": "g", "\\": "\\"}
_BACK = {v: k for k, v in FIRST.items()}
#: A backslash, the first sign of each control string (they may overlap), or a sign at an end that might make one with what is beside.
_ESCAPE = re.compile(r"\\|(?=%s)." % "|".join(map(re.escape, CONTROLS)) + r"|[<\[|]\Z|\A>", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)

TEMPLATE = (
    "{% for m in messages %}{% if m.role == 'assistant' %}<s><|{{ m.role | escape }}|>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[INST]<|{{ m.role | escape }}|>{{ m.text | escape }}[/INST]{% endif %}{% endfor %}"
)
_TURN = re.compile(r"<s><\|(.*?)\|>(.*?)</s>|\[INST\]<\|(.*?)\|>(.*?)\[/INST\]", re.S)
_ENDS = ("</s>", "[/INST]")


def escape(text: str) -> str:
    r"""No control string is left in the result, nor made with what is beside it: a backslash is doubled, and a control string's first character becomes \ and a letter, which no control string holds."""
    return _ESCAPE.sub(lambda m: "\\" + FIRST[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[1]], text)


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    kind: str
    value: object = None
    parts: list = field(default_factory=list)


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|[+().|])|([A-Za-z_]\w*))")
FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "upper": str.upper}


class _Expression:
    """Precedence climbing over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append(m[0].strip())
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if got is None or want and got != want:
            raise TemplateError(f"expected {want or 'a term'}, got {got}")
        self.at += 1
        return got

    def whole(self) -> Node:
        out = self.either()
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()}")
        return out

    def either(self) -> Node:
        out = self.both()
        while self.peek() == "or":
            self.take()
            out = Node("or", parts=[out, self.both()])
        return out

    def both(self) -> Node:
        out = self.negated()
        while self.peek() == "and":
            self.take()
            out = Node("and", parts=[out, self.negated()])
        return out

    def negated(self) -> Node:
        if self.peek() == "not":
            self.take()
            return Node("not", parts=[self.negated()])
        out = self.joined()
        while self.peek() in ("==", "!="):
            out = Node(self.take(), parts=[out, self.joined()])
        return out

    def joined(self) -> Node:
        out = self.filtered()
        while self.peek() == "+":
            self.take()
            out = Node("+", parts=[out, self.filtered()])
        return out

    def filtered(self) -> Node:
        out = self.atom()
        while self.peek() == "|":
            self.take()
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            out = Node("filter", name, [out])
        return out

    def atom(self) -> Node:
        got = self.take()
        if got == "(":
            out = self.either()
            self.take(")")
            return out
        if got[0] in "'\"":
            return Node("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), got[1:-1], flags=re.S))
        if not re.match(r"[A-Za-z]\w*$", got):  # names with a leading underscore are refused
            raise TemplateError(f"unexpected {got}")
        if self.peek() == ".":
            self.take()
            name = self.take()
            if not re.match(r"[A-Za-z]\w*$", name):
                raise TemplateError(f"no field {name}")
            return Node("field", (got, name))
        return Node("name", got)


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    root = Node("block")
    stack: list[tuple[str, Node, Node | None]] = [("", root, None)]
    at = 0
    for m in _TAG.finditer(source):
        here = stack[-1][1]
        if m.start() > at:
            here.parts.append(Node("const", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            here.parts.append(_Expression(m[1]).whole())
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            f = re.fullmatch(r"([A-Za-z]\w*) in ([A-Za-z]\w*)", rest.strip())
            if not f:
                raise TemplateError(f"for {rest}")
            node = Node("for", (f[1], f[2]), [Node("block")])
            here.parts.append(node)
            stack.append(("for", node.parts[0], node))
        elif word == "if":
            node = Node("if", [_Expression(rest).whole()], [Node("block")])
            here.parts.append(node)
            stack.append(("if", node.parts[0], node))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            node = stack.pop()[2]
            node.value.append(_Expression(rest).whole() if word == "elif" else Node("const", True))
            node.parts.append(Node("block"))
            stack.append(("if", node.parts[-1], node))
        elif word == "generation":
            node = Node("generation", None, [Node("block")])
            here.parts.append(node)
            stack.append(("generation", node.parts[0], node))
        elif word == "end" + stack[-1][0] and len(stack) > 1:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {{% {m[2].strip()} %}}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        root.parts.append(Node("const", source[at:]))
    return root


def fold(node: Node) -> Node:
    """The tree with constant parts computed: joined texts, settled conditions, filtered and compared constants."""
    node = Node(node.kind, [fold(x) for x in node.value] if node.kind == "if" else node.value, [fold(x) for x in node.parts])
    consts = [x.value for x in node.parts] if node.parts and all(x.kind == "const" for x in node.parts) else None
    if node.kind == "block":
        flat: list[Node] = []
        for x in node.parts:
            for y in x.parts if x.kind == "block" else [x]:
                if y.kind == "const" and flat and flat[-1].kind == "const":
                    flat[-1] = Node("const", str(flat[-1].value) + str(y.value))
                else:
                    flat.append(y)
        return Node("block", None, flat)
    if node.kind == "if":
        arms = [(c, b) for c, b in zip(node.value, node.parts, strict=True) if not (c.kind == "const" and not c.value)]
        for k, (c, _) in enumerate(arms):
            if c.kind == "const":
                arms = arms[: k + 1]
                break
        if not arms:
            return Node("block")
        return arms[0][1] if arms[0][0].kind == "const" else Node("if", [c for c, _ in arms], [b for _, b in arms])
    if consts is not None and node.kind in ("+", "==", "!=", "and", "or", "not", "filter"):
        a, b = consts[0], consts[-1]
        return Node("const", {"+": lambda: a + b, "==": lambda: a == b, "!=": lambda: a != b, "and": lambda: a and b, "or": lambda: a or b, "not": lambda: not a, "filter": lambda: FILTERS[node.value](a)}[node.kind]())
    return node


BEGIN, END = object(), object()


def _value(node: Node) -> Callable[[dict], object]:
    if node.kind == "const":
        return lambda env, v=node.value: v
    if node.kind == "name":
        return lambda env, k=node.value: env[k]
    if node.kind == "field":
        return lambda env, k=node.value: env[k[0]][k[1]]
    subs = [_value(x) for x in node.parts]
    a, b = subs[0], subs[-1]
    return {
        "+": lambda env: a(env) + b(env), "==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env), "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env), "not": lambda env: not a(env), "filter": lambda env, f=FILTERS.get(node.value if node.kind == "filter" else ""): f(a(env)),
    }[node.kind]


def _emit(node: Node) -> Callable[[dict], Iterator]:
    if node.kind == "block":
        subs = [_emit(x) for x in node.parts]

        def block(env):
            for s in subs:
                yield from s(env)

        return block
    if node.kind == "for":
        (var, over), body = node.value, _emit(node.parts[0])

        def loop(env):
            for item in env[over]:
                yield from body(env | {var: item})

        return loop
    if node.kind == "if":
        arms = [(_value(c), _emit(b)) for c, b in zip(node.value, node.parts, strict=True)]

        def choose(env):
            for c, b in arms:
                if c(env):
                    yield from b(env)
                    return

        return choose
    if node.kind == "generation":
        body = _emit(node.parts[0])

        def marked(env):
            yield BEGIN
            yield from body(env)
            yield END

        return marked
    get = _value(node)

    def text(env):
        yield str(get(env))

    return text


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator]:
    """A function from messages to pieces of text, with BEGIN and END around generated ones. Messages are taken one at a time."""
    run = _emit(fold(parse(source)))
    return lambda messages: run({"messages": messages})


def formatted(messages: Iterable[dict], render=None) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its generated text."""
    out, spans, n, began = [], [], 0, 0
    for piece in (render or compile_template(TEMPLATE))(messages):
        if piece is BEGIN:
            began = n
        elif piece is END:
            spans.append((began, n))
        else:
            out.append(piece)
            n += len(piece)
    return "".join(out), spans


class Reader:
    """Reads turns back from pieces of a formatted conversation as they come; what is not yet a whole turn is kept."""

    def __init__(self):
        self.parts: list[str] = []

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.parts.append(piece)
        if not piece.endswith(_ENDS):
            return
        text, at = "".join(self.parts), 0
        while m := _TURN.match(text, at):
            yield (unescape(m[1]), unescape(m[2])) if m[1] is not None else (unescape(m[3]), unescape(m[4]))
            at = m.end()
        self.parts = [text[at:]] if at < len(text) else []

    def close(self) -> None:
        if self.parts:
            raise TemplateError(f"not a turn: {''.join(self.parts)[:60]!r}")


def read_back(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation. Anything else in it is an error."""
    out, at = [], 0
    while m := _TURN.match(text, at):
        out.append((unescape(m[1]), unescape(m[2])) if m[1] is not None else (unescape(m[3]), unescape(m[4])))
        at = m.end()
    if at < len(text):
        raise TemplateError(f"not a turn: {text[at:at + 60]!r}")
    return out


_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(messages: Iterable[dict], render) -> tuple[int, str, int, str, int]:
    """Turns, their digest, characters under the loss mask, their digest, and characters in all, of one conversation as it is rendered and read back."""
    reader, n, chars, loss_n, lossy, inside = Reader(), 0, 0, 0, [], False
    said, loss = hashlib.sha256(), hashlib.sha256()
    for piece in render(messages):
        if piece is BEGIN or piece is END:
            inside = piece is BEGIN
            t = unescape("".join(lossy))
            loss_n += len(t)
            loss.update(t.encode("utf-8", "surrogatepass"))
            lossy = []
            continue
        chars += len(piece)
        if inside:
            lossy.append(piece)
        for role, text in reader.feed(piece):
            n += 1
            said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
    reader.close()
    return n, said.hexdigest(), loss_n, loss.hexdigest(), chars


def chat_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation, of what is read back from its formatted form.

    Rows are ordered by turn (nulls first; ties by role and text), and a repeated row is one more turn. A null role is an
    empty one, a null text an empty text; rows with a null conv_id are one conversation. Each conversation is rendered as a
    whole: sorted rows stream through the template and the reader, one turn in memory at a time, so a very long conversation
    is never gathered. A template that writes anything but turns of this format stops the job. Empty input: no rows.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def turns(batches):
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True)

    def stream(batches):
        render = compile_template(template)
        done: list[tuple] = []
        for cid, told in groupby(turns(batches), key=lambda r: r[0]):
            done.append((cid, *digest(({"role": role, "text": text} for _, role, text in told), render)))
            if len(done) >= 1000:
                yield _batch(done)
                done = []
        if done:
            yield _batch(done)

    return rows.mapInArrow(stream, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op5(spark, sf_dir: str) -> DataFrame:
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat_digests(told.unionByName(extra))


def _escaped(col: str) -> str:
    """SQL for the length of a text when escaped: a sign more for each backslash, each control string and an end sign that might make one with what is beside."""
    one = lambda c: f"(length({col}) - length(replace({col}, '{c}', ''))) // {len(c)}"
    return f"(length({col}) + {' + '.join(map(one, (chr(92), *CONTROLS)))} + ({col} <> '' AND right({col}, 1) IN ('<', '[', '|'))::INT + starts_with({col}, '>')::INT)"


OP5_SQL = f"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_escaped('role')} + {_escaped('text')} + CASE WHEN role = 'assistant' THEN 11 ELSE 17 END)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""
