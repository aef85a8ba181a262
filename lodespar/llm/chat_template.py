"""Chat formatting: a compiler for a sandboxed template language.

Source is parsed into a syntax tree, constants are folded (operators and
filters over literals, branches with a known condition, runs of plain text),
and the tree becomes Python closures. A template sees only the values that it
is given: attributes and subscripts read dicts, lists and the loop's own
fields, there are no calls, and filters come from a fixed table.

Language: ``{{ e }}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in e %} {% endfor %}`` with loop.index, index0, first and last,
``{% set x = e %}``, ``{% generation %} {% endgeneration %}``, ``{# #}``, and
``-`` inside a tag's end to strip white space. Expressions have literals, names,
``a.b``, ``a[e]``, ``not and or``, comparisons, ``in``, ``+ - * % ~``, and
filters ``e|f(x)``. Text inside generation marks is what a model learns from.

Edge cases: null texts and roles are empty. Rows of a conversation are ordered
by turn (nulls first), then role, then text. Rows without a conversation id
form one conversation with a null id. Repeated rows are turns of their own.
Texts of any length are formatted whole. A conversation's formatted text is one
value of one row, so one conversation has to fit a task's memory. Other columns
of the input don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util

#: The control strings of the template below.
CONTROLS = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")

TEMPLATE = (
    "<s>{%- for m in messages -%}"
    "{%- if m.role == 'user' -%}{{ '[INST] ' ~ m.text|escape ~ ' [/INST]' }}"
    "{%- elif m.role == 'assistant' -%}{% generation %}{{ m.text|escape }}{% endgeneration %}{{ '</s>' }}"
    "{%- elif m.role == 'system' -%}{{ '<<SYS>>' ~ m.text|escape ~ '<</SYS>>' }}"
    "{%- else -%}{{ '[ROLE]' ~ m.role|escape ~ '[/ROLE]' ~ m.text|escape ~ '</s>' }}"
    "{%- endif -%}{%- endfor -%}"
)

_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_UNESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class TemplateError(ValueError):
    pass


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x), "default": lambda x, d="": d if x is None else x, "string": lambda x: _text(x), "first": lambda x: x[0] if x else None, "last": lambda x: x[-1] if x else None,
    "join": lambda x, d="": d.join(map(_text, x)), "replace": lambda x, a, b: _text(x).replace(a, b),
}


def _text(x) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else x if isinstance(x, str) else str(x)


def _item(x, key):
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return x[key] if -len(x) <= key < len(x) else None
    return None


BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: _times(a, b), "%": lambda a, b: _rest(a, b), "~": lambda a, b: _text(a) + _text(b),
}


def _times(a, b):
    if isinstance(a, str) or isinstance(b, str):
        raise TemplateError("text can't be multiplied")
    return a * b


def _rest(a, b):
    if isinstance(a, str):
        raise TemplateError("text has no remainder")
    return a % b


# ---- parsing: nodes are tuples, the first field names the kind

_TAG = re.compile(r"\{#.*?#\}|\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*%~<>.|()\[\],=]))", re.S)
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_BACK = {"n": "\n", "t": "\t", "r": "\r"}


class _Parser:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, object]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 20]!r}")
            at = m.end()
            if m[1]:
                self.tokens.append(("const", int(m[1])))
            elif m[2]:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _BACK.get(x[1], x[1]), m[2][1:-1], flags=re.S)))
            else:
                self.tokens.append(("name", m[3]) if m[3] else ("op", m[4]))
        self.i = 0

    def take(self, *wanted: str) -> str | None:
        if self.i < len(self.tokens) and self.tokens[self.i][0] != "const" and self.tokens[self.i][1] in wanted:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted} is missing")

    def name(self) -> str:
        kind, x = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
        if kind != "name":
            raise TemplateError("a name is missing")
        self.i += 1
        return x

    def end(self, node):
        if self.i < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.i][1]!r}")
        return node

    def expr(self):
        a = self.conjunction()
        while self.take("or"):
            a = ("or", a, self.conjunction())
        return a

    def conjunction(self):
        a = self.negation()
        while self.take("and"):
            a = ("and", a, self.negation())
        return a

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        a = self.chain(0)
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in", "not"):
            if op == "not":
                self.need("in")
                op = "not in"
            a = ("binary", op, a, self.chain(0))
        return a

    def chain(self, level: int):
        levels = (("~",), ("+", "-"), ("*", "%"))
        if level == len(levels):
            return self.unary()
        a = self.chain(level + 1)
        while op := self.take(*levels[level]):
            a = ("binary", op, a, self.chain(level + 1))
        return a

    def unary(self):
        if self.take("-"):
            return ("binary", "-", ("const", 0), self.unary())
        a = self.primary()
        while True:
            if self.take("."):
                a = ("item", a, ("const", self.name()))
            elif self.take("["):
                a = ("item", a, self.expr())
                self.need("]")
            elif self.take("|"):
                f, args = self.name(), []
                if f not in FILTERS:
                    raise TemplateError(f"no filter {f}")
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.expr())
                        self.take(",")
                a = ("filter", f, a, tuple(args))
            else:
                return a

    def primary(self):
        if self.take("("):
            a = self.expr()
            self.need(")")
            return a
        if self.i >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, x = self.tokens[self.i]
        if kind == "op":
            raise TemplateError(f"unexpected {x!r}")
        self.i += 1
        return ("const", x) if kind == "const" else ("const", _WORDS[x]) if x in _WORDS else ("name", x)


def parse(source: str) -> list:
    """The syntax tree: a list of nodes text, out, if, for, set, generation."""
    items: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        if (m[1] or m[4]) == "-":
            text = text.rstrip()
        items.append(("text", text))
        if m[2] is not None:
            items.append(("out", m[2]))
        elif m[5] is not None:
            items.append(("tag", m[5].strip()))
        strip, at = (m[3] or m[6]) == "-", m.end()
    items.append(("text", source[at:].lstrip() if strip else source[at:]))
    items = items[::-1]

    def body(*ends: str) -> tuple[list, str]:
        out: list = []
        while items:
            kind, x = items.pop()
            if kind == "text":
                if x:
                    out.append(("text", x))
            elif kind == "out":
                p = _Parser(x)
                out.append(("out", p.end(p.expr())))
            else:
                word = x.split(None, 1)[0] if x else ""
                rest = x[len(word) :]
                if word in ends:
                    return out, x
                p = _Parser(rest)
                if word == "if":
                    arms, other, cond = [], [], p.end(p.expr())
                    while True:
                        inner, stop = body("elif", "else", "endif")
                        if cond is None:
                            other = inner
                        else:
                            arms.append((cond, inner))
                        if stop.startswith("elif") and cond is not None:
                            q = _Parser(stop[4:])
                            cond = q.end(q.expr())
                        elif stop == "else" and cond is not None:
                            cond = None
                        elif stop == "endif":
                            break
                        else:
                            raise TemplateError(f"misplaced {stop}")
                    out.append(("if", arms, other))
                elif word == "for":
                    var = p.name()
                    p.need("in")
                    over = p.end(p.expr())
                    out.append(("for", var, over, body("endfor")[0]))
                elif word == "set":
                    var = p.name()
                    p.need("=")
                    out.append(("set", var, p.end(p.expr())))
                elif word == "generation":
                    out.append(("generation", body("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown tag {word}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return body()[0]


# ---- folding


def fold_expr(e):
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "not":
        a = fold_expr(e[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind in ("and", "or"):
        a, b = fold_expr(e[1]), fold_expr(e[2])
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "item":
        a, b = fold_expr(e[1]), fold_expr(e[2])
        return ("const", _item(a[1], b[1])) if a[0] == b[0] == "const" else ("item", a, b)
    if kind == "filter":
        a, args = fold_expr(e[2]), tuple(fold_expr(x) for x in e[3])
        if all(x[0] == "const" for x in (a, *args)):
            return ("const", FILTERS[e[1]](a[1], *(x[1] for x in args)))
        return ("filter", e[1], a, args)
    a, b = fold_expr(e[2]), fold_expr(e[3])
    if a[0] == b[0] == "const":
        try:
            return ("const", BINARY[e[1]](a[1], b[1]))
        except (TypeError, ZeroDivisionError) as x:
            raise TemplateError(str(x)) from x
    return ("binary", e[1], a, b)


def fold(nodes: list) -> list:
    out: list = []
    for n in nodes:
        kind = n[0]
        if kind == "out":
            e = fold_expr(n[1])
            n = ("text", _text(e[1])) if e[0] == "const" else ("out", e)
        elif kind == "if":
            arms, other = [], fold(n[2])
            for cond, inner in n[1]:
                c = fold_expr(cond)
                if c[0] == "const":
                    if c[1]:
                        other = fold(inner)
                        break
                    continue
                arms.append((c, fold(inner)))
            if not arms:
                for x in other:
                    _append(out, x)
                continue
            n = ("if", arms, other)
        elif kind == "for":
            n = ("for", n[1], fold_expr(n[2]), fold(n[3]))
        elif kind == "set":
            n = ("set", n[1], fold_expr(n[2]))
        elif kind == "generation":
            n = ("generation", fold(n[1]))
        _append(out, n)
    return out


def _append(out: list, n) -> None:
    if n[0] == "text":
        if not n[1]:
            return
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + n[1])
            return
    out.append(n)


# ---- closures


def _compile_expr(e) -> Callable:
    kind = e[0]
    if kind == "const":
        value = e[1]
        return lambda env: value
    if kind == "name":
        name = e[1]
        return lambda env: env.get(name)
    if kind == "not":
        a = _compile_expr(e[1])
        return lambda env: not a(env)
    if kind in ("and", "or"):
        a, b = _compile_expr(e[1]), _compile_expr(e[2])
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    if kind == "item":
        a, b = _compile_expr(e[1]), _compile_expr(e[2])
        return lambda env: _item(a(env), b(env))
    if kind == "filter":
        f, a, args = FILTERS[e[1]], _compile_expr(e[2]), [_compile_expr(x) for x in e[3]]
        return (lambda env: f(a(env), *[x(env) for x in args])) if args else (lambda env: f(a(env)))
    op, a, b = BINARY[e[1]], _compile_expr(e[2]), _compile_expr(e[3])
    return lambda env: op(a(env), b(env))


def _compile(nodes: list) -> Callable:
    """A closure of the environment and the output."""
    run: list[Callable] = []
    for n in nodes:
        kind = n[0]
        if kind == "text":
            run.append(lambda env, out, text=n[1]: out.write(text))
        elif kind == "out":
            run.append(lambda env, out, e=_compile_expr(n[1]): out.write(_text(e(env))))
        elif kind == "set":
            run.append(lambda env, out, name=n[1], e=_compile_expr(n[2]): env.__setitem__(name, e(env)))
        elif kind == "if":
            run.append(_branch([(_compile_expr(c), _compile(b)) for c, b in n[1]], _compile(n[2])))
        elif kind == "for":
            run.append(_loop(n[1], _compile_expr(n[2]), _compile(n[3])))
        else:
            run.append(_marked(_compile(n[1])))
    if len(run) == 1:
        return run[0]

    def block(env, out):
        for f in run:
            f(env, out)

    return block


def _branch(arms, other):
    def branch(env, out):
        for cond, inner in arms:
            if cond(env):
                return inner(env, out)
        return other(env, out)

    return branch


def _loop(name, over, inner):
    def loop(env, out):
        items = iter(over(env) or ())
        inside = dict(env)
        missing = object()
        i, x = 0, next(items, missing)
        while x is not missing:
            after = next(items, missing)
            inside[name] = x
            inside["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": after is missing}
            inner(inside, out)
            i, x = i + 1, after

    return loop


def _marked(inner):
    def marked(env, out):
        out.begin()
        inner(env, out)
        out.end()

    return marked


class Output:
    def __init__(self):
        self.parts: list[str] = []
        self.size = self.depth = 0
        self.spans: list[tuple[int, int]] = []
        self.start = 0

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def begin(self) -> None:
        if not self.depth:
            self.start = self.size
        self.depth += 1

    def end(self) -> None:
        self.depth -= 1
        if not self.depth:
            self.spans.append((self.start, self.size))


class Template:
    def __init__(self, source: str):
        self.source = source
        self.tree = fold(parse(source))
        self._run = _compile(self.tree)

    def __reduce__(self):
        return Template, (self.source,)

    def render(self, **values) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the places (code points) of what stands inside generation marks."""
        out = Output()
        self._run(dict(values), out)
        return "".join(out.parts), out.spans


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Reads (role, text) back from a conversation formatted by TEMPLATE."""
    if not formatted.startswith("<s>"):
        raise ValueError("no begin mark")
    at = 3

    def until(mark: str, start: int) -> tuple[str, int]:
        end = formatted.index(mark, start)
        return unescape(formatted[start:end]), end + len(mark)

    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            role = "user"
            text, at = until(" [/INST]", at + 7)
        elif formatted.startswith("<<SYS>>", at):
            role = "system"
            text, at = until("<</SYS>>", at + 7)
        elif formatted.startswith("[ROLE]", at):
            role, at = until("[/ROLE]", at + 6)
            text, at = until("</s>", at)
        else:
            role = "assistant"
            text, at = until("</s>", at)
        yield role, text


def format_conversations(rows: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, formatted, and spans (start, end in code points) under the loss mask."""
    _util.ship(rows.sparkSession)
    compiled = Template(template)
    named = rows.select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        now, messages, started = None, [], False
        done: list[tuple] = []
        size = 0
        for batch in batches:
            for c, r, t in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if started and c != now:
                    done.append((now, *compiled.render(messages=messages)))
                    messages = []
                    size += len(done[-1][1])
                    if len(done) >= 500 or size > _util.STEP_BYTES:
                        yield _formatted(done)
                        done, size = [], 0
                now, started = c, True
                messages.append({"role": r, "text": t})
        if started:
            done.append((now, *compiled.render(messages=messages)))
            yield _formatted(done)

    return dealt.mapInArrow(run, "conv_id bigint, formatted string, spans array<struct<start:bigint,end:bigint>>")


def _formatted(done: list[tuple]) -> pa.RecordBatch:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.record_batch([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done]), pa.array([[{"start": a, "end": b} for a, b in d[2]] for d in done], pa.list_(span))], names=["conv_id", "formatted", "spans"])


def digests(formatted: DataFrame) -> DataFrame:
    """Reads turns and learnt text back from the output of format_conversations with TEMPLATE."""
    _util.ship(formatted.sparkSession)

    def run(batches):
        for batch in _util.steps(batches, "formatted"):
            rows = []
            for c, text, spans in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "spans"))):
                n, h = 0, hashlib.sha256()
                for role, said in turns(text):
                    n += 1
                    h.update(f"{role}\n{said}\n".encode())
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((c, n, h.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            if rows:
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: The same for DuckDB over the view conversations. formatted_chars counts the marks and what escaping adds.
SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n as (select *, length(text) + length(regexp_replace(text, '[^\\]+', '', 'g')) + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|</?s>|\[/?INST\]|\[/?ROLE\]')) chars from c)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  (3 + sum(chars + case role when 'user' then 15 when 'assistant' then 4 when 'system' then 15 else 17 + length(role) end))::bigint formatted_chars
from n group by conv_id
"""
