"""JavaScript and TypeScript: broker events, HTTP routes, tRPC and GraphQL operations of one file.

A file is read as tokens with matched brackets.  Names are folded from literals, templates, sums and constants
of the file; an imported constant keeps its spelling.  Objects are told apart by what they were built from: a
rule of a library applies where the file loads the library and the receiver is one of its clients, or where
the file builds none of its own.
"""

from __future__ import annotations

import re
from functools import cached_property
from itertools import product

from weftline.sources import broker_rules as R

_TOKEN = re.compile(
    r"(?P<gap>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")|(?P<tpl>`(?:[^`\\]|\\.)*`)"
    r"|(?P<id>[A-Za-z_$][\w$]*|\#[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\?\.|\.\.\.|[{}()\[\];,.:=<>+\-*/%&|^!~?@#\\])|(?P<other>.)",
    re.S,
)
_FRAMEWORK = re.compile(rf"['\"`](?:{'|'.join(re.escape(lib) for group in R.FRAMEWORKS.values() for lib in group)})['\"`/]")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_CONST = re.compile(r"[A-Z_][A-Z0-9_]*$")
MOST_PREFIXES, MOST_MOUNTS, MOST_ROUTES, DEPTH = 4, 64, 5000, 24
#: Shapes of a text that could hold a broker interaction without naming a library (fixed values).
SHAPES = ("Queue", "Worker", "roducer", "onsumer", "afka", "edpanda", "PRODUCER", "CONSUMER", "KAFKA", "REDPANDA")


def mentions_broker(text: str) -> bool:
    """Whether a text is worth reading for events."""
    return any(s in text for s in SHAPES) or any(lib.rstrip("/") in text for g, libs in R.LIBRARIES.items() if g != "kafka_any" for lib in libs)


def mentions_http(text: str) -> bool:
    """Whether a text could declare a route: it names a framework as a module, or uses a verb decorator."""
    return bool(_FRAMEWORK.search(text)) or ("@" in text and any(f"@{d}" in text for d in R.VERB_DECORATORS))


class Script:
    def __init__(self, text: str):
        self.text = text
        self.kind: list[str] = []
        self.value: list[str] = []
        self.at: list[int] = []
        for m in _TOKEN.finditer(text):
            if m.lastgroup != "gap":
                self.kind.append(m.lastgroup)
                self.value.append(m[0])
                self.at.append(m.start())
        self.size = len(self.value)
        self.mate: dict[int, int] = {}
        stack: list[int] = []
        for i, v in enumerate(self.value):
            if self.kind[i] != "op":
                continue
            if v in "([{":
                stack.append(i)
            elif v in ")]}" and stack and self.value[stack[-1]] == _PAIRS[v]:
                self.mate[stack[-1]] = i
                self.mate[i] = stack.pop()

    # ---- positions

    def __len__(self) -> int:
        return self.size

    @cached_property
    def _line_starts(self) -> list[int]:
        return [0, *(m.end() for m in re.finditer("\n", self.text))]

    def line(self, i: int) -> int:
        from bisect import bisect_right

        return bisect_right(self._line_starts, self.at[i])

    def is_op(self, i: int, v: str) -> bool:
        return 0 <= i < self.size and self.value[i] == v and self.kind[i] == "op"

    def is_id(self, i: int, v: str | None = None) -> bool:
        return 0 <= i < self.size and (v is None or self.value[i] == v) and self.kind[i] == "id"

    @cached_property
    def around(self) -> list[int]:
        """For each token the innermost bracket open around it, or -1."""
        out, stack = [], []
        for i in range(len(self)):
            if i in self.mate and self.mate[i] < i and stack:
                stack.pop()
            out.append(stack[-1] if stack else -1)
            if i in self.mate and self.mate[i] > i:
                stack.append(i)
        return out

    def parts(self, a: int, b: int, mark: str = ",") -> list[tuple[int, int]]:
        """Stretches of [a, b) between marks at its own depth."""
        out, first, i = [], a, a
        while i < b:
            if i in self.mate and self.mate[i] > i:
                i = self.mate[i]
            elif self.is_op(i, mark):
                out.append((first, i))
                first = i + 1
            i += 1
        if first < b:
            out.append((first, b))
        return [p for p in out if p[0] < p[1]]

    def peel(self, a: int, b: int) -> tuple[int, int]:
        """A stretch without parentheses, ``await``, ``as`` and ``satisfies`` around it."""
        while True:
            if a < b and self.is_op(a, "(") and self.mate.get(a) == b - 1:
                a, b = a + 1, b - 1
                continue
            if self.is_id(a, "await"):
                a += 1
                continue
            if b - a > 1 and self.is_op(b - 1, "!"):
                b -= 1
                continue
            cut = next((i for i in range(b - 1, a, -1) if self.kind[i] == "id" and self.value[i] in ("as", "satisfies") and self.around[i] == self.around[a] and not self.is_op(i - 1, ".")), None)
            if cut is None:
                return a, b
            b = cut

    def args(self, opening: int) -> list[tuple[int, int]]:
        return [self.peel(*p) for p in self.parts(opening + 1, self.mate.get(opening, opening + 1))]

    def end_of_expression(self, a: int) -> int:
        """End of the expression that starts at a: a comma or semicolon, a closing bracket, or a new statement's line."""
        i = a
        while i < len(self):
            if self.kind[i] == "op" and (self.value[i] in ",;" or (self.value[i] in ")]}" and self.mate.get(i, -1) < a)):
                return i
            if i > a and self.line(i) > self.line(i - 1) and self.kind[i] == "id" and not (self.kind[i - 1] == "op" and self.value[i - 1] not in ")]}") and self.value[i] not in ("as", "satisfies"):
                return i
            i = self.mate[i] + 1 if i in self.mate and self.mate[i] > i else i + 1
        return i

    # ---- modules

    @cached_property
    def imports(self) -> list[str]:
        out = []
        for i in range(len(self) - 1):
            if self.kind[i] == "id" and self.value[i] in ("from", "import") and self.kind[i + 1] == "str":
                out.append(self.value[i + 1][1:-1])
            elif self.kind[i] == "id" and self.value[i] in ("require", "import") and self.is_op(i + 1, "(") and i + 2 < len(self) and self.kind[i + 2] == "str":
                out.append(self.value[i + 2][1:-1])
        return list(dict.fromkeys(out))

    @cached_property
    def bindings(self) -> dict[str, tuple[str, str, bool]]:
        """local name -> (module, imported name, type only)."""
        out: dict[str, tuple[str, str, bool]] = {}
        for i in range(len(self)):
            if self.is_id(i, "import") and not self.is_op(i + 1, "("):
                end = next((k for k in range(i + 1, min(i + 400, len(self))) if self.is_id(k, "from") or self.kind[k] == "str" or self.is_op(k, ";")), None)
                if end is None or not self.is_id(end, "from") or end + 1 >= len(self) or self.kind[end + 1] != "str":
                    continue
                module, k = self.value[end + 1][1:-1], i + 1
                only = self.is_id(k, "type") and not self.is_id(k + 1, "from") and not self.is_op(k + 1, ",")
                k += only
                while k < end:
                    if self.is_op(k, "{"):
                        for a, b in self.parts(k + 1, self.mate.get(k, k + 1)):
                            names = [self.value[x] for x in range(a, b) if self.kind[x] == "id"]
                            typed = len(names) > 1 and names[0] == "type" and names[1] != "as"
                            names = names[1:] if typed else names
                            if names:
                                out[names[-1]] = (module, names[0], only or typed)
                        k = self.mate.get(k, end)
                    elif self.is_op(k, "*") and self.is_id(k + 1, "as"):
                        out[self.value[k + 2]] = (module, "*", only)
                        k += 2
                    elif self.kind[k] == "id":
                        out[self.value[k]] = (module, "default", only)
                    k += 1
            elif self.is_id(i, "require") and self.is_op(i + 1, "(") and i + 2 < len(self) and self.kind[i + 2] == "str" and self.is_op(i - 1, "="):
                module = self.value[i + 2][1:-1]
                if self.is_id(i - 2):
                    out[self.value[i - 2]] = (module, "default", False)
                elif self.is_op(i - 2, "}"):
                    for a, b in self.parts(self.mate.get(i - 2, i - 2) + 1, i - 2):
                        if self.is_id(a):
                            out[self.value[b - 1]] = (module, self.value[a], False)
        return out

    def loads(self, libraries: tuple[str, ...]) -> bool:
        return any(R.below(m, libraries) for m in self.imports)

    # ---- names

    @cached_property
    def declarations(self) -> list[tuple[str, int, int, int, bool]]:
        """(name, token, start, end, constant) of variables, class fields and ``this.x =`` with a value."""
        out = []
        for i in range(len(self) - 2):
            if self.kind[i] != "id":
                continue
            if self.value[i] in ("const", "let", "var") and self.is_id(i + 1):
                at = i + 1
                while self.is_id(at):  # one declarator after another
                    k = at + 1
                    if self.is_op(k, ":"):
                        k = next((x for x in range(k, min(k + 60, len(self))) if self.is_op(x, "=") or self.is_op(x, ";")), k)
                    end = k
                    if self.is_op(k, "="):
                        end = self.end_of_expression(k + 1)
                        out.append((self.value[at], at, k + 1, end, self.value[i] == "const"))
                    at = end + 1 if self.is_op(end, ",") and self.is_id(end + 1) and (self.is_op(end + 2, "=") or self.is_op(end + 2, ":") or self.is_op(end + 2, ",")) else len(self)
            elif self.is_op(i + 1, "=") and not self.is_op(i + 2, "=") and not self.is_op(i + 2, ">"):
                field = self.is_op(i - 1, ".") and self.is_id(i - 2, "this")
                member = self.around[i] in self.class_bodies and not self.is_op(i - 1, ".")
                if field or member:
                    fixed = member and any(self.is_id(x, "readonly") for x in (i - 1, i - 2, i - 3))
                    out.append((self.value[i], i, i + 2, self.end_of_expression(i + 2), fixed))
        return out

    @cached_property
    def class_bodies(self) -> dict[int, str]:
        """Opening brace of each class body -> the class's name."""
        out = {}
        for i in range(len(self) - 1):
            if self.is_id(i, "class") and not self.is_op(i - 1, "."):
                k = next((x for x in range(i + 1, min(i + 80, len(self))) if self.is_op(x, "{")), None)
                if k is not None:
                    out[k] = self.value[i + 1] if self.is_id(i + 1) else ""
        return out

    @cached_property
    def parameters(self) -> set[str]:
        """Names of function parameters and loop variables: they hide constants."""
        out = set()
        for i in range(len(self) - 1):
            if not self.is_op(i, "("):
                continue
            end = self.mate.get(i)
            if end is None:
                continue
            loop = self.is_id(i - 1, "for")
            after = self.is_op(end + 1, "=>") or self.is_op(end + 1, "{") or (self.is_op(end + 1, ":") and not loop)
            called = self.is_id(i - 1) and self.value[i - 1] in ("if", "while", "switch", "catch", "with")
            if loop:
                out |= {self.value[x + 1] for x in range(i + 1, end) if self.kind[x] == "id" and self.value[x] in ("const", "let", "var") and self.is_id(x + 1)}
            elif after and not called:
                for a, b in self.parts(i + 1, end):
                    out |= {self.value[x] for x in range(a, b) if self.kind[x] == "id" and (x == a or self.value[x - 1] in "{,:" or x + 1 == b or self.value[x + 1] in (":", "=", "?")) and self.value[x] not in ("public", "private", "protected", "readonly")}
        return out

    @cached_property
    def constants(self) -> dict[str, str]:
        """Dotted name -> text of constants, constant objects, enums and static fields."""
        out: dict[str, str] = {}
        seen: dict[str, int] = {}
        for name, *_ in self.declarations:
            seen[name] = seen.get(name, 0) + 1
        pending = []
        for name, i, a, b, fixed in self.declarations:
            body = self.around[i]
            if body in self.class_bodies:
                if fixed:
                    pending.append((f"{self.class_bodies[body]}.{name}", a, b))
                if fixed or seen[name] == 1:
                    pending.append((f"this.{name}", a, b))
            elif fixed and seen[name] == 1:
                pending.append((name, a, b))
            elif self.is_op(i - 1, ".") and seen[name] == 1:
                pending.append((f"this.{name}", a, b))
        for i in range(len(self) - 2):
            if self.is_id(i, "enum") and self.is_id(i + 1) and self.is_op(i + 2, "{"):
                for a, b in self.parts(i + 3, self.mate.get(i + 2, i + 3)):
                    if self.is_op(a + 1, "="):
                        pending.append((f"{self.value[i + 1]}.{self._key(a)}", a + 2, b))
        self._known = out
        for _ in range(3):  # a constant may be folded from a later one
            for name, a, b in pending:
                self._fold(name, *self.peel(a, b), out, 0)
        return out

    def _fold(self, name: str, a: int, b: int, out: dict[str, str], depth: int) -> None:
        if depth > DEPTH or a >= b or name in out:
            return
        if self.is_id(a, "Object") and self.is_id(a + 2, "freeze") and self.is_op(a + 3, "("):
            inner = self.args(a + 3)
            if inner:
                self._fold(name, *inner[0], out, depth + 1)
        elif self.is_op(a, "{") and self.mate.get(a) == b - 1:
            for x, y in self.parts(a + 1, b - 1):
                if self.is_op(x + 1, ":"):
                    self._fold(f"{name}.{self._key(x)}", *self.peel(x + 2, y), out, depth + 1)
        elif (text := self._text(a, b, out, depth)) is not None:
            out[name] = text

    def _key(self, i: int) -> str:
        return self.value[i][1:-1] if self.kind[i] in ("str", "tpl") else self.value[i]

    def _path(self, a: int, b: int) -> str | None:
        """Dotted spelling of a member expression."""
        out, i = "", a
        while i < b:
            if self.kind[i] == "id":
                out += self.value[i]
            elif self.kind[i] == "op" and self.value[i] in (".", "?."):
                out += "."
            elif self.is_op(i, "[") and self.mate.get(i) == i + 2 and self.kind[i + 1] == "str":
                out, i = out + "." + self.value[i + 1][1:-1], i + 2
            else:
                return None
            i += 1
        return out if re.fullmatch(r"[A-Za-z_$#][\w$]*(?:\.[\w$#]+)*", out) else None

    def _text(self, a: int, b: int, known: dict[str, str], depth: int = 0) -> str | None:
        a, b = self.peel(a, b)
        if a >= b or depth > DEPTH:
            return None
        plus = self.parts(a, b, "+")
        if len(plus) > 1:
            texts = [self._text(x, y, known, depth + 1) for x, y in plus]
            return None if None in texts else "".join(texts)
        if b - a == 1 and self.kind[a] == "str":
            return re.sub(r"\\(.)", r"\1", self.value[a][1:-1])
        if b - a == 1 and self.kind[a] == "tpl":
            holes = re.split(r"\$\{\s*([^{}]*?)\s*\}", self.value[a][1:-1])
            texts = [h if k % 2 == 0 else known.get(h) for k, h in enumerate(holes)]
            return None if None in texts else "".join(texts)
        path = self._path(a, b)
        if path is None or path.split(".")[0] in self.parameters:
            return None
        return known.get(path)

    def resolve(self, a: int, b: int) -> tuple[str, bool] | None:
        """(name, exact) of an expression; an imported constant keeps its spelling, as no exact name."""
        text = self._text(a, b, self.constants)
        if text is not None:
            return text, True
        a, b = self.peel(a, b)
        path = self._path(a, b)
        if path is None or path.split(".")[0] in self.parameters or path.split(".")[0] not in self.bindings or self.bindings[path.split(".")[0]][2]:
            return None
        head, _, last = path.rpartition(".")
        if _CONST.fullmatch(last) and re.search("[A-Z]", last) and (not head or head[0].isupper()):
            return path, False
        return None

    def resolve_all(self, a: int, b: int) -> list[tuple[str, bool]]:
        a, b = self.peel(a, b)
        if a < b and self.is_op(a, "[") and self.mate.get(a) == b - 1:
            return [n for p in self.parts(a + 1, b - 1) if (n := self.resolve(*p))]
        one = self.resolve(a, b)
        return [one] if one else []

    def object_value(self, a: int, b: int, key: str) -> tuple[int, int] | None:
        a, b = self.peel(a, b)
        if a >= b or not self.is_op(a, "{") or self.mate.get(a) != b - 1:
            return None
        for x, y in self.parts(a + 1, b - 1):
            if self.kind[x] in ("id", "str") and self._key(x) == key:
                if self.is_op(x + 1, ":"):
                    return x + 2, y
                if y == x + 1 and self.kind[x] == "id":
                    return x, y
        return None

    def elements(self, a: int, b: int) -> list[tuple[int, int]]:
        a, b = self.peel(a, b)
        return self.parts(a + 1, b - 1) if a < b and self.is_op(a, "[") and self.mate.get(a) == b - 1 else []

    # ---- receivers

    def root(self, a: int, b: int) -> str | None:
        """The name that an expression starts from: ``x`` of ``x.y().z``, of ``new x(...)``, of ``this.x.y``."""
        a, b = self.peel(a, b)
        if self.is_id(a, "new"):
            a += 1
        if self.is_id(a, "this") and self.is_op(a + 1, "."):
            a += 2
        return self.value[a] if a < b and self.kind[a] == "id" else None

    @cached_property
    def typed(self) -> dict[str, str]:
        """Names with a type annotation: parameters, properties, variables -> the type's first name."""
        out = {}
        for i in range(1, len(self) - 2):
            if self.is_op(i, ":") and self.is_id(i - 1) and self.is_id(i + 1) and (self.value[i + 2] in ",);={<[.|" or self.kind[i + 2] == "id"):
                out.setdefault(self.value[i - 1], self.value[i + 1])
        return out

    @cached_property
    def clients(self) -> dict[str, set[str]]:
        """Library group -> names built from it, directly or through other clients."""
        groups = {g: R.LIBRARIES[g] for g in R.TRACKED} | R.FRAMEWORKS
        out: dict[str, set[str]] = {g: set() for g in groups}
        by_local = {n: {g for g, libs in groups.items() if R.below(m, libs)} for n, (m, _, only) in self.bindings.items()}
        for _ in range(3):
            for name, _, a, b, _ in self.declarations:
                root = self.root(a, b)
                direct = by_local.get(root, set())
                if root == "require" and self.is_op(a + 1, "(") and self.kind[a + 2] == "str":
                    direct = {g for g, libs in groups.items() if R.below(self.value[a + 2][1:-1], libs)}
                called = any(self.is_op(x, "(") for x in range(a, b))
                for g in groups:
                    if (g in direct and called) or root in out[g]:
                        out[g].add(name)
        for name, kind in self.typed.items():
            for g in by_local.get(kind, ()):
                out[g].add(name)
        for i in range(len(self) - 3):  # @Inject(...) private readonly client: X
            if self.is_op(i, "@") and self.is_id(i + 1) and self.value[i + 1].startswith("Inject") and self.loads(R.LIBRARIES["nest"]):
                end = self.mate.get(i + 2, i + 1) if self.is_op(i + 2, "(") else i + 1
                name = next((x for x in range(end + 1, min(end + 6, len(self))) if self.is_id(x) and self.value[x] not in ("private", "public", "protected", "readonly")), None)
                if name is not None and self.typed.get(self.value[name], "").startswith("Client"):
                    out["nest"].add(self.value[name])
        return out

    def is_client(self, group: str, key: str | None) -> bool | None:
        """Whether a name is a client of a group; None where the file builds none."""
        own = self.clients.get(group, set())
        return True if key in own else False if own else None

    @cached_property
    def calls(self) -> list[tuple[str, int, int, str | None, tuple[int, int]]]:
        """(method, its token, opening bracket, receiver's last name or None for a call, receiver's stretch)."""
        out = []
        for i in range(1, len(self) - 1):
            if self.kind[i] != "id" or not (self.is_op(i - 1, ".") or self.is_op(i - 1, "?.")):
                continue
            opening = i + 1
            if self.is_op(opening, "<"):  # type arguments
                opening = next((x for x in range(opening, min(opening + 30, len(self))) if self.is_op(x, "(")), opening)
            if not self.is_op(opening, "(") or opening not in self.mate:
                continue
            first = i - 2
            while first >= 0:
                if self.kind[first] == "op" and self.value[first] in ")]" and first in self.mate:
                    first = self.mate[first] - 1
                    if first >= 0 and self.kind[first] == "id" and self.is_op(first + 1, "("):
                        pass
                    else:
                        first += 1
                        break
                if self.kind[first] == "id" and (self.is_op(first - 1, ".") or self.is_op(first - 1, "?.")):
                    first -= 2
                    continue
                break
            first = max(first, 0)
            key = self.value[i - 2] if self.kind[i - 2] == "id" else None
            out.append((self.value[i], i, opening, key, (first, i - 1)))
        return out


class _Site:
    """A call, constructor or decorator with its arguments, as the extract functions of the rules see it."""

    def __init__(self, s: Script, args: list[tuple[int, int]], key: str | None = None, receiver: tuple[int, int] = (0, 0)):
        self.s, self.args, self.key, self.receiver = s, args, key, receiver

    def arg(self, i: int) -> list[tuple[str, bool]]:
        return self.s.resolve_all(*self.args[i]) if i < len(self.args) else []

    def keys(self, i: int, *keys: str) -> list[tuple[str, bool]]:
        values = [self.s.object_value(*self.args[i], k) for k in keys] if i < len(self.args) else []
        return [n for v in values if v for n in self.s.resolve_all(*v)]

    def topics(self, array: tuple[int, int] | None) -> list[tuple[str, bool]]:
        out = []
        for e in self.s.elements(*array) if array else []:
            if v := self.s.object_value(*e, "topic"):
                out += self.s.resolve_all(*v)
        return out

    def inner(self, key: str) -> tuple[int, int] | None:
        return self.s.object_value(*self.args[0], key) if self.args else None

    # names of the rules' table

    def first_arg(self):
        return self.arg(0)

    def second_arg(self):
        return self.arg(1)

    def all_string_args(self):
        return [n for k in range(len(self.args)) for n in self.arg(k)]

    def key_args(self):
        return [n for n in self.all_string_args() if not re.fullmatch(r"[\d.]+", n[0])]

    def queue_name_arg(self):
        return [n for n in self.arg(0) if "/" not in n[0] and not n[0].endswith((".js", ".ts"))]

    def kafka_send_topic(self):
        return self.keys(0, "topic")

    def kafka_subscribe_topics(self):
        return self.keys(0, "topic", "topics")

    def kafka_send_batch(self):
        return self.topics(self.inner("topicMessages"))

    def kafka_node_send(self):
        return self.topics(self.args[0]) if self.args else []

    def kafka_node_consumer(self):
        return self.topics(self.args[1]) if len(self.args) > 1 else []

    def platformatic_send(self):
        return self.topics(self.inner("messages"))

    def redis_stream_read(self):
        texts = [self.s.resolve(*a) for a in self.args]
        for k, t in enumerate(texts):
            if t and t[0].upper() == "STREAMS":
                rest = texts[k + 1 :]
                return [n for n in rest[: len(rest) // 2] if n]
        out = []
        for a in self.args:
            for e in self.s.elements(*a) or [a]:
                if self.s.object_value(*e, "id") and (v := self.s.object_value(*e, "key")):
                    out += self.s.resolve_all(*v)
        return out

    def mqtt_subscribe(self):
        out = self.arg(0)
        if self.args:
            a, b = self.args[0]
            if self.s.is_op(a, "{") and self.s.mate.get(a) == b - 1:
                for x, y in self.s.parts(a + 1, b - 1):
                    if self.s.kind[x] == "str":
                        out.append((self.s._key(x), True))
                    elif self.s.is_op(x, "[") and (n := self.s.resolve(x + 1, self.s.mate.get(x, x + 1))):
                        out.append(n)
        return out

    def amqp_exchange(self):
        return [n for n in self.arg(0) if n[0]]

    def sqs_queue(self):
        return [(n.rsplit("/", 1)[-1], e) for n, e in self.keys(0, "QueueUrl") if n.rsplit("/", 1)[-1]]

    def sns_topic(self):
        return [(n.rsplit(":", 1)[-1], e) for n, e in self.keys(0, "TopicArn") if n.startswith("arn:") and n.rsplit(":", 1)[-1]]

    def pubsub_topic_chain(self):
        s, (a, b) = self.s, self.receiver
        opening = s.mate.get(b - 1, -1) if b - 1 > a and s.is_op(b - 1, ")") else -1
        if opening > 0 and s.is_id(opening - 1, "topic") and s.is_op(opening - 2, "."):
            inner = s.args(opening)
            return s.resolve_all(*inner[0]) if inner else []
        return []

    def event_hub_name(self):
        texts = [n for a in reversed(self.args) if (n := self.s.resolve(*a)) and "=" not in n[0] and ";" not in n[0]]
        return texts[:1]

    def queue_of_receiver(self):
        for name, _, a, b, _ in self.s.declarations:
            if name == self.key and self.s.is_id(a, "new"):
                opening = next((x for x in range(a, b) if self.s.is_op(x, "(")), None)
                inner = self.s.args(opening) if opening else []
                return self.s.resolve_all(*inner[0]) if inner else []
        return []

    def processor_queue(self):
        return self.arg(0) + self.keys(0, "name")

    def rabbit_queue(self):
        return self.keys(0, "queue") or self.keys(0, "routingKey")

    def kinesis_stream(self):
        return self.keys(0, "StreamName")

    def eventbridge_events(self):
        out = []
        for e in self.s.elements(*entries) if (entries := self.inner("Entries")) else []:
            v = self.s.object_value(*e, "DetailType")
            names = self.s.resolve_all(*v) if v else []
            if not names and (v := self.s.object_value(*e, "EventBusName")):
                names = self.s.resolve_all(*v)
            out += names
        return out

    def stomp_destination(self):
        return self.keys(0, "destination")

    def pulsar_topic(self):
        return self.keys(0, "topic", "topics")

    # gates

    def kafka_receiver(self) -> bool:
        if self.s.loads(R.LIBRARIES["kafka_any"]):
            return self.s.is_client("kafkajs", self.key) is not False
        chained = any(self.s.is_op(x, "(") for x in range(*self.receiver))
        return not chained and any(n in (self.key or "").lower() for n in ("producer", "consumer", "kafka", "redpanda"))

    def nest_client(self) -> bool:
        if not self.key:
            return False
        if self.s.is_client("nest", self.key):
            return True
        return self.s.loads(R.LIBRARIES["nest"]) and any(n in self.key.lower() for n in ("client", "proxy"))


def events(s: Script) -> list[dict]:
    """Broker interactions: role, kind, name, line, heuristic; each (name, kind, role) once."""
    out: dict[tuple, dict] = {}

    def add(rule: R.Rule, site: _Site, i: int) -> None:
        for name, exact in getattr(site, rule.extract)():
            if name.strip():
                out.setdefault((name, rule.kind, rule.role), {"role": rule.role, "kind": rule.kind, "name": name, "line": s.line(i), "heuristic": not exact})

    for method, i, opening, key, receiver in s.calls:
        for rule in R.CALLS:
            if method not in rule.names or (rule.group and not s.loads(R.LIBRARIES[rule.group])):
                continue
            site = _Site(s, s.args(opening), key, receiver)
            if rule.group in R.TRACKED and rule.extract != "pubsub_topic_chain" and s.is_client(rule.group, key) is False:
                continue
            if rule.when is None or getattr(site, rule.when)():
                add(rule, site, i)
    for i in range(len(s) - 2):
        if s.is_id(i, "new") and s.is_id(i + 1):
            opening = next((x for x in range(i + 2, min(i + 40, len(s))) if s.is_op(x, "(")), None)
            if opening is None or not (opening == i + 2 or s.is_op(i + 2, "<") or s.is_op(i + 2, ".")):
                continue
            name = s.value[opening - 1] if s.is_op(i + 2, ".") else s.value[i + 1]
            module, imported, _ = s.bindings.get(s.value[i + 1], (None, None, None))
            if s.is_op(i + 2, ".") and module:
                imported = name
            for rule in R.CONSTRUCTORS:
                bound = module is not None and R.below(module, R.LIBRARIES[rule.group]) and imported in rule.names
                loose = rule.when == "unbound" and module is None and name in rule.names and name not in s.class_bodies.values() and name not in s.parameters
                if bound or loose:
                    add(rule, _Site(s, s.args(opening)), i)
        elif s.is_op(i, "@") and s.is_id(i + 1) and s.is_op(i + 2, "("):
            module = s.bindings.get(s.value[i + 1], (None,))[0]
            for rule in R.DECORATORS:
                if s.value[i + 1] in rule.names and module is not None and R.below(module, R.LIBRARIES[rule.group]):
                    add(rule, _Site(s, s.args(i + 2)), i)
            if s.value[i + 1] in R.PATTERNS and module is not None and R.below(module, R.LIBRARIES["nest"]):
                add(R.Rule("nest", R.PATTERNS, "consume", "kafka_topic", "first_arg"), _Site(s, s.args(i + 2)), i)
    return list(out.values())


def join(prefix: str, path: str) -> str:
    """A prefix and a path with single slashes between them and none at the end."""
    a, b = prefix.rstrip("/"), path.lstrip("/")
    out = f"{a}/{b}" if a and b else a or (b if b.startswith("*") else f"/{b}" if b else "")
    out = out if out[:1] in ("/", "*") else "/" + out
    return out.rstrip("/") if len(out) > 1 else out


def _mounts(s: Script) -> dict[str, list[tuple[str, str | None]]]:
    """Router -> (prefix, parent) of its mounts."""
    out: dict[str, list] = {}

    def add(router: str, prefix: str, parent: str | None) -> None:
        own = out.setdefault(router, [])
        if len(own) < MOST_MOUNTS and (prefix, parent) not in own:
            own.append((prefix, parent))

    for name, _, a, b, _ in s.declarations:
        a, b = s.peel(a, b)
        opening = next((x for x in range(a, b) if s.is_op(x, "(")), None)
        if opening is None:
            continue
        args = s.args(opening)
        if s.is_id(a, "new") and args and (v := s.object_value(*args[0], "prefix")) and (p := s.resolve(*v)):
            add(name, p[0], None)
        base = next((x for x in range(a, b - 1) if s.is_id(x, "basePath") and s.is_op(x + 1, "(")), None)
        if base is not None and (inner := s.args(base + 1)) and (p := s.resolve(*inner[0])):
            add(name, p[0], s.value[base - 2] if s.is_id(base - 2) else None)
    for method, _, opening, key, _ in s.calls:
        args = s.args(opening)
        if method in ("use", "route") and len(args) >= 2 and (p := s.resolve(*args[0])):
            path = s._path(*args[-1])
            if path:
                add(path.rsplit(".", 1)[-1], p[0], key)
    return out


def prefixes(mounts: dict[str, list[tuple[str, str | None]]], router: str, path: tuple[str, ...] = ()) -> list[str]:
    """Every prefix that a router is mounted under, through its parents; four at most, a cycle ends."""
    if router not in mounts or router in path or len(path) >= 64:
        return [""]
    out: list[str] = []
    for prefix, parent in mounts[router]:
        for above in prefixes(mounts, parent, (*path, router)) if parent else [""]:
            full = join(above, prefix)
            if full not in out:
                out.append(full)
            if len(out) >= MOST_PREFIXES:
                return out
    return out


def looks_like_router(name: str) -> bool:
    words = [w for w in re.split(r"[_\-$]+", re.sub(r"(?<=[^A-Z_$-])(?=[A-Z])", "_", name).lower()) if w]
    return bool(words) and words[-1] in ("app", "router", "routers", "route", "routes", "server", "fastify", "hono", "elysia", "koa")


def _methods(s: Script, names: list[tuple[str, bool]]) -> list[str]:
    known = [v.upper() for v in R.ROUTE_VERBS]
    return list(dict.fromkeys("ALL" if n == "*" else n.upper() for n, _ in names if n == "*" or n.upper() in known))


def _handler(s: Script, a: int, b: int) -> bool:
    """Whether an argument can answer a request: a function, a name, a call, a list of these."""
    if a >= b or s.kind[a] in ("str", "tpl", "num") or s.is_op(a, "{"):
        return False
    return True


def _paths(s: Script, a: int, b: int) -> list[str]:
    return [n for n, _ in s.resolve_all(a, b) if n[:1] in ("/", "*")]


def routes(s: Script) -> list[dict]:
    """Routes registered on apps and routers, and those of decorated controllers: method, path, line."""
    out: dict[tuple[str, str], dict] = {}

    def add(method: str, path: str, i: int) -> None:
        if len(out) < MOST_ROUTES:
            out.setdefault((method, path), {"method": method, "path": path, "line": s.line(i)})

    loaded = [g for g, libs in R.FRAMEWORKS.items() if s.loads(libs)]
    mounts = _mounts(s) if loaded else {}
    for method, i, opening, key, receiver in s.calls if loaded else []:
        if method not in R.ROUTE_VERBS and method not in ("route", "on"):
            continue
        args = s.args(opening)
        base, router = None, key
        if key is None:  # route('/p').get(h).post(h), or a chain from a constructor
            first = s.root(*receiver)
            opens = [x for x in range(*receiver) if s.is_op(x, "(") and s.around[x] == s.around[receiver[0]]]
            head = opens[0] if opens else None
            if head is not None and s.is_id(head - 1, "route") and (inner := s.args(head)):
                base = next(iter(_paths(s, *inner[0])), None)
                router = s.value[head - 3] if s.is_id(head - 3) else None
            elif first in s.bindings and any(R.below(s.bindings[first][0], R.FRAMEWORKS[g]) for g in loaded):
                router = first
            elif first and any(s.is_client(g, first) for g in loaded):
                router = first
        if router and router in s.bindings and R.below(s.bindings[router][0], R.HTTP_CLIENTS):
            continue
        built = router in s.bindings and any(R.below(s.bindings[router][0], R.FRAMEWORKS[g]) for g in loaded) and key is None
        verdicts = [s.is_client(g, router) for g in loaded]
        if not (built or True in verdicts or (all(v is None for v in verdicts) and looks_like_router(router or ""))):
            continue
        above = prefixes(mounts, router) if router else [""]
        if built and s.is_id(receiver[0], "new"):
            opening0 = next((x for x in range(*receiver) if s.is_op(x, "(")), None)
            inner = s.args(opening0) if opening0 is not None else []
            if inner and (v := s.object_value(*inner[0], "prefix")) and (p := s.resolve(*v)):
                above = [join(x, p[0]) for x in above]
        found: list[tuple[str, str]] = []
        if method in R.ROUTE_VERBS:
            verb = {"del": "DELETE", "any": "ALL"}.get(method, method.upper())
            if base is not None:
                found = [(verb, base)] if args and _handler(s, *args[-1]) else []
            elif len(args) >= 2 and _handler(s, *args[-1]):
                own = _paths(s, *args[0])
                if not own and len(args) >= 3 and s.resolve(*args[0]):
                    own = _paths(s, *args[1])
                found = [(verb, p) for p in own]
        elif method == "route" and args:
            for o in s.elements(*args[0]) or [args[0]]:
                v = s.object_value(*o, "url") or s.object_value(*o, "path")
                m = s.object_value(*o, "method")
                verbs = _methods(s, s.resolve_all(*m)) if m else ["ALL"]
                found += [(x, p) for p in (_paths(s, *v) if v else []) for x in verbs]
        elif method == "on" and len(args) >= 3 and _handler(s, *args[-1]):
            found = list(product(_methods(s, s.resolve_all(*args[0])), _paths(s, *args[1])))
        for (verb, path), prefix in product(found, above):
            add(verb, join(prefix, path), i)
    for body, _ in s.class_bodies.items():
        prefix = ""
        for name, i, args in _decorators_before(s, body):
            if name in R.CONTROLLER_DECORATORS:
                prefix = _decorator_path(s, args) or ""
        end = s.mate.get(body, len(s))
        for i in range(body + 1, end):
            if s.is_op(i, "@") and s.is_id(i + 1) and s.around[i] == body and s.value[i + 1] in R.VERB_DECORATORS:
                local = s.bindings.get(s.value[i + 1])
                if local and not local[2] and not R.below(local[0], R.DECORATOR_LIBRARIES):
                    continue
                path = _decorator_path(s, s.args(i + 2) if s.is_op(i + 2, "(") else [])
                if path is not None:
                    add(R.VERB_DECORATORS[s.value[i + 1]], join(prefix, path), i)
    return list(out.values())


def _decorators_before(s: Script, body: int) -> list[tuple[str, int, list]]:
    """Decorators of the class whose body opens at a token."""
    i = body
    while i > 0 and not s.is_id(i, "class"):
        i -= 1
    out = []
    k = i - 1
    while k > 0:
        if s.kind[k] == "id" and s.value[k] in ("export", "default", "abstract"):
            k -= 1
        elif s.is_op(k, ")") and s.is_op(s.mate.get(k, 0) - 2, "@"):
            out.append((s.value[s.mate[k] - 1], k, s.args(s.mate[k])))
            k = s.mate[k] - 3
        elif s.is_id(k) and s.is_op(k - 1, "@"):
            out.append((s.value[k], k, []))
            k -= 2
        else:
            break
    return out


def _decorator_path(s: Script, args: list[tuple[int, int]]) -> str | None:
    if not args:
        return ""
    if s.is_op(args[0][0], "{"):
        v = s.object_value(*args[0], "path")
        p = s.resolve(*v) if v else None
        return p[0] if p else ""
    names = s.resolve_all(*args[0])
    return names[0][0] if names else None


def procedures(s: Script) -> list[dict]:
    """tRPC procedures and GraphQL operations: name (``TRPC query user.get``, ``GRAPHQL Query users``) and line."""
    out: dict[str, int] = {}
    if "trpc" in s.text or "TRPC" in s.text:
        routers: dict[int, str] = {}
        outer: dict[str, tuple[str, str | None]] = {}
        for name, _, a, b, _ in s.declarations:
            opening = next((x for x in range(a, b) if s.is_op(x, "(")), None)
            if opening is not None and s.is_op(opening + 1, "{"):
                routers[opening + 1] = name
        for i in range(len(s) - 3):
            if s.kind[i] in ("id", "str") and s.is_op(i + 1, ":") and s.is_id(i + 2) and s.is_op(s.around[i], "{") and s.value[i + 3] in (",", "}"):
                outer.setdefault(s.value[i + 2], (s._key(i), routers.get(s.around[i])))
        for method, i, _, _, receiver in s.calls:
            if method not in ("query", "mutation", "subscription") or "procedure" not in "".join(s.value[x].lower() for x in range(*receiver) if s.around[x] == s.around[receiver[0]] and s.kind[x] == "id"):
                continue
            if not (s.is_op(receiver[0] - 1, ":") and s.kind[receiver[0] - 2] in ("id", "str")):
                continue
            path, body = [s._key(receiver[0] - 2)], s.around[receiver[0]]
            while body >= 0 and body not in routers:
                call = s.around[body]  # the bracket of router(
                k = call - 1
                while k > 0 and not s.is_op(k, ":") and s.around[k] == s.around[call]:
                    k -= 1
                if call < 0 or not s.is_op(k, ":") or s.around[k] != s.around[call]:
                    break
                path.append(s._key(k - 1))
                body = s.around[k]
            path.reverse()
            name, seen = routers.get(body), set()
            while name in outer and name not in seen and len(seen) < 8:
                seen.add(name)
                key, name = outer[name]
                path.insert(0, key)
            out.setdefault(f"TRPC {method} {'.'.join(path)}", s.line(i))
    if s.loads(R.GRAPHQL_LIBRARIES):
        for i in range(len(s) - 2):
            if s.is_id(i) and s.value[i] in R.OPERATIONS and s.is_op(i + 1, ":") and s.is_op(i + 2, "{"):
                body = s.around[i]
                k = body - 1
                if s.is_op(k, "=") or s.is_op(k, ":"):
                    owner = s.value[k - 1]
                    if s.is_op(k, "=") and s.is_op(k - 2, ":"):  # const resolvers: Resolvers =
                        owner = s.value[k - 3]
                    if ("resolver" in owner.lower()) if s.is_op(k, "=") else owner == "resolvers":
                        for a, _ in s.parts(i + 3, s.mate.get(i + 2, i + 3)):
                            a += s.is_id(a, "async") and s.is_id(a + 1)
                            if s.kind[a] in ("id", "str"):
                                out.setdefault(f"GRAPHQL {s.value[i]} {s._key(a)}", s.line(a))
            elif s.is_op(i, "@") and s.is_id(i + 1) and s.value[i + 1] in s.bindings:
                module, imported, only = s.bindings[s.value[i + 1]]
                if only or imported not in R.OPERATIONS or not R.below(module, R.GRAPHQL_DECORATOR_LIBRARIES):
                    continue
                args = s.args(i + 2) if s.is_op(i + 2, "(") else []
                name = next((n[0] for a in args if (v := s.object_value(*a, "name")) and (n := s.resolve(*v))), None)
                if name is None and args and s.kind[args[0][0]] == "str" and args[0][1] - args[0][0] == 1:
                    name = s._key(args[0][0])
                if name is None:
                    k = s.mate.get(i + 2, i + 1) + 1 if s.is_op(i + 2, "(") else i + 2
                    while k < len(s) and not (s.is_id(k) and s.is_op(k + 1, "(")):
                        k = s.mate[k + 2] + 1 if s.is_op(k, "@") and s.is_op(k + 2, "(") and k + 2 in s.mate else k + 1
                    name = s.value[k] if k < len(s) else None
                if name:
                    out.setdefault(f"GRAPHQL {imported} {name}", s.line(i))
    return [{"name": n, "line": line} for n, line in out.items()]


def exports(s: Script) -> list[str]:
    """Names that a module exports; ``default@callee`` where the default export is a call."""
    out: list[str] = []
    for i in range(len(s) - 1):
        if s.is_id(i, "export"):
            k = i + 1
            if s.is_id(k, "default"):
                out.append("default")
                path, x = "", k + 1
                while x < len(s) and (s.kind[x] == "id" or s.is_op(x, ".")):
                    path, x = path + s.value[x], x + 1
                if s.is_op(x, "(") and path not in ("function", "async", "class"):
                    out.append(f"default@{path}")
            elif s.is_op(k, "{"):
                out += [s.value[b - 1] for _, b in s.parts(k + 1, s.mate.get(k, k + 1)) if s.kind[b - 1] == "id"]
            else:
                while s.is_id(k) and s.value[k] in ("async", "declare", "abstract", "const", "let", "var", "function", "class", "interface", "type", "enum"):
                    k += 1
                k += s.is_op(k, "*")
                if s.is_id(k):
                    out.append(s.value[k])
        elif s.is_id(i, "module") and s.is_id(i + 2, "exports") and s.is_op(i + 3, "="):
            out.append("default")
    return list(dict.fromkeys(out))


def config_routes(s: Script) -> list[dict]:
    """Routes of a React Router configuration: index, route, layout and prefix calls, nested; the first of a path."""
    out: dict[str, int] = {}

    def walk(a: int, b: int, prefix: str) -> None:
        for x, y in s.elements(a, b):
            if s.is_op(x, "..."):
                x += 1
            if not (s.is_id(x) and s.is_op(x + 1, "(")):
                continue
            args, name = s.args(x + 1), s.value[x]
            text = s.resolve(*args[0]) if args else None
            nested = next((p for p in reversed(args) if s.is_op(p[0], "[")), None)
            if name == "index" and args:
                out.setdefault(join(prefix, ""), s.line(x))
            elif name in ("route", "prefix") and text:
                here = join(prefix, text[0])
                if name == "route":
                    out.setdefault(here, s.line(x))
                if nested:
                    walk(*nested, here)
            elif name == "layout" and nested:
                walk(*nested, prefix)

    for i in range(len(s) - 2):
        if s.is_id(i, "export") and s.is_id(i + 1, "default") and s.is_op(i + 2, "["):
            walk(i + 2, s.mate.get(i + 2, i + 2) + 1, "")
    return [{"method": "PAGE", "path": p, "line": n} for p, n in out.items()]


_SCRIPT = re.compile(r"(<script\b[^>]*>)(.*?)(</script\s*>)", re.S | re.I)


def script_view(path: str, text: str) -> str:
    """The script parts of a component file at their own lines, everything else blank."""
    blank = lambda t: re.sub(r"[^\n]", " ", t)
    keep: list[tuple[int, int]] = [m.span(2) for m in _SCRIPT.finditer(text) if not re.search(r"type\s*=\s*['\"](?!module|text/(?:java|type)script|ts)[^'\"]*['\"]", m[1])]
    if path.endswith(".astro") and (m := re.match(r"﻿?\s*---\r?\n(.*?)\r?\n---", text, re.S)):
        keep.append(m.span(1))
    out, at = "", 0
    for a, b in sorted(keep):
        out, at = out + blank(text[at:a]) + text[a:b], b
    return out + blank(text[at:])
