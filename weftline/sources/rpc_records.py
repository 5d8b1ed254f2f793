"""Records of typed RPC clients and handlers in TypeScript files (their forms are told in ``operators.calls``)."""

from __future__ import annotations

import re

from weftline.sources.javascript import Script

#: Constants kept of a file, decorators of RPC handlers, clients that are no RPC stubs (fixed values).
MOST_CONSTANTS, HANDLERS = 4000, ("GrpcMethod", "GrpcStreamMethod")
NOT_STUBS = ("ClientProxy", "ClientGrpc", "ClientKafka", "HttpClient", "QueryClient")


def _service(type_name: str) -> str | None:
    """Service of a generated client's type: ``UserServiceClient`` -> ``UserService``."""
    m = re.fullmatch(r"(\w+?)(?:Grpc)?Client", type_name)
    return m[1] if m and type_name not in NOT_STUBS else None


def _class_of(s: Script, i: int) -> int | None:
    """Opening brace of the class body around a token."""
    while i >= 0:
        i = s.around[i]
        if i in s.class_bodies:
            return i
    return None


def base_of(s: Script, body: int) -> str | None:
    for k in range(body - 1, max(-1, body - 40), -1):
        if s.is_id(k, "extends") and s.is_id(k + 1):
            return s.value[k + 1]
        if s.is_id(k, "class"):
            return None
    return None


def fields(s: Script) -> tuple[dict[tuple[int, str], str], dict[tuple[int, str], str | None]]:
    """((class, field) -> service) of client fields, and ((class, field) -> type) of all declared ones.

    A field is a client by its type, by ``getService<...>('Name')``, or by ``new NameClient(...)``.
    """
    bound: dict[tuple[int, str], str] = {}
    declared: dict[tuple[int, str], str | None] = {}
    for i in range(1, len(s) - 1):
        body = _class_of(s, i)
        if body is None or not s.is_id(i):
            continue
        own = s.around[i] == body
        marked = s.is_id(i - 1) and s.value[i - 1] in ("private", "public", "protected", "readonly", "static")
        if (own or marked) and s.is_op(i + 1, ":") and s.is_id(i + 2):
            declared[body, s.value[i]] = s.value[i + 2]
            if service := _service(s.value[i + 2]):
                bound[body, s.value[i]] = service
        elif own and s.is_op(i + 1, "=") and not s.is_op(i + 2, ">"):
            declared.setdefault((body, s.value[i]), None)
    for name, i, a, b, _ in s.declarations:
        body = _class_of(s, i)
        if body is None:
            continue
        for k in range(a, b):
            if s.is_id(k, "getService") and (opening := next((x for x in range(k, b) if s.is_op(x, "(")), None)) and (args := s.args(opening)) and (n := s.resolve(*args[0])):
                bound[body, name] = n[0]
            elif s.is_id(k, "new") and s.is_id(k + 1) and (service := _service(s.value[k + 1])):
                bound[body, name] = service
    return bound, declared


def _part(s: Script, a: int, b: int) -> str:
    """An argument as written: literals keep their quotes; what else looks quoted gets a ``?`` in front."""
    a, b = s.peel(a, b)
    if b - a == 1 and s.kind[a] == "str":
        return "'" + s.value[a][1:-1].replace("|", "") + "'"
    text = "".join(s.value[a:b]).replace("|", "")
    return "?" + text if text[:1] in "'\"`" else text


def records(s: Script) -> list[tuple[int, str]]:
    """(line, record): constants, client fields, handler references and method calls."""
    out: list[tuple[int, str]] = []
    plain = {k: v for k, v in s.constants.items() if not k.startswith("this.")}
    at = {}
    for i in range(len(s) - 1):
        if s.kind[i] == "id" and s.value[i] in ("const", "let", "var", "enum", "class") and s.is_id(i + 1):
            at.setdefault(s.value[i + 1], s.line(i + 1))
    out += [(at.get(k.split(".")[0], 1), f"${k}={v}") for k, v in list(plain.items())[:MOST_CONSTANTS]]
    bound, declared = fields(s)
    out += [(s.line(body), f"#{field}={service}") for (body, field), service in sorted(bound.items())]
    for i in range(len(s) - 2):
        if s.is_op(i, "@") and s.is_id(i + 1) and s.value[i + 1] in HANDLERS:
            end = s.mate.get(i + 2, i + 1) if s.is_op(i + 2, "(") else i + 1
            args = s.args(i + 2) if s.is_op(i + 2, "(") else []
            k = end + 1
            while k < len(s) and not (s.is_id(k) and s.is_op(k + 1, "(") and not s.is_op(k - 1, "@")):
                k = s.mate[k] + 1 if k in s.mate and s.mate[k] > k else k + 1
            service = _part(s, *args[0]) if args else ""
            name = s.value[k] if k < len(s) else ""
            method = _part(s, *args[1]) if len(args) > 1 else f"'{name[:1].upper()}{name[1:]}'"
            out.append((s.line(i), f"@{service}|{method}" + ("" if len(args) > 1 else "|~")))
    for method, i, _, key, receiver in s.calls:
        a, b = receiver
        if not (b - a == 3 and s.is_id(a, "this") and s.is_op(a + 1, ".")):
            continue
        body = _class_of(s, i)
        if body is None or key is None:
            continue
        base = base_of(s, body) if (body, key) not in declared else None
        if (body, key) in bound:
            out.append((s.line(i), f"={bound[body, key]}.{method}"))
        elif base:
            out.append((s.line(i), f"^{base}#{key}.{method}"))
        else:
            kind = declared.get((body, key))
            if kind and not re.search(r"client|grpc|proxy", kind, re.I) and kind not in ("any", "unknown", "object"):
                continue
            if m := re.fullmatch(r"([a-z]\w*?)(?:Client|Service)", key):
                out.append((s.line(i), f"~{m[1][0].upper()}{m[1][1:]}Service.{method}"))
    return list(dict.fromkeys(out))
