"""URLs: parsing, query codec, rebuilding, prefix and ending predicates.

The query codec follows form encoding with nested names (``a[b]=1``, ``a[]=2``); the last of equal names wins.
"""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = re.compile(
    r"(?s)(?:(?P<scheme>[A-Za-z][A-Za-z0-9+.\-]*):)?(?://(?:(?P<user>[^/?#@]*)@)?(?P<host>\[[^\]]*\]|[^/?#:]*)(?::(?P<port>\d*))?(?=[/?#]|\Z))?"
    r"(?P<path>[^?#]*)(?:\?(?P<query>[^#]*))?(?:#(?P<fragment>.*))?\Z"
)
_SAFE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.")


def parse(url: str) -> dict[str, str] | None:
    """Parts that are there; None if the url can't be parsed."""
    m = _URL.match(url)
    if not m:
        return None
    parts = {k: v for k, v in m.groupdict().items() if v is not None and k != "user"}
    if m["host"] is not None and m["host"] == "" or (parts.get("port") and int(parts["port"]) > 65535):
        return None
    if parts.get("port") == "":
        del parts["port"]
    return parts


def _decode(s: str) -> str:
    return unquote_to_bytes(s.replace("+", " ")).decode("utf-8", "surrogateescape")


def _encode(s: str) -> str:
    return "".join(chr(b) if b in _SAFE else "+" if b == 32 else f"%{b:02X}" for b in s.encode("utf-8", "surrogateescape"))


def parse_query(query: str) -> dict:
    """Nested map of a query. Dots and spaces in names become "_"; a name without value has ''."""
    out: dict = {}
    for piece in query.split("&"):
        if piece == "":
            continue
        name, _, value = piece.partition("=")
        name, value = _decode(name).lstrip(" "), _decode(value)
        if name == "" or name[0] == "\0":
            continue
        open_at = name.find("[")
        if open_at < 1 or "]" not in name[open_at:]:
            out[re.sub(r"[ .\[]", "_", name)] = value
            continue
        keys: list[str] = [re.sub(r"[ .]", "_", name[:open_at])]
        rest = name[open_at:]
        while rest.startswith("[") and (end := rest.find("]")) > 0:
            keys.append(rest[1:end])
            rest = rest[end + 1 :]
        node = out
        for i, key in enumerate(keys):
            if key == "" and i:
                ints = [int(k) for k in node if isinstance(k, str) and re.fullmatch(r"0|[1-9]\d*", k)]
                key = str(max(ints) + 1 if ints else 0)
            if i == len(keys) - 1:
                node[key] = value
            else:
                if not isinstance(node.get(key), dict):
                    node[key] = {}
                node = node[key]
    return out


def build_query(parameters: dict) -> str:
    """Form-encoded query of a nested map."""
    out: list[str] = []

    def walk(node: dict, prefix: str) -> None:
        for k, v in node.items():
            name = f"{prefix}[{k}]" if prefix else k
            if isinstance(v, dict):
                walk(v, name)
            else:
                out.append(f"{_encode(name)}={_encode(v)}")

    walk(parameters, "")
    return "&".join(out)


def build(parts: dict[str, str], parameters: dict) -> str:
    """Scheme, host, port, path, query, fragment; user names, empty queries and empty fragments are left out."""
    url = f"{parts.get('scheme', '')}://{parts.get('host', '')}"
    if parts.get("port"):
        url += f":{parts['port']}"
    url += parts.get("path", "")
    query = build_query(parameters)
    return url + (f"?{query}" if query else "") + (f"#{parts['fragment']}" if parts.get("fragment") else "")


def sanitise(url: str) -> str:
    """Parsed and rebuilt; unchanged without a scheme or host."""
    parts = parse(url)
    if parts is None or not parts.get("scheme") or not parts.get("host"):
        return url
    return build(parts, parse_query(parts.get("query", "")))


def strip_parameters(url: str, names: tuple[str, ...]) -> str:
    """Without the top-level parameters of these names. Only a failed parse leaves the url as it is."""
    parts = parse(url)
    if parts is None:
        return url
    return build(parts, {k: v for k, v in parse_query(parts.get("query", "")).items() if k not in names})


def resolve(base: str, href: str) -> str | None:
    """``href`` against ``base``; None where it can't be resolved."""
    try:
        href = href.strip()
        if href == "":
            return base
        return urljoin(base, href)
    except ValueError:
        return None


#: Urls whose query survives decoding and encoding as it is, so that native expressions are exact.
FLAT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#:@\[\]]+(:[0-9]{1,4})?(/[^?#]*)?(\?([A-Za-z0-9_\-]+=[A-Za-z0-9_.\-]*(&[A-Za-z0-9_\-]+=[A-Za-z0-9_.\-]*)*)?)?(#.*)?$"


def is_flat(url: Column) -> Column:
    """Can ``rewrite_flat`` do this url exactly? Equal names in a query and path-less queries are for the codec."""
    names = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda kv: F.substring_index(kv, "=", 1))
    return url.rlike(FLAT) & (F.size(names) == F.size(F.array_distinct(names)))


def rewrite_flat(url: Column, names: tuple[str, ...] = ()) -> Column:
    """Native sanitation and stripping of parameters for flat urls."""
    head = F.regexp_extract(url, r"^([^?#]*)", 1)
    query, fragment = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"#(.+)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda kv: kv != "")
    if names:
        pairs = F.filter(pairs, lambda kv: ~F.substring_index(kv, "=", 1).isin(list(names)))
    kept = F.array_join(pairs, "&")
    return F.concat(head, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def rewrite_any(url: Column, names: tuple[str, ...] | None = None) -> Column:
    """Sanitation, then stripping if ``names`` is given, by the full codec."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(u):
            if not isinstance(u, str):
                return None
            u = sanitise(u)
            return u if names is None else strip_parameters(u, names)

        return values.map(one)

    return run.asNondeterministic()(url)  # else filters on the result would run it twice


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(c, F.lit(p))
    return out


def path_ends_with_any(url: Column, endings: tuple[str, ...]) -> Column:
    """Does the path, in lower ASCII case and without query and fragment, end with one of them? False without a path."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    lower = F.translate(path, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.lit(False)
    for e in endings:
        out = out | F.endswith(lower, F.lit("".join(c.lower() if c.isascii() else c for c in e)))
    return F.coalesce(out & (path != ""), F.lit(False))
