"""URLs by the URL standard's states: scheme, authority, host, port, path, query, fragment; absolute or against a base.

One parse gives all parts, so every rule sees the same host. Not covered: drive letters of file URLs.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address
from urllib.parse import unquote_to_bytes

#: Fixed values of the standard: schemes with an authority and their ports, and the characters that each part escapes.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
FRAGMENT_SET = ' "<>`'
QUERY_SET, SPECIAL_QUERY_SET = ' "#<>', " \"#<>'"
PATH_SET = FRAGMENT_SET + "#?{}"
USER_SET = PATH_SET + "/:;=@[\\]^|"
FORBIDDEN_HOST = "\0\t\n\r #/:<>?@[\\]^|"
FORBIDDEN_DOMAIN = FORBIDDEN_HOST + "%\x7f" + "".join(map(chr, range(0x20)))
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_DOT, _DOTS = re.compile(r"\.|%2e", re.I), re.compile(r"(?:\.|%2e){2}", re.I)
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]*|[0-9]+")


@dataclass(frozen=True)
class Url:
    """The parts of a parsed URL. path is opaque, and host is None, where the scheme has no authority and no slash follows."""

    scheme: str
    user: str
    host: str | None
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    def bare(self) -> str:
        """The URL without query and fragment."""
        at = f"{self.user}@" if self.user else ""
        port = "" if self.port is None else f":{self.port}"
        authority = "" if self.host is None else f"//{at}{self.host}{port}"
        return f"{self.scheme}:{authority or ('/.' if self.path.startswith('//') else '')}{self.path}"

    def effective_port(self) -> int | None:
        return DEFAULT_PORTS.get(self.scheme) if self.port is None else self.port

    def opaque(self) -> bool:
        return self.host is None and not self.path.startswith("/")


def _escaped(text: str, chars: str) -> str:
    return "".join(c if " " <= c <= "~" and c not in chars else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _ascii_domain(name: str) -> str | None:
    """The labels of a domain as ASCII: compatibility forms and case folded, others than ASCII in Punycode."""
    labels = []
    for label in re.split("[.\u3002\uff0e\uff61]", unicodedata.normalize("NFKC", name.replace("\xad", "")).lower()):
        if not label.isascii():
            try:
                label = "xn--" + label.encode("punycode").decode("ascii")
            except UnicodeError:
                return None
        labels.append(label)
    return ".".join(labels)


def _number(part: str) -> int | None:
    """A part of an IPv4 address: hexadecimal after 0x, octal after 0, else decimal."""
    if not _NUMBER.fullmatch(part):
        return None
    if part[:2].lower() == "0x":
        return int(part[2:] or "0", 16)
    if len(part) > 1 and part[0] == "0":
        return int(part, 8) if not set(part) & set("89") else None
    return int(part)


def _ipv4(parts: list[str]) -> str | None:
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str) -> str | None:
    """An address in brackets, its longest run of zeros (two at least) left out."""
    try:
        packed = IPv6Address(text).packed
    except (AddressValueError, ValueError):
        return None
    if "%" in text:
        return None
    fields = [f"{int.from_bytes(packed[i : i + 2]):x}" for i in range(0, 16, 2)]
    runs = sorted(((m.end() - m.start(), -m.start()) for m in re.finditer("0+", "".join("0" if f == "0" else "x" for f in fields))), reverse=True)
    if runs and runs[0][0] > 1:
        size, at = runs[0][0], -runs[0][1]
        return f"[{':'.join(fields[:at])}::{':'.join(fields[at + size :])}]"
    return f"[{':'.join(fields)}]"


def _host(text: str, special: bool) -> str | None:
    """A host, or None where it is none."""
    if text.startswith("["):
        return _ipv6(text[1:-1]) if text.endswith("]") else None
    if not special:
        return None if set(text) & set(FORBIDDEN_HOST) else _escaped(text, "")
    name = _ascii_domain(unquote_to_bytes(text.encode("utf-8", "replace")).decode("utf-8", "replace"))
    if not name or set(name) & set(FORBIDDEN_DOMAIN):
        return None
    parts = name.removesuffix(".").split(".")
    if parts[-1].isdigit() or (parts[-1][:2] == "0x" and _number(parts[-1]) is not None):
        return _ipv4(parts)
    return name


def _authority(text: str, scheme: str) -> tuple[str, str, int | None] | None:
    """User part, host and port. The user part ends with the last @, so what is before it never is a host."""
    user, at, place = text.rpartition("@")
    name, _, secret = user.partition(":")
    login = _escaped(name, USER_SET) + (f":{_escaped(secret, USER_SET)}" if secret else "")
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", place, re.S)
    if not found:
        return None
    host, port = _host(found[1], scheme in DEFAULT_PORTS), found[2] or ""
    if host is None or (at and not found[1]) or (port and not (port.isascii() and port.isdigit() and int(port) < 65536)):
        return None
    number = int(port) if port else None
    return login, host, None if number == DEFAULT_PORTS.get(scheme) else number


def _path(text: str, special: bool, onto: list[str]) -> str:
    """A path from text after the segments of onto, its dot segments resolved."""
    segments, parts = list(onto), re.split(r"[/\\]" if special else "/", text)
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if _DOTS.fullmatch(part):
            segments = segments[:-1]
            segments += [""] if last else []
        elif _DOT.fullmatch(part):
            segments += [""] if last else []
        else:
            segments.append(_escaped(part, PATH_SET))
    return "/" + "/".join(segments)


def _split(text: str) -> tuple[str, str | None, str | None]:
    text, hash_, fragment = text.partition("#")
    text, mark, query = text.partition("?")
    return text, query if mark else None, fragment if hash_ else None


@lru_cache(maxsize=8192)
def parse(text: str, base: Url | None = None) -> Url | None:
    """The URL that text stands for, against a base where it names no scheme; None where it is no URL."""
    text = re.sub("[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    found = _SCHEME.match(text)
    scheme = found[1].lower() if found else None
    rest = text[found.end() :] if found else text
    if scheme is not None and base is not None and scheme == base.scheme and scheme in DEFAULT_PORTS and not re.match(r"[/\\]", rest) and scheme != "file":
        scheme = None  # as in http:path, which is relative
    if scheme is None and base is None:
        return None
    kind = scheme or base.scheme
    special = kind in DEFAULT_PORTS
    rest, query, fragment = _split(rest)
    query = None if query is None else _escaped(query, SPECIAL_QUERY_SET if special else QUERY_SET)
    fragment = None if fragment is None else _escaped(fragment, FRAGMENT_SET)
    slashes = re.match(r"[/\\]*" if special else "/*", rest)[0]

    def placed(after: str) -> Url | None:
        """With an authority; the path begins at its end."""
        end = re.search(r"[/\\]" if special else "/", after)
        where, path = (after[: end.start()], after[end.start() + 1 :]) if end else (after, None)
        if kind == "file" and where.lower() in ("", "localhost"):
            return Url(kind, "", "", None, _path(path or "", special, []), query, fragment)
        if not where and not special:
            return Url(kind, "", "", None, "" if path is None else _path(path, special, []), query, fragment)
        authority = _authority(where, kind)
        if authority is None or (kind == "file" and (authority[0] or authority[2] is not None)):
            return None
        return Url(kind, *authority, _path(path or "", special, []) if special or path is not None else "", query, fragment)

    if scheme is not None and special and kind != "file":
        return placed(rest[len(slashes) :])
    if len(slashes) >= 2:
        return placed(rest[len(slashes) if special and kind != "file" else 2 :])
    if scheme is not None:
        if kind == "file":
            return Url(kind, "", "", None, _path(rest[len(slashes) :], True, []), query, fragment)
        return Url(kind, "", None, None, _path(rest[1:], False, []) if slashes else _escaped(rest, ""), query, fragment)
    if base.opaque():
        return None if rest or query is not None or fragment is None else Url(kind, "", None, None, base.path, base.query, fragment)
    if slashes:
        return Url(kind, base.user, base.host, base.port, _path(rest[1:], special, []), query, fragment)
    if not rest:
        return Url(kind, base.user, base.host, base.port, base.path, base.query if query is None else query, fragment)
    return Url(kind, base.user, base.host, base.port, _path(rest, special, base.path.split("/")[1:-1]), query, fragment)


def absolute(target: str, base: str | None) -> str | None:
    """A target as an absolute URL without query and fragment; None where it is no URL."""
    found = parse(target, parse(base) if base else None)
    return None if found is None else found.bare()
