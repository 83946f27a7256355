"""Text of PDF pages: plain and Flate streams, object streams, simple fonts and ToUnicode maps.  No encryption, no scans."""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?[\d.]+|[A-Za-z'\"*]+", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
#: What stands for a character after a backslash.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class NotPdf(ValueError):
    pass


class File:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise NotPdf("the file is no PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise NotPdf("the file is encrypted")
        self.objects = {int(n): body for n, _, body in OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self.unpack(body)
        self.maps: dict[bytes, dict[bytes, str]] = {}

    def unpack(self, body: bytes) -> None:
        n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
        inside = self.stream(body)
        numbers = list(map(int, inside[:first].split()))[: 2 * n]
        places = [*numbers[1::2], len(inside) - first]
        for i, number in enumerate(numbers[::2]):
            self.objects.setdefault(number, inside[first + places[i] : first + places[i + 1]])

    def stream(self, body: bytes) -> bytes:
        found = STREAM.search(body)
        if not found:
            return b""
        head = body[: found.start()]
        if b"/FlateDecode" in head:
            return zlib.decompressobj().decompress(found[1])
        return b"" if b"/Filter" in head else found[1]

    def value(self, body: bytes, key: bytes) -> bytes:
        """What stands behind a key: the rest of the dictionary, or the object it refers to."""
        found = re.search(rb"/%s(?![A-Za-z0-9])\s*" % key, body)
        if not found:
            return b""
        rest = body[found.end() :]
        to = REFERENCE.match(rest)
        return self.objects.get(int(to[1]), b"") if to else rest

    def references(self, body: bytes, key: bytes) -> list[int]:
        found = re.search(rb"/%s(?![A-Za-z0-9])\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, body)
        if not found:
            return []
        to = [int(n) for n in REFERENCE.findall(found[1])]
        if not found[1].startswith(b"[") and (target := self.objects.get(to[0], b"").strip()).startswith(b"["):
            return [int(n) for n in REFERENCE.findall(target)]
        return to

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, resources) in the order of the page tree; resources come from the page or the nearest node over it."""
        kids = {k for body in self.objects.values() if re.search(rb"/Type\s*/Pages\b", body) for k in self.references(body, b"Kids")}
        roots = [n for n, body in self.objects.items() if re.search(rb"/Type\s*/Pages\b", body) and n not in kids]
        out, seen = [], set()
        stack = [(n, b"") for n in reversed(roots)]
        while stack:
            n, over = stack.pop()
            body = self.objects.get(n, b"")
            if n in seen:
                continue
            seen.add(n)
            own = self.value(body, b"Resources") or over
            if re.search(rb"/Type\s*/Page\b(?!s)", body):
                out.append((body, own))
            stack += [(k, own) for k in reversed(self.references(body, b"Kids"))]
        return out

    def font(self, resources: bytes, name: bytes) -> dict[bytes, str]:
        """Code -> text of a font with a ToUnicode map; empty for others."""
        body = self.value(self.value(resources, b"Font"), name)
        if body not in self.maps:
            self.maps[body] = unicode_map(self.stream(self.value(body, b"ToUnicode")))
        return self.maps[body]


def unicode_map(data: bytes) -> dict[bytes, str]:
    def text(code: str) -> str:
        return bytes.fromhex(code).decode("utf-16-be", "replace")

    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block.decode("latin-1")):
            out[bytes.fromhex(a)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, z, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", block.decode("latin-1")):
            codes = re.findall(r"<([0-9A-Fa-f]+)>", b)
            for i in range(min(int(z, 16) - int(a, 16) + 1, 1 << 16)):
                code = (int(a, 16) + i).to_bytes(len(a) // 2, "big")
                if b.startswith("["):
                    if i < len(codes):
                        out[code] = text(codes[i])
                else:
                    out[code] = text(codes[0])[:-1] + chr(ord(text(codes[0])[-1]) + i)
    return out


def string(token: bytes, codes: dict[bytes, str]) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], b"" if m[1].endswith(b"\n") else m[1]), token[1:-1])
    if not codes:
        return raw.decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")
    width = len(next(iter(codes)))
    return "".join(codes.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def page_text(file: File, page: bytes, resources: bytes) -> str:
    """Shown strings in their order; moves to another line break it, and wide gaps within a line are spaces."""
    content = b"\n".join(file.stream(file.objects.get(n, b"")) for n in file.references(page, b"Contents"))
    out, held, codes = [], [], {}
    in_list, gap = False, 0.0
    for token in TOKEN.findall(content):
        first = token[:1]
        if first in b"(<":
            if in_list and gap < -200 and out and not out[-1].endswith((" ", "\n")):
                out.append(" ")
            gap = 0.0
            held.append(string(token, codes))
            if in_list:
                out.append(held.pop())
        elif first == b"[":
            in_list, gap = True, 0.0
        elif first == b"]":
            in_list = False
        elif first == b"/" or first.isdigit() or first in b"+-.":
            if in_list:
                gap = float(token)
            held.append(token)
        else:
            if token == b"Tf" and len(held) >= 2:
                codes = file.font(resources, held[-2][1:])
            elif token == b"Tj" and held:
                out.append(held[-1])
            elif token in (b"'", b'"') and held:
                out += ["\n", held[-1]]
            elif token in (b"T*", b"ET") or token in (b"Td", b"TD") and len(held) >= 2 and float(held[-1]) != 0 or token == b"Tm":
                out.append("\n")
            elif token in (b"Td", b"TD"):
                out.append(" ")
            held = []
    return re.sub(r"\n{2,}", "\n", "".join(x for x in out if isinstance(x, str))).strip()


def pages(data: bytes) -> list[str]:
    """The text of each page; a page that can't be read is empty."""
    file = File(data)
    out = []
    for page, resources in file.pages():
        try:
            out.append(page_text(file, page, resources))
        except (ValueError, zlib.error, IndexError, TypeError):
            out.append("")
    return out
