"""Text of PDF files (S1) without an outside library: objects, object streams, Flate and hexadecimal filters, text operators
and ToUnicode maps. Other filters, encryption with a password and fonts without a map beyond Windows-1252 give no text for their parts."""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)(?:endobj|(?=\d+\s+\d+\s+obj\b)|\Z)", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = rb"(\d+)\s+\d+\s+R"
#: A string, a hexadecimal string, a name, a number, an array's bounds, or an operator.
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|\[|\]|<<|>>|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
GAP = -200  # thousandths of a unit between shown strings that count as a blank


class Pdf:
    def __init__(self, blob: bytes) -> None:
        self.encrypted = b"/Encrypt" in blob
        self.objects: dict[int, bytes] = {int(n): body for n, _, body in OBJECT.findall(blob)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body and (found := self.stream(body)) is not None:
                self._unpack(body, found)

    def stream(self, body: bytes) -> bytes | None:
        m = STREAM.search(body)
        if not m:
            return None
        data, head = m[1], body[: m.start()]
        try:
            for name in re.findall(rb"/(FlateDecode|ASCIIHexDecode|DCTDecode|LZWDecode|ASCII85Decode|JPXDecode|CCITTFaxDecode)", head):
                if name == b"FlateDecode":
                    data = zlib.decompressobj().decompress(data)
                elif name == b"ASCIIHexDecode":
                    data = bytes.fromhex(data.split(b">")[0].decode("ascii"))
                else:
                    return None
        except (zlib.error, ValueError):
            return None
        return data

    def _unpack(self, body: bytes, found: bytes) -> None:
        first = re.search(rb"/First\s+(\d+)", body)
        if first:
            numbers = list(map(int, found[: int(first[1])].split()))
            places = list(zip(numbers[::2], numbers[1::2], strict=False))
            for k, (number, at) in enumerate(places):
                end = places[k + 1][1] if k + 1 < len(places) else len(found)
                self.objects.setdefault(number, found[int(first[1]) + at : int(first[1]) + end])

    def resolve(self, body: bytes, key: bytes) -> bytes:
        """What a dictionary has under ``key``: the object that it refers to, or the rest of the dictionary from there."""
        m = re.search(rb"/" + key + rb"\s*(?:" + REFERENCE + rb"|(?=[\[<(/\d]))", body)
        if not m:
            return b""
        return self.objects.get(int(m[1]), b"") if m[1] else body[m.end() :]

    def pages(self) -> list[bytes]:
        """Pages in the order of the tree, or of the file without one."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[bytes] = []
        seen: set[int] = set()

        def walk(body: bytes, inherited: bytes) -> None:
            own = self.resolve(body, b"Resources") or inherited
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                for n in map(int, re.findall(REFERENCE, kids[1])):
                    if n not in seen:
                        seen.add(n)
                        walk(self.objects.get(n, b""), own)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body + b"\n/Inherited " + own)

        walk(self.resolve(root, b"Pages"), b"")
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]

    def text(self, page: bytes) -> str:
        whole = re.search(rb"/Contents\s*(?:\[(.*?)\]|" + REFERENCE + rb")", page, re.S)
        numbers = [int(n) for n in re.findall(REFERENCE, whole[1])] if whole and whole[1] else [int(whole[2])] if whole else []
        if len(numbers) == 1 and (listed := re.fullmatch(rb"\s*\[(.*)\]\s*", self.objects.get(numbers[0], b""), re.S)):
            numbers = [int(n) for n in re.findall(REFERENCE, listed[1])]
        content = b"\n".join(s for n in numbers if (s := self.stream(self.objects.get(n, b""))) is not None)
        fonts = {}
        for where in (self.resolve(page, b"Font"), self.resolve(self.resolve(page, b"Resources") or page, b"Font")):
            for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+" + REFERENCE, where.split(b">>")[0]):
                fonts.setdefault(name, self.unicode_map(self.objects.get(int(n), b"")))
        return shown(content, fonts)

    def unicode_map(self, font: bytes) -> dict[int, str]:
        """Codes to text, and at -1 the bytes of a code."""
        cmap = self.stream(self.resolve(font, b"ToUnicode")) or b""
        out: dict[int, str] = {}
        plain = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                out[int(code, 16)], out[-1] = plain(to), str(len(code) // 2)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                start = plain(to)
                for k in range(min(int(high, 16) - int(low, 16) + 1, 0x10000)):
                    out[int(low, 16) + k] = start[:-1] + chr(ord(start[-1]) + k) if start else ""
                out[-1] = str(len(low) // 2)
        return out


def literal(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def escape(m: re.Match) -> bytes:
        e = m[1]
        return bytes([int(e, 8) & 255]) if e[:1].isdigit() else ESCAPES.get(e, b"" if e in (b"\n", b"\r", b"\r\n") else e)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escape, token[1:-1], flags=re.S)


def shown(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """The strings that a page's content shows; moves to another line break lines."""
    out: list[str] = []
    operands: list[bytes] = []
    font: dict[int, str] = {}

    def put(raw: bytes) -> None:
        if font:
            width = int(font[-1])
            out.append("".join(font.get(int.from_bytes(raw[k : k + width]), "") for k in range(0, len(raw), width)))
        else:
            out.append(raw.decode("cp1252", "ignore"))

    for token in TOKEN.findall(content):
        if token[:1] in b"(<[/]>+-.0123456789":
            operands.append(token)
            continue
        strings = [t for t in operands if t[:1] == b"(" or t[:1] == b"<" and t != b"<<"]
        if token == b"Tf" and len(operands) > 1:
            font = fonts.get(operands[-2][1:], {})
        elif token == b"TJ":
            for t in operands:
                if t in strings:
                    put(literal(t))
                elif t[:1] in b"-+.0123456789" and float(t) < GAP:
                    out.append(" ")
        elif token in (b"Tj", b"'", b'"') and strings:
            out.append("\n" * (token != b"Tj"))
            put(literal(strings[-1]))
        elif token in (b"T*", b"ET") or token in (b"Td", b"TD") and len(operands) > 1 and float(operands[-1]) != 0:
            out.append("\n")
        elif token == b"Tm":
            out.append("\n")
        operands = []
    return re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()


def page_texts(blob: bytes) -> list[str]:
    """The text of each page; none of an encrypted file."""
    pdf = Pdf(blob)
    return [] if pdf.encrypted else [pdf.text(p) for p in pdf.pages()]
