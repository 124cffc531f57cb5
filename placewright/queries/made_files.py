"""Small PDF files and workbooks, made to be read back."""

from __future__ import annotations

import struct
import zlib


def pdf_bytes(lines: list[str], packed: bool = True) -> bytes:
    """A page with a line of text for each of lines; letters are numbered, and a ToUnicode map tells them."""
    letters = sorted({c for line in lines for c in line})
    code = {c: i + 1 for i, c in enumerate(letters)}
    hexed = lambda s: "".join(f"{code[c]:04X}" for c in s)
    body = "BT /F1 12 Tf 72 720 Td\n" + "\n".join(f"<{hexed(line)}> Tj 0 -14 Td" for line in lines) + "\nET"
    rows = "\n".join(f"<{i:04X}> <{c.encode('utf-16-be').hex()}>" for c, i in code.items())
    table = f"/CIDInit /ProcSet findresource begin begincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n{len(code)} beginbfchar\n{rows}\nendbfchar\nendcmap"

    def stream(text: str) -> bytes:
        raw = zlib.compress(text.encode("latin-1")) if packed else text.encode("latin-1")
        return f"<< /Length {len(raw)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + raw + b"\nendstream"

    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R >>",
        stream(body),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Made /Encoding /Identity-H /ToUnicode 6 0 R >>",
        stream(table),
    ]
    out, places = b"%PDF-1.5\n", []
    for i, o in enumerate(objects):
        places.append(len(out))
        out += f"{i + 1} 0 obj\n".encode() + o + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()


def xls_bytes(rows: list[list[str | float | int | bool | None]]) -> bytes:
    """A workbook of one sheet, in a compound file."""
    record = lambda kind, body: struct.pack("<2H", kind, len(body)) + body
    texts = sorted({c for row in rows for c in row if isinstance(c, str)})
    place = {t: i for i, t in enumerate(texts)}
    strings, part = [], struct.pack("<2I", sum(isinstance(c, str) for row in rows for c in row), len(texts))
    for t in texts:
        for at in range(0, max(1, len(t)), 1000):
            piece = t[at : at + 1000]
            wide = not piece.isascii()
            raw = piece.encode("utf-16-le" if wide else "latin-1")
            if len(part) + len(raw) + 3 > 8000 or at:
                strings.append(part)
                part = b""
            part += (struct.pack("<H", len(t)) if not at else b"") + bytes([wide]) + raw
    strings.append(part)
    shared = record(0xFC, strings[0]) + b"".join(record(0x3C, p) for p in strings[1:])
    sheet = record(0x809, struct.pack("<8H", 0x600, 0x10, 0, 0, 0, 0, 0, 0))
    for r, row in enumerate(rows):
        for c, value in enumerate(row):
            head = struct.pack("<3H", r, c, 0)
            if isinstance(value, str):
                sheet += record(0xFD, head + struct.pack("<I", place[value]))
            elif isinstance(value, bool):
                sheet += record(0x205, head + bytes([value, 0]))
            elif isinstance(value, int) and abs(value) < 1 << 29:
                sheet += record(0x27E, head + struct.pack("<I", (value << 2 | 2) & 0xFFFFFFFF))
            elif value is not None:
                sheet += record(0x203, head + struct.pack("<d", value))
    sheet += record(0x0A, b"")
    opening = record(0x809, struct.pack("<8H", 0x600, 0x05, 0, 0, 0, 0, 0, 0))
    name = b"Sheet1"
    bound = lambda at: record(0x85, struct.pack("<IH", at, 0) + bytes([len(name), 0]) + name)
    start = len(opening) + len(bound(0)) + len(shared) + 4
    book = opening + bound(start) + shared + record(0x0A, b"") + sheet
    book += b"\0" * (max(4096, -(-len(book) // 512) * 512) - len(book))
    sectors = len(book) // 512
    tables = -(-(sectors + 2) // 127)
    links = [0xFFFFFFFD] * tables + [0xFFFFFFFE] + [tables + 1 + i + 1 for i in range(sectors - 1)] + [0xFFFFFFFE]
    links += [0xFFFFFFFF] * (tables * 128 - len(links))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<9I", tables, tables, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0)
    head = head[:76] + struct.pack(f"<{tables}I", *range(tables)) + b"\xff" * (4 * (109 - tables))

    def entry(title: str, kind: int, first: int, size: int, child: int) -> bytes:
        raw = (title + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + b"\0" * 36 + struct.pack("<2I", first, size) + b"\0" * 4

    folder = entry("Root Entry", 5, 0xFFFFFFFE, 0, 1) + entry("Workbook", 2, tables + 1, len(book), 0xFFFFFFFF)
    return head + struct.pack(f"<{len(links)}I", *links) + folder.ljust(512, b"\0") + book
