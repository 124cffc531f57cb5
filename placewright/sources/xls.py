"""Cells of workbooks of the binary kind: a compound file, and in it records of the eighth version (BIFF8)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Fixed: numbers of the format.
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
BOF, EOF, BOUNDSHEET, SST, CONTINUE, LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR, FILEPASS = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205, 0x2F
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class Damaged(ValueError):
    """What isn't such a workbook, or can't be read."""


def stream(data: bytes, *names: str) -> bytes:
    """The first of the named streams that a compound file holds."""
    if data[:8] != SIGNATURE or len(data) < 512:
        raise Damaged("not a compound file")
    shift, small_shift = struct.unpack_from("<2H", data, 30)
    size, small_size = 1 << shift, 1 << small_shift
    first, _, cutoff, small_first, _, chain, n_chain = struct.unpack_from("<7I", data, 48)

    def sector(n: int) -> bytes:
        return data[512 + n * size if size == 512 else (n + 1) * size :][:size]

    table = list(struct.unpack_from("<109I", data, 76))
    for _ in range(n_chain):
        if chain >= END - 3:
            break
        more = struct.unpack(f"<{size // 4}I", sector(chain))
        table, chain = table + list(more[:-1]), more[-1]
    follow: list[int] = []
    for n in table:
        if n < END - 3:
            raw = sector(n)
            follow += struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def chained(n: int, links: list[int], piece) -> bytes:
        out, seen = [], set()
        while n < len(links) and n not in seen:
            seen.add(n)
            out.append(piece(n))
            n = links[n]
        return b"".join(out)

    folder = chained(first, follow, sector)
    entries = {}
    for at in range(0, len(folder) - 127, 128):
        length, kind = struct.unpack_from("<HB", folder, at + 64)
        start, amount = struct.unpack_from("<2I", folder, at + 116)
        entries[folder[at : at + max(0, length - 2)].decode("utf-16-le", "replace") if kind != 5 else "\0root"] = (start, amount)
    small_links = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])) if (raw := chained(small_first, follow, sector)) else []
    small = chained(entries["\0root"][0], follow, sector) if "\0root" in entries else b""
    for name in names:
        if name in entries:
            start, amount = entries[name]
            if amount < cutoff:
                return chained(start, small_links, lambda n: small[n * small_size : (n + 1) * small_size])[:amount]
            return chained(start, follow, sector)[:amount]
    raise Damaged("no workbook in the file")


def records(book: bytes, at: int = 0) -> Iterator[tuple[int, bytes, list[int]]]:
    """(kind, bytes, where continued parts begin) of each record; parts are put together."""
    while at + 4 <= len(book):
        kind, length = struct.unpack_from("<2H", book, at)
        body, at, joints = book[at + 4 : at + 4 + length], at + 4 + length, []
        while kind != CONTINUE and at + 4 <= len(book) and struct.unpack_from("<H", book, at)[0] == CONTINUE:
            (length,) = struct.unpack_from("<H", book, at + 2)
            joints.append(len(body))
            body, at = body + book[at + 4 : at + 4 + length], at + 4 + length
        yield kind, body, joints


def _text(body: bytes, at: int, joints: list[int], wide_length: bool = True) -> tuple[str, int]:
    """A string at a place, and where it ends. Where a part begins within its letters, a byte says anew how wide they are."""
    n = struct.unpack_from("<H" if wide_length else "<B", body, at)[0]
    at += 2 if wide_length else 1
    flags = body[at]
    at += 1
    runs = phonetic = 0
    if flags & 8:
        (runs,), at = struct.unpack_from("<H", body, at), at + 2
    if flags & 4:
        (phonetic,), at = struct.unpack_from("<I", body, at), at + 4
    wide, out = flags & 1, []
    while n:
        end = next((j for j in joints if j > at or (j == at and out)), len(body))
        if at in joints and out:
            wide, at = body[at] & 1, at + 1
            end = next((j for j in joints if j > at), len(body))
        take = min(n, (end - at) // (2 if wide else 1))
        if take <= 0:
            if end >= len(body):
                raise Damaged("a string ends early")
            wide, at = body[end] & 1, end + 1
            continue
        raw = body[at : at + take * (2 if wide else 1)]
        out.append(raw.decode("utf-16-le" if wide else "latin-1", "replace"))
        at, n = at + len(raw), n - take
    return "".join(out), at + 4 * runs + phonetic


def number(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _rk(raw: int) -> float:
    value = float(raw >> 2 if raw < 1 << 31 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def cells(data: bytes) -> list[list[str]]:
    """Rows of the first sheet, as text. Raises Damaged."""
    try:
        return _cells(stream(data, "Workbook", "Book"))
    except (struct.error, IndexError, KeyError) as e:
        raise Damaged(f"damaged: {e}") from None


def _cells(book: bytes) -> list[list[str]]:
    shared: list[str] = []
    start = None
    for kind, body, joints in records(book):
        if kind == FILEPASS:
            raise Damaged("encrypted")
        if kind == BOUNDSHEET and start is None and body[5] == 0:
            (start,) = struct.unpack_from("<I", body, 0)
        elif kind == SST:
            at = 8
            for _ in range(struct.unpack_from("<I", body, 4)[0]):
                value, at = _text(body, at, joints)
                shared.append(value)
        elif kind == EOF:
            break
    if start is None:
        raise Damaged("no sheet")
    found: dict[int, dict[int, str]] = {}
    waiting = None
    for kind, body, joints in records(book, start):
        put = lambda row, column, value: found.setdefault(row, {}).__setitem__(column, value)
        row, column = struct.unpack_from("<2H", body, 0) if len(body) >= 4 else (0, 0)
        if kind == EOF:
            break
        if kind == LABELSST:
            put(row, column, shared[struct.unpack_from("<I", body, 6)[0]])
        elif kind == LABEL:
            put(row, column, _text(body, 6, joints)[0])
        elif kind == NUMBER:
            put(row, column, number(struct.unpack_from("<d", body, 6)[0]))
        elif kind == RK:
            put(row, column, number(_rk(struct.unpack_from("<I", body, 6)[0])))
        elif kind == MULRK:
            for i in range((len(body) - 6) // 6):
                put(row, column + i, number(_rk(struct.unpack_from("<I", body, 4 + 6 * i + 2)[0])))
        elif kind == BOOLERR:
            put(row, column, ERRORS.get(body[6], "#N/A") if body[7] else str(body[6]))
        elif kind == FORMULA:
            if body[12:14] == b"\xff\xff":
                waiting = (row, column) if body[6] == 0 else None
                if body[6] in (1, 2):
                    put(row, column, ERRORS.get(body[8], "#N/A") if body[6] == 2 else str(body[8]))
            else:
                put(row, column, number(struct.unpack_from("<d", body, 6)[0]))
        elif kind == STRING and waiting is not None:
            put(*waiting, _text(body, 0, joints)[0])
            waiting = None
    if not found:
        return []
    return [[found[r].get(c, "") for c in range(max(found[r]) + 1)] if r in found else [] for r in range(max(found) + 1)]
