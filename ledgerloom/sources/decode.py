"""Text from bytes of unknown encoding."""

from __future__ import annotations

# Shares of NUL bytes at even or odd places that tell UTF-16, and the least sizes for such evidence.
BOM_PARITY, NUL_PARITY, LEAST_PAIRS, LEAST_CHARS = 0.85, 0.4, 16, 16


def _nul_shares(data: bytes) -> tuple[float, float]:
    """Shares of NUL among the bytes at even and at odd places."""
    pairs = len(data) // 2
    return (data[0 : 2 * pairs : 2].count(0) / pairs, data[1 : 2 * pairs : 2].count(0) / pairs) if pairs else (0.0, 0.0)


def decode_text(data: bytes) -> tuple[str, str]:
    """(text, encoding).

    UTF-8 marks are stripped.  A UTF-16 mark decides, unless the NULs plainly say the other byte order; without a mark NULs
    on one side decide.  Then strict UTF-8, unless it gives control characters; else windows-1252, which never fails.
    """
    while data.startswith(b"\xef\xbb\xbf"):
        data = data[3:]
    even, odd = _nul_shares(data)
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        little = data[:2] == b"\xff\xfe"
        if (even if little else odd) >= BOM_PARITY:
            little = not little
        return data[2:].decode("utf-16-le" if little else "utf-16-be", "replace"), "utf-16"
    need = NUL_PARITY if len(data) // 2 >= LEAST_PAIRS else 1.0
    if data and len(data) % 2 == 0 and max(even, odd) >= need and min(even, odd) < need:
        return data.decode("utf-16-be" if even > odd else "utf-16-le", "replace"), "utf-16"
    try:
        text = data.decode("utf-8")
        if len(text) < LEAST_CHARS or not any(c < " " and c not in "\t\n\r\x0b\x0c" for c in text):
            return text, "utf-8"
    except UnicodeDecodeError:
        pass
    # The five bytes windows-1252 leaves open stand for the control characters of the same number.
    return "".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data) if any(b > 127 for b in data) else data.decode("ascii"), "windows-1252"
