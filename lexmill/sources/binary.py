"""Text out of old word-processor files, by what their bytes show."""

from __future__ import annotations

import struct

import regex

OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LEAST_TEXT = 50

_BYTE_RUN = regex.compile(rb"[\t\n\r\x07\x0b\x0c\x20-\x7e\xa0-\xff]{20,}")
#: Little-endian UTF-16 of printable characters: Latin letters have a zero above, a few others one to five.
_WIDE_RUN = regex.compile(rb"(?:[\x20-\x7e\x0a\x0d\x0b\x0c\x07\xc0-\xff]\x00|[\x00-\xff][\x01-\x05]){15,}")
_BREAKS = str.maketrans({c: "\n" for c in "\r\x07\x0b\x0c"})


def decode_text(content: bytes) -> str:
    for encoding in ("utf-8-sig", "utf-8", "cp1252"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def wide_runs(content: bytes) -> str:
    """Runs of UTF-16 text with blanks and enough letters, at either alignment, one of each beginning."""
    kept: dict[str, str] = {}
    for m in _WIDE_RUN.finditer(content):
        run = m[0].decode("utf-16-le", "ignore").translate(_BREAKS)
        if len(run) >= 20 and " " in run and sum(map(str.isalpha, run)) / len(run) > 0.35:
            kept.setdefault(run[:40], run)
    return "\n".join(kept.values())


def ole_text(content: bytes) -> str:
    """Single-byte text of a document's text region where its header names one, else its runs of UTF-16."""
    for at in (m.start() for m in regex.finditer(rb"\xec\xa5", content)):
        if at % 512 == 0 and at + 0x20 <= len(content):
            first, last = struct.unpack_from("<II", content, at + 0x18)
            region = content[at + first : at + last]
            text = region.decode("latin-1").translate(_BREAKS).replace("\x00", "")
            if last > first and len(text.strip()) >= 500:
                return text
    text = wide_runs(content)
    return text if len(text) >= 200 else ""


def text_of_document(content: bytes) -> tuple[str, str]:
    """Text and method, the first that gives more than 50 characters: old binary documents, then plain text; else nothing."""
    if content.startswith(OLE):
        text, method = ole_text(content), "ole"
    elif b"\x00" in content[:4096]:
        text, method = wide_runs(content), "utf16"
    else:
        text, method = decode_text(content), "plain"
    return (text, method) if len(text.strip()) > LEAST_TEXT else ("", "none")
