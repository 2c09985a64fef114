"""Messages: the envelope and the plain text, and attachments as files of their own."""

from __future__ import annotations

import re
from dataclasses import dataclass
from email import policy
from email.errors import MessageError
from email.message import EmailMessage
from email.parser import BytesParser

from ledgerloom.sources.elements import Element, Malformed, Parsed
from ledgerloom.sources.texts import parse_text

MOST_PARTS, MOST_DEPTH, MOST_BYTES = 200, 10, 50 * 1024 * 1024


@dataclass
class Attachment:
    part_index: int
    name: str | None
    mime: str
    content: bytes


def _parts(message: EmailMessage) -> list[tuple[int, EmailMessage]]:
    found, stack = [], [(message, 0)]
    while stack:
        part, depth = stack.pop()
        if depth > MOST_DEPTH or len(found) >= MOST_PARTS:
            raise Malformed("too many parts, or parts too deep")
        if part.get_content_type() == "message/rfc822":
            raise Malformed("a message inside a message is refused")
        if part.is_multipart():
            stack.extend((p, depth + 1) for p in reversed(list(part.iter_parts())))
        else:
            found.append((len(found), part))
    return found


def _read(content: bytes) -> EmailMessage:
    if len(content) > MOST_BYTES:
        raise Malformed("the message is too large")
    try:
        message = BytesParser(policy=policy.default).parsebytes(content)
    except (MessageError, ValueError, LookupError) as e:
        raise Malformed(str(e)) from e
    if not message.keys():
        raise Malformed("there are no headers")
    return message


def _is_attachment(part: EmailMessage) -> bool:
    return part.get_content_disposition() == "attachment" or part.get_filename() is not None


def safe_name(raw: str | None) -> str | None:
    """The last path segment, unsafe characters as underscores, at most its last 200 characters."""
    base = re.sub(r"[\x00-\x1f\x7f<>:\"|?*]", "_", re.split(r"[/\\]", raw or "")[-1]).strip()[-200:]
    return base if re.search(r"[^._ ]", base) else None


def attachments_of(content: bytes) -> list[Attachment]:
    return [Attachment(i, safe_name(p.get_filename()), p.get_content_type(), p.get_payload(decode=True) or b"") for i, p in _parts(_read(content)) if _is_attachment(p)]


def parse_mail(content: bytes) -> Parsed:
    """A block with the envelope, then the blocks of the plain text parts."""
    message = _read(content)
    parts = _parts(message)
    n = sum(_is_attachment(p) for _, p in parts)
    lines = [f"{h}: {' '.join(str(message[h]).split())}" for h in ("From", "Date", "Subject", "Message-ID") if message[h]]
    out = [Element("\n".join([*lines, f"Attachments: {n}"]), "text-block", block_index=0)]
    reasons, had_text = [], False
    for _, part in parts:
        if part.get_content_type() == "text/plain" and not _is_attachment(part):
            had_text = True
            for e in parse_text(part.get_payload(decode=True) or b"").elements:
                out.append(Element(e.text, "text-block", block_index=len(out)))
    if not had_text:
        reasons.append("the message has no plain text part")
    return Parsed(out, reasons)
