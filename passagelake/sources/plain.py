"""Plain text and Markdown: decoding without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _windows_1252() -> tuple[str, str, str]:
    """Latin-1 control characters, what Windows means by them, and the unassigned ones."""
    latin, windows, unassigned = [], [], []
    for code in range(0x80, 0xA0):
        try:
            windows.append(bytes([code]).decode("cp1252"))
            latin.append(chr(code))
        except UnicodeDecodeError:
            unassigned.append(chr(code))
    return "".join(latin), "".join(windows), "".join(unassigned)


def decode_text(content: Column) -> Column:
    """UTF-8 if valid, else Windows-1252 if every byte is assigned, else Latin-1.

    Line ends become ``\\n``. A byte order mark stays, as UTF-8 decoding leaves it.
    """
    latin, windows, unassigned = _windows_1252()
    single = F.decode(content, "ISO-8859-1")
    fallback = F.when(single.rlike(f"[{unassigned}]"), single).otherwise(
        F.translate(single, latin, windows)
    )
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), fallback)
    return F.regexp_replace(text, "\r\n?", "\n")
