"""Word lists and rewrite rules used by the text functions."""

from __future__ import annotations

from pathlib import Path

# The text rewrite rules, in the order they must be applied.
# Each entry is (kind, what to look for, replacement).
CLEANING_RULES = (
    ("text", '"', " "),
    ("text", "<br />", " "),
    # All but ASCII letters, digits and the space, spelled as ranges: Java matches
    # these about six times faster than the negated class.
    ("regex", r"[\x00-\x1f!-/:-@\[-`{-\x{10ffff}]", " "),
    ("text", "jl ", "jalan "),
    ("text", "jln ", "jalan "),
    ("text", " sy ", " saya "),
    ("text", " bpk ", " bapak "),
    ("text", " blm ", " belum "),
    ("text", " dtg ", " datang "),
    ("text", " bdg ", " bandung "),
    ("text", "ma af", " "),
    ("text", "terima kasih", " "),
    ("text", "tindak lanjut", " "),
    ("regex", "[0-9]", " "),
    ("regex", " [a-z]{1} ", " "),
    ("regex", " {2,}", " "),
)


def read_stopwords(path: str | Path) -> list[str]:
    """Stop words from a text file with one word per line; blank lines and repeats go."""
    lines = Path(path).read_text(encoding="utf-8").splitlines()
    return list(dict.fromkeys(word.strip() for word in lines if word.strip()))
