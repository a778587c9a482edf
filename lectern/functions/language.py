"""Languages by name, code or tag, and how each writes numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code, English name, likely territory, decimal sign, group sign.
LANGUAGES = (
    ("ar", "Arabic", "EG", ".", ","), ("bg", "Bulgarian", "BG", ",", "\u00a0"), ("ca", "Catalan", "ES", ",", "."), ("cs", "Czech", "CZ", ",", "\u00a0"),
    ("da", "Danish", "DK", ",", "."), ("de", "German", "DE", ",", "."), ("el", "Greek", "GR", ",", "."), ("en", "English", "US", ".", ","),
    ("es", "Spanish", "ES", ",", "."), ("et", "Estonian", "EE", ",", "\u00a0"), ("fi", "Finnish", "FI", ",", "\u00a0"), ("fr", "French", "FR", ",", "\u202f"),
    ("he", "Hebrew", "IL", ".", ","), ("hi", "Hindi", "IN", ".", ","), ("hr", "Croatian", "HR", ",", "."), ("hu", "Hungarian", "HU", ",", "\u00a0"),
    ("id", "Indonesian", "ID", ",", "."), ("it", "Italian", "IT", ",", "."), ("ja", "Japanese", "JP", ".", ","), ("ko", "Korean", "KR", ".", ","),
    ("lt", "Lithuanian", "LT", ",", "\u00a0"), ("lv", "Latvian", "LV", ",", "\u00a0"), ("nl", "Dutch", "NL", ",", "."), ("pl", "Polish", "PL", ",", "\u00a0"),
    ("pt", "Portuguese", "BR", ",", "."), ("ro", "Romanian", "RO", ",", "."), ("ru", "Russian", "RU", ",", "\u00a0"), ("sk", "Slovak", "SK", ",", "\u00a0"),
    ("sl", "Slovenian", "SI", ",", "."), ("sr", "Serbian", "RS", ",", "."), ("sv", "Swedish", "SE", ",", "\u00a0"), ("th", "Thai", "TH", ".", ","),
    ("tr", "Turkish", "TR", ",", "."), ("uk", "Ukrainian", "UA", ",", "\u00a0"), ("vi", "Vietnamese", "VN", ",", "."), ("zh", "Chinese", "CN", ".", ","),
)
_BY_CODE = {row[0]: row for row in LANGUAGES}
_BY_NAME = {row[1].lower(): row for row in LANGUAGES}


def resolve(value: str | None) -> tuple[str, str] | None:
    """(code, territory) of a name, a code or a tag such as pt-BR; None if it is none of them."""
    text = (value or "").strip()
    head, *rest = text.replace("_", "-").split("-")
    row = _BY_CODE.get(head.lower()) or _BY_NAME.get(text.lower())
    if row is None or any(not part.isalnum() for part in rest):
        return None
    territory = next((p.upper() for p in rest if len(p) == 2 and p.isalpha() or len(p) == 3 and p.isdigit()), row[2])
    return row[0], territory


def code(value: str) -> str:
    """The short code; the value itself if it is unknown."""
    found = resolve(value)
    return found[0] if found else value


def display_name(value: str) -> str:
    """The English name without a territory, for prompts."""
    found = resolve(value)
    return _BY_CODE[found[0]][1] if found else value


def tag(value: str) -> str:
    """The code with a territory, the likely one if none is named."""
    found = resolve(value)
    return "-".join(found) if found else value


def number_signs(value: str) -> tuple[str, str]:
    """Decimal and group sign; point and comma for an unknown language."""
    found = resolve(value)
    return _BY_CODE[found[0]][3:5] if found else (".", ",")


def name_column(value: Column) -> Column:
    """display_name as an expression: codes, tags and names by a literal map."""
    known = F.create_map(*[F.lit(x) for row in LANGUAGES for k in (row[0], row[1].lower()) for x in (k, row[1])])
    head = F.lower(F.regexp_extract(F.trim(value), r"^[^-_]*", 0))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(value))), F.try_element_at(known, head), value)
