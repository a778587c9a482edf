"""Names, keys, URLs and small text rules as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of a visual, and their older names.
CLASSES = ("decorative", "illustrative", "essential")
OLD_CLASSES = {"decorativo": "decorative", "illustrativo": "illustrative", "essenziale": "essential"}
SUPERSCRIPTS = ("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ")
SUBSCRIPTS = ("0123456789+-=()aeoxn", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₙ")


def slug(title: Column) -> Column:
    return F.substring(F.regexp_replace(title, r"[^\p{L}\p{N}_-]", "_"), 1, 150)


def library_name(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.regexp_replace(text, r'[/\\:*?"<>|]', " "), r"(?U)[\s\x1c-\x1f]+", " "))
    cut = F.substring(F.regexp_replace(spaced, r"^[. ]+|[. ]+$", ""), 1, 120)
    return F.when(cut == "", "Unknown").otherwise(cut)


def stable_id(text: Column, length: int = 10) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f\xa0]+", " "))


def image_url(url: Column) -> Column:
    """The inner URL of a proxied one: percent-encoded, else nested, else unchanged."""
    inner = F.regexp_extract(url, r"(?s)(https%3A%2F%2F.*)$", 1)
    nested = F.regexp_extract(url, r"(?s)^.{8,}?(https://.*)$", 1)
    plain = F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B")))
    return F.when(inner != "", F.coalesce(plain, inner)).when(nested != "", nested).otherwise(url)


def geometry(url: Column) -> Column:
    """struct<width, height, hint> from the size in a file name."""
    size = r"(?i)_(\d{2,5})x(\d{2,5})\.(?:png|jpe?g|gif|webp)\b"
    w, h = (F.regexp_extract(url, size, i).try_cast("int") for i in (1, 2))
    return F.struct(w.alias("width"), h.alias("height"), shape(w, h).alias("hint"))


def shape(w: Column, h: Column) -> Column:
    ratio = w / F.nullif(h, F.lit(0))
    return F.when(ratio >= 4.0, "formula").when((ratio >= 2.4) & (h < 500), "banner").otherwise("figure")


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty without one."""
    return F.lower(F.regexp_extract(url, r"^[^:]+://(?:[^@/?#]*@)?([^/?#:]+)", 1))


def title_case(text: Column) -> Column:
    """Every run of letters begins with a capital, after digits and apostrophes too."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def host_author(url: Column) -> Column:
    first = F.replace(F.regexp_extract(F.regexp_replace(host(url), r"^www\.", ""), r"^[^.]*", 0), F.lit("-"), F.lit(" "))
    return F.when(F.coalesce(first, F.lit("")) == "", "Unknown").otherwise(title_case(first))


def year_of(published: Column) -> Column:
    y = F.substring(published, 1, 4)
    return F.when(y.rlike(r"^\d+$"), y).otherwise("")


def visual_class(name: Column) -> Column:
    old = F.create_map(*[F.lit(x) for kv in OLD_CLASSES.items() for x in kv])
    now = F.coalesce(F.try_element_at(old, name), name, F.lit(""))
    return F.when(now.isin(*CLASSES), now).otherwise("decorative")


def excerpt(kind: Column, text: Column, caption: Column, rows: Column, length: int = 180) -> Column:
    visual = F.coalesce(F.nullif(caption, F.lit("")), F.lit("(no caption)"))
    table = F.coalesce(F.array_join(F.try_element_at(rows, F.lit(1)), " | "), F.lit("(empty table)"))
    return F.trim(F.substring(collapse(F.when(kind == "visual", visual).when(kind == "table", table).otherwise(text)), 1, length))


def render_rows(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def flatten_rows(rows: Column) -> Column:
    filled = F.transform(rows, lambda r: F.array_join(F.filter(r, lambda c: F.trim(c) != ""), ", "))
    return F.array_join(F.filter(filled, lambda r: r != ""), ". ")


def echo_lines(code: Column) -> Column:
    """The lines of a code, collapsed, whose repetition is an echo: of 16 characters or more."""
    lines = F.split(code, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]")
    return F.filter(F.transform(lines, collapse), lambda x: F.length(x) >= 16)


def is_echo(code: Column, reply: Column) -> Column:
    """A description that repeats its code: all of it (8 characters or more) or a line of 16."""
    flat, said = collapse(code), collapse(reply)
    line = F.exists(echo_lines(code), lambda x: said.contains(x))
    return ((F.length(flat) >= 8) & said.contains(flat)) | line


def script_form(text: Column, kind: str) -> Column:
    """Superscript or subscript signs where all characters have one, else ^text or _text."""
    plain, signs = SUPERSCRIPTS if kind == "sup" else SUBSCRIPTS
    whole = text.rlike(f"^[{plain.replace('-', chr(92) + '-')}]+$")
    return F.when(text == "", "").when(whole, F.translate(text, plain, signs)).otherwise(F.concat(F.lit("^" if kind == "sup" else "_"), text))
