"""Text expressions: slugs, list cells, labelled values, excerpts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their plain letter, derived from Unicode."""
    accented, plain = [], []
    for code in range(0x00C0, 0x0250):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            accented.append(char)
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _fold_table()
# Combining marks of already decomposed text.
_MARKS = r"[̀-ͯ]"


def let(c: Column, body) -> Column:
    """``body(c)`` with ``c`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(c), lambda v: body(v)), F.lit(0))


def strip_ws(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """Drop accents, keep case."""
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _ACCENTED, _PLAIN), _MARKS, "")


def decompose(c: Column) -> Column:
    """Each accented letter as its plain letter followed by a combining mark."""
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), f"([{_ACCENTED}])", "$1\u0301")
    return F.translate(marked, _ACCENTED, _PLAIN)


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def slug(c: Column) -> Column:
    """Accent-free, case-folded key with runs of other characters as one ``_``."""
    return F.trim(F.regexp_replace(casefold(fold(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def slug_in(c: Column, tokens) -> Column:
    """Is the slug of ``c`` one of ``tokens``? One pattern tells it for plain ASCII; only other texts are folded."""
    words = "|".join("[^A-Za-z0-9]+".join(t.split("_")) for t in tokens)
    quick = rlike(c, rf"(?i)\A[^A-Za-z0-9]*+(?:{words})[^A-Za-z0-9]*+\z")
    return F.when(F.length(c) == F.octet_length(c), quick).otherwise(let(c, lambda v: slug(v).isin(*tokens)))


def spaced(c: Column) -> Column:
    """Lower-case, accent-free, file separators as blanks."""
    lowered = F.regexp_replace(F.lower(fold(c)), r"[_\-.+()\[\]]+", " ")
    return strip_ws(F.regexp_replace(lowered, r"\s+", " "))


def ascii_lower(c: Column) -> Column:
    """Accent-free lower case with non-ASCII dropped and blanks squeezed."""
    plain = F.lower(F.regexp_replace(fold(c), r"[^\x00-\x7f]", ""))
    return strip_ws(F.regexp_replace(plain, r"\s+", " "))


def compact(c: Column) -> Column:
    """Accent-free, case-folded, without any white space."""
    return casefold(F.regexp_replace(fold(c), r"\s+", ""))


def alnum(c: Column) -> Column:
    """Accent-free, case-folded letters and digits only."""
    return F.regexp_replace(casefold(fold(c)), r"[^\p{L}\p{N}]", "")


def url_slug(c: Column, fallback: str = "proyecto", limit: int = 60) -> Column:
    """File-system slug: ASCII, ``-`` for the rest, case kept, capped."""
    plain = F.regexp_replace(fold(c), r"[^\x00-\x7f]", "")
    dashed = F.regexp_replace(plain, r"[^A-Za-z0-9._-]+", "-")
    cleaned = F.regexp_replace(F.regexp_replace(dashed, r"^[-._]+|[-._]+$", ""), r"-{2,}", "-")
    return F.substring(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(fallback)), 1, limit)


def header_slug(c: Column) -> Column:
    """CSV-header slug: one ``_`` per foreign character; null when nothing is left."""
    body = F.regexp_replace(F.lower(strip_ws(c)), r"[^a-z0-9_-]", "_")
    return F.nullif(F.substring(F.regexp_replace(body, r"^[_-]+|[_-]+$", ""), 1, 60), F.lit(""))


# A part of a list cell from its first to its last character that is not white space.
_PART = r"[^\s|;](?:[^|;]*[^\s|;])?"


def list_cell(c: Column) -> Column:
    """``a | b ; c`` -> trimmed non-empty parts."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[|;]"), strip_ws)
    # One pattern reads an ASCII cell; others may end in line ends that the trimming pattern knows apart.
    return F.when(F.length(c) == F.octet_length(c), F.regexp_extract_all(c, F.lit(_PART), F.lit(0))).otherwise(F.filter(parts, lambda x: x != ""))


def list_size(c: Column) -> Column:
    """Number of parts of a list cell."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\s|;][^|;]*")), F.lit(0))


def distinct_folded(arr: Column) -> Column:
    """Ordered distinct of an array, comparing case-folded values."""
    def firsts(pair):
        return F.filter(pair["a"], lambda x, i: F.array_position(pair["f"], F.get(pair["f"], i)) == i + 1)

    return let(let(arr, lambda a: F.struct(a.alias("a"), F.transform(a, casefold).alias("f"))), firsts)


def stem(c: Column) -> Column:
    """File name without its last suffix (a leading dot is part of the name)."""
    base = F.regexp_extract(c, r"([^/]*)/*$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?<=.)\.([^./]+)$", 1))


def display_name(c: Column) -> Column:
    """``licuadora-oster_2L.png`` -> ``Licuadora oster 2L``."""
    base = strip_ws(F.regexp_replace(stem(c), r"[_\-]+", " "))
    shown = F.concat(F.upper(F.substring(base, 1, 1)), F.substring(base, 2, 2_147_483_647))
    return F.when(base != "", shown).otherwise(c)


def without_copy_suffix(c: Column) -> Column:
    """Layer name without the suffix a design tool adds to duplicates."""
    return strip_ws(F.regexp_replace(strip_ws(c), r"(?i)(\s+cop(y|ia))+(\s+\d+)*$", ""))


def squeeze(c: Column, limit: int | None = None) -> Column:
    out = strip_ws(F.regexp_replace(c, r"\s+", " "))
    return F.substring(out, 1, limit) if limit else out


def clean_document(c: Column, limit: int) -> Column:
    """Squeeze blanks, keep at most one empty line, trim, cut."""
    blanks = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]+", " ")
    lines = F.regexp_replace(blanks, r"\n{3,}", "\n\n")
    return F.substring(strip_ws(lines), 1, limit)


def labelled_value(c: Column, labels: list[str], limit: int | None = None) -> Column:
    """First ``label: value`` line, its first ``limit`` characters if one is given; earlier labels win; empty when none."""
    import re

    found = [
        F.nullif(F.regexp_extract(c, rf"(?im)^\s*{re.escape(label)}\s*[:\-]\s*(.+)$", 1), F.lit(""))
        for label in labels
    ]
    return squeeze(F.coalesce(*found, F.lit("")), limit)


def balanced_excerpt(c: Column, limit: Column, marker: str) -> Column:
    """Head (68 %) + marker + tail when the text is longer than ``limit``."""
    room = limit - F.lit(len(marker))
    head = F.floor(room * F.lit(0.68)).cast("int")
    tail = F.greatest(F.lit(1), room - head).cast("int")
    return (
        F.when(F.length(c) <= limit, c)
        .when(limit <= 80, F.substr(c, F.lit(1), limit))
        .otherwise(F.concat(F.substr(c, F.lit(1), head), F.lit(marker), F.right(c, tail)))
    )


def any_word(c: Column, words) -> Column:
    """True when any of the literal words occurs in the text."""
    cond = F.lit(False)
    for word in words:
        cond = cond | F.contains(c, F.lit(word))
    return cond


def rlike(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def is_price_text(c: Column, pattern: str) -> Column:
    return rlike(c, r"\d") & rlike(c, pattern)


def is_brand_text(text: Column, brand: Column) -> Column:
    """Does the text spell the brand (or a part of it), brand of 3+ letters?"""
    read, target = alnum(text), alnum(brand)
    return (
        (F.length(target) >= 3)
        & (F.length(read) > 0)
        & (F.contains(read, target) | F.contains(target, read))
    )


def closed_answer(answer: Column, valid: list[str]) -> Column:
    """Key of a closed list that an answer names: exact, or the only one mentioned."""
    import re

    clean = F.regexp_replace(F.lower(strip_ws(answer)), r"[^a-z_ ]", " ")
    direct = F.replace(F.trim(clean), F.lit(" "), F.lit("_"))
    hits = F.array_compact(
        F.array(*[
            F.when(rlike(clean, rf"(?<![a-z_]){re.escape(key)}(?![a-z_])"), F.lit(key)) for key in valid
        ])
    )
    return F.when(direct.isin(*valid), direct).when(F.size(hits) == 1, F.element_at(hits, 1))


def index_list(c: Column) -> Column:
    """``0,2`` -> [0, 2]; null for none or for any token that is not digits."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip_ws), lambda x: x != "")
    ok = F.forall(parts, lambda x: rlike(x, r"^\d+$"))
    return F.when(ok & (F.size(parts) > 0), F.transform(parts, lambda x: x.cast("int")))


def json_text_list(c: Column) -> Column:
    """JSON array -> list of non-blank texts; null when it is not an array."""
    arr = F.from_json(F.coalesce(F.nullif(c, F.lit("")), F.lit("[]")), "array<string>")
    return F.filter(arr, lambda x: strip_ws(x) != "")


def url_list(c: Column) -> Column:
    """Lines or commas -> distinct URLs, ``https://`` added where no scheme."""
    parts = F.filter(F.transform(F.split(c, r"[\n,]"), strip_ws), lambda x: x != "")
    full = F.transform(parts, lambda x: F.when(rlike(x, r"(?i)^https?://"), x).otherwise(F.concat(F.lit("https://"), x)))
    return F.array_distinct(full)
