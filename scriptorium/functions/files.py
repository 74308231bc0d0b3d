"""File names and sizes."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import strip

#: The file types that are taken.
ALLOWED = ("pdf", "docx", "png", "jpg", "jpeg", "webp", "bmp", "tiff", "txt", "csv", "md")
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tiff")
PLAIN = ("txt", "csv", "md")
UNITS = ("bytes", "KB", "MB", "GB", "TB")
MAX_UPLOAD = 20 * 1024 * 1024


def extension(filename: Column) -> Column:
    """What follows the last dot, in lower case and stripped; empty without a dot."""
    return F.when(F.contains(filename, F.lit(".")), strip(F.lower(F.substring_index(filename, ".", -1)))).otherwise("")


def is_allowed(filename: Column) -> Column:
    return extension(filename).isin(*ALLOWED)


@cache
def _ascii_parts() -> dict[str, str]:
    """What is ASCII in the compatibility decomposition (NFKD) of each other sign, where anything is; signs come apart one by one."""
    apart = (chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.decomposition(chr(c)))
    parts = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in apart}
    return {c: p for c, p in parts.items() if p}


def _ascii(name: Column) -> Column:
    """The name with its signs decomposed, and without what is not ASCII."""
    single = {c: p for c, p in _ascii_parts().items() if len(p) == 1}
    longer = sorted(((p, c) for c, p in _ascii_parts().items() if len(p) > 1), key=lambda x: -len(x[0]))
    signs, rest = "".join(c for _, c in longer), "".join(map(chr, range(128)))

    def part(c: Column, k: int) -> Column:
        # signs without a counterpart are dropped, so that only the first part holds what is ASCII already
        return F.translate(c, signs + rest if k else signs, "".join(p[k] for p, _ in longer if len(p) > k))

    lone = F.translate(name, "".join(single), "".join(single.values()))
    by_sign = F.transform(F.split(lone, ""), lambda c: F.concat(*(part(c, k) for k in range(len(longer[0][0])))))
    return F.regexp_replace(F.when(lone.rlike(f"[{signs}]"), F.array_join(by_sign, "")).otherwise(lone), r"[^\x00-\x7F]", "")


def secure_filename(filename: Column) -> Column:
    """An ASCII name without folders: letters lose their marks, ligatures come apart, white space becomes one underscore, other signs go."""
    plain = F.when(filename.rlike(r"[^\x00-\x7F]"), _ascii(filename)).otherwise(filename)
    flat = F.regexp_replace(F.regexp_replace(F.translate(plain, "/\\", "  "), r"[\t-\r\x1C-\x20]+", " "), r"^ | $", "")
    return F.regexp_replace(F.regexp_replace(F.translate(flat, " ", "_"), r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")


def human_size(n: Column) -> Column:
    """A size with one decimal in the largest unit under 1024; halves go to the even digit."""

    def shown(power: int, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(n / F.lit(float(1024**power)), 1)), F.lit(f" {unit}"))

    whens = [(n < 1024 ** (k + 1), shown(k, unit)) for k, unit in enumerate(UNITS)]
    return reduce(lambda c, w: c.when(*w), whens[1:], F.when(*whens[0])).otherwise(shown(len(UNITS), "PB"))


def display_size(n: Column) -> Column:
    """KB with one decimal under a MB, else MB with two."""
    kb = n / F.lit(1024.0)
    return F.when(kb < 1024, F.concat(F.bround(kb, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.bround(kb / 1024, 2).cast("string"), F.lit(" MB")))
