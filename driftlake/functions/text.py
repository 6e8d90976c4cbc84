"""String expressions of the taxonomy and sequence tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of a lineage and their prefixes.
RANKS = {"domain": "d", "phylum": "p", "class_": "c", "order": "o", "family": "f", "genus": "g", "species": "s"}


def rank_of(lineage: Column, prefix: str) -> Column:
    """What stands behind `prefix__` in the last such part; empty where there is none."""
    own = F.filter(F.split(lineage, ";"), lambda t: t.startswith(f"{prefix}__"))
    return F.coalesce(F.substring(F.try_element_at(own, F.lit(-1)), len(prefix) + 3, 1 << 30), F.lit(""))


def strip_version(accession: Column) -> Column:
    return F.substring_index(accession, ".", 1)


def mask_ambiguous(sequence: Column) -> Column:
    """Upper case; each run of three or more N becomes one @."""
    return F.regexp_replace(F.upper(sequence), "N{3,}", "@")


def truncate(sequence: Column, most: int) -> Column:
    return F.substring(sequence, 1, most)


def member_key(name: Column, suffix: str) -> Column:
    """File name without its suffix; null for names that don't end in it."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.when(base.endswith(suffix), F.substring(base, F.lit(1), F.char_length(base) - len(suffix)))


def header_id(header: Column) -> Column:
    """First word of a FASTA header, with or without its mark."""
    return F.regexp_extract(header, r"^>?\s*(\S+)", 1)


def remove_suffix(name: Column, suffix: str) -> Column:
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.char_length(name) - len(suffix))).otherwise(name)


def release_number(tag: Column) -> Column:
    return F.regexp_replace(tag, "^[Rr]+", "")


def retry_wait(attempt: Column, most: int = 30) -> Column:
    """Seconds before the next try."""
    return F.least(attempt * 5, F.lit(most))


def fixed(x: Column, digits: int) -> Column:
    """With so many digits, as Python and C print it: the number's exact value is rounded, halves to even (the JVM's `%.2f` rounds
    the shortest decimal that stands for it, halves up). The fraction is printed by itself, so long numbers keep all digits; from 2**63
    on those after the 17th are zeros."""
    size = F.abs(x)
    whole = F.floor(size)
    rest = F.call_function("format_number", size - whole, F.lit("0." + "0" * digits))  # begins with 1 where it rounds up to a whole
    exact = F.concat((whole + F.substring(rest, 1, 1).cast("long")).cast("string"), F.substring(rest, 2, digits + 1))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.concat(sign, F.when(size < 2.0**63, exact).when(size >= 2.0**63, F.format_string(f"%.{digits}f", size)))  # null: null


def shown_bytes(n: Column) -> Column:
    """Megabytes below a thousand of them, else gigabytes, with a digit or two."""
    return F.when(n >= 1e9, F.concat(fixed(n / 1e9, 2), F.lit(" GB"))).otherwise(F.concat(fixed(n / 1e6, 1), F.lit(" MB")))
