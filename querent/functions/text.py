"""Text columns: white space, tokens, numbers, labels, cleanup and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: white space of any script, as Python parts and strips by it. Java and RE2 both read this class.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def tokens(text: Column) -> Column:
    """Lower-cased words between white space, punctuation kept."""
    return F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda t: t != "")


def titled(title: Column, text: Column) -> Column:
    """Title and text as one, either may be missing."""
    return stripped(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))


def is_number(token: Column) -> Column:
    """Whether a token starts a number, after an opening bracket and a sign if it has them."""
    return token.rlike(rf"^{SPACE}*[\[(]?[-+]?[0-9]")


def is_clean_number(cell: Column) -> Column:
    """Whether a cell is one bare number."""
    return is_number(cell) & cell.rlike(r"^\s*\S+\s*\z")


# Labels of benchmark columns with their full names, and units that go from a label to its value.
EXPANSIONS = {
    "NQ": "NaturalQuestions NQ",
    "WQ": "WebQuestions WQ",
    "TQA": "TriviaQA TQA",
    "CT": "CuratedTrec CT",
    "EM": "Exact Match EM",
    "QQP": "QQP",
    "EN-DE": "English-German EN-DE",
    "EN-FR": "English-French EN-FR",
}
UNITS = ("ms", "s", "%", "M", "B", "FLOPs")


def expanded(label: Column, expansions: dict[str, str] | None = None) -> Column:
    """A label without the count behind it, by its full name if it has one."""
    bare = stripped(F.regexp_replace(stripped(label), r"\s+[0-9][0-9.]*[km]?\s*$", ""))
    names = F.create_map(*(F.lit(x) for pair in (expansions or EXPANSIONS).items() for x in pair))
    return F.coalesce(F.try_element_at(names, bare), bare)


def fact_pair(label: Column, value: Column) -> Column:
    """``label value``, a unit in brackets moved from the label to the value."""
    label, value = stripped(label), stripped(value)
    unit = F.regexp_extract(label, r"\(([^)]+)\)\s*$", 1)
    bare = F.regexp_replace(label, r"\s*\([^)]+\)\s*$", "")
    return F.when(unit.isin(*UNITS), F.concat(expanded(bare), F.lit(" "), value, F.lit(" "), unit)).otherwise(F.concat(expanded(label), F.lit(" "), value))


# Patterns of what extraction parts or leaves over, and what is put for each.
REPAIRS = ((r"(\d[\d.]*)\s*·\s*\|?\s*10(\d+)", "$1·10^$2"), (r"\bd\s*=?\s*(\d{3,5})\.?\s*ff\b", "d_ff = $1"))
CLEANUPS = ((r"-\s*\n\s*", ""), (r"(?i)\bPage\s*\d+\b", " "), (r"\s+", " "))


def replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def repaired(text: Column) -> Column:
    """Powers of ten and subscripts joined that extraction has parted."""
    return replaced(text, REPAIRS)


def cleaned(text: Column) -> Column:
    """Page text on one line: words joined over hyphens, page numbers gone, white space single."""
    return stripped(replaced(text, CLEANUPS))


def is_heading(line: Column) -> Column:
    return line.rlike(r"^\s{0,3}#{1,6}\s+\S")


def is_table_line(line: Column) -> Column:
    return line.rlike(r"^\s*\|")


def keyword_score(answer: Column, slots: Column) -> Column:
    """Whether each slot has an alternative that the answer holds, whatever the case; true without slots."""
    low = F.lower(answer)
    return F.forall(slots, lambda slot: F.exists(slot, lambda a: F.contains(low, F.lower(a))))


def is_yes(reply: Column) -> Column:
    """Whether a judge's reply begins with yes."""
    return F.startswith(F.upper(stripped(reply)), F.lit("Y"))


def cache_key(query: Column, *config: Column) -> Column:
    """The md5 of question and settings as JSON, in the order of the settings' names."""
    return F.md5(F.to_json(F.struct(F.struct(*config).alias("config"), query.alias("query"))).cast("binary"))


def slug(name: Column) -> Column:
    """A model's name as a part of a path."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-")


def sources_in(compound: Column) -> Column:
    """The parts of ``a + b``, without blanks."""
    return F.filter(F.transform(F.split(compound, r"\+"), stripped), lambda s: s != "")
