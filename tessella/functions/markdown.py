"""Tables between HTML, CSV cells and Markdown, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_controls


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of `c`, which is worked out once a row: an expression named in a lambda is otherwise worked out for every element."""
    return F.transform(F.array(c), then)[0]


def _unescaped(c: Column) -> Column:
    # '&amp;' first: an escaped entity is decoded twice.
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"')):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def html_table_rows(html: Column) -> Column:
    """Rows of cells of every <tr> with a cell; tags inside a cell go, entities are decoded."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: _unescaped(trim_controls(F.regexp_replace(c, r"<[^>]+>", "")))))
    return F.filter(cells, lambda r: F.size(r) > 0)


def markdown_table(rows: Column, escape: bool = True) -> Column:
    """Markdown of rows of cells, padded to the widest row, with a separator after the first; '' without rows."""
    return _once(rows, lambda r: _markdown_table(r, escape))


def _markdown_table(rows: Column, escape: bool) -> Column:
    clean = (lambda c: trim_controls(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))) if escape else (lambda c: c)

    def whole(width: Column) -> Column:
        line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.concat(F.lit(" "), clean(c), F.lit(" |"))), ""))
        rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), width))
        return trim_controls(F.array_join(F.transform(rows, lambda r, i: F.when(i == 0, F.concat(line(r), rule)).otherwise(line(r))), "\n"))

    return F.when(F.size(rows) > 0, _once(F.array_max(F.transform(rows, lambda r: F.size(r))), whole)).otherwise("")


def html_table_to_markdown(html: Column) -> Column:
    """All tables of an HTML text as one Markdown table, empty cells kept; piped text without a table passes through."""
    h = F.coalesce(html, F.lit(""))
    has_table = F.lower(h).contains("<table")
    inner = F.array_join(F.regexp_extract_all(h, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1)), "")
    return F.when(~has_table & h.contains("|"), trim_controls(h)).otherwise(markdown_table(html_table_rows(inner)))


def html_to_markdown_dropping(html: Column) -> Column:
    """Markdown table split at row and cell tags, empty cells dropped; HTML without text cells stays as it is."""
    h = F.coalesce(html, F.lit(""))
    cell = lambda c: trim_controls(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?i)</t[dh]>", ""), r"<[^>]+>", ""), r"\s+", " "))
    rows = F.transform(F.split(h, r"(?i)<tr[^>]*>"), lambda r: F.filter(F.transform(F.split(r, r"(?i)<t[dh][^>]*>"), cell), lambda c: c != ""))
    return _once(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.when(F.size(r) > 0, markdown_table(r, escape=False)).otherwise(h))


def without_fences(c: Column) -> Column:
    """Table text without Markdown code fences."""
    return trim_controls(F.regexp_replace(F.regexp_replace(trim_controls(F.coalesce(c, F.lit(""))), r"^```[a-zA-Z]*\s*\n?", ""), r"\n?```$", ""))


def table_cells(line: Column) -> Column:
    """Trimmed cells of one Markdown table row."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def merged_tables(parts: Column) -> Column:
    """Non-empty parts joined by a blank line."""
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


# Fixed value: what a browser trims and takes for white space.
_BLANK = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{_BLANK}]+|[{_BLANK}]+$", "")


def _is_separator(line: Column) -> Column:
    """Whether a line is the rule below a table's header: bars, colons, dashes and blanks, a bar first and a dash somewhere."""
    return line.rlike(rf"^[{_BLANK}]*\|[|:\-{_BLANK}]*$") & F.contains(line, F.lit("-"))


def _separator(line: Column) -> Column:
    """The rule with every cell as ' --- ' and its alignment colons; an empty cell is one blank, nothing stays outside the outer bars."""
    return _once(F.split(line, r"\|", -1), _joined_rule)


def _joined_rule(cells: Column) -> Column:
    last = F.size(cells) - 1

    def cell(c: Column, i: Column) -> Column:
        dashes = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit(":"), F.lit("")), rf"[{_BLANK}]+", "-"), "-+", "---")
        colon = lambda at: F.when(at, ":").otherwise("")
        text = F.concat(F.lit(" "), colon(F.startswith(c, F.lit(":"))), dashes, colon(F.endswith(c, F.lit(":"))), F.lit(" "))
        return F.when((c == "") & ((i == 0) | (i == last)), "").when(c == "", " ").otherwise(text)

    return F.array_join(F.transform(F.transform(cells, _stripped), cell), "|")


def normalised_tables(text: Column) -> Column:
    """Markdown in which every table renders: its rule is normalised, and a blank line stands before a header that follows text or begins the text.

    What happens at a line depends on its two neighbours only, so a text is one pass over its lines. A null text is ''.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def kind(x: Column) -> Column:
        """What its neighbours ask of a line: whether it has a bar in front, is blank, is a rule."""
        s = _stripped(x)
        return F.struct(x.alias("x"), s.startswith("|").alias("bar"), (s == "").alias("blank"), _is_separator(x).alias("rule"))

    def joined(known: Column) -> Column:
        def line(k: Column, i: Column) -> Column:
            # Before the first line stands nothing: it opens like a line after text. Position 0 must not be asked for.
            before = F.try_element_at(known, F.greatest(i, F.lit(1)))
            after_text = (i == 0) | (~before["blank"] & ~before["bar"])
            shown = F.when(k["rule"], _separator(k["x"])).otherwise(k["x"])
            return F.when(k["bar"] & F.coalesce(F.try_element_at(known, i + 2)["rule"], F.lit(False)) & after_text, F.concat(F.lit("\n"), shown)).otherwise(shown)

        return F.array_join(F.transform(known, line), "\n")

    return _once(F.transform(lines, kind), joined)
