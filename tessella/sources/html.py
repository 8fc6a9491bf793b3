"""HTML pages as Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SKIP = {"script", "style", "nav", "footer", "header"}
_MARKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### ", "li": "- ", "blockquote": "> "}
_BLOCKS = {*_MARKS, "p", "pre", "td", "th"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.skipped, self.href = 0, ""

    def handle_starttag(self, tag, attrs) -> None:  # noqa: ANN001
        if tag in _SKIP:
            self.skipped += 1
        elif not self.skipped:
            if tag in _BLOCKS or tag == "br":
                self.out.append("\n" if tag == "br" else "\n\n" + _MARKS.get(tag, ""))
            elif tag == "a":
                self.href = dict(attrs).get("href") or ""
            elif tag == "img":
                self.out.append(f"![{dict(attrs).get('alt') or ''}]({dict(attrs).get('src') or ''})")

    def handle_endtag(self, tag) -> None:  # noqa: ANN001
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in _BLOCKS and not self.skipped:
            self.out.append("\n\n")

    def handle_data(self, data) -> None:  # noqa: ANN001
        if not self.skipped:
            self.out.append(f"[{data.strip()}]({self.href})" if self.href else data)
            self.href = ""


def to_markdown(html: str | None) -> str:
    """Markdown of a page's main part: article, else main, else body; scripts and page furniture left out."""
    text = html or ""
    for tag in ("article", "main", "body"):
        if m := re.search(rf"(?is)<{tag}[^>]*>(.*)</{tag}>", text):
            text = m[1]
            break
    reader = _Reader()
    reader.feed(text)
    plain = "".join(reader.out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", plain)).strip()


@F.pandas_udf(StringType())
def html_markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)
