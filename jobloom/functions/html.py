"""HTML to text. The only scalar here that needs Python: an Arrow UDF over the standard parser."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, text


def _shown(values: pd.Series) -> pd.Series:
    """Entities resolved; of values that then hold tags the texts between them, blanks cut off at their ends, one to a line. Scripts
    and styles are not texts."""
    import html
    from html.parser import HTMLParser

    class Lines(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.lines, self.skipped = [], 0

        def handle_starttag(self, tag, attrs):
            self.skipped += tag in ("script", "style")

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.skipped = max(0, self.skipped - 1)

        def handle_data(self, data):
            line = data.strip()
            if line and not self.skipped:
                self.lines.append(line)

    def lines(value: str) -> str:
        value = html.unescape(value)
        if "<" not in value or ">" not in value:
            return value
        page = Lines()
        page.feed(value)
        page.close()
        return "\n".join(page.lines)

    return values.map(lines)


def clean_text(c: Column) -> Column:
    """Entities resolved; if tags are left, their texts on lines of their own; runs of blanks and of empty lines cut short. Null
    gives the empty text. Texts without entity or tag are not sent to Python (a blank goes in their stead)."""
    marked = text(c).contains("&") | text(c).contains("<")
    shown = F.when(marked, F.pandas_udf(_shown, "string")(F.when(marked, text(c)).otherwise(F.lit("")))).otherwise(text(c))
    return strip(F.regexp_replace(F.regexp_replace(shown, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def without_upsell(c):
    """A widget's line that a site mixes into its texts."""
    return strip(F.regexp_replace(c, r"(?is)get ai-powered advice on this job.*?try premium for [^\n]*", ""))


_EMPTY = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


def chosen_texts(c: Column, fields: dict[str, tuple[str, ...]]) -> Column:
    """Struct of the texts of a page's elements: for each field the first of its selectors of which some element shows a text, and of these
    elements the first; blank without one. A selector is tag, tag[attr^=value], [attr*=value] or [attr=value]: a prefix, a part, the whole
    (or, for class, one of its words). A null page is blank."""
    import re

    form = re.compile(r"(\w*)(?:\[([\w-]+)([*^]?)=([^\]]+)\])?$")
    wanted = [(name, rank, *form.match(s).groups()) for name, of in fields.items() for rank, s in enumerate(of)]

    def hit(tag: str, attr: str, op: str, value: str, name: str, attrs: dict) -> bool:
        if tag and tag != name:
            return False
        if not attr:
            return True
        has = attrs.get(attr) or ""
        return has.startswith(value) if op == "^" else value in has if op == "*" else value in has.split() if attr == "class" else value == has

    def run(pages: pd.Series) -> pd.DataFrame:
        from html.parser import HTMLParser

        class Elements(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.open, self.pieces, self.found, self.skipped = [], [], {}, 0

            def handle_starttag(self, tag, attrs):
                if tag in _EMPTY:
                    return
                self.skipped += tag in ("script", "style")
                told = dict(attrs)
                self.open.append((tag, len(self.pieces), [(n, r) for n, r, *how in wanted if hit(*how, tag, told)]))

            def handle_endtag(self, tag):
                if all(t != tag for t, _, _ in self.open):
                    return
                while self.open:
                    t, begin, hits = self.open.pop()
                    self.skipped -= t in ("script", "style")
                    self.keep(begin, hits)
                    if t == tag:
                        break

            def keep(self, begin, hits):
                shown = "\n".join(self.pieces[begin:])
                for n, r in hits:
                    if shown and (begin, -len(self.pieces)) < self.found.get((n, r), ((len(self.pieces), 0), ""))[0]:
                        self.found[n, r] = (begin, -len(self.pieces)), shown  # of several, the one that begins first, and the outer one

            def handle_data(self, data):
                if data.strip() and not self.skipped:
                    self.pieces.append(data.strip())

        out = []
        for page in pages:
            e = Elements()
            e.feed(page or "")
            e.close()
            while e.open:
                _, begin, hits = e.open.pop()
                e.keep(begin, hits)
            out.append([next((e.found[n, r][1] for r in range(len(of)) if (n, r) in e.found), "") for n, of in fields.items()])
        return pd.DataFrame(out, columns=list(fields))

    return F.pandas_udf(run, ", ".join(f"{n} string" for n in fields))(text(c))
