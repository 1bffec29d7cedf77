"""Parsers into blocks: HTML pages and Markdown or plain text; format probing by magic bytes; admission."""

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "doc_id long, ord int, block_type string, level int, page int, text string"
_TAGS = {"p": "paragraph", "li": "list_item", "pre": "code", "figcaption": "caption", "td": "paragraph", "th": "paragraph", "div": "paragraph", "article": "paragraph", "blockquote": "paragraph", "br": "paragraph"}
_TAGS |= {f"h{i}": "heading" for i in range(1, 7)}
_HIDDEN = {"script", "style", "template", "noscript", "title"}
_FURNITURE = {"nav", "header", "footer", "aside"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.text: list[str] = []
        self.tag, self.hidden, self.furniture = "p", 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            kind = "header_footer" if self.furniture else _TAGS[self.tag]
            self.rows.append((kind, int(self.tag[1]) if _TAGS[self.tag] == "heading" else None, text))

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        if tag in _FURNITURE or tag in _TAGS:
            self.flush()
        self.furniture += tag in _FURNITURE
        if tag in _TAGS:
            self.tag = "p" if tag == "br" else tag

    def handle_endtag(self, tag):
        self.hidden -= tag in _HIDDEN and self.hidden > 0
        if tag in _FURNITURE or tag in _TAGS:
            self.flush()
            self.tag = "p"
        self.furniture -= tag in _FURNITURE and self.furniture > 0

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def parse_html(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """Blocks of each page in reading order; navigation and the like are header_footer; a null page has none."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["html"], strict=True):
                p = _Blocks()
                p.feed(text or "")
                p.close()
                p.flush()
                out += [(i, n, kind, level, 0, text) for n, (kind, level, text) in enumerate(p.rows)]
            out = pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])
            yield out.astype({"level": "Int32"})

    return pages.select(F.col(id_column).alias("doc_id"), F.col(html).alias("html")).mapInPandas(run, BLOCKS)


def parse_text(docs: DataFrame) -> DataFrame:
    """Blocks of Markdown or plain text, line by line: # headings, - items, fenced code left as paragraphs."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line")).where(F.trim("line") != "")
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    kind = F.when(marks > 0, "heading").when(F.col("line").rlike(r"^\s*[-*]\s"), "list_item").otherwise("paragraph")
    text = F.trim(F.regexp_replace("line", r"^(#{1,6}|\s*[-*])\s+", ""))
    return lines.select("doc_id", "ord", kind.alias("block_type"), F.when(marks > 0, marks).alias("level"), F.lit(0).alias("page"), text.alias("text"))


def probe_format(content: Column | str, name: Column | str) -> Column:
    """The format by magic bytes, else by what UTF-8 text says of itself, else by extension, else unknown."""
    c = F.col(content) if isinstance(content, str) else content
    head, begin = F.hex(F.substring(c, 1, 8)), F.lower(F.decode(F.substring(c, 1, 512), "ISO-8859-1"))
    text = F.try_validate_utf8(c.cast("string"))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    starts = lambda x: head.startswith(x)
    return (
        F.when(starts("25504446"), "pdf").when(starts("89504E47"), "png").when(starts("FFD8FF"), "jpeg").when(starts("7B5C727466"), "rtf")
        .when(starts("504B0304") & ext.isin("docx", "xlsx", "pptx", "odt", "ods", "odp"), ext).when(starts("504B0304"), "zip")
        .when(starts("D0CF11E0") & ext.isin("doc", "xls", "ppt"), ext).when(starts("D0CF11E0"), "ole")
        .when(text.isNotNull() & begin.rlike(r"^\s*(<!doctype html|<html|<head|<body)"), "html")
        .when(text.isNotNull() & ext.isin("txt", "csv", "md"), ext).when(text.isNotNull() & (F.length(text) > 0), "txt").otherwise("unknown")
    )


def admission_errors(content: Column, kind: Column, supported: list[str], most_bytes: int) -> Column:
    """All reasons for which a document is not admitted."""
    checks = [F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty file"), F.when(~kind.isin(*supported), F.concat(F.lit("unsupported format "), kind)), F.when(F.length(content) > most_bytes, "file too large")]
    return F.array_compact(F.array(*checks))
