"""Text of markup, as Columns and in Python."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that end a block of text.
BLOCKS = "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
_STEPS = (
    (r"(?is)<script\b.*?</script\s*>", " "),
    (r"(?is)<style\b.*?</style\s*>", " "),
    (r"(?s)<!--.*?-->", " "),
    (rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", " "),
    (r"(?s)<[^>]+>", " "),
)
_NAMED = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}


def html_text(c: Column) -> Column:
    """The text of an HTML document as one line. References are decoded after the tags are gone; the named ones that XML has."""
    for pattern, by in _STEPS:
        c = F.regexp_replace(c, pattern, by)
    for name, by in _NAMED.items():
        c = F.replace(c, F.lit(name), F.lit(by))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def from_html(text: str) -> str:
    for pattern, by in _STEPS:
        text = re.sub(pattern, by, text)
    return squeeze(html.unescape(text))


def from_xml(text: str) -> str:
    text = re.sub(r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", " ", text)
    return squeeze(html.unescape(re.sub(r"(?s)<[^>]+>", " ", text)))


def squeeze(text: str) -> str:
    return " ".join(text.split())
