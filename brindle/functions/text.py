"""Text of web pages."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible_text(html: Column) -> Column:
    """What stands between the tags, scripts and styles left out, white space joined.

    Lazy runs up to the end tag or the end of the page: no group repeats, so that long scripts take no stack.
    """
    for pattern in (r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)", r"<[^<>]*>", r"[ \n\t\r]+"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(html)
