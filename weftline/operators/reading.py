"""Reading documentation: pages as lines of Markdown, windows of words around an anchor, pages asked for by name or address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import text as tx

HEADING = r"^#{1,6}[ \t]+([^\n]*)"
#: Elements that end a line.
BLOCKS = r"(?i)</?(?:p|div|li|ul|ol|tr|table|section|article|nav|header|footer|aside|blockquote|pre|br|hr|h[1-6])\b[^>]*>"
MARK = "[...]"


def markdown(html: Column) -> Column:
    """Lines of text: headings led by #, blocks on lines of their own, scripts, styles and tags gone. References stay as written. Null gives ``''``."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<style\b.*?</style>", " "), r"(?is)<head\b.*?</head>", " ")
    t = F.regexp_replace(t, r"\s+", " ")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    t = F.regexp_replace(F.regexp_replace(t, BLOCKS, "\n"), r"<[^>]*>", "")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def anchor_of(name: Column) -> Column:
    return F.coalesce(F.nullif(tx.slugify(name), F.lit("")), F.lit("docs"))


def centre(text: Column, anchor: Column) -> Column:
    """Words before the line that the anchor means: the first heading of that slug, else the first of the lines that share most terms with it."""

    def before(lines: Column) -> Column:
        terms = tx.bm25_tokens(F.regexp_replace(anchor, "-", " "))
        headed = F.array_position(F.transform(lines, lambda x: F.when(x.rlike(HEADING), anchor_of(F.regexp_extract(x, HEADING, 1)) == anchor).otherwise(False)), True)
        shared = tx.let(F.transform(lines, lambda x: F.size(F.array_intersect(terms, tx.bm25_tokens(x)))), lambda s: F.array_position(s, F.array_max(s)))
        place = F.when(headed > 0, headed).otherwise(shared).cast("int")
        return tx.let(place, lambda p: F.aggregate(F.slice(lines, F.lit(1), p - 1), F.lit(0), lambda a, x: a + tx.word_count(x)))

    return F.when(anchor.isNull() | (anchor == ""), F.lit(0)).otherwise(tx.let(F.split(text, "\n"), before))


def excerpt(text: Column, anchor: Column, most: int) -> Column:
    """At most ``most`` words around the anchor's line, marked where something is left out; a text of no more words whole, as it is.

    Without an anchor it is the beginning. Null texts give null.
    """

    def window(words: Column) -> Column:
        n = F.size(words)

        def cut(middle: Column) -> Column:
            end = F.least(n, F.greatest(F.lit(0), middle - most // 2) + most)
            start = F.greatest(F.lit(0), end - most)
            head, tail = F.when(start > 0, MARK + "\n").otherwise(""), F.when(end < n, "\n" + MARK).otherwise("")
            return F.concat(head, F.array_join(F.slice(words, start + 1, F.lit(most)), " "), tail)

        return F.when(n <= most, text).otherwise(tx.let(centre(text, anchor), cut))

    return F.when(text.isNotNull(), tx.let(tx.words(text), window))


def read(docs: DataFrame, requests: DataFrame, most: int) -> DataFrame:
    """``requests`` (request_id, wanted: a slug or an address) with slug, url and excerpt of the page each names, null where there is none.

    ``docs`` (slug, url, text). An address is looked up without its fragment, which is the anchor; a slug is its own anchor. Pages of
    one name all answer.
    """
    wanted = F.trim("wanted")
    address = wanted.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/\s]+")
    key = F.when(address, F.regexp_replace(wanted, "#.*$", "")).otherwise(anchor_of(wanted))
    anchor = F.when(address, F.nullif(F.regexp_extract(wanted, "#(.*)$", 1), F.lit(""))).otherwise(anchor_of(wanted))
    asked = requests.withColumns({"_key": key, "_anchor": anchor})
    names = docs.select(F.col("slug").alias("found_slug"), F.col("url").alias("found_url"), "text", F.explode(F.array_distinct(F.array(F.col("slug"), F.regexp_replace("url", "#.*$", "")))).alias("_key"))
    both = asked.join(names, "_key", "left")
    return both.select(*requests.columns, F.col("found_slug").alias("slug"), F.col("found_url").alias("url"), excerpt(F.col("text"), F.col("_anchor"), most).alias("excerpt"))
