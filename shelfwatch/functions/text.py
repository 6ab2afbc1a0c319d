"""Text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K


_WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Trim any Unicode white space at both ends.

    Most texts begin and end with a visible ASCII character and pass as they are.
    """
    first, last = F.ascii(col), F.ascii(F.right(col, F.lit(1)))
    plain = first.between(33, 126) & last.between(33, 126)
    return F.when(plain, col).otherwise(F.btrim(col, F.lit(_WHITE_SPACE)))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def collapse_spaces(col: Column) -> Column:
    """White space runs become one space."""
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def contains_ignoring_case(col: Column, needle: str) -> Column:
    """ILIKE '%needle%' with wildcards inside the needle left active."""
    return F.coalesce(col, F.lit("")).ilike(f"%{needle}%")


def keywords(col: Column) -> Column:
    """Search keywords of a name, in order, duplicates kept."""
    tokens = F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(
        tokens,
        lambda t: (F.length(t) >= K.MIN_KEYWORD_LENGTH) & ~t.isin(K.SEARCH_STOPWORDS),
    )


def truncate_at_word(col: Column, limit: int = K.MAX_TITLE_LENGTH) -> Column:
    """Cut to ``limit`` characters, back to a whole word if there is one, plus an ellipsis."""
    cut = F.left(col, F.lit(limit))
    # 0-based position of the last space; -1 or 0 means there is no word to cut back to.
    last_space = F.when(
        F.instr(cut, " ") > 0, F.lit(limit) - F.instr(F.reverse(cut), " ")
    ).otherwise(F.lit(-1))
    head = F.when(last_space > 0, F.left(cut, last_space)).otherwise(cut)
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(head, F.lit("…")))


def discount_text(col: Column) -> Column:
    """The stated discount: percent, amount and code, joined by '; ' ('' when none)."""

    def part(pattern: str, before: str, after: str) -> Column:
        hit = F.regexp_extract(col, pattern, 1)
        return F.when(hit != "", F.concat(F.lit(before), hit, F.lit(after)))

    return F.concat_ws(
        "; ",
        part(K.PERCENT_OFF, "", "% off"),
        part(K.DOLLAR_OFF, "$", " off"),
        part(K.COUPON_CODE, "code ", ""),
    )


def price_context(col: Column, reach: int = K.PRICE_CONTEXT_CHARS) -> Column:
    """The characters around every '$', joined by a space.

    Works on the pieces between dollar signs. A context reaches ``reach``
    characters each way, so it spans at most ``reach`` further pieces and only
    the first or last ``reach`` characters of each: linear in the text. A text
    with one dollar sign is cut at once.
    """
    pieces = F.split(col, r"\$", -1)
    heads = F.transform(pieces, lambda p: F.left(p, F.lit(reach)))
    tails = F.transform(pieces, lambda p: F.right(p, F.lit(reach)))

    def around(j: Column) -> Column:
        first = F.greatest(F.lit(1), j - reach)
        before = F.array_join(F.slice(tails, first, j - first + 1), "$")
        after = F.concat(F.lit("$"), F.array_join(F.slice(heads, j + 1, F.lit(reach + 1)), "$"))
        return F.concat(F.right(before, F.lit(reach)), F.left(after, F.lit(reach)))

    contexts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), around)
    spot = F.instr(col, "$")
    start = F.greatest(F.lit(1), spot - reach)
    only = ~F.contains(F.substring(col, spot + 1, F.length(col)), F.lit("$"))
    return (
        F.when(spot == 0, F.lit(""))
        .when(only, F.substring(col, start, spot - start + reach))
        .when(col.isNotNull(), F.array_join(contexts, " "))
    )


def seller_slug_guess(col: Column) -> Column:
    """A seller name as it would look as a slug."""
    return F.translate(F.lower(F.trim(col)), " _", "--")


def embedding_text(title: Column, summary: Column) -> Column:
    return F.concat(title, F.lit("\n"), summary)


def age_label(moment: Column, as_of: Column) -> Column:
    """Relative age: just now, minutes, hours or days."""
    seconds = F.greatest(
        F.lit(0),
        F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(moment.cast("timestamp")),
    ) / F.lit(1_000_000)

    def ago(unit_seconds: int, suffix: str) -> Column:
        return F.concat(F.floor(seconds / unit_seconds).cast("string"), F.lit(suffix))

    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, ago(60, "m ago"))
        .when(seconds < 86400, ago(3600, "h ago"))
        .when(seconds.isNotNull(), ago(86400, "d ago"))
    )
