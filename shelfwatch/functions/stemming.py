"""English word forms for search: a dictionary of stems, made once for a vocabulary.

The rules are those of the Porter2 stemmer (M. F. Porter, Snowball), in order, as
columns over the table of distinct words. A rule looks for the longest of its
endings and tells by length whether the ending lies in the region it must lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# English stop words of the text search configuration.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now""".split()
)

# Porter2 exceptions, suffix tables and letter classes.
_WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
_STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
)
_AFTER_VOWEL = "^.*?[aeiouy][^aeiouy]"  # up to the first vowel and the consonant after it
_SHORT_END = "^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$"


def _ending(endings) -> Column:
    """The longest of some endings that ``stem`` has, else an empty string."""
    return F.regexp_extract("stem", f"(?:{'|'.join(endings)})$", 0)


def _by(endings: dict[str, str]) -> Column:
    """What stands for ``ending``."""
    return F.create_map(*[F.lit(x) for pair in endings.items() for x in pair])[F.col("ending")]


def _rule(words: DataFrame, endings, stem: Column) -> DataFrame:
    """One rule: ``stem`` becomes the given column, which may use ``head`` and ``ending``.

    Without one of the endings, and where the column is null, it stays.
    """
    found = words.withColumn("ending", _ending(endings))
    found = found.withColumn("head", F.expr("substring(stem, 1, length(stem) - length(ending))"))
    kept = (F.col("ending") == "") | F.col("done")
    return found.withColumn("stem", F.when(kept, F.col("stem")).otherwise(F.coalesce(stem, F.col("stem"))))


def _reaches(region: str) -> Column:
    return F.length("head") >= F.col(region)


def _regions(words: DataFrame) -> DataFrame:
    """``stem`` with consonant y as Y, and where its two regions begin."""
    marked = F.regexp_replace(F.regexp_replace("word", "^y", "Y"), "([aeiouy])y", "$1Y")
    words = words.withColumn("stem", marked)
    first = F.length(F.regexp_extract("stem", f"^(?:gener|commun|arsen)|{_AFTER_VOWEL}", 0))
    words = words.withColumn("r1", F.when(first > 0, first).otherwise(F.length("stem")))
    second = F.length(F.regexp_extract(F.expr("substring(stem, r1 + 1)"), _AFTER_VOWEL, 0))
    return words.withColumn("r2", F.when(second > 0, F.col("r1") + second).otherwise(F.length("stem")))


def english_stems(words: DataFrame) -> DataFrame:
    """(word, stem) for the distinct lower-case words of ``words`` (word), stop words left out."""
    words = words.select("word").where(~F.col("word").isin(*sorted(STOP_WORDS))).distinct()
    fixed = F.create_map(*[F.lit(x) for pair in _WHOLE_WORDS.items() for x in pair])[F.col("word")]
    words = words.withColumn("fixed", F.when(F.length("word") <= 2, F.col("word")).otherwise(fixed))
    words = _regions(words).withColumn("done", F.col("fixed").isNotNull())
    head, ending, doubles = F.col("head"), F.col("ending"), "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"

    plural = (
        F.when(ending == "sses", F.concat(head, F.lit("ss")))
        .when(ending.isin("ied", "ies"), F.concat(head, F.when(F.length(head) > 1, "i").otherwise("ie")))
        .when((ending == "s") & F.expr("substring(head, 1, length(head) - 1)").rlike("[aeiouy]"), head)
    )
    words = _rule(words, ["sses", "ied", "ies", "us", "ss", "s"], plural)
    words = words.withColumn("done", F.col("done") | F.col("stem").isin(*sorted(_AFTER_PLURAL)))

    past = F.when(ending.startswith("eed"), F.when(_reaches("r1"), F.concat(head, F.lit("ee")))).when(
        head.rlike("[aeiouy]"),
        F.when(head.rlike("(?:at|bl|iz)$"), F.concat(head, F.lit("e")))
        .when(head.rlike(doubles), F.expr("substring(head, 1, length(head) - 1)"))
        .when(head.rlike(_SHORT_END) & (F.length(head) <= F.col("r1")), F.concat(head, F.lit("e")))
        .otherwise(head),
    )
    words = _rule(words, ["eed", "eedly", "ed", "edly", "ing", "ingly"], past)
    words = _rule(words, ["(?<=.[^aeiouy])[yY]"], F.concat(head, F.lit("i")))

    fits = F.when(ending == "ogi", head.endswith("l")).when(ending == "li", head.rlike("[cdeghkmnrt]$")).otherwise(True)
    words = _rule(words, _STEP_2, F.when(_reaches("r1") & fits, F.concat(head, _by(_STEP_2))))
    region = F.when(ending == "ative", F.col("r2")).otherwise(F.col("r1"))
    words = _rule(words, _STEP_3, F.when(F.length(head) >= region, F.concat(head, _by(_STEP_3))))
    words = _rule(words, _STEP_4, F.when(_reaches("r2") & ((ending != "ion") | head.rlike("[st]$")), head))

    last = F.when(ending == "e", F.when(_reaches("r2") | (_reaches("r1") & ~head.rlike(_SHORT_END)), head))
    last = last.when(_reaches("r2") & head.endswith("l"), head)
    words = _rule(words, ["e", "l"], last)
    return words.select("word", F.coalesce("fixed", F.translate("stem", "Y", "y")).alias("stem"))
