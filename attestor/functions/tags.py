"""Sentence-class tags over text columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V
from . import text as X


def looks_like_question(text: Column) -> Column:
    return X.let(X.fold_for_markers(text), _asks)


def _asks(folded: Column) -> Column:
    """The form that ends as a question is tried from every letter, so only where its ending stands at all."""
    return _either(folded, V.QUESTION_WITHOUT_ENDING, V.QUESTION_LATIN) | (folded.rlike(V.QUESTION_END) & folded.rlike(V.QUESTION))


def _either(folded: Column, pattern: str, latin: str) -> Column:
    """``pattern``, of which a text without Arabic letters can match ``latin`` only."""
    return F.when(folded.rlike(V.ARABIC_LETTER), folded.rlike(pattern)).otherwise(folded.rlike(latin))


def is_personal_case(text: Column) -> Column:
    return X.let(X.fold_for_markers(text), lambda f: _either(f, V.PERSONAL, V.PERSONAL_LATIN))


def is_fabrication_request(text: Column) -> Column:
    return X.fold_for_markers(text).rlike(V.REQUEST)


def asked_of_the_tool(question: Column) -> Column:
    """``question`` in the folded spelling: asks for a ruling, or is about the subject at all."""
    return F.trim(question).rlike("^" + V.RULING_QUESTION) | question.contains("حكم") | question.rlike(V.RULING_WORD) | _either(question, V.TOPIC, V.TOPIC_LATIN)


def attributes_to_canon(text: Column) -> Column:
    return X.normalize_arabic(text).rlike(V.ATTRIBUTION) | text.rlike(V.ATTRIBUTION_EN)


def mentions_person(text: Column) -> Column:
    return text.contains("ﷺ") | X.normalize_arabic(text).rlike(V.MENTIONS_PERSON) | text.rlike(V.MENTIONS_PERSON_EN)


def presents_a_quotation(text: Column) -> Column:
    return X.normalize_arabic(text).rlike(V.PRESENTS)


def plain_words(text: Column, norm: Column | None = None) -> Column:
    """Space-separated normal words; Latin text falls back to lower case without punctuation. ``norm``: the normal form, if at hand."""
    arabic = X.normalize_arabic(text) if norm is None else norm
    latin = X.squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "))
    return X.let(arabic, lambda a: F.when(a != "", a).otherwise(latin))


def asks_authenticity(text: Column, norm: Column | None = None) -> Column:
    def asks(w: Column) -> Column:
        short = (w != "") & (F.size(F.split(w, " ")) <= 9) & ~w.rlike(V.RULING_MENTION)
        return short & w.rlike(V.POINTS_AT_TEXT) & (w.rlike(V.AUTHENTICITY) | w.rlike(V.IS_THIS_TEXT))

    return X.let(plain_words(text, norm), asks)


def names_someone(name: Column) -> Column:
    return X.let(X.normalize_arabic(name), _names)


def _names(norm: Column) -> Column:
    return (norm != "") & ~norm.rlike(V.VAGUE_NAME)


def named_in(name: Column, text: Column) -> Column:
    """Every distinctive word of the name begins a word of the text."""
    noise = F.array(*[F.lit(w) for w in V.NAME_NOISE])
    wanted = F.filter(X.tokens(name, "arabic"), lambda w: ~F.array_contains(noise, w))
    hay = F.concat(F.lit(" "), X.normalize_arabic(text), F.lit(" "))
    return (F.size(wanted) > 0) & F.forall(wanted, lambda w: hay.contains(F.concat(F.lit(" "), w)))


def tag_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All single-text tags in one narrow pass; the folded and the normal form are made once per text."""
    t = F.col(text_col)

    def tags(x: Column) -> Column:
        folded, norm = x["folded"], x["norm"]
        return F.struct(
            _asks(folded).alias("is_question"),
            _either(folded, V.PERSONAL, V.PERSONAL_LATIN).alias("is_personal_case"),
            folded.rlike(V.REQUEST).alias("is_fabrication_request"),
            asked_of_the_tool(folded).alias("asked_of_the_tool"),
            (norm.rlike(V.ATTRIBUTION) | t.rlike(V.ATTRIBUTION_EN)).alias("attributes_to_canon"),
            (t.contains("ﷺ") | norm.rlike(V.MENTIONS_PERSON) | t.rlike(V.MENTIONS_PERSON_EN)).alias("mentions_person"),
            norm.rlike(V.PRESENTS).alias("presents_a_quotation"),
            asks_authenticity(t, norm).alias("asks_authenticity"),
            _names(norm).alias("names_someone"),
        )

    forms = F.struct(X.fold_for_markers(t).alias("folded"), X.normalize_arabic(t).alias("norm"))
    tagged = df.select("*", F.explode(F.array(X.let(forms, tags))).alias("tags"))
    return tagged.select(*df.columns, "tags.*")


# A catalogue of Latin-script tags for the driver's tables, same mechanism.
_ALONE = r"(?i)(?:^|[\s.,])(?:{})(?:[\s.,]|$)"
LATIN_TAGS = {
    "asks": _ALONE.format("what|how|why|who|was|wie|warum|que|qui|comment"),
    "negates": _ALONE.format("not|no|nicht|pas|non"),
    "names_license": r"(?i)licen[sc]e|copyright",
    "has_contact": r"[a-z.]+@[a-z.]+",
    "reports_speech": _ALONE.format("that|dass|que"),
}


def tag_by_catalogue(df: DataFrame, catalogue: dict[str, str], text_col: str = "text") -> DataFrame:
    return df.withColumns({name: F.col(text_col).rlike(pattern) for name, pattern in catalogue.items()})
