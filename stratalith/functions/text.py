"""Column functions over identifiers, titles, tags and running text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values -------------------------------------------------------------------------------------------------
#: Letters of the transliteration alphabet, and the apostrophe.
TRANSLIT = "abcdefghijklmnopqrstuvwxyzāīūṛṝḷḹṅñṭḍṇśṣḥṃ'"
#: Punctuation stripped from the edges of words; the second set is that of the plain tokenizer.
EDGES = '/|.,;:()[]{}"'
EDGES_PLAIN = "-/|.,;:()[]{}\"'"
#: Pronoun lemmas.
PRONOUNS = ("tad", "idam", "etad", "adas", "kim", "yad", "asmad", "yuṣmad", "mad", "tvad", "sva", "bhavat", "ena", "ka", "ya", "sa", "enad")
#: Lemmas of verbs of saying.
SPEAKING = ("vac", "brū", "ah", "vad", "abhidhā")
#: Part-of-speech symbols, with the marks of a segment's begin and end.
SYMBOLS = ("BOL", "EOL", "NOUN", "PRON", "VFIN", "PART", "CONV", "INF", "GDV", "CPD", "INDC", "X")
#: Commentary levels by keyword of a title; the first that occurs counts.
LEVELS = (
    (2, "anutika"), (2, "tika"), (2, "vyakhya"), (2, "panjika"), (2, "vivarana"), (2, "vivrti"), (2, "dipika"), (2, "kaumudi"),
    (1, "bhasya"), (1, "varttika"), (1, "vartika"), (1, "vrtti"),
    (0, "karika"), (0, "sutra"),
)
#: What a section header contains.
HEADER = r"(?iu)paṭala|yogasthāna|\(Chapter|\(Book|bhūmiḥ"
# -------------------------------------------------------------------------------------------------------------------


def text_id(segment: Column) -> Column:
    """Segment id without its last part; unchanged without a colon."""
    return F.regexp_replace(segment, ":[^:]*$", "")


def line_no(segment: Column) -> Column:
    """Last part of a segment id as a number; null if it is none."""
    return F.when(F.instr(segment, ":") > 0, F.substring_index(segment, ":", -1).try_cast("int"))


def number(text: Column) -> Column:
    """Number with thousands commas; null for a blank or anything else."""
    return F.nullif(F.regexp_replace(F.trim(text), ",", ""), F.lit("")).try_cast("double")


def or_else(value: Column, default) -> Column:
    """Default for null, and for the empty string where the default is a string."""
    return F.coalesce(F.nullif(value, F.lit("")) if isinstance(default, str) else value, F.lit(default))


def collection(work: Column, whole: bool = True) -> Column:
    """Second part of an underscored id; without one the id itself, or the empty string."""
    parts = F.split(work, "_")
    return F.when(F.size(parts) > 1, parts[1]).otherwise(work if whole else F.lit(""))


def coarse_class(code: Column) -> Column:
    """Leading ASCII letters of a collection code; the code where there are none."""
    return F.coalesce(F.nullif(F.regexp_extract(code, "^([A-Za-z]+)", 1), F.lit("")), code)


def _stripped(word: Column, edges: str) -> Column:
    return F.lower(F.call_function("btrim", word, F.lit(edges)))


def pieces(text: Column) -> Column:
    """Array of what white space parts; null is empty."""
    return F.split(F.coalesce(text, F.lit("")), r"\s+")


def word(piece: Column, alphabet: str = TRANSLIT, edges: str = EDGES) -> Column:
    """The lower-cased piece without edge punctuation, where it is of the alphabet alone, with a letter; else null."""
    bare = _stripped(piece, edges)
    return F.when(bare.rlike(f"^[{alphabet}]*[{''.join(c for c in alphabet if c.isalpha())}][{alphabet}]*$"), bare)


def words(text: Column, alphabet: str = TRANSLIT, edges: str = EDGES) -> Column:
    """Array of lower-cased words of the alphabet alone, with a letter in each; edge punctuation goes first."""
    return F.filter(F.transform(pieces(text), lambda p: word(p, alphabet, edges)), lambda w: w.isNotNull())


def plain_words(text: Column, edges: str = EDGES_PLAIN) -> Column:
    """Array of lower-cased words without edge punctuation, hyphens and apostrophes."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: _stripped(w, edges)), lambda w: w != "")


def word_lengths(text: Column, edges: str = EDGES) -> Column:
    """struct(chars, words) of the words without a digit."""
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.call_function("btrim", w, F.lit(edges))), lambda w: (w != "") & ~w.rlike(r"\d"))
    return F.struct(F.aggregate(kept, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("chars"), F.size(kept).cast("long").alias("words"))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Lower case without combining marks (NFD)."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").lower())


@F.pandas_udf(StringType())
def deaccented(text: pd.Series) -> pd.Series:
    """Without combining marks (NFKD), case kept."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def letters(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-z]", "")


def unbracketed(text: Column) -> Column:
    """Without bracketed spans, parenthesised spans and bare numbers."""
    for pattern in (r"\[[^\]]*\]", r"\([^\)]*\)", r"\b\d+\b"):
        text = F.regexp_replace(text, pattern, "")
    return text


def without_parentheses(text: Column) -> Column:
    return F.regexp_replace(text, r"\([^)]*\)", " ")


def pos_class(lemma: Column, tag: Column) -> Column:
    """Part of speech of a token, by the first mark that its tag has."""
    tag = F.coalesce(tag, F.lit(""))
    marks = (("Compound", "CPD"), ("Person=", "VFIN"), ("VerbForm=Part", "PART"), ("VerbForm=Conv", "CONV"), ("VerbForm=Inf", "INF"), ("VerbForm=Gdv", "GDV"))
    found = F.when(F.contains(tag, F.lit(marks[0][0])), marks[0][1])
    for mark, symbol in marks[1:]:
        found = found.when(F.contains(tag, F.lit(mark)), symbol)
    found = found.when(F.contains(tag, F.lit("Case=")), F.when(F.coalesce(lemma.isin(*PRONOUNS), F.lit(False)), "PRON").otherwise("NOUN"))
    return found.when(F.trim(tag).isin("", "_"), "INDC").otherwise("X")


def tag_features(tag: Column, aorists: tuple = ("aor",)) -> Column:
    """Array of the counted features of a tag: five keys with their values, formations folded, and Finite for a person."""
    parts = F.filter(F.transform(F.split(F.coalesce(tag, F.lit("")), ","), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit("=")))

    def feature(p):
        key, value = F.substring_index(p, "=", 1), F.substring(p, F.instr(p, "=") + 1, F.length(p))
        return F.when(key.isin("Tense", "Mood", "VerbForm", "Voice", "Case"), p).when(key == "Formation", F.when(value.isin(*aorists), "Formation=aor").otherwise(p)).when(key == "Person", "Finite")

    return F.filter(F.transform(parts, feature), lambda f: f.isNotNull())


def tag_flags(tag: Column, symbol: Column) -> Column:
    """struct of four conjunctions of marks: past participle, present optative, present subjunctive, indeclinable."""
    has = lambda m: F.contains(F.coalesce(tag, F.lit("")), F.lit(m))
    return F.struct(
        (has("VerbForm=Part") & has("Tense=Past")).alias("c_ppp"),
        (has("Tense=Present") & has("Mood=Optative")).alias("c_pres_opt"),
        (has("Tense=Present") & has("Mood=Sub")).alias("c_pres_subj"),
        (symbol == "INDC").alias("c_adverb_indc"),
    )


def commentary(folded_title: Column) -> Column:
    """struct(level, base): level of the first keyword in the title (null: none), and the title's letters without it."""
    level, base = F.lit(None).cast("int"), letters(folded_title)
    for n, word in reversed(LEVELS):
        hit = F.contains(folded_title, F.lit(word))
        level, base = F.when(hit, n).otherwise(level), F.when(hit, letters(F.replace(folded_title, F.lit(word), F.lit(" ")))).otherwise(base)
    return F.struct(level.alias("level"), base.alias("base"))


def is_header(text: Column, pattern: str = HEADER, shorter_than: int = 60) -> Column:
    return F.coalesce(text.rlike(pattern) & (F.length(text) < shorter_than), F.lit(False))


def captured_number(text: Column, pattern: str) -> Column:
    """First group of a pattern as a number; null where there is none."""
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def html_escaped(text: Column) -> Column:
    text = F.trim(F.coalesce(text, F.lit("")))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def search_index(*fields: Column) -> Column:
    """Fields that are not empty, joined and lower-cased; and once more without accents where that differs."""
    base = F.lower(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields]))
    plain = deaccented(base)
    return F.when(plain == base, base).otherwise(F.concat_ws(" ", base, plain))


def display_title(work: Column, *titles: Column) -> Column:
    """First title that is not blank, else the work; an "unknown: x" title reads "x (work)"."""
    title = F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in titles], work)
    after = F.trim(F.when(F.contains(title, F.lit(":")), F.substring(title, F.instr(title, ":") + 1, F.length(title))).otherwise(title))
    return F.when(F.startswith(F.lower(title), F.lit("unknown")), F.concat(after, F.lit(" ("), work, F.lit(")"))).otherwise(title)


def chunk_id(text: Column, k: Column) -> Column:
    return F.concat_ws("#", text, k)


def pair(a: Column, b: Column) -> Column:
    """struct(a, b) in order: the key of an undirected edge."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def bar(n: Column, mark: str = "#") -> Column:
    return F.repeat(F.lit(mark), n)


def padded(text: Column, width: int) -> Column:
    return F.rpad(F.substring(text, 1, width), width, " ")
