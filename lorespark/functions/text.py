"""Text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"

# Words that keyword extraction passes over.
KEYWORD_STOP_WORDS = (
    "this", "that", "with", "from", "have", "will", "into", "over", "they", "them", "then",
    "than", "your", "which", "their", "there", "about", "would", "could", "should", "been",
    "were", "what", "when", "where",
)

# Parts of a question that ask for relations.
RELATIONAL_PARTS = ("related", "depend", "maintain", "connected", "between", "reference", "implement")

# Last words that mark an organisation.
ORGANISATION_WORDS = (
    "inc", "corp", "corporation", "llc", "ltd", "co", "company", "foundation", "institute", "university", "college",
    "lab", "labs", "group", "systems", "technologies", "industries", "ventures", "partners", "association",
    "consortium", "organization",
)

# Which parts of the words between two entities give which relation; the first that fits.
RELATION_PARTS = (
    ("created_by", ("created by", "authored by", "developed by", "written by", "built by", "made by")),
    ("depends_on", ("depend", "require", "needs")),
    ("implements", ("implement", "provides", "realizes")),
    ("references", ("reference", "uses", "calls", "cites", "invokes")),
)

# Parts of an intent that give its class; the first that fits.
INTENT_PARTS = (
    ("research", ("research", "paper", "論文", "report", "レポート")),
    ("coding", ("code", "implement", "function", "bug", "refactor", "コード", "関数", "実装")),
    ("translation", ("translate", "translation", "翻訳")),
)
QUESTION_PARTS = ("what", "why", "how", "explain", "なに", "なぜ", "どう", "説明")

# Content that the security check forbids.
FORBIDDEN = ("begin private key", "password=", "api_key=")


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def trim(text: Column) -> Column:
    """Takes white space of any kind off both ends; long runs of it inside are looked at once."""
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s+$", "")


def s_stem(word: Column) -> Column:
    """Plural-only stemming; a word that meets an exception is left alone."""
    n = F.char_length(word)
    without = F.substring(word, F.lit(1), n - 1)
    return (
        F.when(F.endswith(word, F.lit("ies")), F.when(word.rlike("(e|a)ies$"), word).otherwise(F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y"))))
        .when(F.endswith(word, F.lit("es")), F.when(word.rlike("(a|e|o)es$"), word).otherwise(without))
        .when(F.endswith(word, F.lit("s")), F.when(word.rlike("(u|s)s$"), word).otherwise(without))
        .otherwise(word)
    )


def tokens(text: Column) -> Column:
    """Retrieval tokens: lower case, letters and digits, stemmed, of two characters or more."""
    words = F.filter(F.split(F.lower(text), NOT_ALNUM + "+"), lambda w: w != "")
    return F.filter(F.transform(words, s_stem), lambda w: F.char_length(w) > 1)


def embedder_tokens(text: Column) -> Column:
    """Embedder tokens: more than one byte before they are lower-cased, not stemmed."""
    return F.transform(F.filter(F.split(text, NOT_ALNUM + "+"), lambda w: F.octet_length(w) > 1), lambda w: F.lower(w))


def trim_token(word: Column) -> Column:
    return F.regexp_replace(word, f"^{NOT_ALNUM}+|(?<!{NOT_ALNUM}){NOT_ALNUM}+$", "")


def sentences(text: Column) -> Column:
    """Sentences for extraction: split at . ! ? ; and line ends."""
    return F.filter(F.transform(F.split(text, r"[.!?\n;]"), trim), lambda s: s != "")


def entity_runs(sentence: Column, leading_stop_words: frozenset[str]) -> Column:
    """(entity, gap) of a sentence: its runs of capitalised words, and the lower-cased words since the one before.

    Words that name nothing are dropped from the head of a run; a run of such words alone
    is no entity and no gap. Words hold no white space, so kinds of white space mark the
    pieces: a line end opens a run, a tab closes it, a carriage return is in front of a
    word that names nothing, and a form feed ends each other word.
    """

    def marked(word: Column) -> Column:
        capital = (F.char_length(word) > 1) & word.rlike(r"^\p{IsUppercase}")
        head = F.when(word.isin(*sorted(leading_stop_words)), F.lit("\n\r")).otherwise(F.lit("\n"))
        return F.when(capital, F.concat(head, word, F.lit("\t"))).otherwise(F.concat(word, F.lit("\f")))

    def pieces(line: Column) -> Column:
        """Of each run, what is before it and the run; what follows the last run has no line end."""
        runs = F.filter(F.split(line, "\t"), lambda p: F.contains(p, F.lit("\n")))
        return F.transform(runs, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("before"), F.substring_index(p, "\n", -1).alias("run")))

    def named(piece: Column) -> Column:
        return F.struct(piece["before"].alias("before"), F.regexp_extract(piece["run"], r"(?s)(?:^| )([^\r ].*)$", 1).alias("run"))

    words = F.transform(F.split(sentence, r"(?U)\s+"), trim_token)
    line = F.replace(F.array_join(F.transform(words, marked), ""), F.lit("\t\n"), F.lit(" "))
    # pieces without a name are joined with the next one's, by writing the line anew
    whole = F.transform(F.transform(pieces(line), named), lambda p: F.concat(p["before"], F.when(p["run"] != "", F.concat(F.lit("\n"), p["run"], F.lit("\t"))).otherwise(F.lit(""))))
    gap = lambda before: F.lower(F.array_join(F.filter(F.split(before, "\f"), lambda w: w != ""), " "))
    return F.transform(
        pieces(F.array_join(whole, "")),
        lambda p, i: F.struct(F.translate(p["run"], "\r", "").alias("entity"), F.when(i == 0, F.lit("")).otherwise(gap(p["before"])).alias("gap")),
    )


def chunk_sentences(text: Column) -> Column:
    """Sentences for chunking: the terminator stays; line ends don't part."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?。]*[.!?。]|[^.!?。]+$"), F.lit(0)), trim), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), trim), lambda p: p != "")


def fixed_chunks(text: Column, size: int) -> Column:
    """Windows of ``size`` characters, untrimmed; blank ones are left out."""
    n = F.char_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))), lambda c: trim(c) != "")


def with_overlap(chunks: Column, overlap: int) -> Column:
    """Each chunk after the first gets the end of the one before it, and a blank, in front."""
    return F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.right(F.element_at(chunks, F.greatest(i, F.lit(1)).cast("int")), F.lit(overlap)), F.lit(" "), c)))


def summarize(text: Column, size: int) -> Column:
    """A text of at most ``size`` characters as it is; else its head, cut after the last terminator if that keeps half."""

    def short(whole: Column) -> Column:
        head = F.substring(whole, F.lit(1), F.lit(size))
        last = F.char_length(F.regexp_extract(head, r"(?s)^.*[.!?。]", 0))
        cut = F.when((last > 0) & (last >= size // 2), last).otherwise(F.lit(size))
        return F.when(F.char_length(whole) <= size, whole).otherwise(F.concat(F.regexp_replace(F.substring(head, F.lit(1), cut), r"(?U)\s+$", ""), F.lit("…")))

    return F.get(F.transform(F.array(trim(text)), short), F.lit(0))  # a long text is trimmed once


def keyword_words(text: Column) -> Column:
    """Words that count as keywords: four bytes or more in lower case, no stop word."""
    words = F.transform(F.split(text, NOT_ALNUM), lambda w: F.lower(w))
    return F.filter(words, lambda w: (F.octet_length(w) >= 4) & ~w.isin(*KEYWORD_STOP_WORDS))


def max_hops(question: Column) -> Column:
    return F.when(contains_any(F.lower(question), RELATIONAL_PARTS), 2).otherwise(1)


def classify_label(label: Column) -> Column:
    words = F.split(trim(label), r"(?U)\s+")
    return F.when(F.lower(trim_token(F.element_at(words, -1))).isin(*ORGANISATION_WORDS), F.lit("organization")).otherwise(F.lit("concept"))


def relation_for(gap: Column) -> Column:
    out = F.lit("related_to")
    for kind, parts in reversed(RELATION_PARTS):
        out = F.when(contains_any(gap, parts), F.lit(kind)).otherwise(out)
    return out


def classify_intent(intent: Column) -> Column:
    low = F.lower(intent)
    out = F.when(F.endswith(trim(intent), F.lit("?")) | contains_any(low, QUESTION_PARTS), F.lit("question")).otherwise(F.lit("generic"))
    for kind, parts in reversed(INTENT_PARTS):
        out = F.when(contains_any(low, parts), F.lit(kind)).otherwise(out)
    return out


def snippet(body: Column) -> Column:
    return F.substring(body, 1, 80)


def permits(granted: Column, required: Column) -> Column:
    """A grant permits what it equals, or what starts with it if it ends with a star."""
    return (granted == required) | (F.endswith(granted, F.lit("*")) & F.startswith(required, F.regexp_replace(granted, r"\*$", "")))
