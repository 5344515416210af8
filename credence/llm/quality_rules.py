"""Line-first quality rules.

Every line is judged by three rules - punctuation, navigation and boilerplate -
and failing lines are removed; a document that loses too large a share of its
text that way is rejected. Only built-in expressions are used and nothing is
shuffled: each row is judged from its own text.

A line fails by punctuation if `MIN_PLAIN_WORDS` words or more follow its last
sentence end (a mark at the end of a word, or after it only closing quotes and
brackets), or if signs outnumber half of its words; by navigation, if separators
do a third of them; as boilerplate, if it has a stock phrase of one of four
languages or shouts.

Defined results for unusual input: a null or empty text has no words and fails
the base rules; a very long text is judged whole; a document with a null id is
judged like any other; repeated rows give repeated rows; an empty table gives an
empty result; columns other than the id and the text pass through `clean`
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES, let, occurrences, words

SYMBOLS = "#*$%&|<>"
#: Fixed values of the line rules.
SEPARATORS = "|»›•·→"
NOISE = "#*$%&<>^~={}!"
SENTENCES = r"""(?s)^.*(?:[.!?…]["'”’»)\]]*(?:[\x20\x09-\x0D]|\z)|[。！？])"""
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "click here", "sign up", "log in", "login", "lorem ipsum", "read more", "share this", "skip to content",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "javascript aktivieren", "hier klicken", "jetzt registrieren", "mehr lesen", "zum inhalt springen",
    "todos los derechos reservados", "términos de uso", "condiciones de uso", "política de privacidad", "política de cookies", "aceptar cookies", "haz clic aquí", "haga clic aquí", "iniciar sesión", "leer más", "ir al contenido",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies", "activer javascript", "cliquez ici", "se connecter", "lire la suite", "aller au contenu",
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
MIN_PLAIN_WORDS = 8
MIN_SHOUT_WORDS = 5
_FEW = 64


def repeat_words(w: Column) -> Column:
    """Words of w that lie in a window of three words found twice or more in w.

    Windows are first told apart by hash; only a row with two equal hashes sorts windows themselves - those with such a hash where these are few - so the count is exact.
    """
    n = F.size(w)

    def hashed(a: Column) -> Column:
        return F.slice(F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2))), F.lit(1), F.size(a) - 2)

    def counted(a: Column, h: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(a) - 3)
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i + 1), F.lit(False)))))
        places = let(twice, lambda d: F.when(F.size(d) <= _FEW, F.filter(every, lambda i: F.array_contains(d, F.get(h, i)))).otherwise(every))
        pairs = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)).alias("g"), i.alias("p"))))

        def again(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["g"] == F.get(s, j)["g"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

        starts = let(pairs, again)
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x))

    whole = let(w, lambda a: let(hashed(a), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), counted(a, h)).otherwise(F.lit(0))))
    return F.when(n < 4, F.lit(0)).otherwise(whole).cast("long")


def _any_of(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def has_phrase(text: Column) -> Column:
    """Whether one of PHRASES is in text, in any case."""
    return let(F.lower(text), lambda low: _any_of(low, PHRASES))


def line_fails(line: Column, phrases: Column, separated: Column) -> Column:
    """Whether a line fails one of the three rules. Lines without a word pass. phrases and separated: whether the whole text has a phrase, or a separator; where it has none they are not sought in its lines."""
    n = F.size(words(line))

    def judged(k: Column) -> Column:
        letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
        capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
        after = F.size(words(F.regexp_replace(line, SENTENCES, "")))
        punctuation = ((k >= MIN_PLAIN_WORDS) & (after >= MIN_PLAIN_WORDS)) | (occurrences(line, NOISE) * 2 > k)
        navigation = separated & let(occurrences(line, SEPARATORS), lambda n: (n >= 2) & (n * 3 >= k))
        boilerplate = (phrases & has_phrase(line)) | ((k >= MIN_SHOUT_WORDS) & (capitals * 2 > letters))
        return (k > 0) & (punctuation | navigation | boilerplate)

    return let(n, judged)


def good_lines(text: Column, lines: Column) -> Column:
    """The lines of text that pass."""
    told = F.struct(has_phrase(text).alias("p"), _any_of(text, SEPARATORS).alias("s"))
    return let(told, lambda t: F.filter(lines, lambda x: ~line_fails(x, t["p"], t["s"])))


def _lost(solid: Column, lines: Column, good: Column) -> Column:
    """Characters of words that went with the lines that failed."""
    left = F.aggregate(good, F.lit(0).cast("long"), lambda s, x: s + F.length(F.translate(x, SPACES, "")))
    return F.when(F.size(good) == F.size(lines), F.lit(0).cast("long")).otherwise(solid - left)


def _solid(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the base counts, base_failed, word characters lost to the line rules, the cleaned text and the verdict."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col), text.alias("_text"), words(text).alias("_words"), F.split(text, "\n", -1).alias("_lines"))
    counted = base.select(
        id_col,
        "_text",
        F.size("_words").cast("long").alias("n_words"),
        _solid(F.col("_words")).alias("word_chars"),
        occurrences(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(F.filter("_lines", lambda x: x.rlike(f"[^{SPACE[1:-1]}]")), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        good_lines(F.col("_text"), F.col("_lines")).alias("_good"),
        "_lines",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lost = _lost(F.col("word_chars"), F.col("_lines"), F.col("_good"))
    return counted.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), lost.alias("lost_chars"), F.concat_ws("\n", "_good").alias("clean_text")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT))


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows that are kept, with the columns of df and the failing lines taken out of the text. A text of fewer than min_words words goes."""
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    text = F.coalesce(F.col("_t"), F.lit(""))
    w = words(text)
    staged = inner.select("_row", text.alias("_text"), w.alias("_w"), F.split(text, "\n", -1).alias("_lines"))
    staged = staged.select("_row", F.size("_w").alias("_n"), _solid(F.col("_w")).alias("_solid"), "_lines", repeat_words(F.col("_w")).alias("_r"), good_lines(F.col("_text"), F.col("_lines")).alias("_good"), F.monotonically_increasing_id().alias("_here"))
    # _here keeps the filters above it: pushed below, they would judge every line twice.
    staged = staged.filter((F.col("_n") >= min_words) & (F.col("_r") * 100 <= F.col("_n") * MAX_REPEAT_PERCENT))
    staged = staged.filter(_lost(F.col("_solid"), F.col("_lines"), F.col("_good")) * 100 <= F.col("_solid") * MAX_LOST_PERCENT)
    return staged.select(*[(F.concat_ws("\n", "_good") if c == text_col else F.col("_row")[c]).alias(c) for c in df.columns])
