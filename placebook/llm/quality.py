"""Quality rules: how far a document's characters and common words are from what is usual in its language.

Two histograms of a document, over classes of characters and over common words, are compared with those of all
documents in the same language by the Jensen-Shannon distance. A short text strays from any distribution by chance, so
the divergence that its length alone explains is taken off, and texts below a least length are not judged at all.
Everything is expressions on columns; only the references, a few numbers for each known language, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Base rules: a text of fewer words fails, and one whose repeated words exceed this share, in hundredths.
LEAST_WORDS = 10
MOST_REPEATED = 20

# The distance beyond which a text is rejected, and the words from which it is judged.
MOST_DISTANCE = 0.26
JUDGED_WORDS = 50

# Common words of each known language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it with as was on are be this by from at or an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como".split(),
}

# Classes of characters in the order in which they are taken out of a text; what is left is the last class.
CHARACTER_CLASSES = [r"\p{Ll}+", r"\p{Lu}+", r"\p{L}+", r"\p{N}+", r"[\x20\x09-\x0D]+", r"[.,;:?!'\x22()\-]+"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The runs of characters that are not ASCII white space; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that the text has twice or more.

    Windows are told apart by 64 bits. Sorted by them, equal ones are neighbours; between two repeated windows in the
    order of the text, the first adds its words up to the second's start.
    """

    def hashes(found: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(found) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(WINDOW)]))

    def places(marked: Column) -> Column:
        alike = lambda e, other: F.coalesce(other.getField("h") == e.getField("h"), F.lit(False))
        twice = F.filter(marked, lambda e, i: alike(e, F.get(marked, i - 1)) | alike(e, F.get(marked, i + 1)))
        return F.array_sort(F.transform(twice, lambda e: e.getField("i")))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def count(found: Column) -> Column:
        marked = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        all_apart = F.size(F.array_distinct(found)) == F.size(found)
        return F.when(all_apart, F.lit(0).cast("long")).otherwise(let(marked, lambda m: let(places(m), covered)))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes(words), count))


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.char_length(full) - F.char_length(F.regexp_replace(full, f"[{SYMBOLS}]+", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def character_counts(text: Column) -> Column:
    """The characters in each class, the last for all that are in none."""

    def taken(rest: Column, classes: list[str], counts: list[Column]) -> Column:
        if not classes:
            return F.array(*counts, F.char_length(rest).cast("long"))
        less = F.regexp_replace(rest, classes[0], "")
        return let(less, lambda left: taken(left, classes[1:], [*counts, (F.char_length(rest) - F.char_length(left)).cast("long")]))

    return taken(F.coalesce(text, F.lit("")), CHARACTER_CLASSES, [])


def common_only(words: Column) -> Column:
    """Those of the words that are common in any known language."""
    every = sorted({word for found in COMMON_WORDS.values() for word in found})
    return F.filter(words, lambda word: word.isin(every))


def word_counts(common: Column, n_words: Column, vocabulary: Column) -> Column:
    """The occurrences of each word of the vocabulary, and of all others last."""
    counts = F.transform(vocabulary, lambda word: (F.size(common) - F.size(F.array_remove(common, word))).cast("long"))
    known = lambda found: F.aggregate(found, F.lit(0).cast("long"), lambda total, n: total + n)
    return let(counts, lambda found: F.concat(found, F.array(n_words.cast("long") - known(found))))


def distance(counts: Column, reference: Column) -> Column:
    """The Jensen-Shannon distance (base 2) of counts from a reference's shares, less what the number of counted things
    explains: a sample of n in k classes has a divergence of about (k - 1) / (8 n ln 2) by chance.
    """

    def part(share: Column, other: Column) -> Column:
        return F.when(share > 0, share / 2 * F.log2(share / ((share + other) / 2))).otherwise(F.lit(0.0))

    def of_total(total: Column) -> Column:
        shares = F.zip_with(counts, reference, lambda n, q: part(n / total, q) + part(q, n / total))
        divergence = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x)
        chance = (F.size(counts) - 1) / (total * (8 * math.log(2)))
        return F.sqrt(F.greatest(F.lit(0.0), divergence - chance))

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n).cast("double")
    return let(total, lambda n: F.when(n > 0, of_total(n)).otherwise(F.lit(0.0)))


def vocabulary_of(lang: Column) -> Column:
    chosen = F.lit(None).cast("array<string>")
    for name, words in COMMON_WORDS.items():
        chosen = F.when(lang == name, F.array(*map(F.lit, words))).otherwise(chosen)
    return chosen


def references(docs: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each known language the shares of character classes and of common words over all its documents. A language
    that no document has, or only empty ones, has no reference.
    """
    texts = docs.where(F.col("lang").isin(list(COMMON_WORDS))).select("lang", "text")
    found = texts.select("lang", "text", words_of(F.col("text")).alias("words"))
    bins = found.select("lang", character_counts(F.col("text")).alias("c"), word_counts_of_language().alias("w"))
    sums = []
    for name, size in (("c", len(CHARACTER_CLASSES) + 1), ("w", max(map(len, COMMON_WORDS.values())) + 1)):
        sums.append(F.array(*[F.coalesce(F.sum(F.get(F.col(name), F.lit(i))), F.lit(0)) for i in range(size)]).alias(name))
    rows = bins.groupBy("lang").agg(*sums).agg(F.collect_list(F.struct("lang", "c", "w"))).first()[0]
    shares = lambda counts: [n / (sum(counts) or 1) for n in counts]
    return {row.lang: (shares(row.c), shares(row.w[: len(COMMON_WORDS[row.lang]) + 1])) for row in rows if sum(row.w)}


def word_counts_of_language() -> Column:
    vocabulary = vocabulary_of(F.col("lang"))
    return let(common_only(F.col("words")), lambda common: word_counts(common, F.size("words"), vocabulary))


def judge(docs: DataFrame, found: dict[str, tuple[list[float], list[float]]] | None = None) -> DataFrame:
    """`docs` with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, which
    replace any of the same names. Needs text and lang; every row stays, repeated rows included.

    A text is kept if it passes the base rules and is near the reference of some known language in both histograms; its
    own language is tried first. Texts of fewer than JUDGED_WORDS words, and all texts where there is no reference, are
    judged by the base rules alone. A null text has no words and fails. `found` are references of another corpus;
    without them those of these documents are taken.
    """
    found = references(docs) if found is None else found
    numbers = lambda values: F.array(*map(F.lit, values))
    entries = []
    for lang in sorted(found):
        characters, words = found[lang]
        vocabulary = F.array(*map(F.lit, COMMON_WORDS[lang]))
        entries.append(F.struct(F.lit(lang).alias("l"), vocabulary.alias("v"), numbers(characters).alias("c"), numbers(words).alias("w")))

    text, lang = F.col("text"), F.coalesce(F.col("lang"), F.lit(""))

    def fits(common: Column, characters: Column, n_words: Column) -> Column:
        known = F.array(*entries)
        first = F.concat(F.filter(known, lambda r: r.getField("l") == lang), F.filter(known, lambda r: r.getField("l") != lang))

        def to(r: Column) -> Column:
            words = word_counts(common, n_words, r.getField("v"))
            return (distance(characters, r.getField("c")) <= MOST_DISTANCE) & (let(words, lambda w: distance(w, r.getField("w"))) <= MOST_DISTANCE)

        return F.exists(first, to)

    def of_words(words: Column) -> Column:
        def of_base(base: Column) -> Column:
            n_words = base.getField("n_words")
            failed = (n_words < LEAST_WORDS) | (100 * base.getField("n_repeat_words") > MOST_REPEATED * n_words)
            near = let(common_only(words), lambda w: let(character_counts(text), lambda c: fits(w, c, n_words))) if entries else F.lit(True)
            kept = F.when(failed, False).when(n_words < JUDGED_WORDS, True).otherwise(near)
            return F.struct(*[base.getField(name).alias(name) for name in names], failed.alias("base_failed"), kept.alias("kept"))

        columns = base_columns(text, words)
        names = list(columns)
        return let(F.struct(*[column.alias(name) for name, column in columns.items()]), of_base)

    # One expression, computed once for a row also where a filter on the verdict is moved before it.
    judged = docs.withColumn("_verdict", let(words_of(text), of_words))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.withColumns({name: F.col("_verdict")[name] for name in names}).drop("_verdict")


def keep_good(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that are not kept, columns as they were."""
    whole = docs.select("text", "lang", F.struct("*").alias("_all"))
    return judge(whole).where("kept").select("_all.*")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + str(value).replace("'", "''") + "'" for value in values) + "]"


def _oracle() -> str:
    classes = [p[:-1] for p in CHARACTER_CLASSES]
    rest = "coalesce(text, '')"
    counts = []
    for pattern in (p.replace(r"\x22", '"') for p in classes):
        less = f"regexp_replace({rest}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
        counts.append(f"length({rest}) - length({less})")
        rest = less
    character = "[" + ", ".join([*counts, f"length({rest})"]) + "]"
    languages = "\n  union all ".join(f"select '{lang}' as ref, {_sql_list(words)} as voc" for lang, words in COMMON_WORDS.items())

    def distance_sql(counts: str, shares: str) -> str:
        total = f"list_sum({counts})"
        p, q = f"({counts}[i] / {total}::double)", f"{shares}[i]"
        part = lambda a, b: f"case when {a} > 0 then {a} / 2 * log2({a} / (({a} + {b}) / 2)) else 0 end"
        divergence = f"list_sum(list_transform(range(1, len({counts}) + 1), lambda i: {part(p, q)} + {part(q, p)}))"
        return f"case when {total} > 0 then sqrt(greatest(0, {divergence} - (len({counts}) - 1) / ({total} * {8 * math.log(2)!r}))) else 0 end"

    return rf"""
with languages as (
  {languages}
), split as (
  select row_number() over () as r, doc_id, text, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as filled
  from documents
), windows as (
  select r, i, [words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]] as w
  from (select r, words, unnest(range(1, len(words) - 3)) as i from split where len(words) >= 5)
), twice as (
  select r, i from windows where (r, w) in (select (r, w) from windows group by r, w having count(*) > 1)
), covered as (
  select r, count(distinct i + k) as n from twice, range(0, 5) as t(k) group by r
), base as (
  select split.r, doc_id, text, lang, words, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols,
         len(filled) - len(list_distinct(filled)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, {character} as chars
  from split left join covered using (r)
), counted as (
  select r, ref, lang, n_words, chars, list_transform(voc, lambda v: len(list_filter(words, lambda w: w = v))) as known from base, languages
), bins as (
  select r, ref, lang, chars, list_concat(known, [n_words - list_sum(known)]) as wbins from counted
), places as (
  select ref, i, sum(wbins[i]) as n from (select ref, wbins, unnest(range(1, len(wbins) + 1)) as i from bins where lang = ref) group by ref, i
), wshares as (
  select ref, list(n / total order by i) as w from (select ref, i, n, sum(n) over (partition by ref)::double as total from places) where total > 0 group by ref
), cplaces as (
  select ref, i, sum(chars[i]) as n from (select ref, chars, unnest(range(1, len(chars) + 1)) as i from bins where lang = ref) group by ref, i
), cshares as (
  select ref, list(n / total order by i) as c from (select ref, i, n, sum(n) over (partition by ref)::double as total from cplaces) where total > 0 group by ref
), refs as (
  select * from wshares join cshares using (ref)
), fitting as (
  select distinct r from bins join refs using (ref)
  where {distance_sql("chars", "c")} <= {MOST_DISTANCE} and {distance_sql("wbins", "w")} <= {MOST_DISTANCE}
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
       not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words)
         and (n_words < {JUDGED_WORDS} or r in (select r from fitting) or not exists (select 1 from refs)) as kept
from base
"""


ORACLE = _oracle()
