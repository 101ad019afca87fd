"""Ids, moments, trims and small codes of records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
PERMANENT = (
    "account associated with this video has been terminated", "members-only",
)
TAGS = {"talk": "", "article": "p", "chapter": "b"}


def kind_of_id(doc_id: Column) -> Column:
    """article for w- ids, chapter for ids with a double underscore that are not
    eleven signs long, else talk."""
    return F.when(doc_id.startswith("w-"), "article").when(
        doc_id.contains("__") & (F.length(doc_id) != 11), "chapter"
    ).otherwise("talk")


def moment_start(kind: Column, position: Column) -> Column:
    """Start of the moment that holds a position: milliseconds of a talk go to
    the minute (in seconds), paragraphs to threes, chapter positions to the page."""
    return (
        F.when(kind == "talk", F.floor(position / 60000) * 60)
        .when(kind == "article", F.floor((position - 1) / 3) * 3 + 1).otherwise(F.floor(position / 1000))
    )


def moment_id(doc_id: Column, position: Column) -> Column:
    """Id of the moment; null without a position."""
    kind = kind_of_id(doc_id)
    tag = F.when(kind == "article", "p").when(kind == "chapter", "b").otherwise("")
    return F.when(position >= 0, F.format_string("%s_%s%05d", doc_id, tag, moment_start(kind, position)))


def parse_moment(moment: Column) -> Column:
    """Struct of document and start; the start follows the last underscore."""
    pattern = "^(.*)_([pb]?)([0-9]+)$"
    return F.when(moment.rlike(pattern), F.struct(
        F.regexp_extract(moment, pattern, 1).alias("doc_id"), F.regexp_extract(moment, pattern, 3).try_cast("long").alias("start")
    ))


def trimmed(text: Column, most: int) -> Column:
    """The first words of a text, with an ellipsis if more follow."""
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(words, 1, most), " "), F.when(F.size(words) > most, F.lit(" …")).otherwise(F.lit("")))


def wrapped(item_id: Column, quote: Column) -> Column:
    """A quote as untrusted text; it cannot close the wrapper itself."""
    safe = F.replace(F.coalesce(quote, F.lit("")), F.lit("</untrusted_source>"), F.lit(""))
    return F.concat(F.lit('<untrusted_source item_id="'), item_id, F.lit('">'), safe, F.lit("</untrusted_source>"))


def version_key(version: Column) -> Column:
    """Comparable array of numbers of a dotted version."""
    return F.transform(F.split(F.coalesce(version, F.lit("")), r"[^0-9]+"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait: a number, or the time until an HTTP date, not below 0;
    null for anything else. The session's time zone is taken to be UTC."""
    v = F.trim(value)
    when = F.try_to_timestamp(F.regexp_extract(v, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return F.when(v.rlike(r"^\d+$"), v.try_cast("double")).when(
        when.isNotNull(), F.greatest(F.lit(0.0), (F.unix_timestamp(when) - F.unix_timestamp(now)).cast("double"))
    )


def permanent_failure(message: Column, known: tuple = PERMANENT) -> Column:
    """The first known text of a lasting failure in the message, or null."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.coalesce(*[F.when(low.contains(k.lower()), F.lit(k)) for k in known])


def gap_question(line: Column) -> Column:
    """Struct of question and domain of a line "question | domain"; null for blank
    lines, comments and lines without a question."""
    t = F.trim(F.coalesce(line, F.lit("")))
    question = F.trim(F.regexp_extract(t, r"^([^|]*)", 1))
    return F.when(
        ~t.startswith("#") & (question != ""),
        F.struct(question.alias("question"), F.trim(F.regexp_extract(t, r"^[^|]*\|(.*)$", 1)).alias("domain")),
    )


def pick_track(human: Column, automatic: Column) -> Column:
    """Struct of kind and code: plain en, else the shortest English code, then by
    letters; else the original automatic track; else null."""
    english = F.array_sort(F.transform(
        F.filter(human, lambda k: F.element_at(F.split(F.lower(k), "[-_]"), 1) == "en"),
        lambda k: F.struct((k != "en").alias("a"), F.length(k).alias("b"), k.alias("c")),
    ))
    return F.when(F.size(english) > 0, F.struct(F.lit("human").alias("kind"), F.get(english, F.lit(0))["c"].alias("code"))).when(
        F.array_contains(automatic, "en-orig"), F.struct(F.lit("auto").alias("kind"), F.lit("en-orig").alias("code"))
    )


def content_words(text: Column, stop: list[str]) -> Column:
    """Distinct words of three or more signs without the given ones."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0)))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(F.array(*map(F.lit, stop)), w))


def word_overlap(question: Column, source: Column, stop: list[str]) -> Column:
    """Share of the question's content words the source has; 1 without any."""
    q = content_words(question, stop)
    return F.when(F.size(q) == 0, 1.0).otherwise(F.size(F.array_intersect(q, content_words(source, stop))) / F.size(q))


def hash_share(seed: str, key: Column) -> Column:
    """Place of a key in [0, 1] by its seeded hash, for splits that never move."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("double") / 4294967295.0


EMBED_DIM = 64


def hash_embedding(text: Column) -> Column:
    """Deterministic unit vector of a text's words by their md5, for use where no
    model is at hand; the zero vector for a wordless text."""
    words = F.filter(F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"(?U)\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, "^[.,?!'\"]+|[.,?!'\"]+$", ""))
    # the remainder by 64 of a 128-bit number is that of its last byte
    place = F.transform(bare, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 31, 2), 16, 10).cast("int") % EMBED_DIM)

    def once(value: Column, use) -> Column:
        """``use(value)`` with the value worked out a single time."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def counted(places: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(EMBED_DIM - 1)), lambda d: F.size(F.filter(places, lambda p: p == d)).cast("double"))

    def scaled(counts: Column) -> Column:
        return once(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(
            counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float")
        ))

    return once(once(place, counted), scaled)


def majority_of_trials(outcomes: Column, once: Column, trials: int = 3) -> Column:
    """Result of repeated runs: the first one where it decides alone or passed, else
    the majority of up to ``trials``; null while it is open."""
    need = trials // 2 + 1
    seen = F.slice(outcomes, 1, trials)
    good, bad = F.size(F.filter(seen, lambda o: o)), F.size(F.filter(seen, lambda o: ~o))
    return F.when(F.size(outcomes) == 0, None).when(once | F.element_at(outcomes, 1), F.element_at(outcomes, 1)).when(good >= need, True).when(bad >= need, False)


def claim_supported(first: Column, second: Column, third: Column) -> Column:
    """Two judges agree, or the third decides; without a third a split is no support."""
    b = F.coalesce(second, F.lit(False))
    return F.when(first == b, first & b).otherwise(F.coalesce(third, F.lit(False)))


def parts_reached(expected: Column, searches: Column) -> Column:
    """How many parts (arrays of domains) a search named a domain of; a search
    without domains covers all."""
    return F.size(F.filter(expected, lambda want: F.exists(
        searches, lambda c: (F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0) | F.coalesce(F.arrays_overlap(c, want), F.lit(False))
    )))


def as_of_date(line: Column) -> Column:
    """Date of a line that says as of when it is: m/d/yyyy, yyyy-mm-dd or Mon-d-yyyy."""
    said = F.lower(line).rlike("as of|downloaded|date|positions for")
    found = F.coalesce(
        F.try_to_date(F.nullif(F.regexp_extract(line, r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1), F.lit("")), "M/d/yyyy"),
        F.try_to_date(F.nullif(F.regexp_extract(line, r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit("")), "yyyy-MM-dd"),
        F.try_to_date(F.nullif(F.regexp_extract(line, r"\b([A-Z][a-z]{2}-\d{1,2}-\d{4})\b", 1), F.lit("")), "MMM-d-yyyy"),
    )
    return F.when(said, found)


def uncited(answer: Column, seen: Column) -> Column:
    """Links and book pages an answer cites that no result had (text fragments of a
    link do not count)."""
    links = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1)))
    pages = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"PDF p\. (\d+)"), F.lit(1)))
    known = F.array_union(F.regexp_extract_all(seen, F.lit(r", PDF p\. (\d+)"), F.lit(1)), F.regexp_extract_all(seen, F.lit(r'"page"\s*:\s*(\d+)'), F.lit(1)))
    return F.concat(
        F.filter(links, lambda u: ~F.contains(seen, u) & ~F.contains(seen, F.element_at(F.split(u, "#:~:text="), 1))),
        F.transform(F.array_except(pages, known), lambda p: F.concat(F.lit("PDF p. "), p)),
    )
