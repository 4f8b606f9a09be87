"""Native column functions over text: trimming, titles, sentences, tokens, names, truncation, lenient JSON."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions import lexicons as L


#: The characters that count as white space in any script.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_contents_line(line: Column) -> Column:
    return line.rlike("(?U)" + L.CONTENTS_PATTERN)


def title_level(line: Column) -> Column:
    """Level of a chapter title, null for other lines: short, not a line of contents, not a number alone."""
    s = strip(line)
    level = F.coalesce(*[F.when(s.rlike("(?U)" + p), F.lit(name)) for name, p in L.TITLE_PATTERNS])
    fits = (F.length(s) > 0) & (F.length(s) <= L.TITLE_CHARS) & ~is_contents_line(s) & ~s.rlike(r"(?U)^\d+$")
    return F.when(fits, level)


def split_sentences(text: Column, ends: str = L.SENTENCE_ENDS) -> Column:
    """Sentences with their end marks, trimmed; what follows the last mark is one too. Empty ones are left out."""
    mark = re.escape(ends)
    found = F.regexp_extract_all(text, F.lit(f"[^{mark}]*[{mark}]|[^{mark}]+$"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def tokens(text: Column, stop_words: list[str] | None = None, segment: Callable[[Column], Column] | None = None) -> Column:
    """Lower-case words, longer than one character, that are no stop words: runs of letters and digits, or what
    ``segment`` (a dictionary segmenter as a pandas UDF, say) makes of the lower-case text."""
    low = F.lower(text)
    found = F.filter(segment(low) if segment else F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) > 1)
    return F.filter(found, lambda w: ~w.isin(stop_words)) if stop_words else found


def entity_name(name: Column) -> Column:
    """Trimmed, without honorific suffixes where more than one character is left before them."""
    # The suffixes come off from the right in their order, each at most once: together they are one optional tail.
    tail = "".join(f"(?:{suffix})?" for suffix in reversed(L.NAME_SUFFIXES))
    last = "".join(sorted({suffix[-1] for suffix in L.NAME_SUFFIXES}))
    out = strip(name)
    return F.when(F.right(out, F.lit(1)).isin(*last), strip(F.regexp_replace(out, f"(?s)^(.{{2,}}?){tail}$", "$1"))).otherwise(out)


def entity_type(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in L.ENTITY_TYPES.items() for x in pair]
    known, upper = F.create_map(*pairs), F.upper(strip(kind))
    return F.coalesce(known[upper], known[F.lower(upper)], F.lit("OTHER"))


def is_noise(name: Column) -> Column:
    return (F.length(name) < 2) | name.isin(L.NOISE_NAMES) | name.rlike(r"(?U)^\d+$")


def standard_name(name: Column) -> Column:
    """The standard name of an alias, or the name itself."""
    pairs = [F.lit(x) for standard, names in L.NAME_ALIASES.items() for alias in names for x in (alias, standard)]
    return F.coalesce(F.create_map(*pairs)[name], name)


def truncate_at_sentence(text: Column, limit: Column | int) -> Column:
    """At most ``limit`` characters, cut behind the last sentence end, else behind the last soft end, else hard with
    an ellipsis; trailing white space goes. Texts within the limit stay as they are."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.substr(text, F.lit(1), limit)
    full = F.regexp_extract(head, f"(?s)^(.*[{L.SENTENCE_ENDS}\n])", 1)
    soft = F.regexp_extract(head, f"(?s)^(.*[{L.SOFT_ENDS}])", 1)
    rstrip = lambda c: F.regexp_replace(c, r"(?U)\s+$", "")
    cut = F.when(full != "", rstrip(full)).when(soft != "", rstrip(soft)).otherwise(F.concat(rstrip(head), F.lit("...")))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def lenient_json(raw: Column, schema: str) -> Column:
    """A struct from the first brace to the last, whatever stands around it (code fences, talk); null if none parses."""
    return F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), schema)


def keywords_or(query: Column, keywords: Column) -> Column:
    """Keywords joined by a space, or the query where there are none."""
    return F.coalesce(F.nullif(F.array_join(keywords, " "), F.lit("")), query)


def bullet_list(points: Column, placeholder: str = "-") -> Column:
    kept = F.filter(points, lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(kept) == 0, F.lit(placeholder)).otherwise(F.array_join(F.transform(kept, lambda p: F.concat(F.lit("- "), p)), "\n"))


def chunk_id(book: Column, chapter: Column, chunk: Column) -> Column:
    return F.format_string("%s_ch%03d_%03d", book, chapter, chunk)


def register(spark) -> None:
    """The functions that SQL users can call by name, as SQL functions."""
    pattern = f"[^{L.SENTENCE_ENDS}]*[{L.SENTENCE_ENDS}]|[^{L.SENTENCE_ENDS}]+$"
    each = r"transform(regexp_extract_all(t, '%s', 0), s -> regexp_replace(s, r'(?U)^\s+|\s+$', ''))" % pattern
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ravelin_sentences(t STRING) RETURNS ARRAY<STRING> RETURN filter({each}, s -> s <> '')")
