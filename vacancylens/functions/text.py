"""Text columns: normalising, shingles, n-grams, HTML to text, fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancylens import fixed

# Whitespace as `str.strip` sees it.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0               　"
UNICODE = "(?U)"
UNICODE_NOCASE = "(?iU)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it many times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank(c: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(col(c), F.lit(""))


def filled(c: Column | str) -> Column:
    """The empty string becomes null, so `coalesce` falls through it."""
    return F.nullif(col(c), F.lit(""))


def either(*cs: Column | str) -> Column:
    """First non-empty value, else ''."""
    return F.coalesce(*[filled(c) for c in cs], F.lit(""))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def squeeze(c: Column | str) -> Column:
    """Runs of whitespace to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), UNICODE + r"\s+", " "))


def norm_text(c: Column | str) -> Column:
    """Lower case; everything but a-z, 0-9 and space becomes a space; spaces collapse."""
    kept = F.regexp_replace(F.lower(blank(c)), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def squash(c: Column | str) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]", "")


def slug(c: Column | str, sep: str, default: str = "") -> Column:
    """Lower case, other characters to one separator, separators trimmed, default where nothing is left."""
    dashed = F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", sep)
    return F.coalesce(filled(F.btrim(dashed, F.lit(sep))), F.lit(default))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(blank(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def _windows(items: Column, n: int) -> Column:
    """Consecutive runs of n items as structs with fields '0'..'n-1'; needs at least n items."""
    count = F.size(items) - F.lit(n - 1)
    safe = F.greatest(count, F.lit(0))
    shifted = [F.slice(items, F.lit(i + 1), safe).alias(str(i)) for i in range(n)]
    return F.arrays_zip(*shifted)


def word_shingles(items: Column, n: int = fixed.SHINGLE_WORDS) -> Column:
    """Distinct runs of n words as text; fewer than n words give an empty array."""
    return F.array_distinct(
        F.transform(_windows(items, n), lambda w: F.concat_ws(" ", *[w.getField(str(i)) for i in range(n)]))
    )


def _hash_runs(items: Column, n: int) -> Column:
    """64-bit hashes of all runs of n words. Words are hashed once; a run's hash is made of the hashes of two shorter runs."""
    def joined(a: Column, b: Column, skip: int) -> Column:
        rest = F.greatest(F.size(b) - F.lit(skip), F.lit(0))
        later = F.slice(b, F.lit(skip + 1), rest)
        return F.zip_with(F.slice(a, F.lit(1), rest), later, lambda x, y: F.xxhash64(x, y))

    def runs(singles: Column, n: int) -> Column:
        if n == 1:
            return singles
        half = n // 2
        if n % 2:
            return joined(runs(singles, n - 1), singles, n - 1)
        return let(runs(singles, half), lambda h: joined(h, h, half))

    return let(F.transform(items, lambda w: F.xxhash64(w)), lambda singles: runs(singles, n))


def shingle_hashes(items: Column, n: int = fixed.SHINGLE_WORDS) -> Column:
    """Distinct 64-bit hashes of the runs of n words."""
    return F.array_distinct(_hash_runs(items, n))


def char_ngrams(c: Column | str, n: int = fixed.CLUSTER_NGRAM, floor: int = fixed.CLUSTER_MIN_CHARS) -> Column:
    """Distinct n-grams of the squashed value; values shorter than the floor give an empty array."""
    need = max(n, floor)

    def grams(s: Column) -> Column:
        last = F.greatest(F.length(s) - F.lit(n - 1), F.lit(1))
        return F.when(
            F.length(s) >= need,
            F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(s, i, F.lit(n)))),
        ).otherwise(F.array().cast("array<string>"))

    return let(squash(c), grams)


def any_contains(c: Column, terms: Sequence[str]) -> Column:
    """Does the text contain any of a fixed list of terms? Stays inside code generation."""
    test = F.lit(False)
    for term in terms:
        test = test | c.contains(term)
    return test


def first_contained(c: Column, terms: Sequence[str]) -> Column:
    """The first term of the list that the text contains, else null."""
    return F.coalesce(*[F.when(c.contains(t), F.lit(t)) for t in terms])


def whole_word(pattern: str) -> str:
    return UNICODE_NOCASE + pattern


# The entities that most landed texts hold; texts with others are decoded reference by reference.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
             ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"))


_CODED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
_OPEN_NAMES = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
_UNCLOSED = f"^({_OPEN_NAMES})"
# Something that can be a reference, and is none of the common ones: `&page=2` of a link is not.
_OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e, _ in _ENTITIES) + f");)(?:#[0-9xX]|[A-Za-z][A-Za-z0-9]*;|{_OPEN_NAMES})"
_C1 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]


def _numbered(code: Column) -> Column:
    """The character of a numeric reference: code points that are none give U+FFFD, 128 to 159 mean Windows-1252."""
    dropped = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (
        code.bitwiseAND(F.lit(0xFFFE).cast("bigint")) == 0xFFFE)
    return (F.when((code <= 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("�"))
            .when(code.between(0x80, 0x9F), F.try_element_at(F.array(*map(F.lit, _C1)), (code - 0x7F).cast("int")))
            .when(dropped, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def _named() -> Column:
    """The names in one map per first letter, from `A` on: a map is searched from its start, so short ones are found faster."""
    def letter(code: int) -> Column:
        pairs = "\x01".join(f"{k}\x02{v}" for k, v in _CODED.items() if k.startswith(chr(code)))
        return F.str_to_map(F.lit(pairs or "\x02"), F.lit("\x01"), F.lit("\x02"))

    return F.array(*[letter(code) for code in range(ord("A"), ord("z") + 1)])


def _after_ampersand(p: Column, coded: Column) -> Column:
    """A piece of text that followed an ampersand, with the reference that it begins with, if any, decoded by the map of names."""
    digits, hexed = F.regexp_extract(p, "^#0*([0-9]*)", 1), F.regexp_extract(p, "^#[xX]0*([0-9a-fA-F]*)", 1)
    code = F.when(p.rlike("^#[0-9]"), F.when(F.length(digits) > 8, F.lit(-1)).otherwise(F.concat(F.lit("0"), digits).try_cast("bigint"))).otherwise(
        F.when(F.length(hexed) > 8, F.lit(-1)).otherwise(F.conv(F.concat(F.lit("0"), hexed), 16, 10).try_cast("bigint")))
    closed, unclosed = F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]*);", 1), F.regexp_extract(p, _UNCLOSED, 1)

    def value(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(coded, F.ascii(name) - ord("A") + 1), name)

    return (F.when(p.rlike("^#([0-9]|[xX][0-9a-fA-F])"), F.concat(
                _numbered(code.cast("bigint")), F.regexp_replace(p, "^#([0-9]+|[xX][0-9a-fA-F]+);?", "")))
            .when((closed != "") & value(closed).isNotNull(), F.concat(value(closed), F.substr(p, F.length(closed) + 2)))
            .when(unclosed != "", F.concat(value(unclosed), F.substr(p, F.length(unclosed) + 1)))
            .otherwise(F.concat(F.lit("&"), p)))


def unescape(c: Column | str) -> Column:
    """Entities decoded once each: named, decimal and hexadecimal, as HTML5 names them.

    Texts that hold no others than the common ones take plain replacements, the rest is decoded reference by reference.
    """
    def decoded(x: Column) -> Column:
        common = x
        for entity, char in _ENTITIES:
            common = F.replace(common, F.lit(entity), F.lit(char))
        pieces = F.split(x, "&")
        later = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        each = let(_named(), lambda coded: F.array_join(F.transform(later, lambda p: _after_ampersand(p, coded)), ""))
        return (F.when(~x.contains("&"), x)
                .when(x.rlike(_OTHER_ENTITY), F.concat(F.try_element_at(pieces, F.lit(1)), each)).otherwise(common))

    return let(col(c), decoded)


def strip_tags(c: Column | str, limit: int | None = None) -> Column:
    """Tags to spaces, entities decoded, ends trimmed. `limit` cuts the result where a format needs it."""
    text = strip(unescape(F.regexp_replace(blank(c), "<[^>]+>", " ")))
    return text if limit is None else F.substring(text, 1, limit)


def html_to_text(c: Column | str) -> Column:
    """Visible text: scripts and styles dropped, tags end lines, lines trimmed, blank runs collapsed."""
    visible = F.regexp_replace(blank(c), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "")
    lines = F.regexp_replace(visible, "<[^>]+>", "\n")
    trimmed = F.array_join(F.transform(F.split(unescape(lines), r"\r\n|[\n\r]"), strip), "\n")
    return strip(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"))


def fingerprint(c: Column | str) -> Column:
    """First 12 hex digits of SHA-256 over the whitespace-collapsed text; blank stays blank."""
    flat = squeeze(blank(c))
    return F.when(flat == "", F.lit("")).otherwise(F.substring(F.sha2(flat, 256), 1, 12))


def replace_all(c: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    out = col(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def present_terms(c: Column | str, terms: Sequence[str]) -> Column:
    """Those of the fixed terms that occur in the text, in list order."""
    found = F.array(*[F.when(col(c).contains(t), F.lit(t)) for t in terms])
    return F.array_compact(found)


def thousands(c: Column | str) -> Column:
    """Whole number with comma groups, halves to even."""
    return F.format_number(F.bround(col(c).cast("double"), 0).cast("bigint"), 0)
