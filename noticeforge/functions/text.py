"""Text functions as Catalyst expressions; sizes are Unicode code points."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

CHUNK, OVERLAP = 2000, 200
#: Words around a title that say nothing about it (case aside), what stands in for a missing one, and the tags of an
#: answer's two parts.
TITLE_NOISE = r"(?i)(새글|NEW|N|공지|첨부파일|분류|작성자|조회수|등록일)"
UNTITLED = "(제목 없음)"
SHORT_TAG, LONG_TAG = "[핵심 답변]", "[상세 답변]"


def normalize_text(text: Column) -> Column:
    """Lines with inner blanks collapsed and outer ones dropped, blank lines removed; null stays null."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def squash(text: Column) -> Column:
    """Only letters and digits, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


@lru_cache(maxsize=65_536)
def _compacted(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


@arrow_udf(T.StringType())
def compact(texts: pa.Array) -> pa.Array:
    """NFKC, case-folded, only letters and digits; null stays null."""
    return pa.array([t if t is None else _compacted(t) for t in texts.to_pylist()], pa.string())


def norm_key(kind: Column, name: Column) -> Column:
    """The key of an entity: compact type and name."""
    return F.concat(compact(kind), F.lit(":"), compact(name))


def windows(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Windows of `size` at steps of size - overlap; the last one may repeat what is already covered. Empty text: none."""
    step = size - overlap
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")))
    return F.coalesce(F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size))), F.array().cast("array<string>"))


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """The chunks of a text: paragraphs packed up to `size`, each new chunk beginning with the end of the one before.

    A text within `size` is one chunk, an empty one none. A paragraph longer than `size` ends the chunk in hand without
    overlap and is cut into windows. The carried end may take a chunk above `size` by overlap + 2.
    """
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")

    def pack(state: Column, p: Column) -> Column:
        out, cur = state["out"], state["cur"]
        joined = F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p))
        flushed = F.when(cur == "", out).otherwise(F.concat(out, F.array(cur)))
        carried = F.regexp_replace(F.concat(F.right(cur, F.lit(overlap)) if overlap else F.lit(""), F.lit("\n\n"), p), r"^[\s]+|[\s]+$", "")
        return (
            F.when(F.length(p) > size, F.struct(F.concat(flushed, windows(p, size, overlap)).alias("out"), F.lit("").alias("cur")))
            .when(F.length(joined) <= size, F.struct(out.alias("out"), joined.alias("cur")))
            .otherwise(F.struct(flushed.alias("out"), carried.alias("cur")))
        )

    def whole(t: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
        done = lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"])))
        packed = F.aggregate(F.split(t, "\n+"), start, pack, done)
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= size, F.array(t)).otherwise(packed)

    # The normalised text is bound once, as a lambda variable.
    return F.element_at(F.transform(F.array(normalize_text(text)), whole), 1)


def titles_match(listing: Column, title: Column, content: Column) -> Column:
    """Whether a listing's title and a page are of the same notice.

    Squashed and without noise words, the listing's title is empty, stands in the page's title and content, holds the page's
    title (of eight letters or more), or is how that begins (if it has eight letters or more itself).
    """
    x, y = (squash(F.regexp_replace(F.coalesce(t, F.lit("")), TITLE_NOISE, " ")) for t in (listing, title))
    page = squash(F.concat_ws(" ", title, content))
    return (x == "") | F.contains(page, x) | (F.length(y) >= 8) & F.contains(x, y) | (F.length(x) >= 8) & F.startswith(y, x)


def named(title: Column) -> Column:
    """The title, or what stands in for a null or empty one."""
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(UNTITLED))


def citation(title: Column, page: Column) -> Column:
    """`title - N페이지`, or the title alone without a page; a missing title gets a stand-in."""
    return F.when(page.isNotNull(), F.concat(named(title), F.lit(" - "), page.cast("string"), F.lit("페이지"))).otherwise(named(title))


#: White space of any kind.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")


def squeeze(text: Column, limit: int) -> Column:
    """One line with single blanks; of a longer one the first `limit` characters and an ellipsis."""
    line = strip(F.regexp_replace(text, _SPACE, " "))
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit)), F.lit("…"))).otherwise(line)


def error_detail(kind: Column, message: Column, limit: int = 300) -> Column:
    """`Kind: message` with the message on one line, cut to `limit`; the kind alone without a message."""
    line = strip(F.regexp_replace(F.coalesce(message, F.lit("")), r"[\r\n]+", " "))
    return F.when(line == "", kind).otherwise(F.concat(kind, F.lit(": "), F.left(line, F.lit(limit))))


def fill_template(template: Column, groups: Column) -> Column:
    """template with {0}, {1}, ... replaced by the items of groups; null if an item is asked for that is not there."""
    numbers = F.transform(F.regexp_extract_all(template, F.lit(r"\{(\d+)\}"), 1), lambda n: n.cast("int"))
    missing = F.exists(numbers, lambda n: n >= F.size(groups))
    filled = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(groups) - 1, F.lit(0))), template, lambda t, i: F.replace(t, F.concat(F.lit("{"), i.cast("string"), F.lit("}")), F.coalesce(F.get(groups, i), F.lit(""))))
    return F.when(~F.coalesce(missing, F.lit(False)), F.when(F.size(groups) > 0, filled).otherwise(template))


def answer_parts(answer: Column) -> Column:
    """struct(summary, detail): the parts of an answer after their tags; without tags its first line and the rest."""
    text = strip(answer)
    tagged = F.contains(text, F.lit(SHORT_TAG)) & F.contains(text, F.lit(LONG_TAG))
    after = F.substring_index(text, SHORT_TAG, -1)
    short, long = strip(F.substring_index(after, LONG_TAG, 1)), strip(F.substring_index(text, LONG_TAG, -1))
    first = F.substring_index(text, "\n", 1)
    rest = strip(F.substring(text, F.length(first) + 1, F.length(text)))
    return F.when(tagged, F.struct(short.alias("summary"), long.alias("detail"))).otherwise(F.struct(strip(first).alias("summary"), rest.alias("detail")))


def attachment_uri(attachment_id: Column) -> Column:
    """The address under which chunks of an uploaded file are cited."""
    return F.concat(F.lit("attachment://"), attachment_id.cast("string"))


def node_label(entity_id: Column) -> Column:
    """An entity's id as graphs show it; as texts, e_10 sorts before e_2."""
    return F.concat(F.lit("e_"), entity_id.cast("string"))


def byte_size(size: Column) -> Column:
    """A size in bytes for people: B below a kilobyte, else KB or MB with one digit."""
    kb, mb = size / 1024, size / (1024 * 1024)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def prompt(instruction: str, *parts: tuple[str, Column]) -> Column:
    """A model's input: the instruction, then each part under its label, parts that are null or blank left out."""
    blocks = [F.when(strip(c) != "", F.concat(F.lit(f"{label}:\n"), c)) for label, c in parts]
    return F.concat_ws("\n\n", F.lit(instruction), *blocks)
